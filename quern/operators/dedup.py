"""Duplicates: exact, normalised, by MinHash bands, by shape of code, by line and by vector."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.functions import text as X

PRIME = 2147483647


def keep_first(df: DataFrame, key: Column, row_id: str = "doc_id") -> DataFrame:
    """The smallest id of each key and its number of rows; only ids and keys are shuffled, pre-aggregated."""
    return df.groupBy(key.alias("_key")).agg(F.min(row_id).alias(row_id), F.count("*").alias("copies")).drop("_key")


def shingle_rows(df: DataFrame, n: int = 5, row_id: str = "doc_id") -> DataFrame:
    """(id, h): the different n-word shingles of each text as 28-bit hashes."""
    w = df.select(row_id, F.explode(F.array(F.split(X.norm_key(F.col("text")), " "))).alias("w"))
    grams = w.select(row_id, F.explode(F.array_distinct(X.shingles(F.col("w"), n))).alias("g"))
    return grams.select(row_id, F.conv(F.substring("g", 1, 7), 16, 10).cast("long").alias("h")).distinct()


def min_hashes(rows: DataFrame, k: int = 16, row_id: str = "doc_id") -> DataFrame:
    """(id, m0 .. mk-1): the least value of k linear hash functions over a text's shingles."""
    value = lambda i: F.min(((2654435 * (i + 1) + 1) * F.col("h") + 40503 * i) % PRIME).alias(f"m{i}")
    return rows.groupBy(row_id).agg(*[value(i) for i in range(k)])


def lsh_pairs(hashes: DataFrame, k: int = 16, bands: int = 8, row_id: str = "doc_id") -> DataFrame:
    """(a, b) with a < b of rows that agree in a band of hash values: with 8 bands of 2, 0.90 of the pairs at a similarity of 0.5 and all but 3 in 10,000 at 0.8."""
    r = k // bands
    keys = F.array(*[F.struct(F.lit(b).alias("band"), F.concat_ws(",", *[F.col(f"m{i}").cast("string") for i in range(b * r, b * r + r)]).alias("key")) for b in range(bands)])
    banded = hashes.select(F.col(row_id).alias("id"), F.explode(keys).alias("x")).select("id", "x.band", "x.key")
    other = banded.select(F.col("id").alias("b"), "band", "key")
    return banded.withColumnRenamed("id", "a").join(other, ["band", "key"]).where("a < b").select("a", "b").distinct()


#: Ids of a candidate group that are compared in one block, and rows that one call compares.
BLOCK, ROWS_PER_BUCKET = 1024, 4096
#: Different shingles that a block's matrices hold at once.
COLUMNS = 4096


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """The sorted different hashes of ``shingle_rows`` of a normalised text."""
    w = (text or "").encode().split(b" ")
    grams = map(b" ".join, zip(*(w[i:] for i in range(n)), strict=False))
    return np.unique(np.frombuffer(b"".join([hashlib.md5(g).digest()[:4] for g in grams]), ">u4").astype(np.int64) >> 4)


def signature(h: np.ndarray, k: int = 16) -> np.ndarray:
    """The values of ``min_hashes`` of a set."""
    return np.array([(((2654435 * (i + 1) + 1) * h + 40503 * i) % PRIME).min() for i in range(k)], np.int64)


def _signed(batches):
    for b in batches:
        ids, found = [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            h = shingle_set(t)
            if len(h):
                ids.append(i)
                found.append(signature(h))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([int(m[k]) for m in found], pa.int64()) for k in range(16))], names=["id", *(f"m{k}" for k in range(16))])


def _sets(batches):
    for b in batches:
        found = [shingle_set(t).astype("<u4").tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("block"), b.column("cells"), pa.array(found, pa.binary())], names=["id", "block", "cells", "hashes"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections."""
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, column = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), (np.cumsum(often > 1) - 1)[code]
    row, column = row[often[code] > 1], column[often[code] > 1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        i, j = np.searchsorted(column, [at, at + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[row[i:j], column[i:j] - at] = 1
        out += held @ held.T
    return out


def _compared(least: float, bands: int = 8):
    """The candidates among a bucket's cells whose similarity is about least or more; a pair belongs to the cell of its two blocks."""

    def run(table):
        root, i, j, ids, blocks = (table.column(c).to_numpy() for c in ("root", "i", "j", "id", "block"))
        hashes = table.column("hashes").to_pylist()
        order = np.lexsort((ids, j, i, root))
        new = np.nonzero(np.concatenate([[True], np.any([np.diff(x[order]) != 0 for x in (root, i, j)], axis=0)]))[0]
        out = [[], [], [], [], []]
        for at, to in zip(new, [*new[1:], len(order)], strict=True):
            own: dict[int, np.ndarray] = {}
            where = {}
            for k in order[at:to]:
                h = np.frombuffer(hashes[k], "<u4").astype(np.int64)
                own[ids[k]] = np.union1d(own[ids[k]], h) if ids[k] in own else h  # rows that share an id are one set
                where[ids[k]] = blocks[k]
            own = {k: h for k, h in own.items() if len(h)}
            if len(own) < 2:
                continue
            node, sets, block = np.array(list(own)), list(own.values()), np.array([where[k] for k in own])
            sig = np.stack([signature(h) for h in sets])
            met = np.zeros((len(node), len(node)), bool)
            for r in range(bands):
                x, y = sig[:, 2 * r], sig[:, 2 * r + 1]
                met |= (x[:, None] == x) & (y[:, None] == y)
            met &= node[:, None] < node
            first, last = i[order[at]], j[order[at]]
            met &= (np.minimum(block[:, None], block) == first) & (np.maximum(block[:, None], block) == last)
            a, b = np.nonzero(met)
            n = np.array([len(h) for h in sets])
            if len(a) > 4 * len(node):
                both = overlaps(sets)[a, b].astype(np.int64)
            else:
                both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
            ok = both >= (least - 1e-6) * (n[a] + n[b] - both)
            for k, x in enumerate((node[a], node[b], both, n[a], n[b])):
                out[k].append(x[ok].astype(np.int64))
        return pa.table({c: pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for c, x in zip(("a", "b", "o", "na", "nb"), out, strict=True)})

    return run


def similar_classes(df: DataFrame, least: float, bands: int = 8, row_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(a, b, jaccard) with a < b of classes of equal texts that agree in a band, and (id, cls) of all ids that have shingles; a class has its smallest id.

    What agrees in bands hangs together in groups, by stars, so no pairs are
    made of copies or of bands.  Each text's set is made where it is sent: once
    for each pair of blocks of its group in which it has a candidate, one if the
    group has no more than BLOCK ids.  Ids that repeat have the shingles of all
    their texts; null ids and texts of fewer than five words are in no pair.
    """
    _checkpoint_dir(df)
    texts = df.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("id"), "text")
    keyed = texts.select("id", F.md5(F.coalesce("text", F.lit(""))).alias("k")).groupBy("id").agg(F.md5(F.concat_ws(",", F.array_sort(F.collect_set("k")))).alias("k")).checkpoint()
    named = keyed.groupBy("k").agg(F.min("id").alias("cls"))
    classes = keyed.join(named.hint("merge"), "k").select("id", "cls").checkpoint()
    normal = texts.select("id", X.norm_key(F.col("text")).alias("text"))
    m = [f"m{k}" for k in range(16)]
    signed = normal.mapInArrow(_signed, "id long, " + ", ".join(f"{c} long" for c in m)).groupBy("id").agg(*[F.min(c).alias(c) for c in m])
    keys = F.array(*[F.struct(F.lit(k).alias("band"), (F.col(m[2 * k]) * (PRIME + 1) + F.col(m[2 * k + 1])).alias("key")) for k in range(bands)])
    banded = signed.join(classes.where("id = cls").select("id").hint("merge"), "id").select("id", F.explode(keys).alias("x")).select("id", "x.band", "x.key").checkpoint()
    many = banded.groupBy("band", "key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo != hi").select("band", "key", "lo")
    met = banded.join(many.hint("merge"), ["band", "key"]).checkpoint()
    roots = clusters(met.where("lo != id").select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct())
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).cast("int")
    blocks = roots.join(sizes.hint("merge"), "root").select(F.col("node").alias("id"), "root", block.alias("block")).checkpoint()
    placed = met.join(blocks.hint("merge"), "id").select("id", "band", "key", "root", "block")
    beside = placed.groupBy("band", "key").agg(F.collect_set("block").alias("near"))
    asked = placed.join(beside.hint("merge"), ["band", "key"]).select("id", "root", "block", F.explode("near").alias("other")).distinct()
    cell = F.struct("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    cells = asked.groupBy("id").agg(F.first("block").alias("block"), F.collect_list(cell).alias("cells")).checkpoint()
    n = max(1, -(-(cells.agg(F.sum(F.size("cells"))).first()[0] or 0) // ROWS_PER_BUCKET))
    sent = texts.join(cells.hint("merge"), "id").select("id", "block", "cells", X.norm_key(F.col("text")).alias("text"))
    made = sent.mapInArrow(_sets, "id long, block int, cells array<struct<root:long,i:int,j:int>>, hashes binary")
    spread = made.select("id", "block", F.explode("cells").alias("c"), "hashes").select("id", "block", "c.root", "c.i", "c.j", "hashes").withColumn("bucket", F.pmod(F.xxhash64("root", "i", "j"), F.lit(n)))
    pairs = spread.groupBy("bucket").applyInArrow(_compared(least, bands), "a long, b long, o long, na long, nb long")
    return pairs.select("a", "b", F.round(F.col("o") / (F.col("na") + F.col("nb") - F.col("o")), 9).alias("jaccard")).where(F.col("jaccard") >= least), classes.join(banded.where("band = 0").select(F.col("id").alias("cls")).hint("merge"), "cls")


def similar_ids(df: DataFrame, least: float, row_id: str = "doc_id") -> DataFrame:
    """(a, b, jaccard) with a < b of all ids, copies of equal texts included, that agree in a band and have the similarity."""
    pairs, classes = similar_classes(df, least, row_id=row_id)
    own = classes.join(classes.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls").hint("merge"), "cls")
    twins = own.join(own.select("cls", F.col("id").alias("b")).hint("merge"), "cls").where("id < b").select(F.col("id").alias("a"), "b", F.lit(1.0).alias("jaccard"))
    side = lambda c, o: classes.select(F.col("cls").alias(c), F.col("id").alias(o))
    spread = pairs.join(side("a", "x").hint("merge"), "a").join(side("b", "y").hint("merge"), "b")
    return spread.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard").unionByName(twins)


def similar_clusters(df: DataFrame, least: float, row_id: str = "doc_id") -> DataFrame:
    """(node, root) of the groups that ids form by such pairs; ids without any are left out.  Copies hang on their class."""
    pairs, classes = similar_classes(df, least, row_id=row_id)
    copies = classes.where("id != cls").select(F.col("cls").alias("a"), F.col("id").alias("b"))
    return clusters(pairs.select("a", "b").unionByName(copies))


def clusters(pairs: DataFrame) -> DataFrame:
    """(node, root) of the pairs' connected groups by spreading smallest ids; each round is checkpointed."""
    _checkpoint_dir(pairs)
    edges = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"))).checkpoint()
    labels = edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")).checkpoint()
    while True:
        near = edges.join(labels.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = labels.join(near, "node").join(jump, "root", "left").select("node", "root", F.least("root", "near", F.coalesce("up", "root")).alias("new")).checkpoint()
        labels = new.select("node", F.col("new").alias("root"))
        if not new.where("new != root").limit(1).count():
            return labels


def _checkpoint_dir(df: DataFrame) -> None:
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quern-checkpoint-"))


def shape_of(c: Column) -> Column:
    """Code with its identifiers made equal and its spaces removed."""
    kept = F.regexp_replace(c, r"\b(def|return|print)\b", "@$1@")
    return F.regexp_replace(F.regexp_replace(kept, r"(^|[^@A-Za-z_])[A-Za-z_]\w*", "$1ID"), r"\s+", "")


def same_shape(df: DataFrame) -> DataFrame:
    s = df.select("id", shape_of(F.col("code")).alias("s"))
    return s.withColumnRenamed("id", "a").join(s.withColumnRenamed("id", "b"), "s").where("a < b").select("a", "b")


def first_lines(df: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """Each text with the lines that occur for the first time, by id and line number; texts without any are left out."""
    lines = df.select(row_id, F.posexplode(F.split("text", "\n")).alias("i", "line"))
    first = lines.groupBy(F.md5("line").alias("h")).agg(F.min(F.struct(row_id, "i", "line")).alias("x")).select("x.*")
    return first.groupBy(row_id).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), "\n").alias("text"), F.count("*").alias("n_lines"))


#: Queries that are compared with all vectors at once.
QUERY_BLOCK = 2_000


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(vec_id, near_id, rank): the k nearest of all vectors to each of the queries, by dot product of unit vectors.

    Queries are counted and broadcast in blocks of about so many rows, whatever
    their number; each block streams past all vectors, and only each task's k
    best of a query are shuffled.
    """
    n = max(1, -(-queries.count() // block))
    dot = F.aggregate(F.zip_with("e", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "vec_id"))
    out = None
    for i in range(n):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == i).select(F.col("vec_id").alias("q"), F.col("embedding").alias("e"))
        scored = vectors.crossJoin(F.broadcast(own)).where("vec_id != q").select("q", "vec_id", F.round(dot, 7).alias("s"))
        near = scored.select(F.col("q").alias("vec_id"), F.col("vec_id").alias("near_id"), rank.alias("rank")).where(f"rank <= {k}")
        out = near if out is None else out.unionByName(near)
    return out

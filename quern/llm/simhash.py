"""SimHash near-duplicates: segment-popcount embedding and a grid range join.

A 64-bit fingerprint is cut into 16 segments of 4 bits; the vector of their
bit counts is a point of a grid, and two fingerprints that differ in k bits lie
at most k apart under the Manhattan distance.  Two points are within 2 exactly
when some cell lies within 1 of both, so every point is put into its own cell
and the cells one step away (33 at most) and points meet by equality of cells.

Cells with a single fingerprint end there.  The rest are verified exactly: in a
cell, a fingerprint meets the 64-bit words that lie in the cell and differ from
it in at most one bit.  Fingerprints that share such a word differ in at most
two bits, and all that differ in at most two bits share one, so a word's
fingerprints (65 at most, whatever the data) are linked in a star.  No pairs are
ever listed: the work per fingerprint is bounded, however large a group is.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE, Scratch, broadcast_if, drop_shuffles, fresh, materialise, slices
from .components import connected_components

SEGMENTS, WIDTH = 16, 4
BLOCK = 1 << 15


def fingerprint_of(text: bytes, shingle: int, seed: int = 42) -> int:
    """The fingerprint of one text: the majority, over half, of each bit of the XXH64 of its word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    ones, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        h = np.array([xxhash.xxh64_intdigest(g, seed) for g in grams], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42) -> DataFrame:
    """(id, fp) for every row; fp is the fingerprint's 64 bits as a signed long.

    Words are what ``[^\\x20\\x09-\\x0D]+`` matches after A-Z are lower-cased; a
    shorter text is one shingle; null, empty and blank texts have fingerprint 0.
    """

    def run(batches):
        for b in slices(batches):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint_of(t or b"", shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    two = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(run, "id long, fp long")


def _cells() -> Column:
    """The cells within one step of fp: (cell, step), step 0 for the own cell, i + 1 or -(i + 1) for one bit more or less in segment i.

    A cell packs the 16 counts into 4 bits each; they are added up within the word.
    """
    ones = "1229782938247303441L"  # the lowest bit of each segment
    counts = " + ".join(f"(shiftrightunsigned(fp, {i}) & {ones})" for i in range(WIDTH))
    near = f"""CASE WHEN s = 0 THEN own
        WHEN s > 0 AND (shiftrightunsigned(own, {WIDTH} * (s - 1)) & 15L) < {WIDTH} THEN own + shiftleft(1L, {WIDTH} * (s - 1))
        WHEN s < 0 AND (shiftrightunsigned(own, {WIDTH} * (-s - 1)) & 15L) > 0 THEN own - shiftleft(1L, {WIDTH} * (-s - 1)) END"""
    return F.expr(f"""filter(flatten(transform(array({counts}), own ->
        transform(sequence(-{SEGMENTS}, {SEGMENTS}), s -> named_struct('cell', {near}, 'step', s)))), x -> x.cell IS NOT NULL)""")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) star edges between the fingerprints of column fp that differ in one or two bits; their components are those of all such pairs."""
    in_cells = distinct.select("fp", F.explode(_cells()).alias("c")).select("fp", "c.cell", "c.step")
    shared = in_cells.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo != hi").select("cell")
    found = in_cells.join(shared.hint("merge"), "cell")
    at = "4 * (abs(step) - 1) + j"
    words = F.expr(f"""CASE WHEN step = 0 THEN array(fp) ELSE
        transform(filter(sequence(0, 3), j -> (shiftrightunsigned(fp, {at}) & 1L) = IF(step > 0, 0L, 1L)), j -> fp ^ shiftleft(1L, {at})) END""")
    met = found.select("fp", F.explode(words).alias("word")).groupBy("word").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    return met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a != b").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42) -> DataFrame:
    """(id, fp, component_id) for every row: the smallest id among the rows reachable over links of at most two differing bits.

    Rows with the same fingerprint are linked.  Null ids have a row like any
    other but never name a component unless all of its ids are null; repeated
    rows each have one; an empty table gives no rows.  Other columns are ignored.
    Joins are by sorted runs, never by a table that the driver collects.
    """
    prints = materialise(fingerprints(df, id_col, text_col, shingle, seed), "prints")
    classes = materialise(prints.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    roots = connected_components(links(classes.select("fp")), "a", "b").select(F.col("node").alias("fp"), "root")
    grouped = classes.join(roots.hint("merge"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = grouped.join(named.hint("merge"), "root").select("fp", "component_id")
    return prints.join(labels.hint("merge"), "fp").select("id", "fp", "component_id")


#: Classes whose shingles are to be compared, and rows that stay, are broadcast up to so many.
BROADCAST_ROWS = 1_000_000
#: Wide fingerprints of a set's shingles have 128 bits; smaller sets than this have none that means anything.
LEAST_SET = 64
#: Shingles in more than this share of a task's texts, and in so many at least, go last in the order of prefixes.
COMMON_SHARE, COMMON_LEAST, COMMON_MOST = 0.002, 8, 1 << 18


class _Words(dict):
    """The hashes of the words met so far."""

    def __init__(self, seed: int):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed)
        return h


_KNOWN: dict[int, _Words] = {}


def shingle_set(text: bytes, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted different 64-bit hashes of a text's word shingles; a shorter text is one shingle, a text without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    known = _KNOWN.setdefault(seed, _Words(seed))
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(known) > 1 << 18:
        known.clear()
    k = min(shingle, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : len(w) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def ratio_of(similarity: float) -> tuple[int, int]:
    """The similarity as a fraction, so that no pair at the bound is decided by rounding."""
    f = Fraction(str(similarity))
    return f.numerator, f.denominator


def prefix(hashes: np.ndarray, common: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first shingles in the order (common or not, hash), so many that any two sets of the similarity share one of theirs."""
    n = len(hashes)
    if not n:
        return hashes
    last = np.isin(hashes, common, assume_unique=True) if len(common) else np.zeros(n, bool)
    return np.concatenate([hashes[~last], hashes[last]])[: n - -(-num * n // den) + 1]


def wide_fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 SimHash bits of a set of hashes, as two signed longs."""
    h = hashes.view(np.uint64)
    both = np.stack([h, (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)], 1)
    ones = np.unpackbits(np.ascontiguousarray(both).view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return tuple(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64).tolist())


#: Rounds in which each set that isn't connected yet meets one drawn at random: where links are dense, a round leaves a fraction of the components.
DRAWS = 1
#: 64-bit words of a parity sketch.
SKETCH = 16
#: A pair is made at a shingle only if the sets share none of the so many before it in their prefixes.
BEFORE = 8


def parity(hashes: np.ndarray) -> np.ndarray:
    """64 * SKETCH bits, each the parity of the hashes that fall on it: two sketches differ in no more bits than their sets in members."""
    at = (hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    odd = np.bincount((at % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_bits(similarity: float) -> int:
    """The bits in which the wide fingerprints of sets of this similarity may differ: the expected number and five and a half standard errors."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(128 * share + 5.5 * np.sqrt(128 * share * (1 - share)))


def _may_link(x: str, y: str, num: int, den: int, bits: int) -> Column:
    """Whether sizes and wide fingerprints of two structs (cls, n, f0, f1) allow the similarity."""
    return F.expr(f"""{x}.cls != {y}.cls AND least({x}.n, {y}.n) * {den} >= greatest({x}.n, {y}.n) * {num}
        AND (least({x}.n, {y}.n) < {LEAST_SET} OR bit_count({x}.f0 ^ {y}.f0) + bit_count({x}.f1 ^ {y}.f1) <= {bits})""")


def _class_of(text: str) -> Column:
    """The class of equal texts: their hash, and one class for null, empty and blank ones."""
    bare = F.btrim(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.lit(0).cast("long")).otherwise(F.xxhash64(F.col(text).cast("string")))


def _common(texts: DataFrame, shingle: int) -> np.ndarray:
    """The shingles that many texts hold, so many at most as a driver easily has.  They only order the prefixes; nothing is left out by them."""

    def counted(batches):
        total, held, n = [], 0, 0

        def counts():
            h, c = np.unique(np.concatenate(total), return_counts=True)
            often = c >= max(COMMON_LEAST, COMMON_SHARE * n)
            return pa.RecordBatch.from_arrays([pa.array(h[often]), pa.array(c[often])], names=["hash", "n"])

        for b in slices(batches):
            for t in dict.fromkeys(b.column(0).cast(pa.binary()).to_pylist()):
                total.append(shingle_set(t or b"", shingle))
                held, n = held + len(total[-1]), n + 1
                if held > 1 << 22:
                    yield counts()
                    total, held, n = [], 0, 0
        if total:
            yield counts()
        _KNOWN.clear()

    found = texts.select("text").mapInArrow(counted, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r.hash for r in found.orderBy(F.desc("n"), "hash").limit(COMMON_MOST).select("hash").collect()], np.int64))


def _exact(num: int, den: int):
    def run(batches):
        for b in batches:
            ok = []
            for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(p, np.int64), np.frombuffer(q, np.int64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both * den >= (len(p) + len(q) - both) * num)
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    return run


def grid_pairs(texts: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """(a, b), a < b, of classes (cls, text) whose fingerprints are equal or linked by the grid; those of one fingerprint meet its smallest class."""
    prints = scratch.table(fingerprints(texts, "cls", "text", shingle).distinct(), "prints")
    firsts = scratch.table(prints.groupBy("fp").agg(F.min("id").alias("first")), "firsts")
    end = lambda n: firsts.select(F.col("fp").alias(n), F.col("first").alias(f"first_{n}"))
    linked = links(firsts.select("fp")).join(end("a").hint("merge"), "a").join(end("b").hint("merge"), "b").select(F.col("first_a").alias("x"), F.col("first_b").alias("y"))
    equal = prints.join(firsts.hint("merge"), "fp").where("id != first").select(F.col("first").alias("x"), F.col("id").alias("y"))
    return scratch.table(linked.unionByName(equal).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near")


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, cls, component_id, root) for every row: the smallest id among the rows reachable over pairs of the given similarity of shingles or more.

    The similarity is the exact Jaccard index of the sets of 64-bit shingle
    hashes.  The operator's fingerprints meet first, in the cells of its grid,
    and those within two bits are linked if their sets have the similarity.
    At 0.8 fingerprints differ in ten bits or so, which no grid of one step
    holds, so what the grid has left apart, and that alone, is compared by
    prefixes.  Two sets of the similarity share a shingle of theirs, whatever
    the order is, so every such pair meets: common shingles come last, the others
    in the order of their hashes.  Those that meet are told apart by their sizes
    and wide fingerprints, and what is left by the sets themselves.  Where sets
    share a shingle of their prefixes, all meet the first and the last one and
    each is compared with one of those it may resemble, then, DRAWS times, each
    meets one drawn at random; in what isn't connected after that all pairs of
    different components meet, told apart by parity sketches, too, before any is
    made.  There a pair is made at the first shingle that both prefixes hold, and
    not at a later one that follows a shared one closely: all prefixes have one
    order, so the first is never left out.  Rows of equal texts are one class;
    root names the component.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    num, den = ratio_of(similarity)
    bits = most_bits(similarity)
    texts = df.select(_class_of(text_col).alias("cls"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.select("id", "cls")
    common = spark.sparkContext.broadcast(_common(texts, shingle))

    def keys(batches):
        for b in slices(batches):
            held, of, facts, seen = [], [], [], set()
            for c, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if c in seen:
                    continue
                seen.add(c)
                hashes = shingle_set(t or b"", shingle)
                if len(hashes):
                    held.append(prefix(hashes, common.value, num, den))
                    of.append(len(held[-1]))
                    facts.append((c, len(hashes), *wide_fingerprint(hashes)))
            if held:
                each = np.repeat(np.array(facts, np.int64), of, axis=0)
                at = np.concatenate([np.arange(n, dtype=np.int32) for n in of])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(at), *(pa.array(np.ascontiguousarray(each[:, k])) for k in range(4))], names=["key", "at", "cls", "n", "f0", "f1"])
        _KNOWN.clear()

    def sets_of(batches):
        for b in slices(batches):
            found = [shingle_set(t or b"", shingle).tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["cls", "hashes"])
        _KNOWN.clear()

    def lists(arrays):
        ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))

    def parities(batches):
        for b in slices(batches):
            found = [shingle_set(t or b"", shingle) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), lists([parity(h) for h in found]), lists([prefix(h, common.value, num, den) for h in found])], names=["cls", "parity", "prefix"])
        _KNOWN.clear()

    def of_classes(asked: DataFrame) -> DataFrame:
        return texts.join(broadcast_if(asked, asked.count(), BROADCAST_ROWS), "cls", "left_semi").select("cls", "text")

    own = F.struct("cls", "n", "f0", "f1")
    of_key = Window.partitionBy("key")
    emitted = texts.select("cls", "text").mapInArrow(keys, "key long, at int, cls long, n long, f0 long, f1 long").select("key", "at", own.alias("own"))
    ends = emitted.withColumns({"lo": F.min("own").over(of_key), "hi": F.max("own").over(of_key)}).where("lo.cls != hi.cls")
    members = scratch.table(ends, "members")
    drop_shuffles(spark)

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("own.cls", "end.cls").alias("a"), F.greatest("own.cls", "end.cls").alias("b")).distinct()

    def apart_only(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """The pairs whose ends aren't in one component yet."""
        for end in ("a", "b"):
            pairs = pairs.join(roots.select(F.col("cls").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
        return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")

    def starred(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")

    def link(pairs: DataFrame, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The edges among the pairs, those of before added, and the components' roots."""
        own_scratch = Scratch(spark)
        pairs = own_scratch.table(pairs, "pairs")
        drop_shuffles(spark)
        asked = own_scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "asked")
        sets = own_scratch.table(of_classes(asked).mapInArrow(sets_of, "cls long, hashes binary").dropDuplicates(["cls"]), "sets")
        side = lambda n: sets.select(F.col("cls").alias(n), F.col("hashes").alias(f"hashes_{n}"))
        new = side("a").join(broadcast_if(pairs, pairs.count(), BROADCAST_ROWS), "a").join(side("b"), "b").select("a", "b", "hashes_a", "hashes_b").mapInArrow(_exact(num, den), "a long, b long")
        edges = scratch.table(new if before is None else before.unionByName(new), "edges")
        own_scratch.clear()
        drop_shuffles(spark)
        roots = connected_components(edges, "a", "b").select(F.col("node").alias("cls"), "root")
        return edges, scratch.table(roots, "roots")

    def open_members(roots: DataFrame) -> DataFrame:
        """The members of the keys that still hold several components, each once."""
        named = members.select("key", "at", "own", F.col("own.cls").alias("cls")).join(roots, "cls", "left").select("key", "at", "own", F.coalesce("root", "cls").alias("root"))
        ranged = named.withColumns({"x": F.min("root").over(of_key), "y": F.max("root").over(of_key)}).where("x != y")
        found = scratch.table(ranged.select("key", "at", "own", "root").distinct(), "open")
        drop_shuffles(spark)
        return found

    edges, roots = link(grid_pairs(texts, shingle, scratch))
    may = _may_link("own", "end", num, den, bits)
    met = ordered(members.select("own", F.explode(F.array("lo", "hi")).alias("end")).where(may))
    edges, roots = link(starred(apart_only(met, roots)), edges)
    left = open_members(roots)
    if not left.isEmpty():
        asked = scratch.table(left.select(F.col("own.cls").alias("cls")).distinct(), "open-classes")
        sketches = scratch.table(of_classes(asked).mapInArrow(parities, "cls long, parity array<long>, prefix array<long>").dropDuplicates(["cls"]), "parities")
        apart = "aggregate(zip_with(parity, far, (x, y) -> bit_count(x ^ y)), 0, (a, x) -> a + x)"
        close = F.expr(f"{apart} * {den + num} <= (own.n + end.n) * {den - num}")
        before = F.expr(f"slice(prefix, greatest(1, at + 1 - {BEFORE}), least(at, {BEFORE}))")

        def sketched(rows: DataFrame) -> DataFrame:
            found = scratch.table(rows.withColumn("cls", F.col("own.cls")).join(sketches, "cls").select("key", "own", "root", "parity", before.alias("before")), "sketched")
            drop_shuffles(spark)
            return found

        for turn in range(DRAWS):
            now = sketched(left)
            drawn = now.groupBy("key").agg(F.max(F.struct(F.xxhash64("own.cls", F.lit(turn)).alias("h"), F.col("own").alias("end"), F.col("root").alias("other"), F.col("parity").alias("far"))).alias("x"))
            met = now.join(drawn.select("key", "x.*"), "key").where(may & F.expr("root != other") & close)
            best = met.groupBy("own.cls").agg(F.max(F.struct("h", "own", "end")).alias("x")).select("x.own", "x.end")
            edges, roots = link(ordered(best), edges)
            left = open_members(roots)
        now = sketched(left)
        other = now.select("key", F.col("own").alias("end"), F.col("root").alias("other"), F.col("parity").alias("far"), F.col("before").alias("passed"))
        first = ~F.arrays_overlap("before", "passed")
        _, roots = link(ordered(now.join(other, "key").where((F.col("root") < F.col("other")) & may & first & close)), edges)

    classes = rows.groupBy("cls").agg(F.min("id").alias("first"))
    grouped = classes.join(roots, "cls", "left").select("cls", "first", F.coalesce("root", "cls").alias("root"))
    named = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = materialise(grouped.join(named, "root").select("cls", "root", "component_id"), "labels")
    scratch.clear()
    return rows.join(labels, "cls").select("id", "cls", "component_id", "root")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """df's rows, all columns: one row of each group of similar rows, that of the smallest id and, among rows of this id, of the smallest text hash.

    The decision goes by id and text, so different texts under one id or without
    id are judged each for itself; a row without id stays only if its group has
    no id; null, empty and blank texts are one group; an empty table gives no rows.
    """
    row_id, row_cls = fresh("id"), fresh("cls")
    found = similar_groups(df, id_col, text_col, shingle, similarity).groupBy("root", "id", "cls").agg(F.count("*").alias("n"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "cls", "n")).alias("x"))
    stay = materialise(first.select(F.col("x.id").alias(row_id), F.col("x.cls").alias(row_cls), "x.n"), "stay")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(row_id)) & (_class_of(text_col) == F.col(row_cls))

    def of(chosen: DataFrame) -> DataFrame:
        return df.join(broadcast_if(chosen.drop("n"), chosen.count(), BROADCAST_ROWS), same, "left_semi")

    repeated = stay.where("n > 1")
    kept = of(stay.where("n = 1"))
    if repeated.isEmpty():
        return kept
    return kept.unionByName(of(repeated).withColumn(row_cls, _class_of(text_col)).dropDuplicates([id_col, row_cls]).drop(row_cls))

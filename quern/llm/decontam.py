"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are cut into blocks of a bounded number of words; a
block becomes one automaton, which is broadcast.  Texts stream through it word
by word; the automaton's state gives the longest suffix that occurs in an item,
hence every window that ends at the word.  Further blocks follow as further
passes, each adding its hit spans to the row and stored before the next one
begins: neither the driver nor a worker ever holds more than one block, whatever
the benchmark's size, and texts are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import fresh, load, materialise, slices

WINDOW = 13
#: Words of one automaton; about 100 MB of Python memory.
BLOCK_WORDS = 150_000
#: Bytes to bytes: A-Z lower-cased, word bytes [0-9a-z\x80-\xFF] kept, everything else a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton over the words of (item id, words) pairs.

    next_of[state * span + word] is a transition, link the suffix link, size the
    longest length.  ends[state] lists, for items shorter than the window, their
    whole lengths; owners[(state, length)] the items whose windows these are;
    items without an id are None.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        for _, words in items:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.span = max(1, len(self.vocabulary))
        self.next_of: dict[int, int] = {}
        self.link, self.size, self.edges = [-1], [0], [[]]
        coded = [(i, [self.vocabulary[w] for w in words]) for i, words in items]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.shortest = min((min(window, len(c)) for _, c in coded if c), default=0)
        self.owners: dict[int, list[str | None]] = {}
        self.short: dict[int, list[int]] = {}
        for item, codes in coded:
            if not codes:
                continue
            for state, length in self._windows(codes):
                owned = self.owners.setdefault(state * (window + 1) + length, [])
                if not owned or owned[-1] != item:
                    owned.append(item)
                if length < window and length not in self.short.setdefault(state, []):
                    self.short[state].append(length)
        del self.edges
        #: The nearest state on the suffix path, the state itself included, where a short item ends.
        self.out = [-1] * len(self.size)
        for v in sorted(range(len(self.size)), key=self.size.__getitem__):
            self.out[v] = v if v in self.short else self.out[self.link[v]] if v else -1
        #: The state on the suffix path that holds the suffix of exactly the window's length.
        self.exact = [-1] * len(self.size)
        for v in sorted(range(len(self.size)), key=self.size.__getitem__):
            if self.size[v] >= window:
                self.exact[v] = v if self.size[self.link[v]] < window else self.exact[self.link[v]]

    def _add(self, size: int, link: int) -> int:
        self.size.append(size)
        self.link.append(link)
        self.edges.append([])
        return len(self.size) - 1

    def _set(self, state: int, c: int, to: int) -> None:
        key = state * self.span + c
        if key not in self.next_of:
            self.edges[state].append(c)
        self.next_of[key] = to

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._add(self.size[p] + 1, self.link[q])
        for x in self.edges[q]:
            self._set(copy, x, self.next_of[q * self.span + x])
        self.link[q] = copy
        while p >= 0 and self.next_of.get(p * self.span + c) == q:
            self.next_of[p * self.span + c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next_of.get(last * self.span + c)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, c, q)
        new, p = self._add(self.size[last] + 1, 0), last
        while p >= 0 and p * self.span + c not in self.next_of:
            self._set(p, c, new)
            p = self.link[p]
        if p >= 0:
            q = self.next_of[p * self.span + c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
        return new

    def _windows(self, codes: list[int]) -> Iterator[tuple[int, int]]:
        length = min(self.window, len(codes))
        state = 0
        for i, c in enumerate(codes):
            state = self.next_of[state * self.span + c]
            while self.size[self.link[state]] >= length:
                state = self.link[state]
            if i >= length - 1:
                yield state, length

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """(merged hit spans [from, to) in words, the items with a window in the text)."""
        get, step, link, size, span, window = self.vocabulary.get, self.next_of.get, self.link, self.size, self.span, self.window
        exact, out, owners = self.exact, self.out, self.owners
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        state = length = 0
        for i, w in enumerate(words):
            c = get(w)
            if c is None:
                state = length = 0
                continue
            to = step(state * span + c)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = step(state * span + c)
            if to is None:
                continue
            state, length = to, length + 1
            if length >= window:
                spans.append((i - window + 1, i + 1))
                found.add(exact[state] * (window + 1) + window)
            v = out[state]
            while v > 0:
                for n in self.short[v]:
                    if n <= length:
                        spans.append((i - n + 1, i + 1))
                        found.add(v * (window + 1) + n)
                v = out[link[v]]
        return merged(spans), {x for k in found for x in owners[k]}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS) -> Iterator[list]:
    """The items in blocks of about block_words words: (item id, text) of one block is collected when it is asked for.

    Items without text are left out, those without an id are not.  An item
    longer than a block is a block by itself.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    size = F.size(F.split("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // block_words))
    if n == 1:
        yield items.collect()
        return
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    held = materialise(items.withColumn("part", part), "items")
    for k in range(n):
        yield held.where(F.col("part") == k).select("item", "text").collect()


def _pass(auto, at: list[int], names: list[str], first: bool):
    """at: the places of the text and of the three result columns; the first pass finds only the former."""

    def run(batches):
        a = auto.value
        for b in slices(batches):
            texts = b.column(at[0]).cast(pa.binary()).to_pylist()
            held = [[]] * len(texts) if first else b.column(at[2]).to_pylist()
            owned_before = [[]] * len(texts) if first else b.column(at[3]).to_pylist()
            n_words, spans, items = [], [], []
            for t, s, i in zip(texts, held, owned_before, strict=True):
                words = words_of(t)
                new, owned = a.hits(words) if a.shortest else ([], set())
                flat = new if not s else merged(new + list(zip(s[::2], s[1::2], strict=True)))
                n_words.append(len(words))
                spans.append([x for ab in flat for x in ab])
                items.append(sorted(owned.union(i), key=lambda x: (x is None, x)))
            found = [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            kept = b.columns if first else [c for k, c in enumerate(b.columns) if k not in at[1:]]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=names)

    return run


def annotated(
    docs: DataFrame, benchmark: DataFrame, names: tuple[str, str, str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """docs, all columns, with those of names added: the number of words, the hit spans and the items' ids."""
    spark, out, first = docs.sparkSession, docs, True
    n = len(docs.columns)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), *T.StructType.fromDDL("a long, b array<int>, c array<string>")])
    for f, name in zip(schema.fields[n:], names, strict=True):
        f.name = name
    schema = T.StructType(schema.fields)
    at, before = [docs.columns.index(text_col), n, n + 1, n + 2], None
    text = F.col(text_col).cast("string").alias(text_col)
    if schema[at[0]].dataType != T.StringType():
        schema = T.StructType([T.StructField(f.name, T.StringType()) if k == at[0] else f for k, f in enumerate(schema)])
        out = docs.select(*[text if c == text_col else F.col(c) for c in docs.columns])
    for items in blocks_of(benchmark, item_col, item_text, block_words):
        if before is not None:
            out = materialise(out, "pass")
            before.destroy()
        before = spark.sparkContext.broadcast(Automaton([(i, words_of(t)) for i, t in items], window))
        out = out.mapInArrow(_pass(before, at, schema.names, first), schema)
        first = False
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(row_id, text, n_words, spans, items) for every row of docs.

    spans holds from, to, from, to ... of the merged hit runs in words, items the
    ids (as strings, sorted) of the items one of whose windows occurs; items
    without an id hit like others and are one null there.  Null and empty texts
    have no words; an empty benchmark hits nothing; repeated rows and null ids
    have their row; other columns are ignored.
    """
    two = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    return annotated(two, benchmark, ("n_words", "spans", "items"), "text", item_col, item_text, window, block_words)


def hit_words(spans: str) -> Column:
    return F.expr(f"aggregate(transform(`{spans}`, (x, i) -> IF(i % 2 = 0, -cast(x as long), cast(x as long))), 0L, (a, x) -> a + x)")


def with_verdict(found: DataFrame, min_share: int = 20) -> DataFrame:
    """Adds n_hit, n_items and contaminated: hit words are at least 1 / min_share of the words, and there are any."""
    return found.withColumns({"n_hit": hit_words("spans"), "n_items": F.size("items").cast("long")}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * min_share >= F.col("n_words"))
    )


def without_spans(texts: list[str | None], spans: list[list[int]]) -> list[str | None]:
    """The texts with the given word runs cut out, separators before them included."""
    import re

    out = []
    word = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    for t, s in zip(texts, spans, strict=True):
        if t is None or not len(s):
            out.append(t)
            continue
        data = t.encode()
        at = [m.span() for m in word.finditer(data)]
        kept, end = [], 0
        for a, b in zip(s[::2], s[1::2], strict=True):
            kept.append(data[end : at[a][0]])
            end = at[b - 1][1]
        out.append(b"".join([*kept, data[end:]]).decode())
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_share: int = 20, min_span: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs, all columns, of the rows that are not contaminated: each row by its own text, whatever other rows share its id.

    With min_span, hit runs of at least so many words are cut out of the rows
    that stay; without it these rows stay whole.
    """
    words, spans, items = (fresh(x) for x in ("words", "spans", "items"))
    n_hit = hit_words(spans)
    found = annotated(docs, benchmark, (words, spans, items), text_col, block_words=block_words)
    kept = found.where(~((n_hit > 0) & (n_hit * min_share >= F.col(words)))).drop(words, items)
    if min_span is None:
        return kept.drop(spans)
    at, last = kept.columns.index(text_col), len(kept.columns) - 1

    def cut(batches):
        for b in slices(batches):
            long = [[x for a, z in zip(s[::2], s[1::2], strict=True) if z - a >= min_span for x in (a, z)] for s in b.column(last).to_pylist()]
            yield b.set_column(at, b.schema.names[at], pa.array(without_spans(b.column(at).to_pylist(), long), pa.string()))

    return kept.mapInArrow(cut, kept.schema).drop(spans)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return with_verdict(found).select(
        F.col("row_id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


#: The same by joining 13-word strings.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS gram
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM w, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT d.doc_id, d.n, d.p, g.item_id FROM d JOIN g ON d.n = g.n AND d.gram = g.gram),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

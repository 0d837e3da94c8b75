"""Removal of byte strings that already start in an earlier document.

Every string of ``length`` bytes has an anchor, the place of the smallest hash
among its substrings of GRAM bytes; equal strings have the same anchor at the
same offset.  Anchors, about one byte in sixteen, are compared first, in packed
blocks, and those that no second document has end there.  Around each of the
others lies a segment of the text, the strings whose anchor it is.  Segments
are dealt out by their anchor's gram, and a bucket of them is sorted as one
text: a two-stage suffix sort orders the suffixes smaller than their successors
directly and induces the rest by scans over the buckets of the first byte;
neighbours with a common prefix of ``length`` bytes are equal strings.

Copies never meet in numbers: equal documents are one, and within a batch equal
anchors and equal segments are merged before they are sent.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import broadcast_if, load, materialise, slices

LENGTH, GRAM = 50, 20
#: Bytes that are hashed together; arrays of them fit in a core's cache.
PIECE = 1 << 17
BYTES_PER_BUCKET = 4 << 20
LEAST_BUCKETS = 256
BROADCAST_ROWS = 1_000_000
LAST = (1 << 63) - 1
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _K[1]
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of data[i : i + gram] at every i, built by doubling."""
    h, size, out, done = _mixed((data.astype(np.uint64) + np.uint64(1)) * _K[0]), 1, None, 0
    while True:
        if gram & size:
            out = h[: len(data) - gram + 1] if out is None else _mixed(out * _K[2] + h[done : done + len(out)])
            done += size
        if size * 2 > gram:
            return out | np.uint64(1)
        h, size = _mixed(h[:-size] * _K[2] + h[size:]), size * 2


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x, size = f(x[:-size], x[size:]), size * 2
    return f(x[: len(x) - width + size], x[width - size :]) if size < width else x


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of texts laid end to end, which end at ends."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, width = gram_hashes(data, gram), length - gram + 1
    low = _slide(h, width, np.minimum)
    begins = np.concatenate([[0], ends[:-1]])
    fits = np.zeros(len(data) + 1, np.int32)
    inside = ends - begins >= length
    np.add.at(fits, begins[inside], 1)
    np.add.at(fits, ends[inside] - length + 1, -1)
    low = np.where(np.cumsum(fits)[: len(low)] > 0, low, np.uint64(0))
    edge = np.zeros(width - 1, np.uint64)
    at = np.nonzero(_slide(np.concatenate([edge, low, edge]), width, np.maximum) == h)[0]
    return at, h[at]


def own_strings(text: bytes, places: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """(place, first, last): the starts of the strings whose anchor a place is; places that are no anchors are left out."""
    out, width = [], length - gram + 1
    for at in range(0, max(1, len(text) - length + 1), PIECE):
        data = np.frombuffer(text[at : at + PIECE + length - 1], np.uint8)
        if len(data) < length:
            continue
        h = gram_hashes(data, gram)
        low = _slide(h, width, np.minimum)
        p = places[(places >= at) & (places < at + len(h))] - at
        start = p[:, None] - np.arange(width)
        own = (start >= 0) & (start < len(low)) & (low[np.clip(start, 0, len(low) - 1)] == h[p][:, None])
        last, first = p - own.argmax(1), p - (width - 1 - own[:, ::-1].argmax(1))
        some = own.any(1)
        out += zip((p[some] + at).tolist(), (first[some] + at).tolist(), (last[some] + at).tolist(), strict=True)
    return out


def _pieces(texts: list[bytes], length: int):
    """Lists of (text number, offset, bytes) of about PIECE bytes; longer texts are cut with an overlap that keeps every string whole."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), PIECE):
            part = t[at : at + PIECE + length - 1]
            held.append((i, at, part))
            size += len(part)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def batch_anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, hash) of the anchors of all texts, each once, by hash, text and place."""
    docs, places, hashes = [], [], []
    for group in _pieces(texts, length):
        data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        ends = np.cumsum([len(p) for _, _, p in group])
        at, h = anchors(data, ends, length, gram)
        k = np.searchsorted(ends, at, side="right")
        docs.append(np.array([i for i, _, _ in group])[k])
        places.append(at - np.concatenate([[0], ends[:-1]])[k] + np.array([o for _, o, _ in group])[k])
        hashes.append(h)
    if not docs:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64)
    d, p, h = np.concatenate(docs), np.concatenate(places), np.concatenate(hashes)
    in_place = ((d[1:] > d[:-1]) | (d[1:] == d[:-1]) & (p[1:] > p[:-1])).all()  # but for texts of several pieces
    order = np.argsort(h, kind="stable") if in_place else np.lexsort((p, d, h))
    d, p, h = d[order], p[order], h[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1])])[: len(d)]
    return d[new], p[new], h[new]


ASKED = "bucket int, ids array<long>, n int, body binary"
FLAGGED = "id long, places array<int>"
SEGMENT = "bucket int, id long, key long, places array<int>, offset int, segment binary"
RANGES = "id long, key long, ranges array<int>"


def _ask(n_buckets: int, length: int, gram: int):
    """Anchors as packed questions to their buckets; those that two documents of the batch share are answered at once (n < 0)."""

    def run(batches):
        for b in slices(batches):
            ids = b.column(0).to_numpy()
            d, p, h = batch_anchors(b.column(1).to_pylist(), length, gram)
            if not len(d):
                continue
            first = np.concatenate([[True], h[1:] != h[:-1]])
            start = np.nonzero(first)[0]
            last = np.concatenate([start[1:], [len(h)]]) - 1
            shared = np.repeat(ids[d[start]] != ids[d[last]], last - start + 1)
            bucket = (((h >> np.uint64(48)) * np.uint64(n_buckets)) >> np.uint64(16)).astype(np.int64)
            rows = []
            if shared.any():
                sd, sp = d[shared], p[shared]
                who, sd = np.unique(sd, return_inverse=True)
                rows.append((int(h[0] % np.uint64(n_buckets)), ids[who], -len(sd), sd.astype("<u2").tobytes() + sp.astype("<u4").tobytes()))
            sent = ~shared | first
            d, p, h, shared, bucket = d[sent], p[sent], h[sent], shared[sent], bucket[sent]
            order = np.lexsort((p, d, bucket))
            d, p, h, shared, bucket = d[order], p[order], h[order], shared[order], bucket[order]
            cut = np.nonzero(np.diff(bucket))[0] + 1
            for i, j in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(d)]]), strict=True):
                who, local = np.unique(d[i:j], return_inverse=True)
                body = (h[i:j] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + ((h[i:j] >> np.uint64(32)) & np.uint64(0xFF)).astype("u1").tobytes()
                body += p[i:j].astype("<u4").tobytes() + local.astype("<u2").tobytes() + shared[i:j].astype("u1").tobytes()
                rows.append((int(bucket[i]), ids[who], int(j - i), body))
            yield _batch(rows, ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("n", pa.int32()), ("body", pa.binary()))

    return run


def _batch(rows: list[tuple], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(cols)], names=[c for c, _ in cols])


def _by_row(ids: np.ndarray, keys: np.ndarray, values: list[np.ndarray], names: list[str]) -> pa.Table:
    """One row for each (id, key): the values, interleaved, as a list."""
    order = np.lexsort((values[0], keys, ids))
    ids, keys = ids[order], keys[order]
    start = np.nonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])])[: len(ids)])[0]
    flat = np.stack([v[order] for v in values], 1).astype(np.int32).ravel()
    offsets = np.concatenate([start, [len(ids)]]).astype(np.int32) * len(values)
    return pa.Table.from_arrays([pa.array(ids[start]), pa.array(keys[start]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=names)


def _answer(table):
    """The places of a bucket's anchors that more than one document has."""
    out, asked = [], []
    for ids, n, body in zip(*(table.column(c).to_pylist() for c in ("ids", "n", "body")), strict=True):
        ids = np.array(ids, np.int64)
        if n < 0:
            out.append((ids[np.frombuffer(body, "<u2", -n)], np.frombuffer(body, "<u4", -n, -2 * n)))
            continue
        h = np.frombuffer(body, "<u4", n).astype(np.uint64) | np.frombuffer(body, "u1", n, 4 * n).astype(np.uint64) << np.uint64(32)
        asked.append((h, ids[np.frombuffer(body, "<u2", n, 9 * n)], np.frombuffer(body, "<u4", n, 5 * n), np.frombuffer(body, "u1", n, 11 * n)))
    if asked:
        h, ids, p, known = (np.concatenate(x) for x in zip(*asked, strict=True))
        order = np.argsort(h, kind="stable")
        h, ids, p, known = h[order], ids[order], p[order], known[order]
        start = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
        many = (np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start)) | (np.maximum.reduceat(known, start) > 0)
        tell = np.repeat(many, np.diff(np.concatenate([start, [len(h)]]))) & (known == 0)
        out.append((ids[tell], p[tell]))
    ids, p = (np.concatenate(x) for x in zip(*out, strict=True))
    return _by_row(ids, np.zeros(len(ids), np.int64), [p.astype(np.int64)], ["id", "key", "places"]).drop_columns(["key"])


def _segments(n_buckets: int, length: int, gram: int):
    """Segments around flagged anchors, one of each kind in a batch; a later document's copy of a segment is answered at once (offset -1)."""

    def run(batches):
        for b in slices(batches):
            kinds: dict[tuple[bytes, int], list[tuple[int, int, int]]] = {}
            for i, key, text, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for p, first, last in own_strings(text, np.unique([x for ps in places for x in ps]), length, gram):
                    kinds.setdefault((text[first : last + length], p - first), []).append((i, key, p))
            rows, gone = [], {}
            for (segment, offset), found in kinds.items():
                least = min(f[0] for f in found)
                bucket = xxhash.xxh64_intdigest(segment[offset : offset + gram]) % n_buckets
                stay: dict[tuple[int, int], list[int]] = {}
                for i, key, p in found:
                    if i == least:
                        stay.setdefault((i, key), []).append(p)
                    else:
                        gone.setdefault((i, key), []).extend((p - offset, p - offset + len(segment)))
                rows += [(bucket, i, key, ps, offset, segment) for (i, key), ps in stay.items()]
            rows += [(key % n_buckets, i, key, ranges, -1, b"") for (i, key), ranges in gone.items()]
            if rows:
                yield _batch(rows, ("bucket", pa.int32()), ("id", pa.int64()), ("key", pa.int64()), ("places", pa.list_(pa.int32())), ("offset", pa.int32()), ("segment", pa.binary()))

    return run


def suffix_order(data: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of data in the order of their first depth bytes at least; where these are equal, in any.

    Suffixes smaller than their successors are sorted directly.  A greater one
    stands, within the bucket of its first byte, before those and in the order
    of its successors: scanning the buckets upwards, each finished bucket hands
    its predecessors on; a run of one byte follows wave by wave.  With wanted,
    the result holds these suffixes and some others: a smaller one that isn't
    wanted is sorted only if a wanted one is induced from it.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    step = np.sign(np.diff(data.astype(np.int16)))
    idx = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(idx[::-1])[::-1] if n > 1 else idx
    smaller = np.zeros(n, bool)
    smaller[: n - 1] = np.where(nearest < n, step[np.minimum(nearest, n - 2)] > 0, False) if n > 1 else False
    words = _words(data, depth)
    s = np.nonzero(smaller)[0]
    if wanted is not None and len(s):
        upto = np.concatenate([[0], np.cumsum(wanted)])
        s = s[upto[s + 1] > upto[np.concatenate([[0], s[:-1] + 1])]]  # some wanted one lies at it or between it and the smaller one before
    s = s[np.lexsort([words[s + 8 * q] for q in range(-(-depth // 8) - 1, -1, -1)])] if len(s) else s
    s_of = np.searchsorted(data[s], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if wanted is None or not len(s) or wanted[s[-1] + 1 :].any():
        waiting[data[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        mine = []
        while len(wave):
            mine.append(wave)
            wave = wave[wave > 0] - 1
            wave = wave[(data[wave] == c) & ~smaller[wave]]
        mine.append(s[s_of[c] : s_of[c + 1]])
        bucket = np.concatenate(mine)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[data[before] > c]
        heads = data[before]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        cut = np.nonzero(np.diff(heads))[0] + 1
        for part in np.split(before, cut) if len(before) else []:
            waiting[data[part[0]]].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _words(data: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes at every place as one big-endian number; beyond the end zeros."""
    padded = np.concatenate([data, np.zeros(depth + 16, np.uint8)]).astype(np.uint64)
    x, size = padded, 1
    while size < 8:
        x, size = (x[:-size] << np.uint64(8 * size)) | x[size:], size * 2
    return x


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix but the first, in order, the length of its common prefix with the one before it, up to depth."""
    words = _words(data, depth)
    a, b = order[:-1], order[1:]
    out, alive = np.zeros(len(a), np.int64), np.arange(len(a))
    for q in range(0, depth, 8):
        x = words[a[alive] + q] ^ words[b[alive] + q]
        same = (x == 0).astype(np.int64)
        for k in range(1, 8):
            same += x < np.uint64(1 << 8 * k)
        out[alive] += same
        alive = alive[x == 0]
    return np.minimum(out, depth)


def _bucket_ranges(length: int):
    def run(table):
        ids, keys, found = [], [], []
        kinds: dict[tuple[bytes, int], list[tuple[int, int, list[int]]]] = {}
        for i, key, places, offset, segment in zip(*(table.column(c).to_pylist() for c in ("id", "key", "places", "offset", "segment")), strict=True):
            if offset < 0:
                found += [(i, key, a, b) for a, b in zip(places[::2], places[1::2], strict=True)]
            else:
                kinds.setdefault((segment, offset), []).append((i, key, places))
        least = []
        for (segment, offset), owners in kinds.items():
            m = min(o[0] for o in owners)
            least.append(m)
            found += [(i, key, p - offset, p - offset + len(segment)) for i, key, ps in owners if i != m for p in ps]
        segments = [s for s, _ in kinds]
        low, high = repeated_part(segments, np.array(least, np.int64), length)
        for k, ((_, offset), owners) in enumerate(kinds.items()):
            if high[k] > low[k]:
                found += [(i, key, int(p - offset + low[k]), int(p - offset + high[k])) for i, key, ps in owners if i == least[k] for p in ps]
        if not found:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.int32()))], names=["id", "key", "ranges"])
        ids, keys, a, b = (np.array(x, np.int64) for x in zip(*found, strict=True))
        return _by_row(ids, keys, [a, b], ["id", "key", "ranges"])

    return run


def repeated_part(segments: list[bytes], owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each segment (of less than 2 * length bytes) the range of its bytes in strings that a segment of a smaller owner has; low = high for none."""
    low, high = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64)
    if len(segments) < 2:
        return low, high
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(segments)), sizes)
    whole = np.arange(len(data)) + length <= ends[of]
    order = suffix_order(data, length, whole)
    order = order[whole[order]]
    if not len(order):
        return low, high
    # Between two strings that are equal nothing else stands, so neighbours among the whole ones tell all.
    run, k = np.concatenate([[0], np.cumsum(common_prefixes(data, order, length) < length)]), of[order]
    start = np.nonzero(np.concatenate([[True], run[1:] != run[:-1]]))[0]
    first = np.repeat(np.minimum.reduceat(owner[k], start), np.diff(np.concatenate([start, [len(run)]])))
    hit = owner[k] > first
    at, k = order[hit] - (ends - sizes)[k[hit]], k[hit]
    low[k] = length * 2
    np.minimum.at(low, k, at)
    np.maximum.at(high, k, at + length)
    return low, high


def _result(batches):
    for b in slices(batches):
        rows = []
        for i, key, text, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
            ranges = [f["ranges"] for f in found or [] if f["key"] == key]
            merged: list[list[int]] = []
            for a, z in sorted({(r[j], r[j + 1]) for r in ranges for j in range(0, len(r), 2)}):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(z, merged[-1][1])
                else:
                    merged.append([a, z])
            cuts = [0, *(x for r in merged for x in r), len(text)]
            kept = b"".join(text[a:z] for a, z in zip(cuts[::2], cuts[1::2], strict=True))
            rows.append((i, len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
        yield _batch(rows, ("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, bytes_per_bucket: int = BYTES_PER_BUCKET) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row.

    Removed are the bytes of strings of length bytes that also start in a row
    with a smaller id; all is judged on the input.  kept may cut a character
    in two, hence is binary.  Null texts are empty; null ids count as 2**63 - 1,
    the largest; rows that repeat an id don't
    remove each other's bytes; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("own"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("text")
    ).withColumns({"key": F.xxhash64("text"), "sha": F.unhex(F.sha2("text", 256)), "n": F.octet_length("text").cast("long")})
    heads = materialise(rows.select("id", "sha", "n"), "heads")
    first = heads.groupBy("sha").agg(F.min("id").alias("first"))
    later = materialise(heads.join(first, "sha").where("id > first").select("id", "sha").distinct(), "later")
    later = broadcast_if(later, later.count(), BROADCAST_ROWS)
    total = heads.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(LEAST_BUCKETS, -(-total // bytes_per_bucket))
    single = rows.join(later, ["id", "sha"], "left_anti").select("id", "key", "text")
    asked = single.select("id", "text").mapInArrow(_ask(n_buckets, length, gram), ASKED)
    flagged = asked.groupBy("bucket").applyInArrow(_answer, FLAGGED).groupBy("id").agg(F.collect_list("places").alias("places"))
    segments = single.join(flagged, "id").select("id", "key", "text", "places").mapInArrow(_segments(n_buckets, length, gram), SEGMENT)
    ranges = segments.groupBy("bucket").applyInArrow(_bucket_ranges(length), RANGES)
    ranges = ranges.groupBy("id").agg(F.collect_list(F.struct("key", "ranges")).alias("found"))
    # Both joins deal out the same texts by the same key in one plan, so the texts are shuffled once.
    cut = single.join(ranges, "id", "left").select(F.when(F.col("id") != LAST, F.col("id")).alias("own"), "key", "text", "found")
    out = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    whole = F.col("n") >= length
    copies = rows.join(later, ["id", "sha"], "left_semi").select(
        F.col("own").alias("id"), F.col("n").alias("n_bytes"), F.when(whole, F.col("n")).otherwise(0).alias("n_removed"), whole.cast("long").alias("n_spans"),
        F.sha2(F.when(whole, F.lit(b"")).otherwise(F.col("text")), 256).alias("kept_sha256"), F.when(whole, F.lit(b"")).otherwise(F.col("text")).alias("kept"),
    )
    return cut.mapInArrow(_result, out).unionByName(copies)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")

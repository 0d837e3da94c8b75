"""Line dedup by an exact set-similarity join.

A line is the set of its words.  Words are ordered by rarity, from a table of a
fixed number of counters over all lines; a word's counter only orders it, so
shared counters cost time and never a match.  Two sets with a Jaccard similarity
of t share a word among their first n - ceil(t * n) + 1.  These prefixes are
dealt out by word in packed blocks; words that one set alone has end there, and
so do sets that the length and positional filters leave without partner.

What is left, (word, set) rows, is joined to the sets' words and verified inside
each word's group, block by block, each pair in the group of its first common
word only.  A group gives one row per set - its number of similar sets and the
first place of any of them - so no pairs are ever listed.  Sets themselves are
one, however many lines are equal.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh, load, materialise, slices

THRESHOLD = 0.8
COUNTERS = 1 << 20
CHUNK = 1 << 14
BYTES_PER_BUCKET = 4 << 20
#: Bits of the filter that tells sets with candidates from others; a full filter costs time only.
FILTER_BITS = 1 << 27
BLOCK = 1024
#: Sets of more words have sketches of 128 bits, the others of 64: those of large sets may differ in so many that 64 tell few apart.
WIDE = 64
#: Words of more rows than so many blocks are not filtered but verified at once.
FILTERED = 16
#: Rows that are verified in one task's go; the rows of a word stay together.
ROWS_PER_BUCKET = 10_000
PAIRS = 1_000_000
LAST = (1 << 63) - 1
#: Bytes of text whose words a worker holds as arrays at once: some twenty numbers for each word.
SLICE = 4 << 20


def line_words(text: bytes | None) -> list[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each line, A-Z lower-cased."""
    return [line.split() for line in (text or b"").lower().split(b"\n")]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)


class Sets:
    """The word sets of a batch's lines: flat word hashes by line, each line's in rarity order; sig 0 stands for a line without words.

    Lines and words are cut by Arrow; only a batch's different words are seen by Python.
    """

    def __init__(self, texts: pa.Array, counts: np.ndarray | None):
        lines = pc.split_pattern(texts, "\n")
        per_text = pc.list_value_length(lines).to_numpy()
        self.doc = np.repeat(np.arange(len(texts)), per_text)
        self.number = np.arange(len(self.doc)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        words = pc.ascii_split_whitespace(pc.ascii_lower(lines.flatten()))
        line = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy())
        coded = words.flatten().dictionary_encode()
        kinds = coded.dictionary.cast(pa.large_binary())
        at = np.frombuffer(kinds.buffers()[1], np.int64)[kinds.offset : kinds.offset + len(kinds) + 1].tolist()
        data = kinds.buffers()[2].to_pybytes() if kinds.buffers()[2] else b""
        hashes = np.array([xxhash.xxh64_intdigest(data[i:j]) for i, j in zip(at, at[1:], strict=False)], np.uint64)
        some = np.diff(at)[coded.indices.to_numpy()] > 0 if len(kinds) else np.zeros(0, bool)  # blanks at the ends of a line are no words
        code, line = coded.indices.to_numpy()[some], line[some]
        rare = counts[hashes & np.uint64(COUNTERS - 1)] if counts is not None else np.zeros(len(hashes), np.int64)
        order = np.lexsort((hashes, rare))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        both = np.sort(line * max(1, len(order)) + rank[code])
        both = both[np.concatenate([[True], both[1:] != both[:-1]])[: len(both)]]
        line = both // max(1, len(order))
        self.words = hashes[order][both % max(1, len(order))] if len(both) else np.zeros(0, np.uint64)
        self.size = np.bincount(line, minlength=len(self.doc))
        self.end = np.cumsum(self.size)
        self.mixed = mixed = _mix(self.words)
        sig = self._sums(mixed) + self.size.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        self.sig = np.where(self.size > 0, sig | np.uint64(1), np.uint64(0)).view(np.int64)

    def _sums(self, x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
        return total[self.end] - total[self.end - self.size]

    def sketches(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each line, as the halves' sum and the second half: a word flips one of them, so that two lines' sketches differ in at most as many bits as their sets differ in words."""
        found = []
        for bit in _flips(self.mixed):
            total = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(bit)]) if len(bit) else np.zeros(1, np.uint64)
            found.append(total[self.end] ^ total[self.end - self.size])
        return found[0], found[1]


def _flips(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bit that each word flips in the halves' sum, and in the second half if it is there."""
    bit = np.uint64(1) << (mixed >> np.uint64(58))
    return bit, bit * ((mixed >> np.uint64(57)) & np.uint64(1))


def _apart(both: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The differing bits of two sketches, from the differences of the halves' sum and of the second half; of the sum alone where that is 0."""
    return np.bitwise_count(both ^ second) + np.bitwise_count(second)


def _needed(n: np.ndarray, m: np.ndarray, t: float) -> np.ndarray:
    """The least overlap of sets of n and m words at similarity t."""
    return np.ceil(t / (1 + t) * (n + m) - 1e-9)


LINES = "id long, line long, sig long, chunk int, counts binary"


def _lines(batches):
    """A row for each line, and one for each chunk of the task's counters: in how many lines the words of each occur."""
    total = np.zeros(COUNTERS, np.int64)
    nulls = lambda n, kind: pa.nulls(n, kind)
    for b in slices(batches, size=SLICE):
        sets = Sets(b.column(0), None)
        total += np.bincount((sets.words & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        n = len(sets.doc)
        yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(sets.doc)), pa.array(sets.number), pa.array(sets.sig), nulls(n, pa.int32()), nulls(n, pa.binary())], names=["id", "line", "sig", "chunk", "counts"])
    chunks = [(i // CHUNK, total[i : i + CHUNK]) for i in range(0, COUNTERS, CHUNK) if total[i : i + CHUNK].any()]
    n = len(chunks)
    yield pa.RecordBatch.from_arrays(
        [*(nulls(n, pa.int64()) for _ in range(3)), pa.array([k for k, _ in chunks], pa.int32()), pa.array([c.astype("<u4").tobytes() for _, c in chunks], pa.binary())], names=["id", "line", "sig", "chunk", "counts"]
    )


def _add(table):
    total = sum(np.frombuffer(c, "<u4").astype(np.uint64) for c in table.column("counts").to_pylist())
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())})


def word_counts(held: DataFrame) -> np.ndarray:
    """The fixed table of counters, from the chunks that stand beside the lines; a chunk's sum stops at the largest 32-bit number."""
    chunks = held.where("chunk IS NOT NULL").select("chunk", "counts").groupBy("chunk").applyInArrow(_add, "chunk int, counts binary").collect()
    out = np.zeros(COUNTERS, np.int64)
    for r in chunks:
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, "<u4")
    return out


def _post(counts, n_buckets: int, t: float):
    """The prefixes of the batch's different sets, packed by bucket of the word; words counted once have no second line."""

    def run(batches):
        for b in slices(batches, size=SLICE):
            sets = Sets(b.column(0), counts.value)
            _, own = np.unique(sets.sig, return_index=True)
            own = own[sets.size[own] > 0]
            n, (sketch, second) = sets.size[own], (x[own] for x in sets.sketches())
            kind, wide = "<u2" if n.max(initial=0) < 1 << 16 else "<u4", n > WIDE
            take = n - np.ceil(t * n - 1e-9).astype(np.int64) + 1
            row = np.repeat(np.arange(len(own)), take)
            place = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
            word = sets.words[(sets.end[own] - n)[row] + place]
            many = counts.value[word & np.uint64(COUNTERS - 1)] > 1
            row, place, word = row[many], place[many], word[many]
            before = np.zeros(len(word), np.uint64)
            before[1:] = np.where(row[1:] == row[:-1], word[:-1], np.uint64(0))
            bucket = ((word >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            row, place, word, bucket, before = row[order], place[order], word[order], bucket[order], before[order]
            cut = np.nonzero(np.diff(bucket))[0] + 1
            bounds = list(zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(bucket)]]), strict=True)) if len(bucket) else []
            sig, body = sets.sig[own], []
            for i, j in bounds:
                at = row[i:j]
                columns = (word[i:j], sig[at], sketch[at], before[i:j], second[at[wide[at]]], n[at].astype(kind), place[i:j].astype(kind), np.array([j - i, int(kind[2])], "<u4"))
                body.append(b"".join(c.tobytes() for c in columns))
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[i]) for i, _ in bounds], pa.int32()), pa.array(body, pa.binary())], names=["bucket", "body"])

    return run


def _candidates(t: float):
    def run(table):
        parts = []
        for body in table.column("body").to_pylist():
            m, size = np.frombuffer(body, "<u4", 2, len(body) - 8).tolist()
            longs = (np.frombuffer(body, t, m, 8 * k * m) for k, t in enumerate(("<u8", "<i8", "<u8", "<u8")))
            ends = len(body) - 8 - 2 * size * m
            n, place = (np.frombuffer(body, f"<u{size}", m, ends + k * size * m).astype(np.int64) for k in range(2))
            second = np.zeros(m, np.uint64)
            second[n > WIDE] = np.frombuffer(body, "<u8", (ends - 32 * m) // 8, 32 * m)
            parts.append((*longs, n, place, second))
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.lexsort((columns[1], columns[4], columns[0]))
        word, sig = columns[0][order], columns[1][order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (sig[1:] != sig[:-1])
        word, sig, sketch, before, n, place, second = (x[order[new]] for x in columns)
        hit = with_partner(word, sketch, second, before, n, place, t)
        return pa.table({"word": pa.array(word[hit].view(np.int64)), "sig": pa.array(sig[hit])})

    return run


def windows(word: np.ndarray, n: np.ndarray, t: float, at_most: int | None = None):
    """Pairs of rows of the same word, about PAIRS at a time, whose sizes allow the similarity.

    Rows are sorted by word and size, so that a row's partners follow it; words
    of more than at_most rows are left out.
    """
    new = np.concatenate([[True], word[1:] != word[:-1]])[: len(word)]
    group = np.cumsum(new) - 1
    span = int(n.max(initial=0)) + 2
    place = group * span + n
    upto = np.searchsorted(place, group * span + np.minimum(np.floor(n / t + 1e-9).astype(np.int64), span - 1), side="right")
    many = np.maximum(upto - np.arange(len(word)) - 1, 0)
    if at_most is not None:
        many[np.bincount(group)[group] > at_most] = 0
    total = np.cumsum(many)
    at = 0
    while at < len(many):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        left = np.repeat(np.arange(at, end), many[at:end])
        right = left + 1 + np.arange(len(left)) - np.repeat(total[at:end] - many[at:end] - (total[at - 1] if at else 0), many[at:end])
        if len(left):
            yield left, right
        at = end


def with_partner(word: np.ndarray, sketch: np.ndarray, second: np.ndarray, before: np.ndarray, n: np.ndarray, place: np.ndarray, t: float) -> np.ndarray:
    """Which rows, sorted by word and size, have a row of the same word that passes the length and positional filters with them, and whose sketch is near enough.

    Rows that share the word before, too, meet in the group of an earlier word, so they don't count here.
    """
    start = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0] if len(word) else np.zeros(0, int)
    size = np.diff(np.concatenate([start, [len(word)]]))
    hit = np.repeat(size > FILTERED * BLOCK, size)  # very large groups go on whole: verification is the exact way for them
    for left, right in windows(word, n, t, FILTERED * BLOCK):
        a, b = n[left], n[right]
        apart = _apart(sketch[left] ^ sketch[right], np.where(a > WIDE, second[left] ^ second[right], np.uint64(0)))
        need = _needed(a, b, t)
        ok = (apart <= a + b - 2 * need) & (np.minimum(a - place[left], b - place[right]) >= need)
        ok &= (before[left] != before[right]) | (before[left] == 0)
        hit[left[ok]] = True
        hit[right[ok]] = True
    return hit


def _contents(counts, wanted):
    """(sig, id, line, words) of the batch's different sets that may have candidates; the words' bytes are in rarity order."""

    def run(batches):
        bits = np.frombuffer(wanted.value, np.uint8)
        for b in slices(batches, size=SLICE):
            ids = b.column(1).to_numpy()
            sets = Sets(b.column(0), counts.value)
            order = np.lexsort((sets.number, ids[sets.doc], sets.sig))
            sig = sets.sig[order]
            own = order[np.concatenate([[True], sig[1:] != sig[:-1]])] if len(order) else order
            low = sets.sig[own] & (FILTER_BITS - 1)
            own = own[(sets.sig[own] != 0) & (bits[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1 == 1)]
            words = [sets.words[sets.end[k] - sets.size[k] : sets.end[k]].tobytes() for k in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sets.sig[own]), pa.array(ids[sets.doc[own]]), pa.array(sets.number[own]), pa.array(words, pa.binary())], names=["sig", "id", "line", "words"]
            )

    return run


def _verify(t: float):
    """The links of a bucket of words: pair by pair in small groups, block by block in large ones."""

    def run(table):
        sets = [np.frombuffer(w, "<u8") for w in table.column("words").to_pylist()]
        word = table.column("word").to_numpy().view(np.uint64)
        n = np.array([len(x) for x in sets], np.int64)
        order = np.lexsort((n, word))
        sets, word, n = [sets[k] for k in order], word[order], n[order]
        sig, ids, lines = (table.column(c).to_numpy()[order] for c in ("sig", "id", "line"))
        by_place = np.lexsort((lines, ids))
        rank = np.empty(len(sets), np.int64)
        rank[by_place] = np.arange(len(sets))
        links, first = small_groups(sets, word, n, rank, t)
        start = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0]
        for i, j in zip(start, [*start[1:], len(word)], strict=True):
            if j - i > BLOCK:
                links[i:j], best = similar(sets[i:j], word[i], np.argsort(rank[i:j]), t)
                first[i:j] = np.where(links[i:j] > 0, rank[i + best], len(sets))
        hit = links > 0
        near = by_place[first[hit]]
        return pa.table({"sig": sig[hit], "links": links[hit], "id": ids[near], "line": lines[near]})

    return run


def small_groups(sets: list[np.ndarray], word: np.ndarray, n: np.ndarray, rank: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set, sorted by word and size, the number of similar ones whose first common word with it is its word, and the least rank of them."""
    links, first = np.zeros(len(sets), np.int64), np.full(len(sets), len(sets))
    words = np.concatenate([np.zeros(0, np.uint64), *sets])
    row = np.repeat(np.arange(len(sets)), n)
    place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
    before = np.zeros(len(sets), np.int64)
    own = words == word[row]
    before[row[own]] = place[own]
    kinds, code = np.unique(words, return_inverse=True)
    span = max(1, len(kinds))
    key = row * span + code
    order = np.argsort(key)
    key, place_of = key[order], place[order]
    sketch, second = (np.bitwise_xor.reduceat(bit, np.cumsum(n) - n) if len(words) else np.zeros(len(sets), np.uint64) for bit in _flips(_mix(words)))
    begin = np.cumsum(n) - n
    for left, right in windows(word, n, t, BLOCK):
        need = _needed(n[left], n[right], t)
        near = _apart(sketch[left] ^ sketch[right], second[left] ^ second[right]) <= n[left] + n[right] - 2 * need
        left, right, need = left[near], right[near], need[near]
        cuts = [*range(0, len(left), 20_000), len(left)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            a, b = left[i:j], right[i:j]
            pair = np.repeat(np.arange(j - i), n[a])
            at = np.arange(len(pair)) - np.repeat(np.cumsum(n[a]) - n[a], n[a])
            asked = b[pair] * span + code[begin[a][pair] + at]
            found = np.minimum(np.searchsorted(key, asked), len(key) - 1)
            both = key[found] == asked
            early = both & (at < before[a][pair]) & (place_of[found] < before[b][pair])
            ok = (np.bincount(pair[both], minlength=j - i) >= need[i:j]) & (np.bincount(pair[early], minlength=j - i) == 0)
            a, b = a[ok], b[ok]
            links += np.bincount(a, minlength=len(sets)) + np.bincount(b, minlength=len(sets))
            np.minimum.at(first, a, rank[b])
            np.minimum.at(first, b, rank[a])
    return links, first


def similar(sets: list[np.ndarray], word: np.uint64, order: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set the number of similar ones whose first common word with it is word, and the one among them that is first in order."""
    n = np.array([len(s) for s in sets])
    before = np.array([int(np.nonzero(s == word)[0][0]) for s in sets])
    rank = np.empty(len(sets), np.int64)
    rank[order] = np.arange(len(sets))
    links, first = np.zeros(len(sets), np.int64), np.full(len(sets), len(sets))
    by_size = np.argsort(n, kind="stable")
    blocks = [by_size[i : i + BLOCK] for i in range(0, len(sets), BLOCK)]
    for x, a in enumerate(blocks):
        for b in blocks[x:]:
            if n[b[0]] * t > n[a[-1]] + 1e-9:
                break
            _, code = np.unique(np.concatenate([sets[k] for k in a] + [sets[k] for k in b]), return_inverse=True)
            left, right = _incidence(code, n[np.concatenate([a, b])], before[np.concatenate([a, b])], len(a))
            overlap, early = left[0] @ right[0].T, left[1] @ right[1].T
            ok = (early == 0) & (overlap >= _needed(n[a][:, None], n[b][None, :], t)) & (a[:, None] != b[None, :])
            links[a] += ok.sum(1)
            first[a] = np.minimum(first[a], np.where(ok, rank[b][None, :], len(sets)).min(1))
            if b is not a:
                links[b] += ok.sum(0)
                first[b] = np.minimum(first[b], np.where(ok, rank[a][:, None], len(sets)).min(0))
    return links, order[np.minimum(first, len(sets) - 1)]


def _incidence(code: np.ndarray, n: np.ndarray, before: np.ndarray, cut: int):
    """Set by word matrices of the first cut sets and of the rest: of all words, and of those ahead of the group's word."""
    counts = np.bincount(code)
    column = np.cumsum(counts > 1) - 1
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    keep = counts[code] > 1
    full, early = (np.zeros((len(n), int((counts > 1).sum())), np.float32) for _ in range(2))
    full[row[keep], column[code[keep]]] = 1
    ahead = keep & (place < np.repeat(before, n))
    early[row[ahead], column[code[ahead]]] = 1
    return (full[:cut], early[:cut]), (full[cut:], early[cut:])


def _filter_bits(batches):
    packed = np.zeros(FILTER_BITS // 8, np.uint8)
    for b in batches:
        low = np.unique(b.column(0).to_numpy() & (FILTER_BITS - 1))
        np.bitwise_or.at(packed, low >> 3, np.uint8(128) >> (low & 7).astype(np.uint8))
    size = 1 << 16
    parts = [(i, packed[i : i + size]) for i in range(0, len(packed), size)]
    parts = [(i // size, p.tobytes()) for i, p in parts if p.any()]
    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=["chunk", "bits"])


def _or(table):
    total = np.bitwise_or.reduce([np.frombuffer(c, np.uint8) for c in table.column("bits").to_pylist()])
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "bits": pa.array([total.tobytes()], pa.binary())})


def sig_filter(sigs: DataFrame) -> bytes:
    """A bit for each value of the lower bits of the sigs: FILTER_BITS / 8 bytes, whatever their number."""
    rows = sigs.mapInArrow(_filter_bits, "chunk int, bits binary").groupBy("chunk").applyInArrow(_or, "chunk int, bits binary").collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(r.bits, np.uint8)
        out[r.chunk * (1 << 16) : r.chunk * (1 << 16) + len(part)] = part
    return out.tobytes()


def matched_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bytes_per_bucket: int = BYTES_PER_BUCKET) -> DataFrame:
    """(id, line, links, first_id, removed) for every line of every row.

    links is the number of other word sets with a similarity of threshold or
    more, first_id the id of the earliest row with such a set or the same one,
    removed whether a line before this one, by id and line number, has it.
    All is judged on the input.  Lines without words, hence those of null and
    empty texts, match nothing.  Null ids come last; rows that repeat an id are
    one row as to their order, and of equal lines at the same place none is
    removed; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"))
    lines = materialise(texts.mapInArrow(_lines, LINES), "lines")
    counts = spark.sparkContext.broadcast(word_counts(lines))
    lines = lines.where("chunk IS NULL").select("id", "line", "sig")
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_buckets = max(1, -(-total // bytes_per_bucket))
    posted = texts.select("text").mapInArrow(_post(counts, n_buckets, threshold), "bucket int, body binary")
    members = materialise(posted.groupBy("bucket").applyInArrow(_candidates(threshold), "word long, sig long"), "members")
    wanted = spark.sparkContext.broadcast(sig_filter(members.select("sig")))
    held = texts.mapInArrow(_contents(counts, wanted), "sig long, id long, line long, words binary")
    place = F.struct("id", "line")
    held = held.groupBy("sig").agg(F.min(F.struct(place.alias("at"), "words")).alias("m")).select("sig", "m.at.id", "m.at.line", "m.words")
    n_groups = max(1, -(-members.count() // ROWS_PER_BUCKET))
    grouped = members.join(held, "sig").withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(n_groups)))
    verified = grouped.groupBy("bucket").applyInArrow(_verify(threshold), "sig long, links long, id long, line long")
    similar_sets = verified.groupBy("sig").agg(F.sum("links").alias("links"), F.min(place).alias("near"))
    firsts = lines.where("sig != 0").groupBy("sig").agg(F.min(place).alias("own")).join(similar_sets, "sig", "left")
    firsts = firsts.select("sig", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.least("own", F.coalesce("near", "own")).alias("first"))
    out = lines.join(firsts, "sig", "left")
    null = lambda c: F.when(c != LAST, c)
    return out.select(
        null(F.col("id")).alias("id"), "line", F.coalesce("links", F.lit(0)).cast("long").alias("links"), null(F.coalesce("first.id", "id")).alias("first_id"),
        F.coalesce(F.col("first") < place, F.lit(False)).alias("removed"),
    )


def per_document(lines: DataFrame) -> DataFrame:
    """(id, class_id, n_lines, n_removed, n_links): class_id is the earliest row that shares a line or a similar one with this row, or its own id."""
    return lines.groupBy("id").agg(
        F.min("first_id").alias("class_id"), F.count("*").alias("n_lines"), F.sum(F.col("removed").cast("long")).alias("n_removed"), F.sum("links").alias("n_links")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, with the later matches cut out of the text; null texts stay null."""
    gone, own = fresh("gone"), fresh("own")
    found = matched_lines(docs, id_col, text_col, threshold).where("removed").groupBy(F.col("id").alias(own)).agg(F.collect_set("line").alias(gone))
    out = docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col(own)), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.col(gone), i.cast("long"))), "\n")
    return out.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept)).drop(gone, own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_document(matched_lines(load(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


#: The same with sets as sorted lists; a place is doc_id and line number in one number.
ORACLE = r"""
WITH x AS (SELECT doc_id, string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, doc_id * 1000000 + i AS pos, list_sort(list_distinct(regexp_extract_all(x[i], '[^\x20\x09-\x0D]+'))) AS w FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM x)),
s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY first) AS sid, w, len(w) AS n, first FROM (SELECT w, min(pos) AS first FROM l WHERE len(w) > 0 GROUP BY w)),
t AS (SELECT sid, n, unnest(w) AS tok FROM s), f AS (SELECT tok, count(*) AS f FROM t GROUP BY tok),
r AS (SELECT sid, n, tok, row_number() OVER (PARTITION BY sid ORDER BY f, tok) AS k FROM t JOIN f USING (tok)),
p AS (SELECT sid, n, tok FROM r WHERE k <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.sid AS a, b.sid AS b FROM p a JOIN p b ON a.tok = b.tok AND a.sid <> b.sid AND 5 * b.n >= 4 * a.n AND 5 * a.n >= 4 * b.n),
o AS (SELECT c.a, y.first FROM c JOIN s x ON x.sid = c.a JOIN s y ON y.sid = c.b WHERE 9 * len(list_intersect(x.w, y.w)) >= 4 * (x.n + y.n)),
m AS (SELECT a AS sid, count(*) AS links, min(first) AS near FROM o GROUP BY a),
b AS (SELECT w, coalesce(links, 0) AS links, least(first, coalesce(near, first)) AS best FROM s LEFT JOIN m USING (sid))
SELECT doc_id, min(coalesce(best // 1000000, doc_id))::BIGINT AS class_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE best < pos)::BIGINT AS n_removed, sum(coalesce(links, 0))::BIGINT AS n_links
FROM l LEFT JOIN b ON b.w = l.w GROUP BY doc_id
"""

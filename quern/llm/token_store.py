"""Token ids as Parquet list columns.

Texts are put into doc_id order by ranges, encoded by the task that writes
them, and stored with small row groups and pages, dictionary-coded token ids
and delta-coded metadata.  A file is one range, and names follow the order.
Page indexes are written, so a reader that wants some documents or only the
metadata skips the rest.
"""

from __future__ import annotations

import functools
import os
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import few_rows, load, shared_path, slices

END_ID = 2
STORE = "doc_id long, shard int, place long, n_tokens long, ids array<int>"
#: Parquet writer settings; "#" names a column.
LAYOUT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#place": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}
#: Bytes of text in a range, about.
RANGE_BYTES = 24 << 20
#: Different words that a worker remembers.
CACHED = 300_000
LETTER, DIGIT, OTHER, SPACE, BLANK, UNSURE = range(6)


def _classes() -> np.ndarray:
    """The class of each byte: letters of Latin, Cyrillic and ASCII, digits, spaces, other white space; UNSURE where a byte doesn't tell."""
    k = np.full(256, OTHER, np.uint8)
    k[[*range(65, 91), *range(97, 123)]] = LETTER
    k[0x80:0xC0] = LETTER  # continues a letter
    k[48:58] = DIGIT
    k[32] = SPACE
    k[9:14] = BLANK
    k[[0, *range(0x1C, 0x20), *range(0xC0, 0x100)]] = UNSURE
    k[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = LETTER
    return k


CLASSES = _classes()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for themselves, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256))
    return [chr(b) if b in own else chr(256 + next(rest)) for b in range(256)]


def cut(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sure): where the byte-level pre-tokenizer's words start, and which texts it is sure of.

    Texts lie end to end in data and end at ends.  Words are runs of letters,
    of digits or of others, with one space before them; of white space the last
    before a word stands apart, and 's, 't, 're, 've, 'm, 'll, 'd at a word's
    start are words.  White space beside a space, and characters that aren't
    plainly letters, make a text unsure.
    """
    n = len(data)
    first = np.zeros(n + 3, bool)
    first[0] = True
    first[ends] = True
    k = np.concatenate([CLASSES[data], np.full(3, OTHER, np.uint8)])
    three = np.nonzero(data == 0xE2)[0]
    three = three[three + 2 < n]
    three = three[(data[three + 1] == 0x80) & (data[three + 2] >= 0x90) & (data[three + 2] <= 0xA7)]  # dashes and quotation marks
    for i in range(3):
        k[three + i] = OTHER
    same = ~first[1:n]
    now, before = k[1:n], k[: n - 1]
    odd = np.zeros(n, bool)
    odd[:n] = k[:n] == UNSURE
    odd[1:] |= same & (((before == SPACE) & ((now == SPACE) | (now == BLANK))) | ((before == BLANK) & (now == SPACE)))
    sign = np.nonzero(data[: n - 1] == 0xC3)[0]
    odd[sign[(data[sign + 1] == 0x97) | (data[sign + 1] == 0xB7)]] = True
    starts = first[:n].copy()
    starts[1:] |= (now != before) & (before != SPACE)
    blank = np.nonzero(k[:n] == BLANK)[0]
    starts[blank[~first[blank + 1] & (k[blank + 1] != BLANK)]] = True
    q = np.nonzero(data == 39)[0]
    q = q[starts[q] & ~first[q + 1] & (k[q + 1] == LETTER)]
    if len(q):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        a, b = padded[q + 1], np.where(first[q + 2], 0, padded[q + 2])
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ~one & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
        starts[q[one | two] + 1] = False
        after = np.concatenate([q[one] + 2, q[two] + 3])
        after = after[after < n]
        starts[after[k[after] == LETTER]] = True
    bad = np.concatenate([[0], np.cumsum(odd)])
    return starts, bad[ends] == bad[np.concatenate([[0], ends[:-1]])]


class Encoder:
    """Texts to ids.

    A batch is cut into the pre-tokenizer's words by classes of bytes; each
    different word is encoded once, by the tokenizer's own model without its
    pre-tokenizer, and a text's ids are put together from its words'.  Texts
    that the cut isn't sure of, and other kinds of tokenizers, are encoded whole.
    """

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        model, pre = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.letters = {b: ord(c) for b, c in enumerate(_byte_letters())}
        vocabulary = self.tokenizer.get_vocab()
        self.mark = vocabulary.get(chr(self.letters[10]))
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith(chr(self.letters[32]))]] = True
        plain = self.tokenizer.normalizer is None and isinstance(pre, pre_tokenizers.ByteLevel) and not pre.add_prefix_space and pre.use_regex
        self.by_word = plain and self.mark is not None and isinstance(model, models.BPE) and not model.dropout and model.unk_token is None
        if self.by_word:
            self.words = Tokenizer(model)
            self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, words: list[bytes]) -> None:
        """words, none of them known, are encoded together: a token that begins with a space begins a word; words without one get a line feed between them."""
        spaced = [w for w in words if w[0] == 32]
        plain = [w for w in words if w[0] != 32 and b"\n" not in w]
        odd = [w for w in words if w[0] != 32 and b"\n" in w]
        ids, n = [], []
        for group, mark in ((spaced, False), (plain, True)):
            for at in range(0, len(group), 50_000):
                part = group[at : at + 50_000]
                # A space inside a word is its first byte, so what joins the words is no part of any of them.
                joined = b"\n".join(part).decode("latin-1").translate({**self.letters, 10: f" {chr(self.letters[10])} " if mark else " "})
                found = np.asarray(self.words.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
                if mark:
                    gap = np.nonzero(found == self.mark)[0]
                    n.append(np.diff(np.concatenate([[-1], gap, [len(found)]])) - 1)
                    found = np.delete(found, gap)
                else:
                    n.append(np.diff(np.append(np.nonzero(self.spaced[found])[0], len(found))))
                ids.append(found)
                if len(n[-1]) != len(part):
                    raise ValueError("the tokenizer's words can't be told apart")
        rest = self._whole([w.decode() for w in odd])
        n.append(np.array([len(x) for x in rest], np.int64))
        self.known.update(zip((*spaced, *plain, *odd), range(len(self.known), len(self.known) + len(words)), strict=True))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(n).astype(np.int64))])
        self.ids = np.concatenate([self.ids, *ids, *rest])

    def _by_word(self, data: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = np.nonzero(starts)[0]
        offsets = pa.py_buffer(np.append(places, len(data)).astype(np.int64))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places), [None, offsets, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > CACHED:
            self.forget()
        if new := [w for w in words if w not in self.known]:
            self._learn(new)
        slot = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        first, n = self.at[slot], self.at[slot + 1] - self.at[slot]
        total = np.concatenate([[0], np.cumsum(n)])
        flat = self.ids[np.arange(total[-1]) + np.repeat(first - total[:-1], n)]
        upto = total[np.searchsorted(places, ends)]
        return flat, np.diff(upto, prepend=0)

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of all texts, and how many each has; null texts are empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        ends, counts = offsets[1:] - offsets[0], np.zeros(len(texts), np.int64)
        starts, sure = cut(data, ends) if self.by_word and len(data) else (np.zeros(len(data), bool), np.zeros(len(texts), bool))
        if sure.all():
            return self._by_word(data, ends, starts)
        size = np.diff(ends, prepend=0)
        flat = np.zeros(0, np.uint32)
        if sure.any():
            inside = np.repeat(sure, size)
            flat, counts[sure] = self._by_word(data[inside], np.cumsum(size[sure]), starts[inside])
        whole = self._whole(texts.filter(pa.array(~sure)).to_pylist())
        counts[~sure] = [len(x) for x in whole]
        out, of_sure = np.empty(int(counts.sum()), np.uint32), np.repeat(sure, counts)
        out[of_sure] = flat
        out[~of_sure] = np.concatenate([np.zeros(0, np.uint32), *whole])
        return out, counts

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        ids, counts = self.arrays(pa.array(texts, pa.string()))
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(texts) else []


@functools.lru_cache(maxsize=1)
def _encoder(spec: str) -> Encoder:
    """One for a worker, whichever tasks it runs."""
    return Encoder(spec)


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, range_bytes: int = RANGE_BYTES) -> None:
    """Encode every text, end_id after it, and write the store in ascending id order, one file for each range.

    Null and empty texts are the end id alone.  Null ids come first; rows that
    repeat an id stand in the order of their texts' hashes; an empty table makes
    an empty store; other columns are not stored.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(Path(tokenizer or default_tokenizer()).read_text())

    def run(batches):
        encode, place, last = _encoder(spec.value), 0, None
        for b in slices(batches, 2000, 3 << 20):
            ids, n = encode.arrays(b.column(1))
            shard = b.column(2).to_numpy()
            place = place if shard[0] == last else 0
            n, ends = n + 1, np.cumsum(n + 1)
            flat = np.full(int(ends[-1]), end_id, np.int32)
            inside = np.ones(len(flat), bool)
            inside[ends - 1] = False
            flat[inside] = ids.view(np.int32)
            first = np.nonzero(np.diff(shard))[0] + 1
            begin = np.repeat(np.concatenate([[-place], ends[first - 1]]), np.diff(np.concatenate([[0], first, [len(n)]])))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ends - n - begin), pa.array(n), lists], names=["doc_id", "shard", "place", "n_tokens", "ids"])
            place, last = int(ends[-1] - begin[-1]), shard[-1]
        encode.forget()  # the tokenizers stay for the worker's next task, the words don't

    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = two.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ranged = two.repartitionByRange(max(1, -(-total // range_bytes)), *order[:2]).sortWithinPartitions(*order)
    placed = ranged.withColumn("shard", F.spark_partition_id())
    with few_rows(spark):
        placed.mapInArrow(run, STORE).write.options(**LAYOUT).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start is the number of ids before the document in the whole store.

    Columns that aren't used and row groups and pages whose doc_id can't match a
    filter aren't read.
    """
    store = spark.read.schema(STORE).parquet(path)
    ends = store.groupBy("shard").agg(F.max(F.col("place") + F.col("n_tokens")).alias("size"))
    starts = ends.select("shard", (F.sum("size").over(Window.orderBy("shard")) - F.col("size")).alias("offset"))
    joined = store.join(F.broadcast(starts), "shard")  # a row for each range: a millionth of the texts' bytes
    return joined.select("doc_id", (F.col("offset") + F.col("place")).alias("start"), "n_tokens", "ids")


def read_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """(doc_id, n_tokens, ids) of some documents, by their row groups' and pages' ranges of doc_id."""
    return spark.read.schema(STORE).parquet(path).where(F.col("doc_id").isin(*ids)).select("doc_id", "n_tokens", "ids")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens) of all documents; no token is read."""
    return spark.read.schema(STORE).parquet(path).select("doc_id", "n_tokens")


def checksums(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a read store, over the little-endian bytes of each list of ids."""

    def run(batches):
        for b in batches:
            ids = b.column(3)
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write docs as a store in the shared folder and give back each document's place and checksum from the files."""
    path = shared_path(docs.sparkSession, "tokens")
    write_store(docs, path, id_col, text_col, tokenizer)
    return checksums(read_store(docs.sparkSession, path))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(load(spark, sf_dir, "documents"))

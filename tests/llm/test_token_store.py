import random
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import token_store
from tests.llm.helpers import frame, rows_of

ODD = ["", " ", "  a", "a ", "a  b", "\n a", " \nfoo bar", "x  y", "<|endoftext|> hi <|endoftext|>", "don't we'll 12 ab3  ", "é ü\tb c\n\n d", "a \x1cb", " ĠĠ Ġa bĠ Ġ", "a　 b", "tail \n"]


def tokenizer():
    made = Tokenizer.from_file(token_store.default_tokenizer())
    made.encode_special_tokens = True
    return made


def plain(rows, extra=(2,)):
    made, start, out = tokenizer(), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*made.encode(t or "", add_special_tokens=False).ids, *extra], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(token_store, "CACHED", 20)
    encode, made = token_store.Encoder(Path(token_store.default_tokenizer()).read_text()), tokenizer()
    for texts in (ODD, ["the of and the", "the of", *ODD], [f"w{k} the" for k in range(50)], ["the of and w3"]):
        assert encode(texts) == [np.array(made.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_round_trip(spark):
    df = frame(spark, [*rows_of(frame(spark)), *((1000 - k, t) for k, t in enumerate(ODD))])
    got = sorted((tuple(r) for r in token_store.encoded(df).collect()), key=lambda r: r[1])
    assert got == plain(rows_of(df))


def test_files_are_ordered_and_indexed(spark, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(frame(spark), path)
    store = spark.read.parquet(path)
    assert "ids" not in store.select("doc_id", "n_tokens").schema.names
    for part in store.select("doc_id", F.input_file_name().alias("f")).groupBy("f").agg(F.collect_list("doc_id").alias("x")).collect():
        assert list(part.x) == sorted(part.x)
    rows = frame(spark, [(k * 7919 % 1000, f"text {k} " * 40) for k in range(1000)] + [(None, "x")])
    token_store.write_store(rows, ordered := str(tmp_path / "ordered"), range_bytes=20_000)
    files = sorted(str(f) for f in Path(ordered).glob("*.parquet"))
    found = [i for f in files for i in spark.read.parquet(f).toPandas()["doc_id"].tolist()]
    assert len(files) > 8 and np.isnan(found[0]) and found[1:] == list(range(1000))
    some = token_store.read_documents(spark, ordered, [3, 500])
    assert sorted(r.doc_id for r in some.collect()) == [3, 500] and "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    assert "ids" not in token_store.read_metadata(spark, ordered)._jdf.queryExecution().executedPlan().toString()
    import pyarrow.parquet as pq

    meta = pq.read_metadata(next(str(f) for f in Path(path).glob("*.parquet")))
    column = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    ids = next(c for n, c in column.items() if n.startswith("ids"))
    assert "RLE_DICTIONARY" in ids.encodings and ids.has_column_index and ids.has_offset_index
    assert "DELTA_BINARY_PACKED" in column["doc_id"].encodings


def test_a_selective_read_touches_a_part_of_the_bytes(spark, tmp_path):
    import pyarrow.parquet as pq

    path = tmp_path / "store"
    token_store.write_store(frame(spark, [(k, f"text {k * k} and more " * 60) for k in range(3000)]), str(path), range_bytes=100_000)
    ids = meta = wanted = 0
    for f in path.glob("*.parquet"):
        m = pq.read_metadata(str(f))
        for g in range(m.num_row_groups):
            columns = [m.row_group(g).column(i) for i in range(m.num_columns)]
            own = {c.path_in_schema.split(".")[0]: c for c in columns}
            ids += own["ids"].total_compressed_size
            meta += own["doc_id"].total_compressed_size + own["n_tokens"].total_compressed_size
            wanted += own["ids"].total_compressed_size * (own["doc_id"].statistics.min <= 77 <= own["doc_id"].statistics.max)
    assert 0 < wanted < ids / 8 and meta < ids / 3


def test_words_are_cut_as_the_pre_tokenizer_cuts_them():
    rng = random.Random(1)
    letters = ["a", "B", "z", "é", "ß", "Ñ", "ж", "'", "'s", "'re", "'ll", "'t", " ", " ", "\n", "\n", "\t", "1", "23", "!", "-", ".", "…", "“", "×", "÷", "\xa0", "日", "\x1c", "\x00", "’", "ǀ", "👍", "'S", "İ"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    encode, made = token_store.Encoder(Path(token_store.default_tokenizer()).read_text()), tokenizer()
    want = [np.asarray(e.ids, "<u4").tobytes() for e in made.encode_batch_fast(texts, add_special_tokens=False)]
    assert encode(texts) == want
    data, ends = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([len(t.encode()) for t in texts])
    assert 0.2 < token_store.cut(data, ends)[1].mean() < 0.5


def test_empty_table(spark):
    assert token_store.encoded(frame(spark, [])).count() == 0

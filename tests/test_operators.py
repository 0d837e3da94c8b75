"""Cases that tables alone don't hold."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from quern.functions import text as X
from quern.operators import dedup, search, sequences, splits
from quern.sources import sinks


def test_code_keeps_its_layout(spark):
    code = "def f():\r\n\tif x:\r\n        return  'a  b'\r"
    df = spark.createDataFrame([("code", code), ("prose", "a   b\r\n")], "kind string, c string").select(X.normalize(F.col("kind"), F.col("c")).alias("o"))
    assert [r.o for r in df.collect()] == ["def f():\n\tif x:\n        return  'a  b'\n", "a b\n"]


def test_fences_are_kept(spark):
    df = spark.createDataFrame([("a   b```x   y```c   d",)], "c string").select(X.norm_markdown(F.col("c")).alias("o"))
    assert df.first().o == "a b```x   y```c d"


def test_luhn(spark):
    df = spark.createDataFrame([("4539578763621486",), ("4539578763621487",)], "c string").select(X.luhn(F.col("c")).alias("o"))
    assert [r.o for r in df.collect()] == [True, False]


def test_unicode_is_composed(spark):
    assert spark.createDataFrame([("e\u0301",), (None,)], "c string").select(X.norm_unicode("c").alias("o")).collect()[0].o == "é"


def test_clusters_of_a_chain_and_a_ring(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(20, 21), (21, 22), (20, 22)], "a long, b long")
    got = {r.node: r.root for r in dedup.clusters(pairs).collect()}
    assert got == {**dict.fromkeys(range(1, 13), 1), 20: 20, 21: 20, 22: 20}


def test_planted_contamination_fails_and_clean_data_passes(spark):
    rows = [(1, "one two", "train"), (2, "One, two!", "test"), (3, "three", "train")]
    got = {r.chk: r.verdict for r in splits.verdict(spark.createDataFrame(rows, "id int, text string, split string")).collect()}
    assert got == {"exact": "PASS", "normalized": "FAIL"}


def test_groups_do_not_straddle_splits(spark):
    df = spark.range(400).withColumn("g", F.concat(F.lit("g"), F.col("id") % 40)).withColumn("split", splits.assign(F.col("g")))
    assert df.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n != 1").count() == 0


def test_global_rank_is_dense(spark):
    df = spark.range(1000).withColumn("h", F.md5(F.col("id").cast("string"))).repartition(7)
    assert sorted(r.pos for r in splits.global_rank(df, ["h", "id"], "pos").collect()) == list(range(1, 1001))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "tool_result", "final"]), st.integers(0, 6)), min_size=1, max_size=6))
def test_masks_cover_targets_only(spark, segments):
    df = spark.createDataFrame([(1, i, k, n) for i, (k, n) in enumerate(segments)], "record_id int, ord int, kind string, n int")
    mask = sequences.pad(sequences.segment_mask(df, ["final"]), 20).first()
    assert sum(mask.mask) == sum(n for k, n in segments if k == "final")
    assert len(mask.padded) == max(20, sum(n for _, n in segments)) and sum(mask.padded) == sum(mask.mask)


def test_wrong_answers_are_rejected(spark):
    made = sequences.arithmetic(spark, 50).withColumn("answer", F.col("answer") + F.when(F.col("id") % 5 == 0, 1).otherwise(0))
    assert sequences.verify_arithmetic(made).where("accepted").count() == 40


def test_versions_roll_back_and_ids_are_not_overwritten(spark, tmp_path):
    root = str(tmp_path / "data")
    for v, n in (("v1", 3), ("v2", 5)):
        sinks.commit_version(spark.range(n), root, v)
    assert sinks.read_version(spark, root).count() == 5
    sinks.set_version(spark, root, "v1")
    assert sinks.read_version(spark, root).count() == 3
    sinks.append_log(spark, str(tmp_path / "log"), {"experiment": "e", "loss": 1.0})
    try:
        sinks.append_log(spark, str(tmp_path / "log"), {"experiment": "e", "loss": 2.0})
        raise AssertionError("an experiment was overwritten")
    except Exception as e:
        assert "PATH_ALREADY_EXISTS" in str(e)


def test_ties_are_counted_among_all_documents(spark, tmp_path):
    n = 100_300
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit("the data of a model").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["search_tiebreak"](spark, str(tmp_path)).collect()
    assert got and {(r.first, r.n) for r in got} == {(0, n)}
    best = search.bm25(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.createDataFrame([(1, "data")], "query_id int, query string"), 3)
    assert sorted((r.doc_id, r.rank) for r in best.collect()) == [(0, 1), (1, 2), (2, 3)]


def test_similar_ids_of_copies_blocks_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 8)
    monkeypatch.setattr(dedup, "ROWS_PER_BUCKET", 30)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[: 50 - k % 7], f"own{k % 23}"])) for k in range(70)]  # one group of several blocks, with copies
    rows += [(200, " ".join(base[:40])), (200, "five other words stand here"), (None, rows[0][1]), (300, None), (301, "too short"), (302, "too short"), (303, "a b c d e"), (304, "A b, c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shingles, sets = dedup.shingle_rows(df).where("doc_id IS NOT NULL"), {}
    for r in shingles.collect():
        sets.setdefault(r.doc_id, set()).add(r.h)
    met = [(r.a, r.b, round(len(sets[r.a] & sets[r.b]) / len(sets[r.a] | sets[r.b]), 9)) for r in dedup.lsh_pairs(dedup.min_hashes(shingles)).collect()]
    for least in (0.5, 0.8):
        pairs = sorted(p for p in met if p[2] >= least)
        assert sorted(map(tuple, dedup.similar_ids(df, least).collect())) == pairs and (303, 304, 1.0) in pairs
        roots = {r.node: r.root for r in dedup.clusters(spark.createDataFrame([p[:2] for p in pairs], "a long, b long")).collect()}
        assert {r.node: r.root for r in dedup.similar_clusters(df, least).collect()} == roots


def test_copies_are_not_compared_with_each_other(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(dedup, "clusters", lambda pairs, own=dedup.clusters: sent.append(pairs.count()) or own(pairs))
    text = "one text that many rows hold word by word"
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    assert {(r.node, r.root) for r in dedup.similar_clusters(df, 0.8).collect()} == {(k, 0) for k in range(3000)}
    assert sent == [0, 2999]

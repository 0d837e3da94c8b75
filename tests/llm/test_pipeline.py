"""The pipeline on a small folder with planted cases, stage by stage against plain Python."""

import collections
import random

import corpus_pipeline
from quern.llm import mixing, quality
from tests.llm.test_other_operators import plain_contamination, plain_quality, plain_targets
from tests.llm.test_token_store import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(3, 8))) for _ in range(2500)]
    make = lambda n: " ".join(rng.choice(words) if rng.random() < 0.7 else rng.choice(["the", "of", "and", "to", "in", "a", "is"]) for _ in range(n)).capitalize() + "."
    items = [(k, make(25)) for k in range(6)]
    docs = {k: make(rng.randint(120, 300)) for k in range(120)}
    docs |= {200: "too short", 201: "", 202: None, 203: "again and again " * 80, 204: docs[3], 205: docs[3], 206: docs[4].replace(docs[4].split()[40], "edited", 1), 207: docs[5] + " and a little more."}
    docs |= {210: make(150) + " " + items[0][1], 211: items[1][1] + " " + make(100), 212: make(4000) + " " + items[2][1]}
    return [(i, t, rng.choice(["en", "en", "en", "fr", None]), f"s{0 if k % 3 == 0 else k % 7}" if k % 11 else None, len(t or "")) for k, (i, t) in enumerate(docs.items())], items


def test_stages(spark, tmp_path):
    docs, items = planted()
    folder = str(tmp_path)
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    text, source = {d[0]: d[1] for d in docs}, {d[0]: d[3] for d in docs}
    df, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, folder).write.parquet(f"{folder}/stage{k}")
        df = spark.read.parquet(f"{folder}/stage{k}")
        if k < 4:
            assert df.schema == spark.createDataFrame([], SCHEMA).schema
            out.append(sorted(r.doc_id for r in df.collect()))
    assert out[0] == sorted(i for i in text if not plain_quality(text[i])[5])
    assert set(out[0]) >= set(range(120)) and not set(out[0]) & {200, 201, 202, 203}
    assert out[1] == [i for i in out[0] if i not in (204, 205, 206, 207)]
    judged = {r[0]: r[4] for r in plain_contamination([(i, text[i]) for i in out[1]], items)}
    assert out[2] == [i for i in out[1] if not judged[i]] and judged[210] and judged[211] and not judged[212]
    sizes, order = collections.Counter(), collections.defaultdict(list)
    for r in mixing.sizes(spark.read.parquet(f"{folder}/stage2")).collect():
        sizes[r.source] += r.size
        order[r.source].append((r.key, r.id, r.size))
    want = []
    for s, target in plain_targets(sizes).items():
        epochs = min(3, int(target // sizes[s]))
        before, budget = 0, target - epochs * sizes[s]
        for _, i, n in sorted(order[s]):
            want += [i] * (epochs + (budget > 0 and 2 * before + n <= 2 * budget))
            before += n
    assert out[3] == sorted(want) and all(source[i] is None or source[i] in sizes for i in want)
    assert sorted((tuple(r) for r in df.collect()), key=lambda r: r[1]) == plain([(i, text[i]) for i in out[3]])
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, df.collect()))


def test_rows_that_share_an_id_are_judged_each_for_itself(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghik") for _ in range(6))
    make = lambda n: " ".join(word() if k % 3 else "the" for k in range(n))
    good, other, item = make(90), make(80), make(30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for i in (5, None):
        docs = [(i, t, "en", "s", len(t)) for t in (good, "too short", other, f"{item} {make(60)}")]
        df = corpus_pipeline.quality_rules(spark, spark.createDataFrame(docs, SCHEMA), str(tmp_path))
        assert sorted(r.text for r in df.collect()) == sorted(d[1] for d in docs if d[1] != "too short")
        clean = corpus_pipeline.benchmark_decontamination(spark, df, str(tmp_path))
        assert sorted(r.text for r in clean.collect()) == sorted([good, other])


def test_the_quality_stage_keeps_no_copy_of_the_texts(spark, monkeypatch):
    made = []
    monkeypatch.setattr(quality, "materialise", lambda df, label: made.append(label) or df)
    kept = quality.filtered(spark.createDataFrame(planted()[0], SCHEMA)).collect()
    assert 119 < len(kept) < 130 and not made

"""Decontamination, mixing, quality, WARC, HTML and toxicity against plain Python or planted cases."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import decontam, html_text, mixing, quality, toxicity, warc
from tests.llm.helpers import frame, rows_of, texts

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}

# --- decontamination -------------------------------------------------------


def plain_contamination(docs, items):
    grams = collections.defaultdict(set)
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else []:
            grams[tuple(w[i : i + n])].add(None if item is None else str(item))
    out = []
    for i, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    found |= grams[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), sorted(found, key=lambda x: (x is None, x)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [150_000, 40])
def test_contamination(spark, block):
    df = frame(spark)
    rng, docs = random.Random(5), [t for t in texts() if t and len(t.split()) > 15]
    items = [(k, " ".join(rng.choice(docs).split()[j : j + n])) for k, (j, n) in enumerate([(0, 13), (3, 20), (5, 4), (1, 1), (2, 12), (0, 30), (4, 13), (6, 2)])]
    items += [(100, "nowhere to be found"), (101, ""), (102, None), (None, "the of and"), (None, "the the THE"), (103, items[1][1]), (104, "a " * 40), (105, "a b " * 10), (7, items[0][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    got = decontam.with_verdict(decontam.contamination(df, bench, block_words=block)).collect()
    want = plain_contamination(rows_of(df), items)
    assert sorted(((r.row_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got), key=str) == want
    assert sum(r[4] for r in want) > 3 and any(None in r[3] for r in want)


def test_many_blocks_are_held_one_at_a_time(spark):
    words = [f"w{k}" for k in range(900)]
    items = [(None if k % 9 == 4 else k, " ".join(words[k * 30 : k * 30 + 30])) for k in range(30)]
    df = frame(spark, [(k, f"x y {t} z") for k, (_, t) in enumerate(items)] + [(90, "x y z")])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.row_id: (r.n_hit, list(r["items"])) for r in decontam.with_verdict(decontam.contamination(df, bench, block_words=60)).collect()}
    assert got == {k: (30, [None if i is None else str(i)]) for k, (i, _) in enumerate(items)} | {90: (0, [])}
    blocks = decontam.blocks_of(bench, "item_id", "text", 60)
    assert 30 > len(next(blocks)) and sum(map(len, blocks)) < 30
    clean = decontam.decontaminate(df.withColumn("spans", F.lit("mine")), bench, block_words=60)
    assert clean.columns == [*df.columns, "spans"] and [(r.doc_id, r.spans) for r in clean.collect()] == [(90, "mine")]


def test_spans_are_cut_and_empty_benchmarks_hit_nothing(spark):
    df = frame(spark, [(1, "Alpha, beta gamma! delta tail " + "x " * 200), (2, None), (3, "beta gamma delta")])
    bench = spark.createDataFrame([(1, "beta GAMMA delta")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontam.decontaminate(df, bench, min_span=3).collect()}
    assert got == {1: "Alpha,  tail " + "x " * 200, 2: None}
    assert decontam.decontaminate(df, bench.where("false")).count() == 3
    assert decontam.contamination(frame(spark, []), bench).count() == 0


# --- mixing ----------------------------------------------------------------


def plain_targets(sizes):
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = {k: w for k, w in weight.items() if k not in capped}
        left = total - sum(capped.values())
        share = {k: left * w / sum(free.values()) for k, w in free.items()}
        over = {k: 3.0 * sizes[k] for k, v in share.items() if v > 3 * sizes[k]}
        if not over:
            return {**capped, **share}
        capped.update(over)


@pytest.mark.parametrize("range_rows", [50_000, 7])
def test_mixing(spark, range_rows):
    df = frame(spark)
    sized = mixing.sizes(df).persist()
    rows = sized.collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += r.size
    plan = {r.source: r for r in mixing.cuts(sized, range_rows=range_rows).collect()}
    for source, target in plain_targets(sizes).items():
        assert plan[source].target == pytest.approx(target) and plan[source].source_size == sizes[source]
        taken = sum(r.size * plan[source].epochs for r in rows if r.source == source)
        cut = plan[source].cut
        extra = [r for r in rows if r.source == source and cut and (r.key, r.id if r.id is not None else -(1 << 63)) <= (cut.key, cut.id)]
        taken += sum(r.size for r in extra)
        assert abs(taken - target) <= max(r.size for r in rows if r.source == source)
        assert plan[source].epochs + bool(extra) <= 3


def test_mix_repeats_rows_and_keeps_columns(spark):
    df = frame(spark)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    counts = collections.Counter(r.doc_id for r in mixed.collect())
    assert 1 < max(counts.values()) <= 9 and set(counts) < {r.doc_id for r in df.collect()}
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    assert mixing.mix(frame(spark, [])).count() == 0


# --- quality ---------------------------------------------------------------


def plain_quality(text):
    text = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(grams)
    repeat = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), len(w) < 50 or 100 * len(repeat) > 50 * len(w)


@pytest.mark.parametrize("bits", [24, 5])
def test_quality_counts(spark, monkeypatch, bits):
    monkeypatch.setattr(quality, "PLACE_BITS", bits)
    rows = [*rows_of(frame(spark)), (900, "a b c\na b c\n# $x <y> a|b & * %"), (901, "a a a a a a"), (902, "a b a b a b c"), (903, "x\r\ny\r\nx\r\n \n \n")]
    got = quality.quality(frame(spark, rows)).collect()
    want = [(i, *plain_quality(t)) for i, t in rows]
    assert sorted(((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == sorted(want, key=str)
    assert all(not r.kept for r in got if r.base_failed)


def test_distances_tell_junk_from_language(spark):
    rng = random.Random(1)
    make = lambda: " ".join(rng.choice(["the", "of", "and", "house", "river", "Stone.", "walking", "in", "was"]) for _ in range(120))
    junk = " ".join(f"{rng.randrange(10**6)}#{rng.randrange(99)}$" for _ in range(120))
    df = spark.createDataFrame([(i, make() + f" w{i}", "en") for i in range(30)] + [(99, junk, "en"), (100, junk, "zz")], "doc_id long, text string, lang string")
    found = {r.id: r for r in quality.judged(quality.features(df), quality.references(quality.features(df))).collect()}
    assert found[99].class_distance > quality.MAX_CLASS_DISTANCE > max(found[i].class_distance for i in range(30))
    assert not found[99].kept and found[100].kept
    p, q = np.array(list(found[0].classes)) / sum(found[0].classes), np.array(quality.references(quality.features(df))["en"][0], float)
    q /= q.sum()
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    assert found[0].class_distance == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2))


def test_quality_without_references(spark):
    df = spark.createDataFrame([(1, "word " * 10 + " ".join(map(str, range(60))), "xx")], "doc_id long, text string, lang string")
    assert quality.quality(df).first().kept
    assert quality.quality(df.where("false")).count() == 0


# --- WARC ------------------------------------------------------------------

PAGES = [(5, "http://www.A.example.com:80/x?q=1#f", "<p>é</p>"), (2, "https://a.example.com/x", "<p>é</p>"), (7, None, None), (9, "http://b.org", ""), (1, "http://b.org/1", "WARC/1.1\r\n\r\nbody\r\n\r\nWARC/1.1\r\n"), (3, "http://c\r\n/", "x" * 100_000), (3, "http://c/2", "x" * 100_000), (None, "http://n", "<p>é</p>")]


def test_archives_round_trip(spark, monkeypatch, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = str(tmp_path / "warc")
    warc.write_archives(warc.records(pages), path, per_archive=2)
    got = warc.merge_index(warc.read_archives(spark, path).persist(), per_range=3).collect()
    for r in got:
        data = (tmp_path / "warc" / r.archive).read_bytes()[r.position : r.position + r.length]
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and data.endswith(b"\r\n\r\n")
    assert warc.records_per_archive(pages, most_bytes=250_000) == 2 and warc.records_per_archive(pages, archive_bytes=1) == 1
    least = {}
    for i, _, h in PAGES:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        data, first = (h or "").encode(), least[h or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), digest, *(("response", None) if i == first else ("revisit", first))))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    order = [(r.url_key, r.captured_at) for r in sorted(got, key=lambda r: (r.index_part, r.index_place))]
    assert order == sorted(order)


def test_loser_tree():
    rng = random.Random(3)
    row = lambda: (rng.randrange(50), 0, "", "", None, rng.choice("abc"), str(rng.randrange(3)), "", 0, 0)
    for k in range(8):
        runs = [sorted((row() for _ in range(rng.randrange(6))), key=warc._order) for _ in range(k)]
        assert [warc._order(r) for r in warc.loser_tree_merge(runs)] == sorted(warc._order(r) for x in runs for r in x)
    rows = [row() for _ in range(30)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:j], strict=True), warc._types(), strict=True)], names=warc._names()) for i, j in ((0, 1), (1, 17), (17, 30))]
    runs = [list(warc.stream(x)) for x in warc.natural_runs(batches)]
    assert [r for x in runs for r in x] == rows and all(x == sorted(x, key=warc._order) for x in runs)
    assert all(warc._order(y[0]) < warc._order(x[-1]) for x, y in zip(runs, runs[1:], strict=False))


def test_archives_of_no_pages(spark, tmp_path):
    path = str(tmp_path / "none")
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.records(none), path, warc.records_per_archive(none))
    assert warc.read_archives(spark, path).count() == 0


# --- HTML ------------------------------------------------------------------

HTML = [
    ("<header>Site</header><nav><a>x</a></nav><article><h1>T &amp; U</h1><p>one\n two<br>three<p>four</article><footer>f</footer>", "T & U\n\none two three\n\nfour"),
    ("<div class='sidebar'><p>no</p></div><main><p>yes<script>var a='</p><p>';</script></p><form>no</form></main><section id=comments><p>reader said</section>", "yes"),
    ("<article><p>a</p><div class='ad-box'>buy</div><!-- <p>x</p> --><p>b&nbsp;c</p></article>", "a\n\nb c"),
    (None, ""), ("", ""), ("<article>", ""), ("<article><p>open <b>and", "open and"), ("<article><p a='>' b=\"<p>\">q</p><p>1 < 2</p>", "q\n\n1 < 2"), ("<!-- never closed <p>x</p>", ""),
    ("<div class=cookie-notice>We use cookies " + "c " * 40 + "</div><article><style>p{}</style><p>short</p></article>", "short"),
]


def test_main_text(spark):
    df = spark.createDataFrame([(i, "u", h, "clash") for i, (h, _) in enumerate(HTML)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(df).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(HTML)}


def test_the_tree_fits_pages_it_has_not_seen():
    tree = html_text.tree()
    for seed in (1, 2, 3):
        rows, labels = html_text.labelled_table(seed, 300)
        right = [int(html_text.decide(tree, r)) == y for r, y in zip(rows, labels, strict=True)]
        assert sum(right) >= 0.99 * len(right)


def test_the_tree_asks_for_link_density():
    def asked(t):
        return {html_text.FEATURES[t[0]]} | asked(t[2]) | asked(t[3]) if isinstance(t, tuple) else set()

    assert {"link_density", "link_density_before", "link_density_after", "words", "words_before", "words_after"} <= asked(html_text.tree())


def w(n):
    return " ".join(["word"] * n)


@pytest.mark.parametrize("name", ["reader-view", "search-page", "response", "tags", "widget", "x"])
def test_a_name_alone_drops_no_main_text(name):
    assert html_text.main_text(f'<div class="{name}"><p>{w(140)}</p><p>{w(140)}</p></div>', html_text.tree()) == f"{w(140)}\n\n{w(140)}"


def test_link_lists_short_endings_and_formulas():
    tree = html_text.tree()
    assert html_text.main_text("<ul>" + "".join(f"<li><a href=/{k}>link {k}</a></li>" for k in range(30)) + "</ul>", tree) == ""
    assert html_text.main_text(f"<div><p>{w(80)}</p><p>{w(20)}</p><p>Short closing.</p></div>", tree) == f"{w(80)}\n\n{w(20)}\n\nShort closing."
    page = f"<article><p>{w(60)}</p><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds <object>here</object></p></article>"
    assert html_text.main_text(page, tree) == f"{w(60)}\n\nso x=2 holds here"


def test_pages_without_id_and_repeated_pages(spark):
    schema = "page_id long, url string, html string, words int"
    rows = [(None, None, "<article><p>a</p></article>", 1), (3, "u", "<article><p>a</p></article>", 2), (3, "u", "<article><p>a</p></article>", 2)]
    got = [tuple(r) for r in html_text.extract(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=str) == sorted([(None, None, "a", 1), (3, "u", "a", 1), (3, "u", "a", 1)], key=str)
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


# --- toxicity --------------------------------------------------------------


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    s, moves, start = rng.normal(size=(4, 1)), rng.normal(size=(2, 2)), 0.3
    weight = {}
    for z in range(16):
        y = [z >> t & 1 for t in range(4)]
        weight[tuple(y)] = np.exp(start * y[0] + sum(s[t, 0] * y[t] for t in range(4)) + sum(moves[y[t], y[t + 1]] for t in range(3)))
    want = [sum(w for y, w in weight.items() if y[t]) / sum(weight.values()) for t in range(4)]
    assert toxicity.forward_backward(s, np.array([4]), moves, start)[:, 0] == pytest.approx(want)


def test_pair_marginals_are_the_gradient_of_the_chains_normaliser():
    rng = np.random.default_rng(1)
    n, moves, start = np.array([5, 3, 1]), rng.normal(size=(2, 2)), -0.2
    s = np.where(np.arange(5)[:, None] < n, rng.normal(size=(5, 3)), 0)

    def normaliser(m):
        total = 0.0
        for k in range(3):
            z = 0.0
            for bits in range(1 << n[k]):
                y = [bits >> t & 1 for t in range(n[k])]
                z += np.exp(start * y[0] + sum(s[t, k] * y[t] for t in range(n[k])) + sum(m[y[t], y[t + 1]] for t in range(n[k] - 1)))
            total += np.log(z)
        return total

    got = toxicity.pair_sums(s, n, moves, *toxicity.messages(s, n, moves, start))
    for i in (0, 1):
        for j in (0, 1):
            step = np.zeros((2, 2))
            step[i, j] = 1e-5
            assert got[i, j] == pytest.approx((normaliser(moves + step) - normaliser(moves - step)) / 2e-5, abs=1e-6)
    assert got.sum() == pytest.approx(6)


def test_toxicity_of_an_empty_table(spark):
    empty = frame(spark, [])
    field = toxicity.fit(toxicity.training_rows(empty, spark.createDataFrame([], "doc_id long, toxic int")))
    assert toxicity.tag(empty, field).count() == 0


def test_planted_words_are_found(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def make(toxic):
        w = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["Vilest", "vilely", "rotten"])
        return " ".join(w)

    labels = [(i, int(i % 6 == 0)) for i in range(600)]
    rows = [(i, make(y)) for i, y in labels]
    df = frame(spark, rows + [(5000, None), (5001, ""), (5002, "So vilest, rotten\nend")])
    known = spark.createDataFrame(labels + [(None, 1), (7777, None)], "doc_id long, toxic int")
    field = toxicity.fit(toxicity.training_rows(df, known))
    got = {r.id: r for r in toxicity.tag(df, field).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i].score >= 0.3) == bool(y) for i, y in held) >= 0.97 * len(held)
    assert got[5000].score == got[5001].score == 0 and not got[5000].spans
    assert list(got[5002].spans) == [3, 17]
    assert df.select(toxicity.held_out(F.col("doc_id")).alias("h")).where("h is null").count() == 0


def test_no_toxic_labels_make_everything_clean(spark):
    field = toxicity.fit([("some text", 0)])
    assert toxicity.tag(frame(spark), field).where("score >= 0.3").count() == 0


def test_the_stage_drops_long_texts_without_common_words(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfghklm") for _ in range(6))
    prose = lambda: " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.2 else word() for _ in range(150))
    rows = [(i, prose(), "en") for i in range(30)] + [(99, " ".join(word() for _ in range(150)), "en"), (100, " ".join(word() for _ in range(150)), "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in quality.filtered(df).collect()) == [*range(30), 100]

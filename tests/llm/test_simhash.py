import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from quern.llm import components, simhash
from quern.llm.components import connected_components
from tests.llm.helpers import frame, rows_of


def plain_components(ids, prints, radius=2):
    distinct = sorted(set(prints))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for i, f in zip(ids, prints, strict=True):
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [least.get(find(f)) for f in prints]


def plain_fingerprint(text, k):
    import xxhash

    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    v = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("shingle", [3, 5])
def test_documents(spark, monkeypatch, shingle):
    monkeypatch.setattr(simhash, "BLOCK", 37)
    df = frame(spark)
    got = simhash.near_duplicates(df, shingle=shingle).collect()
    want = [(i, plain_fingerprint(t, shingle)) for i, t in rows_of(df)]
    assert sorted(((r.id, r.fp) for r in got), key=str) == sorted(want, key=str)
    assert [r.component_id for r in got] == plain_components([r.id for r in got], [r.fp for r in got])


def test_links_of_dense_and_random_fingerprints(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)] + [0, -1, 1 << 62, -(1 << 63)]
    prints = set(base)
    for b in base[:12] + [0, -1]:
        for _ in range(12):
            x = b & (2**64 - 1)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            prints.add(x - 2**64 if x >> 63 else x)
    prints = sorted(prints)
    links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    for r in links.collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() in (1, 2)
    roots = {r.node: r.root for r in connected_components(links, "a", "b").collect()}
    got = [roots.get(p, p) for p in prints]
    want = plain_components(list(range(len(prints))), prints)
    group = lambda xs: {x: tuple(i for i, y in enumerate(xs) if y == x) for x in xs}
    assert sorted(group(got).values()) == sorted(group(want).values())


def test_one_document_of_each_group_stays(spark):
    rows = [(4, "a b c d e f g"), (2, "A b c d e f g"), (9, "something else altogether here now"), (9, "something else altogether here now"), (3, None), (5, "")]
    df = frame(spark, rows)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 9]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 300: 100}


@pytest.mark.parametrize("block", [1, 50, 400, 1 << 19])
def test_components_of_any_block(spark, monkeypatch, block):
    import random

    rng = random.Random(9)
    pairs = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)]
    pairs += [(1000 + k, 5000 - k) for k in range(60)] + [(5000 - k, 1001 + k) for k in range(60)]  # a path of alternating small and large nodes
    pairs += [(9000, 9000 - k) for k in range(1, 80)]  # a hub above all that hang on it
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in root:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    monkeypatch.setattr(components, "BLOCK", block)
    got = connected_components(spark.createDataFrame([*pairs, (None, 1), (2, None)], "a long, b long"), "a", "b").collect()
    assert len(got) == len(root) and {r.node: r.root for r in got} == root


def test_edges_of_a_block_take_no_rounds(spark, monkeypatch):
    stored, plain = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **b: stored.append(plain(self, *a, **b)) or stored[-1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(3000)], "a long, b long")
    assert {r.root for r in connected_components(edges, "a", "b").collect()} == {0}
    assert len(stored) == 2 and stored[1].rdd.getNumPartitions() == 1


def test_the_stage_drops_shuffles_before_each_search(spark, monkeypatch):
    calls, plain = [], connected_components
    monkeypatch.setattr(simhash, "drop_shuffles", lambda s: calls.append("drop"))
    monkeypatch.setattr(simhash, "connected_components", lambda *a: calls.append("components") or plain(*a))
    simhash.similar_groups(frame(spark, [(1, "a b c d e f g"), (2, "A b c d e f g")]))
    at = [k for k, c in enumerate(calls) if c == "components"]
    assert at and calls[0] == "drop" and all(calls[k - 1] == "drop" for k in at)


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_nothing_that_grows_with_the_table_is_broadcast(spark, monkeypatch):
    plans, plain = [], DataFrame.checkpoint

    def spied(self, *a, **b):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return plain(self, *a, **b)

    monkeypatch.setattr(DataFrame, "checkpoint", spied)
    found = simhash.near_duplicates(frame(spark), shingle=3)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 2 and any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]


def test_near_copies_of_the_stage(spark):
    import random

    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(3000)]
    rows, pairs = [], []
    for k in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(120, 400))]
        v = list(w)
        for _ in range(1 + len(w) // 100 * (k % 3)):
            v[rng.randrange(len(v))] = "edited"
        grams = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, v)]
        pairs.append((k, len(grams[0] & grams[1]) / len(grams[0] | grams[1])))
        rows += [(k, " ".join(w)), (1000 + k, " ".join(v))]
    found = {r.id: r.component_id for r in simhash.similar_groups(frame(spark, rows)).collect()}
    high = [k for k, j in pairs if j >= 0.83]
    assert len(high) > 30 and sum(found[1000 + k] == k for k in high) >= 0.95 * len(high)
    assert all(found[k] == k for k in range(60))
    assert all(found[1000 + k] == 1000 + k for k, j in pairs if j < 0.75)


def edited(words, n, rng):
    """The words with n of them replaced, far from each other, so that each takes five shingles."""
    out = list(words)
    for at in rng.sample(range(5, len(words) - 5, 6), n):
        out[at] = f"x{rng.randrange(10**9)}"
    return out


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_every_pair_at_the_threshold_is_linked_and_none_below(spark):
    import random

    rng, rows, want = random.Random(3), [], {}
    for k in range(300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(364)]
        near = edited(base, 8 if k % 2 else 9, rng)
        rows += [(k, " ".join(base)), (1000 + k, " ".join(near))]
        want[k] = jaccard(base, near) >= 0.8
    assert 100 < sum(want.values()) < 200
    found = {r.id: r.component_id for r in simhash.similar_groups(frame(spark, rows)).select("id", "component_id").collect()}
    assert {k: found[1000 + k] == k for k in want} == want


def test_copies_alike_only_through_a_hub_are_one_group(spark):
    import random

    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    copies = [edited(base, 6, rng) for _ in range(300)]
    assert min(jaccard(base, c) for c in copies) >= 0.8 and jaccard(copies[0], copies[1]) < 0.8
    rows = [(k, " ".join(c)) for k, c in enumerate(copies)] + [(999, " ".join(base))]
    assert [r.doc_id for r in simhash.deduplicate(frame(spark, rows)).collect()] == [0]


@pytest.mark.parametrize("before", [0, 1, 8])
def test_pairs_are_the_same_wherever_they_are_made(spark, monkeypatch, before):
    import random

    monkeypatch.setattr(simhash, "DRAWS", 0)
    monkeypatch.setattr(simhash, "BEFORE", before)
    rng, rows, sets = random.Random(6), [], []
    for g in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for _ in range(12):
            sets.append(edited(base, rng.randint(2, 6), rng))
            rows.append((len(rows), " ".join(sets[-1])))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    root = list(range(len(rows)))
    for _ in rows:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    got = {r.id: r.component_id for r in simhash.similar_groups(frame(spark, rows)).select("id", "component_id").collect()}
    assert 6 < len(set(root)) < len(rows) and [got[k] for k in range(len(rows))] == root


def test_each_row_is_decided_by_its_own_text(spark):
    alone = [f"{name} is all that this {name} text of {name} has to say" for name in ("alpha", "beta", "gamma", "delta")]
    rows = [(None, alone[0]), (None, alone[1]), (None, alone[1]), (7, alone[2]), (7, alone[3]), (1, "the shared text of three rows"), (7, "the shared text of three rows"), (None, "the shared text of three rows")]
    kept = sorted(((r.doc_id, r.text) for r in simhash.deduplicate(frame(spark, rows)).collect()), key=str)
    assert kept == sorted([(None, alone[0]), (None, alone[1]), (7, alone[2]), (7, alone[3]), (1, rows[5][1])], key=str)


def test_the_stage_takes_its_first_links_from_the_grid(spark, monkeypatch):
    import random

    rng, rows, asked, plain = random.Random(5), [], [], simhash.links
    for k in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        rows += [(k, " ".join(base)), (100 + k, " ".join([*base, "end"])), (200 + k, " ".join(edited(base, 7, rng)))]
    # the same counts of few shingles: equal fingerprints of sets that have little in common
    rows += [(300, " ".join(["p q r s t"] * 60)), (301, " ".join(["p q r s t"] * 60) + " " + " ".join(f"v{k}" for k in range(40)))]
    monkeypatch.setattr(simhash, "links", lambda prints: asked.append({r.fp for r in prints.collect()}) or plain(prints))
    monkeypatch.setattr(simhash, "_may_link", lambda *a: F.lit(False))
    alone = {r.id: r.component_id for r in simhash.similar_groups(frame(spark, rows)).collect()}
    assert asked == [{plain_fingerprint(t, 5) for _, t in rows}]
    bits = lambda i, j: ((plain_fingerprint(dict(rows)[i], 5) ^ plain_fingerprint(dict(rows)[j], 5)) & (2**64 - 1)).bit_count()
    near = [k for k in range(12) if bits(k, 100 + k) <= 2]
    assert len(near) > 8 and all(alone[100 + k] == k for k in near)
    assert bits(300, 301) <= 2 and alone[301] == 301  # the exact check follows
    monkeypatch.undo()
    whole = {r.id: r.component_id for r in simhash.similar_groups(frame(spark, rows)).collect()}
    assert all(whole[i] == i % 100 for i, _ in rows[:36]) and whole[301] == 301

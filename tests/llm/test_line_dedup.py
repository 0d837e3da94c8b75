import types

import numpy as np
import pyarrow as pa

from quern.llm import line_dedup
from tests.llm.helpers import frame, rows_of

LAST = line_dedup.LAST


def brute(rows, t=0.8):
    lines = [(LAST if i is None else i, k, frozenset(w)) for i, text in rows for k, w in enumerate(line_dedup.line_words((text or "").encode()))]
    first = {}
    for i, k, s in lines:
        if s:
            first[s] = min(first.get(s, (i, k)), (i, k))
    alike = {s: [x for x in first if x != s and len(x & s) * 5 >= 4 * len(x | s)] for s in first}
    out = {}
    for i, k, s in lines:
        at = min([first[s], *(first[x] for x in alike[s])]) if s else None
        own = out.setdefault(i, [i, 0, 0, 0])
        own[0] = min(own[0], at[0] if s else i)
        own[1] += 1
        own[2] += bool(s) and at < (i, k)
        own[3] += len(alike[s]) if s else 0
    return {(None if i == LAST else i): (None if v[0] == LAST else v[0], *v[1:]) for i, v in out.items()}


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PAIRS", 50)
    df = frame(spark)
    got = line_dedup.per_document(line_dedup.matched_lines(df, bytes_per_bucket=2000)).collect()
    want = brute(rows_of(df))
    assert {r.id: (r.class_id, r.n_lines, r.n_removed, r.n_links) for r in got} == want
    assert sum(v[3] for v in want.values()) > 20


def test_large_groups_are_verified_in_blocks(monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 3)
    rng = np.random.default_rng(3)
    word = np.uint64(5)
    sets = []
    for _ in range(25):
        early = rng.choice(4, rng.integers(0, 3), replace=False).astype(np.uint64)
        sets.append(np.concatenate([np.sort(early), [word], np.sort(rng.choice(np.arange(6, 16), rng.integers(6, 10), replace=False)).astype(np.uint64)]))
    links, best = line_dedup.similar(sets, word, np.arange(25), 0.7)
    for a in range(25):
        mates = [b for b in range(25) if b != a and min(set(sets[a].tolist()) & set(sets[b].tolist())) == 5 and len(np.intersect1d(sets[a], sets[b])) >= 0.7 * len(np.union1d(sets[a], sets[b])) - 1e-9]
        assert links[a] == len(mates)
        assert not mates or best[a] == min(mates)


def test_small_groups_give_what_blocks_give(monkeypatch):
    monkeypatch.setattr(line_dedup, "PAIRS", 7)
    rng = np.random.default_rng(5)
    groups = []
    for word in (5, 6, 7):
        for _ in range(20):
            early = rng.choice(4, rng.integers(0, 3), replace=False).astype(np.uint64)
            groups.append((word, np.concatenate([np.sort(early), [np.uint64(word)], np.sort(rng.choice(np.arange(8, 18), rng.integers(5, 10), replace=False)).astype(np.uint64)])))
    groups.sort(key=lambda g: (g[0], len(g[1])))
    word, sets = np.array([g[0] for g in groups], np.uint64), [g[1] for g in groups]
    rank = rng.permutation(60)
    links, first = line_dedup.small_groups(sets, word, np.array([len(x) for x in sets]), rank, 0.7)
    for i in (0, 20, 40):
        want, best = line_dedup.similar(sets[i : i + 20], word[i], np.argsort(rank[i : i + 20]), 0.7)
        assert links[i : i + 20].tolist() == want.tolist() and want.sum() > 0
        assert all(first[i + k] == rank[i + best[k]] for k in range(20) if want[k])


def test_texts_lose_their_later_matches(spark):
    df = frame(spark, [(1, "one two three four five\nother"), (2, "x y\n\none two three four five six"), (3, None), (4, "One two three four five")])
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: "one two three four five\nother", 2: "x y\n", 3: None, 4: ""}


def test_empty_table(spark):
    assert line_dedup.matched_lines(frame(spark, [])).count() == 0


def test_long_lines_that_only_meet_are_no_candidates():
    rng = np.random.default_rng(4)
    lines = [rng.choice(400, 150, replace=False).tolist() for _ in range(200)]
    lines += [[*x[:140], *range(1000 + 10 * k, 1010 + 10 * k)] for k, x in enumerate(lines[:20])]
    lines += [[*x[:140], *range(2000, 2014 + k)] for k, x in enumerate(lines[20:40])]
    lines += [[*range(3000 + 70 * k, 3055 + 70 * k), *(range(9000, 9009 + i))] for k in range(3) for i in range(3)]  # on both sides of WIDE
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{k}" for k in x) for x in lines])], names=["text"])
    counts = types.SimpleNamespace(value=np.full(line_dedup.COUNTERS, 2))
    posts = pa.Table.from_batches(line_dedup._post(counts, 1, 0.8)([batch]))
    found = set(line_dedup._candidates(0.8)(posts).column("sig").to_pylist())
    sets, sig = [set(x) for x in lines], line_dedup.Sets(batch.column(0), None).sig.tolist()
    alike = {sig[i] for i, x in enumerate(sets) if any(y is not x and 5 * len(x & y) >= 4 * len(x | y) for y in sets)}
    assert len(alike) > 70 and alike <= found and len(found) <= len(alike) + 20  # pairs just below the threshold among them

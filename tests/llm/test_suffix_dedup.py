import hashlib

import numpy as np

from quern.llm import suffix_dedup
from tests.llm.helpers import frame, rows_of


def brute(rows, length):
    docs = [(suffix_dedup.LAST if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in docs:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in docs:
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k + 1 : k + 1 + length] = True
        kept = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out.append((None if i == suffix_dedup.LAST else i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(spark, monkeypatch):
    df = frame(spark)
    for piece, bucket in ((1 << 20, 3000), (700, 1 << 20)):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        monkeypatch.setattr(suffix_dedup, "LEAST_BUCKETS", 3)
        got = suffix_dedup.remove_repeats(df, bytes_per_bucket=bucket).drop("kept").collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows_of(df), 50)


def test_suffixes_are_in_order():
    rng = np.random.default_rng(1)
    for k in range(60):
        data = rng.integers(0, 3 if k % 2 else 256, rng.integers(1, 200)).astype(np.uint8)
        order = suffix_dedup.suffix_order(data, 300)
        b = data.tobytes()
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_common_prefixes():
    data = np.frombuffer(b"banana bandana", np.uint8)
    order = suffix_dedup.suffix_order(data, 20)
    b = data.tobytes()
    for x, y, n in zip(order, order[1:], suffix_dedup.common_prefixes(data, order, 20), strict=False):
        assert b[x : x + n] == b[y : y + n] and b[x : x + n + 1] != b[y : y + n + 1]


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_wanted_suffixes_are_in_order():
    rng = np.random.default_rng(2)
    for k in range(80):
        data = rng.integers(0, 3 if k % 2 else 256, rng.integers(1, 200)).astype(np.uint8)
        wanted = rng.random(len(data)) < (0.05, 0.3, 0.0)[k % 3]
        order = suffix_dedup.suffix_order(data, 300, wanted)
        b = data.tobytes()
        assert order[wanted[order]].tolist() == sorted(np.nonzero(wanted)[0].tolist(), key=lambda i: b[i:])

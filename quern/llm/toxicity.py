"""Toxic spans by a linear-chain conditional random field.

The chain's states are clean and toxic; a word's emission is a sum of hashed
features of the word and its beginnings.  Word labels for training come from
the labelled documents: words (or their beginnings) that toxic documents hold
and clean ones don't.  Chains are the lines of a text, cut after every 128
words.  Forward-backward gives each word's marginal; a document's score is its
highest marginal and its spans are the runs of words of 0.5 or more.  Scoring
is one pass over the texts without a shuffle; the model has a fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import load, slices
from .decontam import FOLD

#: Labelled documents that a model is fitted to, at most.
TRAIN_DOCS = 6_000
CHAIN = 128
DIMENSIONS = 1 << 18
CACHED = 400_000
THRESHOLD = 0.3
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def chains_of(text: str | None) -> list[list[bytes]]:
    out = []
    for line in (text or "").lower().encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.translate(FOLD).split()
        out += [words[i : i + CHAIN] for i in range(0, len(words), CHAIN)]
    return out


def keys_of(word: bytes) -> list[bytes]:
    """A word's features: the word and its first 4 to 6 letters."""
    letters = word.decode("utf-8", "replace")
    return [b"w" + word] + [b"%d" % n + letters[:n].encode() for n in (4, 5, 6) if len(letters) >= n]


def features_of(word: bytes) -> list[int]:
    return [zlib.crc32(k) % DIMENSIONS for k in keys_of(word)]


class Field:
    """Weights of hashed features, transition scores [from][to] and the start's; score(word) is toxic against clean."""

    def __init__(self, weights: np.ndarray, bias: float, moves: np.ndarray, start: float):
        self.weights, self.bias, self.moves, self.start = weights, bias, moves, start
        self.known: dict[bytes, float] = {}

    def score(self, word: bytes) -> float:
        s = self.known.get(word)
        if s is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            s = self.known[word] = self.bias + float(self.weights[features_of(word)].sum())
        return s

    def marginals(self, chains: list[list[bytes]]) -> list[np.ndarray]:
        """The probability of the toxic state at each word of each chain."""
        out: list[np.ndarray] = [np.zeros(0)] * len(chains)
        order = sorted((i for i in range(len(chains)) if chains[i]), key=lambda i: len(chains[i]))
        at = 0
        while at < len(order):
            longest = max(8, 1 << (len(chains[order[at]]) - 1).bit_length())
            group = []
            while at < len(order) and len(chains[order[at]]) <= longest and len(group) < 4096:
                group.append(order[at])
                at += 1
            n = np.array([len(chains[i]) for i in group])
            s = np.zeros((n.max(), len(group)))
            s.T[np.arange(n.max())[None, :] < n[:, None]] = [self.score(w) for i in group for w in chains[i]]
            p = forward_backward(s, n, self.moves, self.start)
            for k, i in enumerate(group):
                out[i] = p[: n[k], k]
        return out


def messages(s: np.ndarray, n: np.ndarray, moves: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of the toxic state for emissions s (word, chain) of chains of n words."""
    a = np.exp(moves)
    turn = lambda odds, m: np.log((odds * m[1, 1] + m[0, 1]) / (odds * m[1, 0] + m[0, 0]))
    odds = lambda x: np.exp(np.clip(x, -40, 40))
    ahead, back = np.empty_like(s), np.zeros_like(s)
    ahead[0] = s[0] + start
    for t in range(1, len(s)):
        ahead[t] = s[t] + turn(odds(ahead[t - 1]), a)
    for t in range(len(s) - 2, -1, -1):
        back[t] = np.where(t + 1 < n, turn(odds(s[t + 1] + back[t + 1]), a.T), 0)
    return ahead, back


def marginals_of(ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(ahead + back, -40, 40)))


def forward_backward(s: np.ndarray, n: np.ndarray, moves: np.ndarray, start: float) -> np.ndarray:
    """The toxic state's marginals."""
    return marginals_of(*messages(s, n, moves, start))


def pair_sums(s: np.ndarray, n: np.ndarray, moves: np.ndarray, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The expected number of moves [from][to], by the pair marginals of neighbouring words."""
    both = np.arange(1, len(s))[:, None] < n[None, :]
    left, right = ahead[:-1], (s + back)[1:]
    score = np.stack([moves[0, 0] + 0 * left, moves[0, 1] + right, moves[1, 0] + left, moves[1, 1] + left + right])
    p = np.exp(np.clip(score - score.max(0), -80, 0))
    return (both * (p / p.sum(0))).sum((1, 2)).reshape(2, 2)


def token_labels(texts: list[tuple[list[list[bytes]], int]], chance: float = 0.1) -> set[bytes]:
    """Features of words that tell toxic documents.

    A feature counts if chance alone would raise so many false ones, at most,
    among all features, by the likelihood ratio of its share of toxic documents
    to the share of all.  It counts no more often than it has contexts, pairs
    of neighbouring words: copies of a toxic document repeat its contexts, so
    its harmless words gain nothing by them.
    """
    seen, contexts, n = (Counter(), Counter()), {}, [0, 0]
    for chains, toxic in texts:
        n[toxic] += 1
        seen[toxic].update({k for c in chains for w in set(c) for k in keys_of(w)})
        if not toxic:
            continue
        for c in chains:
            for i, w in enumerate(c):
                around = (c[i - 1] if i else b"", c[i + 1] if i + 1 < len(c) else b"")
                for k in keys_of(w):
                    contexts.setdefault(k, set()).add(around)
    share = n[1] / (n[0] + n[1])
    needed = np.log(max(1, len(contexts)) / chance)
    out = set()
    for k, x in contexts.items():
        c, d = min(len(x), seen[1][k]), seen[0][k]
        if c / (c + d) > 0.5 and c * np.log(c / (c + d) / share) + (d * np.log(d / (c + d) / (1 - share)) if d else 0) > needed:
            out.add(k)
    return out


def fit(texts: list[tuple[str | None, int]], rounds: int = 30, rate: float = 0.2, l2: float = 1e-4, clean_chains: int = 4_000) -> Field:
    """A field fitted by Adam to the word labels of labelled documents; without toxic ones everything is clean.

    Chains of toxic documents without a marked word are left out, and of the
    clean documents' chains every k-th is taken, clean_chains at most.  The
    gradient is that of the chains' likelihood and of the weights' squares.
    """
    cut = [(chains_of(t), y) for t, y in texts]
    marks = token_labels(cut) if len({y for _, y in cut}) == 2 else set()
    toxic = lambda w: any(k in marks for k in keys_of(w))
    labelled = [(c, [int(toxic(w)) for w in c]) for chains, y in cut if y for c in chains]
    labelled = [x for x in labelled if any(x[1])]
    clean = [(c, [0] * len(c)) for chains, y in cut if not y for c in chains]
    labelled += clean[:: max(1, -(-len(clean) // clean_chains))]
    if not marks or not labelled:
        return Field(np.zeros(DIMENSIONS, np.float32), -20.0, np.zeros((2, 2)), 0.0)
    words = sorted({w for c, _ in labelled for w in c})
    index = {w: i for i, w in enumerate(words)}
    flat = [features_of(w) for w in words]
    owner = np.repeat(np.arange(len(words)), [len(f) for f in flat])
    flat = np.concatenate(flat)
    labelled.sort(key=lambda x: len(x[0]))
    batches = []
    for i in range(0, len(labelled), 2048):
        part = labelled[i : i + 2048]
        n = np.array([len(c) for c, _ in part])
        w, y = np.zeros((n.max(), len(part)), int), np.zeros((n.max(), len(part)))
        for k, (c, labels) in enumerate(part):
            w[: n[k], k], y[: n[k], k] = [index[x] for x in c], labels
        batches.append((w, y, n, np.arange(n.max())[:, None] < n[None, :]))
    theta = np.zeros(DIMENSIONS + 6)
    theta[DIMENSIONS] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = sum(int(b[2].sum()) for b in batches)
    for r in range(1, rounds + 1):
        moves, start, grad = theta[DIMENSIONS + 1 : DIMENSIONS + 5].reshape(2, 2), theta[DIMENSIONS + 5], np.zeros_like(theta)
        emission = theta[DIMENSIONS] + np.bincount(owner, theta[flat], len(words))
        per_word = np.zeros(len(words))
        for w, y, n, inside in batches:
            s = np.where(inside, emission[w], 0)
            ahead, back = messages(s, n, moves, start)
            p = marginals_of(ahead, back)
            off = np.where(inside, p - y, 0)
            per_word += np.bincount(w.ravel(), off.ravel(), len(words))
            grad[DIMENSIONS] += off.sum()
            grad[DIMENSIONS + 5] += off[0].sum()
            own = [(inside[1:] & (y[:-1] == i) & (y[1:] == j)).sum() for i in (0, 1) for j in (0, 1)]
            grad[DIMENSIONS + 1 : DIMENSIONS + 5] += pair_sums(s, n, moves, ahead, back).ravel() - own
        grad[:DIMENSIONS] = np.bincount(flat, per_word[owner], DIMENSIONS)
        grad = grad / total * 1e3 + l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Field(theta[:DIMENSIONS].astype(np.float32), float(theta[DIMENSIONS]), theta[DIMENSIONS + 1 : DIMENSIONS + 5].reshape(2, 2).copy(), float(theta[DIMENSIONS + 5]))


def held_out(row_id: Column) -> Column:
    return F.coalesce(F.crc32(row_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = TRAIN_DOCS) -> list[tuple[str | None, int]]:
    """At most limit labelled texts that aren't held out, by order of the hash of their id; rows without label are left out."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).dropna()
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.md5(F.col("id").cast("string"))).limit(limit)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "id").orderBy(F.md5(F.col("id").cast("string")), F.md5("text")).limit(limit)
    return [(r.text, int(r.y > 0)) for r in found.collect()]


def spans_of(text: str, marked: list[bool]) -> list[int]:
    """From, to, from, to ... in characters of the runs of marked words."""
    out: list[int] = []
    before = False
    for m, on in zip(WORD.finditer(text), marked, strict=False):
        if on and before:
            out[-1] = m.end()
        elif on:
            out += m.span()
        before = on
    return out


def tag(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans) of every row: its highest marginal and the offsets of its toxic spans.

    Null, empty and wordless texts score 0 and have no spans; repeated rows and
    null ids each have a row; an empty table gives no rows; other columns are
    ignored.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((field.weights, field.bias, field.moves, field.start))

    def run(batches):
        model = Field(*held.value)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            cut = [chains_of(t) for t in texts]
            found = iter(model.marginals([c for chains in cut for c in chains]))
            scores, spans = [], []
            for t, chains in zip(texts, cut, strict=True):
                p = np.concatenate([next(found) for _ in chains]) if chains else np.zeros(1)
                scores.append(float(p.max()))
                spans.append(spans_of(t, (p >= 0.5).tolist()) if p.max() >= 0.5 else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(pa.int32()))], names=["id", "score", "spans"])

    two = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(run, "id long, score double, spans array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scored = tag(docs, fit(training_rows(docs, load(spark, sf_dir, "labels"))))
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

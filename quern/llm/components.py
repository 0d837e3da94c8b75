"""Connected components: forests of blocks of edges, then alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import shared_root

#: Edges that a task holds at once.
BLOCK = 1 << 19


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), each once, and the smallest node reachable from each."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, up := root[root]):
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def _forests(block: int):
    def run(batches):
        held, n = [], 0

        def stars():
            nodes, roots = smallest_reachable(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[nodes != roots]), pa.array(roots[nodes != roots])], names=["u", "v"])

        for b in batches:
            if held and n + b.num_rows > block:
                yield stars()
                held, n = [], 0
            held.append(b)
            n += b.num_rows
        if held:
            yield stars()

    return run


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable.

    Blocks of edges are replaced by their forests, each by a task.  Edges of no
    more than one block are done then, whatever the number of the session's
    partitions is; the others meet in rounds of sorted joins.
    Each round hangs every neighbour on the smallest node seen, so the number
    of rounds grows with the logarithm of the component, and a hub is only ever
    aggregated and joined on its key.  Nothing is broadcast: a driver need not
    hold a table that grows with the edges.  Self loops, null ends and repeated edges
    are ignored; no edges give no rows.
    """
    shared_root(edges.sparkSession)
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = e.distinct().checkpoint()
    n = e.count()
    e = e.coalesce(max(1, -(-n // BLOCK))).mapInArrow(_forests(BLOCK), e.schema).checkpoint()
    state = _state(e) if n > BLOCK else (0,)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("lo")).select("u", F.least("u", "lo").alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.unionByName(near.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        new = _state(e)
        if new == state:
            break
        state = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _state(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]

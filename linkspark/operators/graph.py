"""Iterative graph operators over edge frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.operators.skew import join_unique
from linkspark.sources.storage import discard, materialize

#: Edge frames above this many rows are joined with hot nodes salted.
_MANY = 1_000_000
#: Edges that are contracted together before the rounds.
_CHUNK = 1_000_000


def _labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the least node that these edges alone reach from each."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[root]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces each run of about _CHUNK edges (u, v) by one edge from every node to the least it reaches there."""

    def flush() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("u", "v"))
        node, least = _labels(u, v)
        return pa.RecordBatch.from_arrays([pa.array(x[node != least]) for x in (node, least)], ["u", "v"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _CHUNK:
            yield flush()
            held, rows = [], 0
    if rows:
        yield flush()


def _star(pairs: DataFrame, many: bool) -> DataFrame:
    """pairs (u, v): adds m, the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    if many:
        return join_unique(pairs, least, "u", weight="n")
    return pairs.join(least.drop("n"), "u")


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component): the least node that links reach. Only nodes with an edge to another are returned.

    Runs of up to _CHUNK edges are first contracted on their own, so that a dense family enters the rounds
    with about as many edges as it has nodes; one run alone is settled by that. Then alternates large-star
    and small-star steps: every round hands each node's larger, then smaller neighbours to the least node
    it knows, until nothing changes. Each step is an aggregation and a
    join on the node, cut by a table in the shared folder; rounds grow with the log of the diameter.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u <> v").distinct()
    e = materialize(e, "edges")
    n, state = e.count(), None
    settled = n == 0
    if n and dict(e.dtypes)["u"] == "bigint":
        runs = n // _CHUNK + 1
        before, e = e, materialize(e.coalesce(runs).mapInArrow(_contract, "u long, v long").distinct(), "edges")
        discard(before)
        n, settled = e.count(), runs == 1
    many = n > _MANY
    for _ in range(max_rounds):
        if settled:
            break
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, many).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large, many)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        before, e = e, materialize(small, "edges")
        discard(before)
        seen = tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

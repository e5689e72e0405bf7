"""One-to-one matching over edge frames. Matchers take Edges and return pairs (i, j, score).

Optimal matching is solved per connected component of the candidate graph, whose optima do not
depend on each other: as many real pairs as possible first, then the best total.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.frames import Edges, Registry
from linkspark.operators import kernels
from linkspark.operators.graph import components
from linkspark.sources.storage import materialize

matchers = Registry("matcher")
#: Cells (rows x columns) of a component above which the exact solver refuses.
MAX_CELLS = 25_000_000


def with_component(edges: DataFrame) -> DataFrame:
    """Adds `part`, the component of the bipartite graph that an edge lies in."""
    rows, cols = (2 * F.col("i")).alias("a"), (2 * F.col("j") + 1).alias("b")
    found = components(edges.select(rows, cols), "a", "b")
    return edges.withColumn("node", 2 * F.col("i")).join(found, "node").withColumnRenamed("component", "part").drop("node")


def _per_component(edges: Edges, max_cells: int) -> DataFrame:
    parts = with_component(edges.df.select("i", "j", "score").withColumn("cost", edges.best))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["i"].nunique() * pdf["j"].nunique() > max_cells:
            raise ValueError(f"a component has more than {max_cells} cells; block more finely or match greedily")
        pdf = pdf.sort_values(["i", "j"]).reset_index(drop=True)
        return pdf.loc[kernels.match_edges(pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["cost"].to_numpy(float)), ["i", "j", "score"]]

    return parts.groupBy("part").applyInPandas(solve, "i long, j long, score double")


@matchers.add("optimal")
@matchers.add("hungarian")
@matchers.add("max_weight")
@matchers.add("kuhn_munkres")
def optimal(max_cells: int = MAX_CELLS):
    return lambda edges: _per_component(Edges.coerce(edges), max_cells)


@matchers.add("greedy")
def greedy():
    """Best score first, ties by (i, j), both ends free: by rounds of edges that are the first at both ends."""

    def match(edges) -> DataFrame:
        e = Edges.coerce(edges)
        left = materialize(e.df.select("i", "j", "score", e.best.alias("cost")).filter("score is not null"), "edges")
        schema, taken = "i long, j long, score double", []
        while not left.isEmpty():
            order = F.struct("cost", "i", "j")
            ranked = left.withColumn("bi", F.min(order).over(Window.partitionBy("i"))).withColumn("bj", F.min(order).over(Window.partitionBy("j")))
            first = materialize(ranked.filter((F.col("bi") == order) & (F.col("bj") == order)).select("i", "j", "score"), "matched")
            taken.append(first)
            left = materialize(left.join(first.select("i"), "i", "left_anti").join(first.select("j"), "j", "left_anti"), "edges")
        out = left.sparkSession.createDataFrame([], schema)
        for x in taken:
            out = out.unionByName(x.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("score").cast("double")))
        return out

    return match


@matchers.add("stable")
def stable():
    """Deferred acceptance: rows propose in order of preference, columns keep the best offer; ties to the lower index."""

    def match(edges) -> DataFrame:
        e = Edges.coerce(edges)
        open_edges = materialize(e.df.select("i", "j", "score", e.best.alias("cost")), "edges")
        while True:
            offers = open_edges.withColumn("n", F.row_number().over(Window.partitionBy("i").orderBy("cost", "j"))).filter("n = 1").drop("n")
            ranked = materialize(offers.withColumn("n", F.row_number().over(Window.partitionBy("j").orderBy("cost", "i"))), "offers")
            refused = ranked.filter("n > 1").select("i", "j")
            if refused.isEmpty():
                return ranked.select("i", "j", "score")
            open_edges = materialize(open_edges.join(refused, ["i", "j"], "left_anti"), "edges")

    return match


@matchers.add("pairs")
def pairs(k: int = 1):
    """No one-to-one constraint: the k best of each row."""
    from linkspark.operators.blocking import top_k

    return lambda edges: top_k(Edges.coerce(edges).df, k, Edges.coerce(edges).sense).select("i", "j", "score")


def match_in_key_order(edges: DataFrame, minimum: float = float("-inf")) -> DataFrame:
    """Each i in order takes its best free j (ties to the lower j); scores of 0 or less never match.

    An edge is final once no smaller i can still want its j: rounds over rows that are the least
    among those that share a wanted column, whose number falls every round.
    """
    left = materialize(edges.select("i", "j", "score").filter((F.col("score") > 0) & (F.col("score") >= minimum)), "edges")
    taken: list[DataFrame] = []
    while not left.isEmpty():
        first = left.groupBy("j").agg(F.min("i").alias("lead"))
        ready = left.join(first, "j").groupBy("i").agg(F.max(F.col("lead") < F.col("i")).alias("waits")).filter("not waits").select("i")
        best = left.join(ready, "i").withColumn("n", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "j"))).filter("n = 1").select("i", "j", "score")
        best = materialize(best, "matched")
        taken.append(best)
        left = materialize(left.join(best.select("i"), "i", "left_anti").join(best.select("j"), "j", "left_anti"), "edges")
    out = left.select("i", "j", "score")
    for x in taken:
        out = out.unionByName(x)
    return out


def soft_match(edges, reg: float = 0.1, rounds: int = 2000, tolerance: float = 1e-9, *, a: DataFrame | None = None, b: DataFrame | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """Entropic transport plan over each component: i, j, mass.

    a, b: the marginals (id, mass) of rows and columns, uniform if not given; within a component the columns' are scaled to the rows'.
    Log-domain scaling per component; a component's mass is its rows' share. Pairs without an edge
    carry mass too where the marginals need it, at a cost above every real one; they are left out of the result.
    A component that has not settled after so many rounds, or is too large, raises an error.
    """
    if reg <= 0:
        raise ValueError("reg must be positive")
    e = Edges.coerce(edges)
    n_rows = e.n_a or e.df.select("i").distinct().count()
    parts = e.df.select("i", "j", "score").withColumn("cost", e.best)
    total = float(n_rows) if a is None else float(a.agg(F.sum("mass")).first()[0])
    for side, given, name in (("i", a, "row_mass"), ("j", b, "col_mass")):
        own = F.lit(1.0) if given is None else F.col("__mass")
        parts = parts if given is None else parts.join(given.select(F.col("id").alias(side), F.col("mass").cast("double").alias("__mass")), side)
        parts = parts.withColumn(name, own).drop("__mass")
    parts = with_component(parts)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, r0, ri = np.unique(pdf["i"], return_index=True, return_inverse=True)
        cols, c0, cj = np.unique(pdf["j"], return_index=True, return_inverse=True)
        if len(rows) * len(cols) > max_cells:
            raise ValueError(f"a component of {len(rows)} x {len(cols)} is too large for a transport plan")
        c = pdf["cost"].to_numpy(float)
        c = c - c.min()
        k = np.full((len(rows), len(cols)), -(c.max() * min(len(rows), len(cols)) + 1) / reg)
        k[ri, cj] = -c / reg
        u, v = pdf["row_mass"].to_numpy(float)[r0], pdf["col_mass"].to_numpy(float)[c0]
        share = u.sum()
        with np.errstate(divide="ignore"):
            la, lb = np.log(u / share), np.log(v / v.sum())
        f, g = np.zeros(len(rows)), np.zeros(len(cols))
        for _ in range(rounds):
            old = f
            f = la - np.logaddexp.reduce(k + g[None, :], 1)
            g = lb - np.logaddexp.reduce(k + f[:, None], 0)
            if np.nanmax(np.abs(f - old)) < tolerance:
                break
        else:
            off = np.abs(np.exp(k + f[:, None] + g[None, :]).sum(1) - u / share).max()
            if off > 1e-3:
                raise ValueError(f"the transport plan did not settle in {rounds} rounds; raise reg or rounds")
        plan = np.exp(k + f[:, None] + g[None, :]) * share / total
        return pd.DataFrame({"i": rows[ri], "j": cols[cj], "mass": plan[ri, cj]})

    return parts.groupBy("part").applyInPandas(solve, "i long, j long, mass double")


def harden(plan: DataFrame) -> DataFrame:
    """The one-to-one pairs that carry the most mass."""
    return optimal()(Edges(plan.select("i", "j", F.col("mass").alias("score"))))


def resolve_matcher(spec=None, **options):
    """A matcher whose answer never holds a pair without an edge."""
    inner = matchers.resolve(spec, "optimal", **options)

    def match(edges) -> DataFrame:
        e = Edges.coerce(edges)
        return e.only_real(inner(e))

    match.__wrapped__ = inner
    return match

"""The review loop: what to look at next, and re-solving under a user's decisions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.frames import Edges
from linkspark.operators import kernels
from linkspark.operators.blocking import top_k
from linkspark.operators.matching import MAX_CELLS, with_component


@dataclass(frozen=True)
class CandidateStore:
    """The k best candidates of each row: i, rank, j, score; NaN last, ties to the lower j."""

    df: DataFrame
    sense: str = "maximize"

    @classmethod
    def from_scores(cls, scores, k: int = 5) -> CandidateStore:
        e = Edges.coerce(scores)
        return cls(top_k(e.df, k, e.sense).select("i", "rank", "j", "score"), e.sense)

    def top(self, n: int = 1) -> DataFrame:
        return self.df.filter(F.col("rank") <= n)

    def margins(self, rows: DataFrame | None = None) -> DataFrame:
        """i, margin: first less second score; infinite with fewer than two. rows: all i, those without a candidate too."""
        two = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
        m = self.df.groupBy("i").agg(F.abs(two(1) - two(2)).alias("margin"))
        m = rows.select("i").join(m, "i", "left") if rows is not None else m
        return m.withColumn("margin", F.coalesce("margin", F.lit(float("inf"))))


def review_queue(store: CandidateStore, rows: DataFrame | None = None, most_uncertain_first: bool = True) -> DataFrame:
    m = store.margins(rows)
    return m.orderBy(F.col("margin").asc() if most_uncertain_first else F.col("margin").desc(), "i")


def uncertainty_sampling(store: CandidateStore, n: int = 10, rows: DataFrame | None = None) -> DataFrame:
    return review_queue(store, rows).limit(n)


@dataclass(frozen=True)
class Constraints:
    """An append-only log of decisions."""

    log: tuple[tuple[str, int, int], ...] = ()

    def confirm(self, i: int, j: int) -> Constraints:
        return Constraints((*self.log, ("force", i, j)))

    def reject(self, i: int, j: int) -> Constraints:
        return Constraints((*self.log, ("forbid", i, j)))

    @property
    def forced(self) -> list[tuple[int, int]]:
        return [(i, j) for op, i, j in self.log if op == "force"]

    @property
    def forbidden(self) -> list[tuple[int, int]]:
        return [(i, j) for op, i, j in self.log if op == "forbid"]


def reoptimize(scores, constraints: Constraints) -> DataFrame:
    """Optimal pairs (i, j, score) under the log. Forced pairs stay, with an edge or without (score null)."""
    e = Edges.coerce(scores)
    forced, forbidden = list(dict.fromkeys(constraints.forced)), list(dict.fromkeys(constraints.forbidden))
    if set(forced) & set(forbidden):
        raise ValueError("a pair is both forced and forbidden")
    if len({i for i, _ in forced}) < len(forced) or len({j for _, j in forced}) < len(forced):
        raise ValueError("two forced pairs share a row or a column")
    spark, kind = e.df.sparkSession, "i long, j long"
    fixed, no = spark.createDataFrame(forced, kind), spark.createDataFrame(forbidden, kind)
    free = e.df.select("i", "j", "score").join(F.broadcast(no), ["i", "j"], "left_anti")  # a user's clicks
    if not _feasible(e, forced, forbidden):
        raise ValueError("the decisions leave no complete assignment")
    rest = free.join(F.broadcast(fixed.select("i")), "i", "left_anti").join(F.broadcast(fixed.select("j")), "j", "left_anti")
    from linkspark.operators.matching import optimal

    return optimal()(Edges(rest.select("i", "j", "score"), e.sense)).unionByName(fixed.join(e.df.select("i", "j", "score"), ["i", "j"], "left").select("i", "j", "score"))


def _feasible(e: Edges, forced: list[tuple[int, int]], forbidden: list[tuple[int, int]]) -> bool:
    """Whether the smaller side can still be assigned throughout, pairs that were never proposed included.

    Only a block of forbidden pairs whose rows and columns add up to more than the larger side prevents that, and such a block
    has at least as many pairs as the larger side has members; with fewer there is nothing to solve, and else the
    matrix has no more rows or columns than the user made decisions.
    """
    rows, cols = {i for i, _ in forced}, {j for _, j in forced}
    out = [(i, j) for i, j in forbidden if i not in rows and j not in cols]
    if not out:
        return True
    named = [*forced, *forbidden]
    known = e.df.agg(F.countDistinct("i").alias("a"), F.countDistinct("j").alias("b")).first()
    seen = {c: {r[0] for r in e.df.filter(F.col(c).isin([x[k] for x in named])).select(c).distinct().collect()} for k, c in enumerate("ij")}  # at most one a decision
    n = (e.n_a or known.a + len({i for i, _ in named} - seen["i"])) - len(rows)
    m = (e.n_b or known.b + len({j for _, j in named} - seen["j"])) - len(cols)
    if len(out) < max(n, m):
        return True
    a, b = ({x: k for k, x in enumerate(sorted({p[side] for p in out}))} for side in (0, 1))
    block = np.zeros((n, m))
    block[[a[i] for i, _ in out], [b[j] for _, j in out]] = 1
    return not any(block[x, y] for x, y in kernels.assign(block))


def solve_constrained(scores, forced=(), forbidden=()) -> DataFrame:
    """The best complete assignment (i, j, score) with the forced and without the forbidden pairs; pairs without an edge are out.
    No rows if there is none. The edges are one problem, of at most MAX_CELLS cells."""
    e = Edges.coerce(scores)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, ri = np.unique(pdf["i"], return_inverse=True)
        cols, cj = np.unique(pdf["j"], return_inverse=True)
        if len(rows) * len(cols) > MAX_CELLS:
            raise ValueError("too many cells for one assignment")
        cost = np.full((len(rows), len(cols)), np.inf)
        cost[ri, cj] = pdf["cost"]
        a, b = {x: k for k, x in enumerate(rows)}, {x: k for k, x in enumerate(cols)}
        if any(i not in a or j not in b for i, j in forced):
            return pd.DataFrame({"i": [], "j": []})
        got = kernels.solve_constrained(cost, [(a[i], b[j]) for i, j in forced], [(a[i], b[j]) for i, j in forbidden if i in a and j in b])
        return pd.DataFrame([(int(rows[i]), int(cols[j])) for i, j in got[0].items()] if got else [], columns=["i", "j"])

    chosen = e.df.select("i", "j", "score").withColumn("cost", e.best).withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(solve, "i long, j long")
    return chosen.join(e.df.select("i", "j", "score"), ["i", "j"])


def k_best_assignments(scores, k: int) -> DataFrame:
    """The k best assignments of each component: part, rank, i, j, total (its cost)."""
    e = Edges.coerce(scores)
    parts = with_component(e.df.select("i", "j", "score").withColumn("cost", e.best))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, ri = np.unique(pdf["i"], return_inverse=True)
        cols, cj = np.unique(pdf["j"], return_inverse=True)
        if len(rows) * len(cols) > MAX_CELLS:
            raise ValueError("a component is too large for k-best")
        cost = np.full((len(rows), len(cols)), np.inf)
        cost[ri, cj] = pdf["cost"]
        out = [(int(pdf["part"].iloc[0]), r, int(rows[i]), int(cols[j]), total) for r, (chosen, total) in enumerate(kernels.k_best(cost, k), 1) for i, j in chosen.items()]
        return pd.DataFrame(out, columns=["part", "rank", "i", "j", "total"])

    return parts.groupBy("part").applyInPandas(solve, "part long, rank int, i long, j long, total double")

"""All pairs of vectors in numpy, a block against another: scores of the pairs within a key, and nearest neighbours.

Rows are cut into blocks by a hash of their ids. A task gets two blocks as plain rows, holds no more than these and a slice of scores, and
yields pairs. Products are BLAS's; what is near a bound (a rounding's half, the k-th best) is summed again in the order of the vector's
components, so that results are those of the comparators' expressions in functions/similarity.py.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key has this many blocks where its rows are many, of LEAST rows at least and MOST at most.
BLOCKS = 16
LEAST, MOST = 1 << 11, 1 << 16
#: Scores that are held at once, and pairs that are summed again at once.
SLICE = 1 << 20
_AGAIN = 1 << 14
MOST_TASKS = 4096
_WIDE = Context(prec=400)


def _dealt(a: DataFrame, b: DataFrame | None, group: list[str], extra: list[str], least: int = LEAST) -> DataFrame:
    """Rows (t, own, id, item, extra) of tasks t, in order: the rows of a block, own false, then those of the one it is held against.
    b=None: a's blocks in pairs, a block against itself as well (own is false only). a, b: id, item, group, extra."""
    size = lambda df, n: df.groupBy(*group).agg(F.greatest(F.ceil(F.count("*") / MOST), F.least(F.lit(BLOCKS), F.ceil(F.count("*") / least))).cast("int").alias(n))
    sizes = size(a, "x").withColumn("y", F.col("x")) if b is None else size(a, "x").join(size(b, "y"), group) if group else size(a, "x").crossJoin(size(b, "y"))
    count = F.sum(F.col("x") * (F.col("x") + 1) / 2) if b is None else F.sum(F.col("x") * F.col("y"))
    tasks = int(min(MOST_TASKS, max(1, 2 * (sizes.agg(count).first()[0] or 0))))
    key = F.xxhash64(*group) if group else F.lit(0).cast("long")

    def rows(df: DataFrame, own: str, other: str, right: bool) -> DataFrame:
        with_sizes = df.join(F.broadcast(sizes), group) if group else df.crossJoin(F.broadcast(sizes))
        with_sizes = with_sizes.withColumn("m", F.pmod(F.xxhash64("id"), F.col(own)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        first, second = (F.col("m"), F.col("o")) if not right else (F.col("o"), F.col("m"))
        if b is None:
            first, second, right = F.least("m", "o"), F.greatest("m", "o"), F.col("m") > F.col("o")
        return with_sizes.select(*[F.col(g).alias(f"g{k}") for k, g in enumerate(group)], key.alias("g"), first.alias("u"), second.alias("v"), F.lit(right).alias("own") if isinstance(right, bool) else right.alias("own"), "id", F.col("item").cast("array<double>").alias("item"), *extra)

    out = rows(a, "x", "y", False)
    if b is not None:
        out = out.unionByName(rows(b, "y", "x", True))
    names = [f"g{k}" for k in range(len(group))]
    out = out.repartition(tasks, "g", "u", "v").sortWithinPartitions("g", *names, "u", "v", "own", "id")
    return out.select(F.struct(*names, "g", "u", "v").alias("t"), "own", "id", "item", *extra)


class Block:
    """Ids, and vectors scaled by their largest component (scale=False: as they are), with norms."""

    def __init__(self, batches: list[pa.RecordBatch], scale: bool, extra: str | None) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        self.ids = table.column("id").to_numpy()
        items = table.column("item").combine_chunks()
        items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
        width = np.diff(items.offsets.to_numpy())
        self.null = items.is_null().to_numpy(zero_copy_only=False)
        self.width = int(width[~self.null][0]) if (~self.null).any() else None
        if self.width is not None and (width[~self.null] != self.width).any():
            raise ValueError("vectors of different length")
        self.x = np.full((len(self.ids), self.width or 0), np.nan)
        if self.width:
            self.x[~self.null] = items.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.width)
        with np.errstate(all="ignore"):
            if scale and self.width:
                top = np.abs(self.x).max(axis=1)
                self.x /= np.where(top == 0, 1.0, top)[:, None]
            self.norm = np.sqrt(self.sums(np.arange(len(self.ids)), self, np.arange(len(self.ids))))
        self.extra = table.column(extra).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(self.ids), -1) if extra else None

    def sums(self, u: np.ndarray, other: Block, v: np.ndarray) -> np.ndarray:
        """Dot products of the rows u with the other's rows v, summed in order."""
        out = np.zeros(len(u))
        for k in range(0, len(u), _AGAIN):
            z = slice(k, k + _AGAIN)
            a, b, s = self.x[u[z]], other.x[v[z]], np.zeros(len(u[z]))
            for c in range(self.x.shape[1]):
                s += a[:, c] * b[:, c]
            out[z] = s
        return out

    def cosines(self, u: np.ndarray, other: Block, v: np.ndarray) -> np.ndarray:
        n = self.norm[u] * other.norm[v]
        return np.where(n == 0, 0.0, self.sums(u, other, v) / np.where(n == 0, 1.0, n))


def _blocks(batches: Iterator[pa.RecordBatch], scale: bool, extra: str | None = None) -> Iterator[tuple[Block, Block | None]]:
    """The blocks of each task: the second is None if a block is held against itself (no rows of own true)."""
    held: list[pa.RecordBatch] = []
    last = None

    def parts() -> tuple[Block, Block | None]:
        table = pa.Table.from_batches(held)
        own = table.column("own").to_numpy()
        cut = int(np.searchsorted(own, True))
        left = Block(table.slice(0, cut).to_batches(), scale, extra) if cut else None
        right = Block(table.slice(cut).to_batches(), scale, extra) if cut < len(own) else None
        if left and right and None not in (left.width, right.width) and left.width != right.width:
            raise ValueError("vectors of different length")
        for one, other in ((left, right), (right, left)):
            if one and other and one.width is None:  # nulls only
                one.x = np.full((len(one.ids), other.width or 0), np.nan)
        return left, right

    for batch in batches:
        t = batch.column("t")
        fields = [t.field(k) for k in range(t.type.num_fields)]
        new = np.zeros(len(batch), bool)
        for f in fields:
            f = f.to_numpy(zero_copy_only=False)
            new[1:] |= f[1:] != f[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), len(batch)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            now = t[lo].as_py()
            if held and now != last:
                yield parts()
                held.clear()
            last = now
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield parts()


def _half_up(x: float) -> float:
    return float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP, _WIDE)) + 0.0 if math.isfinite(x) else x


METRICS = ("cosine", "dot", "angular")


def _scores(a: Block, b: Block, u: np.ndarray, v: np.ndarray, dots: np.ndarray, metric: str) -> np.ndarray:
    """Scores of the pairs (u, v), rounded to 6 digits, half up as Spark's round() does."""
    eps = 4e-16 * (a.x.shape[1] + 8)

    def finish(dot: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        if metric == "dot":
            return dot
        n = a.norm[u] * b.norm[v]
        cos = np.where(n == 0, 0.0, dot / np.where(n == 0, 1.0, n))
        return cos if metric == "cosine" else np.arccos(np.clip(cos, -1.0, 1.0)) / math.pi

    with np.errstate(all="ignore"):
        x = finish(dots, u, v)
        off = eps * a.norm[u] * b.norm[v] if metric == "dot" else eps if metric == "cosine" else 1e-11
        y = np.abs(x) * 1e6
        near = np.abs(y - np.floor(y) - 0.5) <= 1e6 * off + 4e-16 * y + 1e-9
        near |= ~(y < 1e15)
        if metric == "angular":
            near |= (x < 1e-3) | (x > 1 - 1e-3)
        out = np.copysign(np.floor(y + 0.5), x) / 1e6 + 0.0
        again = np.flatnonzero(near)
        if len(again):
            x = finish(a.sums(u[again], b, v[again]), u[again], v[again])
            y = np.abs(x) * 1e6
            near = (np.abs(y - np.floor(y) - 0.5) <= 4e-16 * y + 1e-9) | ~(y < 1e15)
            value = np.copysign(np.floor(y + 0.5), x) / 1e6 + 0.0
            value[near] = [_half_up(float(z)) for z in x[near]]
            out[again] = value
    return out


def _pairs(batches: Iterator[pa.RecordBatch], metric: str) -> Iterator[pa.RecordBatch]:
    for a, other in _blocks(batches, metric != "dot"):
        if a is None:
            continue
        b = a if other is None else other
        step = max(1, (SLICE >> 2) // len(b.ids))
        for lo in range(0, len(a.ids), step):
            hi = min(lo + step, len(a.ids))
            mask = a.ids[lo:hi, None] < b.ids if other is None else a.ids[lo:hi, None] != b.ids
            u, v = np.nonzero(mask)
            if not len(u):
                continue
            with np.errstate(all="ignore"):
                dots = (a.x[lo:hi] @ b.x.T)[u, v]
            u = u + lo
            score = _scores(a, b, u, v, dots, metric)
            i, j = a.ids[u], b.ids[v]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(score, mask=a.null[u] | b.null[v])], ["i", "j", "score"])


def scored_within(items: DataFrame, key: str, metric: str = "cosine") -> DataFrame:
    """Pairs (i, j, score) of items (id long, item a vector) that agree in the column key, i < j; the scores with 6 digits. Null vectors score null."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    rows = items.select(F.col("id").cast("long").alias("id"), "item", F.col(key).alias("key")).filter("id is not null and key is not null")
    return _dealt(rows, None, ["key"], []).select("t", "own", "id", "item").mapInArrow(lambda it: _pairs(it, metric), "i long, j long, score double")


def _best(a: Block, b: Block, k: int, alone: bool, met: bool) -> pa.RecordBatch:
    """Of each row of a, the k best of b by cosine (NaN last, ties to the lower id), of those that agree in a band if met."""
    at: list[tuple] = []
    eps = 1e-15 * (b.x.shape[1] + 100)
    with np.errstate(all="ignore"):
        unit = [np.where(c.norm[:, None] == 0, 0.0, c.x / np.where(c.norm == 0, 1.0, c.norm)[:, None]) for c in (a, b)]
        step, n = max(1, SLICE // len(b.ids)), len(b.ids)
        for lo in range(0, len(a.ids), step):
            hi = min(lo + step, len(a.ids))
            s = unit[0][lo:hi] @ unit[1].T
            s[np.isnan(s)] = -3.0
            if alone:
                s[a.ids[lo:hi, None] == b.ids] = -9.0
            rest = np.arange(lo, hi)
            for most in (4 * k, n) if met else (k,):
                few = s[rest - lo]
                parts = min(n, max(8 * most, n // 64))
                top = np.maximum.reduceat(few, np.arange(parts) * n // parts, axis=1)
                bound = np.partition(top, parts - min(most, parts), axis=1)[:, parts - min(most, parts)] if most < parts else few.min(axis=1)
                r, v = np.nonzero(few >= np.maximum(bound - eps, -5.0)[:, None])
                u = rest[r]
                if met:
                    z = [(a.extra[u[q : q + SLICE // 8]] == b.extra[v[q : q + SLICE // 8]]).any(axis=1) for q in range(0, len(u), SLICE // 8)]
                    good = np.concatenate(z) if z else np.zeros(0, bool)
                    u, v = u[good], v[good]
                done = np.bincount(u - lo, minlength=hi - lo)[rest - lo] >= k if met and most < n else np.ones(len(rest), bool)
                good = np.isin(u, rest[done])
                u, v = u[good], v[good]
                score = a.cosines(u, b, v)
                order = np.lexsort((b.ids[v], np.where(np.isnan(score), 0.0, -score), np.isnan(score), u))
                u, v, score = u[order], v[order], score[order]
                rank = np.arange(len(u)) - np.searchsorted(u, u)
                at.append((a.ids[u[rank < k]], b.ids[v[rank < k]], score[rank < k]))
                rest = rest[~done]
                if not len(rest):
                    break
    i, j, score = (np.concatenate(x) for x in zip(*at, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(score)], ["i", "j", "score"])


def nearest(a: DataFrame, b: DataFrame | None, k: int, top_k: Callable, bands: str | None = None) -> DataFrame:
    """i, j, score, rank: the k best j of each i by cosine. a, b: id long, item a vector, and bands (an array<long>) if only pairs with one in
    common in the same place count. b=None: a's items against each other, none against its own id."""
    extra = [bands] if bands else []
    sides = [df.select(F.col("id").cast("long").alias("id"), "item", *extra).filter("id is not null") for df in ((a,) if b is None else (a, b))]

    alone, met = b is None, bool(bands)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in _blocks(batches, True, bands):
            if x is None or (y is None and not alone):
                continue
            yield _best(x, x if y is None else y, k, y is None, met)
            if alone and y is not None:
                yield _best(y, x, k, False, met)

    dealt = _dealt(sides[0], sides[1] if len(sides) > 1 else None, [], extra, LEAST // 2)
    return top_k(dealt.mapInArrow(near, "i long, j long, score double"), k)

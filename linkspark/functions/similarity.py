"""Comparators: builders of Column expressions over a pair of columns.

All but ratio, jaro_winkler and metaphone-like codes run inside the JVM; those three are Arrow-batched.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from linkspark.frames import Registry, Trait

comparators = Registry("comparator")
Comparator = Callable[[Column, Column], Column]
EARTH_KM = 6371.0088


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@comparators.add("ratio", Trait(symmetric=False))
def ratio() -> Comparator:
    """Share of characters in matching blocks, difflib's; depends on the order of its two texts."""
    return F.pandas_udf(_ratio, "double")


def ratio_bound(a: Column, b: Column) -> Column:
    """No ratio of a and b is larger: a filter to put before ratio() when a threshold is known."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / total)


@comparators.add("levenshtein_distance", Trait("distance", bounded=False, metric=True))
def levenshtein_distance() -> Comparator:
    return lambda a, b: F.levenshtein(a, b).cast("double")


@comparators.add("levenshtein")
def levenshtein() -> Comparator:
    def sim(a: Column, b: Column) -> Column:
        longest = F.greatest(F.length(a), F.length(b))
        return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)

    return sim


@comparators.add("monge_elkan", Trait(symmetric=False))
def monge_elkan(sim: Comparator | None = None, pattern: str = r"\s+") -> Comparator:
    """Mean over the words of a of their best similarity in b. sim must be an expression (default: levenshtein)."""
    inner = sim or levenshtein()

    def score(a: Column, b: Column) -> Column:
        words = lambda x: F.filter(F.split(x, pattern), lambda w: w != "")
        best = F.transform(words(a), lambda x: F.coalesce(F.array_max(F.transform(words(b), lambda y: inner(x, y))), F.lit(0.0)))
        return F.when(F.size(words(a)) == 0, 0.0).otherwise(F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(words(a)))

    return score


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, matched = [False] * len(b), []
    for i, ch in enumerate(a):
        for k in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[k] and b[k] == ch:
                taken[k] = True
                matched.append(ch)
                break
    m = len(matched)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(matched, (b[k] for k in range(len(b)) if taken[k]), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        s, p = jaro(x, y), 0
        while p < min(4, len(x), len(y)) and x[p] == y[p]:
            p += 1
        return s + 0.1 * p * (1 - s) if s > 0.7 else s  # no prefix bonus for weak matches

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@comparators.add("jaro_winkler")
def jaro_winkler() -> Comparator:
    return F.pandas_udf(_jaro_winkler, "double")


@comparators.add("phonetic")
def phonetic(algorithm: str = "soundex") -> Comparator:
    """1.0 where the sound codes agree. Only soundex is built in."""
    if algorithm != "soundex":
        raise ValueError(f"no phonetic code {algorithm!r} here; there is soundex")
    return lambda a, b: (F.soundex(a) == F.soundex(b)).cast("double")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _checked(u: Column, v: Column, value: Column) -> Column:
    return F.when(F.size(u) == F.size(v), value).otherwise(F.raise_error(F.lit("vectors of different length")).cast("double"))


def dot_product(u: Column, v: Column) -> Column:
    return _sum(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _top(u: Column) -> Column:
    top = F.array_max(F.transform(u, lambda x: F.abs(x.cast("double"))))
    return F.when(F.coalesce(top, F.lit(0.0)) == 0, 1.0).otherwise(top)


@comparators.add("cosine")
def cosine() -> Comparator:
    """Scaled by the largest component first, so huge vectors don't overflow; 0 with a zero vector."""

    def score(u: Column, v: Column) -> Column:
        def norm(w: Column, s: Column) -> Column:
            return F.sqrt(F.aggregate(w, F.lit(0.0), lambda acc, x: acc + (x.cast("double") / s) * (x.cast("double") / s)))

        def scaled(su: Column, sv: Column) -> Column:
            both = _sum(F.zip_with(u, v, lambda x, y: (x.cast("double") / su) * (y.cast("double") / sv)))
            return _let(norm(u, su) * norm(v, sv), lambda n: F.when(n == 0, 0.0).otherwise(both / n))

        return _checked(u, v, _let(_top(u), lambda su: _let(_top(v), lambda sv: scaled(su, sv))))

    return score


@comparators.add("dot", Trait(bounded=False))
def dot() -> Comparator:
    return lambda u, v: _checked(u, v, dot_product(u, v))


@comparators.add("angular", Trait("distance", metric=True))
def angular() -> Comparator:
    near = cosine()
    return lambda u, v: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), near(u, v)))) / math.pi


def l2_normalize(u: Column) -> Column:
    """The vector at length 1; a zero vector unchanged."""
    return _let(F.sqrt(dot_product(u, u)), lambda n: F.transform(u, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))


def _positive(name: str, value: float) -> float:
    if value <= 0:
        raise ValueError(f"{name} must be positive, not {value}")
    return float(value)


def _gap(x: Column, y: Column) -> Column:
    return F.abs(x - y)


@comparators.add("exp_decay")
def exp_decay(scale: float = 1.0, distance: Comparator = _gap) -> Comparator:
    s = _positive("scale", scale)
    return lambda x, y: F.exp(-F.abs(distance(x, y)) / s)


@comparators.add("linear_decay")
def linear_decay(max_distance: float = 1.0, distance: Comparator = _gap) -> Comparator:
    m = _positive("max_distance", max_distance)
    return lambda x, y: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(distance(x, y)) / m))


@comparators.add("gaussian_decay")
def gaussian_decay(scale: float = 1.0, distance: Comparator = _gap) -> Comparator:
    s = _positive("scale", scale)
    return lambda x, y: F.exp(-0.5 * F.pow(distance(x, y) / s, 2))


@comparators.add("haversine", Trait("distance", bounded=False, metric=True))
def haversine() -> Comparator:
    """Kilometres between two points, structs of lat and lon in degrees."""

    def km(p: Column, q: Column) -> Column:
        a, b = F.radians(p["lat"]), F.radians(q["lat"])
        h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(q["lon"] - p["lon"]) / 2), 2)
        return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))

    return km


@comparators.add("geo")
def geo(scale_km: float = 10.0) -> Comparator:
    return exp_decay(scale_km, haversine())


# records

def agreement(fields: dict[str, Comparator], left: Callable[[str], Column], right: Callable[[str], Column], missing: float | None = 0.0) -> dict[str, Column]:
    """One score a field; `missing` where either side is null (None: null, which is no evidence)."""
    out = {}
    for name, compare in fields.items():
        a, b = left(name), right(name)
        out[name] = F.when(a.isNull() | b.isNull(), F.lit(missing).cast("double")).otherwise(compare(a, b))
    return out


def weighted_sum(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    return sum((c * float((weights or {}).get(k, 1.0)) for k, c in scores.items()), F.lit(0.0))


def mean(scores: dict[str, Column]) -> Column:
    return weighted_sum(scores) / len(scores) if scores else F.lit(0.0)


def maximum(scores: dict[str, Column]) -> Column:
    values = list(scores.values())
    return F.greatest(*values) if len(values) > 1 else values[0] if values else F.lit(0.0)


def fellegi_sunter(scores: dict[str, Column], m: dict[str, float], u: dict[str, float], eps: float = 1e-6) -> Column:
    """Sum of log-likelihood ratios, mixed by the degree of agreement."""
    total = F.lit(0.0)
    for k, s in scores.items():
        if k not in m or k not in u:
            raise KeyError(f"no m or u for field {k!r}")
        p, q = (min(1 - eps, max(eps, x[k])) for x in (m, u))
        total = total + s * math.log(p / q) + (1 - s) * math.log((1 - p) / (1 - q))
    return total


def threshold(score: Column, t: float, hard: bool = True) -> Column:
    return score >= t if hard else score

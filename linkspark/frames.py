"""The frames that stages hand on: scored edges with their sense, and the names of strategies per stage.

An edge frame has one row (i, j, score) per candidate pair; a pair that was never proposed has no row,
so it can neither be preferred nor returned.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENSES = ("maximize", "minimize")


def check_sense(sense: str) -> str:
    if sense not in SENSES:
        raise ValueError(f"sense must be one of {SENSES}, not {sense!r}")
    return sense


@dataclass(frozen=True)
class Edges:
    """Scored candidate pairs. n_a, n_b: sizes of the two sides (ids 0 to n - 1), where known."""

    df: DataFrame
    sense: str = "maximize"
    n_a: int | None = None
    n_b: int | None = None

    def __post_init__(self) -> None:
        check_sense(self.sense)

    @classmethod
    def coerce(cls, value: Any, sense: str | None = None) -> Edges:
        if isinstance(value, Edges):
            if sense and sense != value.sense:
                raise ValueError(f"the edges say {value.sense}, the call says {sense}")
            return value
        return cls(value, sense or "maximize")

    @property
    def best(self) -> Column:
        """Smaller is better."""
        return F.col("score") if self.sense == "minimize" else -F.col("score")

    def cost(self) -> DataFrame:
        """Scores as costs: unchanged when minimizing, else the largest score less each."""
        if self.sense == "minimize":
            return self.df
        top = self.df.agg(F.max("score").alias("__top"))
        return self.df.join(F.broadcast(top)).withColumn("score", F.col("__top") - F.col("score")).drop("__top")

    def dense(self, fill: float | None = None) -> DataFrame:
        """Every cell of an n_a by n_b matrix; holes get `fill`, or worse than any sum of real scores."""
        if self.n_a is None or self.n_b is None:
            raise ValueError("dense() needs n_a and n_b")
        spark = self.df.sparkSession
        if fill is None:
            r = self.df.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("hi"), F.coalesce(F.min("score"), F.lit(0.0)).alias("lo")).first()
            worst = min(self.n_a, self.n_b) * (abs(r.hi) + abs(r.lo)) + 1
            fill = worst if self.sense == "minimize" else -worst
        cells = spark.range(self.n_a).toDF("i").crossJoin(spark.range(self.n_b).toDF("j"))
        return cells.join(self.df, ["i", "j"], "left").withColumn("score", F.coalesce("score", F.lit(float(fill))))

    def only_real(self, pairs: DataFrame, keep: DataFrame | None = None) -> DataFrame:
        """Of the pairs (i, j), those with an edge; and those in `keep` in any case."""
        real = self.df.select("i", "j")
        return pairs.join((real.unionByName(keep.select("i", "j")) if keep is not None else real).distinct(), ["i", "j"], "left_semi")


@dataclass(frozen=True)
class Trait:
    """What a comparator or featurizer says about itself."""

    polarity: str = "similarity"
    bounded: bool = True
    metric: bool = False
    symmetric: bool = True
    output: str = "scalar"
    normalized: bool = False

    @property
    def sense(self) -> str:
        return "maximize" if self.polarity == "similarity" else "minimize"


class MissingPackage(ImportError):
    """An optional package that a strategy needs isn't installed."""


def have(package: str) -> bool:
    return importlib.util.find_spec(package) is not None


def require(package: str, why: str) -> Any:
    if not have(package):
        raise MissingPackage(f"{why} needs the package {package!r}, which isn't installed")
    return importlib.import_module(package)


@dataclass
class Registry:
    """Names to makers of strategies, made on use. A maker takes options and returns a callable."""

    stage: str
    makers: dict[str, Callable[..., Any]] = field(default_factory=dict)
    traits: dict[str, Trait] = field(default_factory=dict)

    def add(self, name: str, trait: Trait | None = None) -> Callable:
        def keep(maker: Callable) -> Callable:
            self.makers[name] = maker
            if trait:
                self.traits[name] = trait
            return maker

        return keep

    def __contains__(self, name: object) -> bool:
        return name in self.makers

    def names(self) -> list[str]:
        return sorted(self.makers)

    def trait(self, name: Any) -> Trait:
        return self.traits.get(name, Trait()) if isinstance(name, str) else getattr(name, "trait", Trait())

    def resolve(self, spec: Any, default: str | None = None, **options: Any) -> Any:
        spec = default if spec is None else spec
        if callable(spec):
            if options:
                raise TypeError(f"a ready {self.stage} takes no options: {sorted(options)}")
            return spec
        if not isinstance(spec, str):
            raise TypeError(f"a {self.stage} is a name or a callable, not {type(spec).__name__}")
        if spec not in self.makers:
            raise KeyError(f"no {self.stage} {spec!r}; there are {', '.join(self.names())}")
        return self.makers[spec](**options)

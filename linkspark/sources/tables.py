"""Reading and writing the tables that queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write(df: DataFrame, path: str, *, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def null_counts(df: DataFrame) -> DataFrame:
    """column, nulls: only columns that have some."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])).alias("x"))
    return rows.select("x.*").filter("nulls > 0")


def most_common(df: DataFrame, column: str, pattern: str, k: int | None = None, group: int = 0) -> DataFrame:
    """What a pattern finds, with counts; the k most common, or all."""
    found = df.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(group))).alias("found")).groupBy("found").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "found").limit(k) if k else found

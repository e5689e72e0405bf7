"""Joins that stay balanced when one key holds much of the rows, or few keys hold all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_unique(left: DataFrame, right: DataFrame, key: str, *, weight: str | None = None, share: int = 512, how: str = "left", least: int = 1000) -> DataFrame:
    """Join (left or inner) to a side with one row per key, safe for keys that hold much of the left.

    A key on more than 1/share of the left's rows (and `least` rows) is hot; there are fewer than
    `share` of them, so their right rows are broadcast, and the left rows that have them are dealt out
    by a row hash instead of the key. weight: a column of the right that holds how many left rows a
    key has, if known; else the left is counted. The result has the left's columns, then the right's
    without key and weight.
    """
    values = [c for c in right.columns if c not in (key, weight)]
    if weight:
        counts, total = right.select(key, F.col(weight).alias("__n")), right.agg(F.sum(weight)).first()[0] or 0
    else:
        counts, total = left.groupBy(key).agg(F.count("*").alias("__n")), left.count()
    hot = counts.filter((F.col("__n") >= total // share + least) & F.col(key).isNotNull()).select(key)
    hot_rows = right.join(F.broadcast(hot), key, "left_semi").select(F.col(key).alias("__hot"), *[F.col(c).alias(f"__hot_{c}") for c in values])
    marked = left.join(F.broadcast(hot_rows), F.col(key) == F.col("__hot"), "left")
    marked = marked.withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(65536))).otherwise(F.lit(-1)))
    side = right.select(F.col(key).alias("__key"), F.lit(-1).cast("long").alias("__key_salt"), *[F.col(c).alias(f"__cold_{c}") for c in values])
    out = marked.join(side, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__key_salt")), "left")
    if how == "inner":
        out = out.filter("__hot is not null or __key is not null")
    return out.select(*left.columns, *[F.when(F.col("__hot").isNotNull(), F.col(f"__hot_{c}")).otherwise(F.col(f"__cold_{c}")).alias(c) for c in values])


#: Rows of a key on either side that one task pairs, and about how many pairs a task is for.
SIDE = 2048
TASK_PAIRS = 1 << 19
MOST_TASKS = 2048


def join_blocks(left: DataFrame, right: DataFrame, on: list[str], side: int = SIDE) -> DataFrame:
    """Inner join for keys with many rows on both sides, so that the pairs are far more than the rows.

    Keys with more than `side` squared pairs are cut into blocks of about `side` rows (by a hash of the row), each held against each
    of the other side. There are as many tasks as the pairs ask for: the rows alone are so small that Spark would put them
    into a few. Reads both sides' keys once more, to count them.
    """
    n_left, n_right = (df.groupBy(*on).agg(F.count("*").alias(n)) for df, n in ((left, "__l"), (right, "__r")))
    counts = n_left.join(n_right, on)
    total = counts.agg(F.sum(F.col("__l").cast("double") * F.col("__r"))).first()[0] or 0.0
    heavy = counts.filter(F.col("__l").cast("double") * F.col("__r") > float(side) ** 2).select(*on, F.ceil(F.col("__l") / side).alias("__x"), F.ceil(F.col("__r") / side).alias("__y"))

    def cut(df: DataFrame, own: str, other: str) -> DataFrame:
        rows = df.join(F.broadcast(heavy), on, "left")
        rows = rows.withColumn("__own", F.when(F.col(own).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.col(own))).cast("int"))
        rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other) - 1, F.lit(0)).cast("int"))))
        return rows.select(*df.columns, F.col("__own").alias(f"_{own}"), F.col("__other").alias(f"_{other}"))

    tasks = int(min(MOST_TASKS, total // TASK_PAIRS + 1))
    keys = [*on, "___x", "___y"]
    return cut(left, "__x", "__y").repartition(tasks, *keys).join(cut(right, "__y", "__x").repartition(tasks, *keys), keys).drop("___x", "___y")

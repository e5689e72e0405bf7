"""Mixing sources to target weights by systematic sampling.

Within a source every document expects target / source size copies. Documents stand in a fixed order
(by the eight leading bits of their size, a bucket, size, id); the running sum of expected copies starts at
one offset per source, and a document is emitted once for each integer that its share of the sum
crosses. The order by size keeps the words taken near the target (they differ by about the longest document's at most), and the running sum is built from
block counts plus a window inside each block, so a source with most of the rows has no single task.

Targets: each source's weight times a common level, at most `most` times its size; the level makes the
targets add up to `share` of all sizes (excess over the caps is thereby dealt to the others by weight).

Edge cases: null or empty texts have size 0, are still counted in the order, and take 0 words. Null
sources form one source, last in order. A source of size 0 has target 0 and no copies. Equal rows are
interchangeable. An empty table gives an empty result. Kept columns that are named like one of the result's are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.llm import common

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Blocks of each source and size class (sizes with the same eight leading bits).
N_BLOCKS = 16
SEED = "mix-1"


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """sizes: source_null, source, source_size, one row a source. Adds target, rate and offset."""
    every = Window.partitionBy()
    ordered = Window.orderBy("source_null", "source")
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "source_null", "source")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", weight)
    t = t.withColumn("level", (share * F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after))
    t = t.withColumn("level", F.max("level").over(every))
    t = t.withColumn("target", F.least(F.col("weight") * F.col("level"), most * F.col("source_size")))
    t = t.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.when(F.col("source_null"), "").otherwise(F.concat(F.lit("="), "source")))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return t.select("source_null", "source", "source_size", "target", "rate", u.alias("offset"))


def _planned(docs: DataFrame, keep: list[str], id_col: str, text_col: str, source_col: str, **targets) -> DataFrame:
    """row (a struct of the kept columns), size, source_size, target, copies."""
    source = F.col(source_col).cast("string")
    carried = F.struct(*[F.col(c) for c in keep]).alias("row")
    rows = docs.select(carried, F.col(id_col).cast("long").alias("id"), source.isNull().alias("source_null"), F.coalesce(source, F.lit("")).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tie"))
    bits = F.length(F.bin("size"))
    leading = bits * 256 + F.call_function("shiftright", F.col("size"), F.greatest(bits - 8, F.lit(0)))
    rows = rows.withColumn("block", leading * N_BLOCKS + F.pmod(F.coalesce("id", F.lit(-1)), F.lit(N_BLOCKS)))
    blocks = rows.groupBy("source_null", "source", "block").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    to = source_targets(blocks.groupBy("source_null", "source").agg(F.sum("words").alias("source_size")), **targets)
    earlier = Window.partitionBy("source_null", "source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("source_null", "source", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")).join(to, ["source_null", "source"])
    within = Window.partitionBy("source_null", "source", "block").orderBy("size", F.col("id").asc_nulls_first(), "tie")
    out = rows.withColumn("i", F.row_number().over(within)).join(starts, ["source_null", "source", "block"])
    i = F.col("start") + F.col("i")
    crossed = F.floor(F.col("offset") + F.col("rate") * i) - F.floor(F.col("offset") + F.col("rate") * (i - 1))
    return out.select("row", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, **targets) -> DataFrame:
    """Documents with size, source_size, target and copies. keep: columns carried along (the id by default)."""
    added = ["size", "source_size", "target", "copies"]
    keep = [c for c in ([id_col] if keep is None else keep) if c not in added] or [id_col]
    return _planned(docs, keep, id_col, text_col, source_col, **targets).select("row.*", *added)


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **targets) -> DataFrame:
    """The mix itself: every column of the documents, one row per copy, with `copy` from 0 (in place of a column of that name)."""
    planned = _planned(docs, docs.columns, id_col, text_col, source_col, **targets).filter("copies > 0")
    return planned.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "copy"], F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_mix(common.table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op6_mix_sources": op6_mix_sources}

ORACLES = {
    "op6_mix_sources": rf"""
WITH d AS (SELECT doc_id, source IS NULL AS sn, coalesce(source, '') AS source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
z AS (SELECT sn, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY sn, source) - 1) % 3 + 1] AS weight FROM z),
l AS (SELECT *, ({SHARE} * sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW o AS (ORDER BY source_size / weight, sn, source)),
t AS (SELECT *, least(weight * max(level) OVER (), {MOST} * source_size) AS target FROM l),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(target AS DOUBLE) / source_size ELSE 0 END AS rate,
        CAST('0x' || substr(md5('{SEED}:' || CASE WHEN sn THEN '' ELSE '=' || source END), 1, 8) AS BIGINT) / 4294967296.0 AS off FROM t),
r AS (SELECT d.*, row_number() OVER (PARTITION BY sn, source ORDER BY length(bin(size)) * 256 + (size >> greatest(length(bin(size)) - 8, 0)), ((coalesce(doc_id, -1) % {N_BLOCKS}) + {N_BLOCKS}) % {N_BLOCKS}, size, doc_id NULLS FIRST) AS i FROM d)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(size * (floor(CAST(off AS DOUBLE) + rate * i) - floor(CAST(off AS DOUBLE) + rate * (i - 1))) AS BIGINT) AS taken
FROM r JOIN u USING (sn, source)
"""
}

"""Clusters from scored pairs, golden records, decisions, and agreement probabilities by EM."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.frames import Registry, check_sense
from linkspark.operators.blocking import number_rows
from linkspark.operators.graph import components
from linkspark.sources.storage import materialize

clusterers = Registry("clusterer")


def passing(pairs: DataFrame, threshold: float | None, sense: str) -> DataFrame:
    """Pairs without a score, or without a threshold, pass; else the score must reach it."""
    check_sense(sense)
    if threshold is None or "score" not in pairs.columns:
        return pairs.select("i", "j")
    return pairs.filter(F.col("score") >= threshold if sense == "maximize" else F.col("score") <= threshold).select("i", "j")


def _checked(pairs: DataFrame, n: int) -> DataFrame:
    if not pairs.filter((F.least("i", "j") < 0) | (F.greatest("i", "j") >= n)).isEmpty():
        raise ValueError(f"a pair names an index outside of 0 to {n - 1}")
    return pairs


def _labels(items: DataFrame, n: int) -> DataFrame:
    """items: item, head. All items 0 to n - 1 with dense numbers in the order of their heads."""
    every = items.sparkSession.range(n).toDF("item").join(items, "item", "left").withColumn("head", F.coalesce("head", "item"))
    heads = number_rows(every.select("head").distinct(), ["head"], "cluster_id")
    return every.join(heads, "head").select("item", F.col("cluster_id").cast("long").alias("cluster_id"))


@clusterers.add("connected_components")
def connected_components():
    def cluster(pairs: DataFrame, n: int, threshold: float | None = 0.0, sense: str = "maximize") -> DataFrame:
        edges = _checked(passing(pairs, threshold, sense), n)
        return _labels(components(edges, "i", "j").select(F.col("node").alias("item"), F.col("component").alias("head")), n)

    return cluster


@clusterers.add("correlation")
def correlation_clustering():
    """Pivot in index order, without chaining: the lowest open item takes its open neighbours.

    The pivots are the lexicographically first maximal independent set, found in rounds of items that are
    lower than all their open neighbours; everyone else joins the lowest pivot among its neighbours.
    """

    def cluster(pairs: DataFrame, n: int, threshold: float | None = 0.0, sense: str = "maximize") -> DataFrame:
        edges = _checked(passing(pairs, threshold, sense), n).filter("i <> j")
        both = materialize(edges.select("i", "j").unionAll(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct(), "edges")
        open_items, pivots = materialize(both.select("i").distinct(), "open"), None
        while not open_items.isEmpty():
            live = both.join(open_items, "i", "left_semi").join(open_items.select(F.col("i").alias("j")), "j", "left_semi")
            new = open_items.join(live.groupBy("i").agg(F.min("j").alias("lo")), "i", "left").filter("lo is null or i < lo").select(F.col("i").alias("p"))
            new = materialize(new, "pivots")
            pivots = new if pivots is None else pivots.unionAll(new)
            beside = both.join(new, F.col("j") == F.col("p")).select("i")
            open_items = materialize(open_items.join(new.select(F.col("p").alias("i")).unionAll(beside).distinct(), "i", "left_anti"), "open")
        if pivots is None:
            return _labels(both.select(F.col("i").alias("item"), F.col("j").alias("head")), n)
        joined = both.join(pivots, F.col("j") == F.col("p")).join(pivots.select(F.col("p").alias("i")), "i", "left_anti").groupBy("i").agg(F.min("p").alias("head"))
        return _labels(joined.select(F.col("i").alias("item"), "head"), n)

    return cluster


def groups(partition: DataFrame) -> DataFrame:
    return partition.groupBy("cluster_id").agg(F.sort_array(F.collect_list("item")).alias("items"))


def pairs_within(partition: DataFrame) -> DataFrame:
    """Pairs of items of one cluster, i < j: the partition as links, quadratic in its clusters."""
    a = partition.select("cluster_id", F.col("item").alias("i"))
    return a.join(partition.select("cluster_id", F.col("item").alias("j")), "cluster_id").filter("i < j").select("i", "j")


POLICIES = ("first", "most_complete", "majority")


def canonicalize(partition: DataFrame, records: DataFrame, policy: str = "most_complete") -> DataFrame:
    """One record a cluster. records: item and fields. Ties go to the lower item; majority votes by field over non-null values."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}, not {policy!r}")
    fields = [c for c in records.columns if c != "item"]
    rows = partition.join(records, "item")
    if policy == "majority":
        out = rows.select("cluster_id").distinct()
        for f in fields:
            votes = rows.filter(F.col(f).isNotNull()).groupBy("cluster_id", f).agg(F.count("*").alias("n"), F.min("item").alias("at"))
            won = votes.groupBy("cluster_id").agg(F.max_by(f, F.struct("n", -F.col("at"))).alias(f))
            out = out.join(won, "cluster_id", "left")
        return out
    filled = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0)) if policy == "most_complete" else F.lit(0)
    best = rows.groupBy("cluster_id").agg(F.max_by(F.struct(*fields), F.struct(filled, -F.col("item"))).alias("r"))
    return best.select("cluster_id", *[F.col(f"r.{f}").alias(f) for f in fields])


def classify(weight, lower: float, upper: float):
    """match from upper on, non_match up to lower, else possible_match; upper is asked first."""
    if math.isnan(lower) or math.isnan(upper) or lower > upper:
        raise ValueError("lower must not be above upper, and neither may be NaN")
    plain = F.when(weight >= upper, "match").when(weight <= lower, "non_match").otherwise("possible_match")
    return F.when(F.isnan(weight), F.raise_error(F.lit("a weight is NaN")).cast("string")).otherwise(plain)


def estimate_mu_em(scores: DataFrame, fields: list[str], rounds: int = 50, agree: float = 0.5, eps: float = 1e-6) -> dict:
    """m and u of each field, and the share of matches, from two classes by EM.

    One aggregation counts the patterns of agreement (at most 3 to the number of fields, null being no evidence);
    the rounds then run over the counted patterns.
    """
    rows = scores.select(*[F.when(F.col(f).isNull(), None).otherwise((F.col(f) >= agree).cast("int")).alias(f) for f in fields]).groupBy(*fields).count().collect()
    clamp = lambda x: min(1 - eps, max(eps, x))
    m, u, p = dict.fromkeys(fields, 0.9), dict.fromkeys(fields, 0.1), 0.1
    total = sum(r["count"] for r in rows)
    for _ in range(rounds if total else 0):
        weights = []
        for r in rows:
            a, b = math.log(clamp(p)), math.log(1 - clamp(p))
            for f in fields:
                if r[f] is not None:
                    a += math.log(m[f] if r[f] else 1 - m[f])
                    b += math.log(u[f] if r[f] else 1 - u[f])
            top = max(a, b)
            weights.append(math.exp(a - top) / (math.exp(a - top) + math.exp(b - top)))
        p = clamp(sum(w * r["count"] for w, r in zip(weights, rows, strict=True)) / total)
        for f in fields:
            seen = [(w, r) for w, r in zip(weights, rows, strict=True) if r[f] is not None]
            yes, no = sum(w * r["count"] for w, r in seen), sum((1 - w) * r["count"] for w, r in seen)
            if yes > 0:
                m[f] = clamp(sum(w * r["count"] * r[f] for w, r in seen) / yes)
            if no > 0:
                u[f] = clamp(sum((1 - w) * r["count"] * r[f] for w, r in seen) / no)
    return {"m": m, "u": u, "p": p}


def platt(scored: DataFrame, score: str = "score", label: str = "label"):
    """Fits a logistic curve to scores and 0/1 labels; returns frame to frame, adding `probability`."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    assemble = VectorAssembler(inputCols=[score], outputCol="__x")
    rows = assemble.transform(scored.select(F.col(score).cast("double").alias(score), F.col(label).cast("double").alias("__y")))
    model = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=1.0 / max(1, rows.count()), standardization=False).fit(rows)
    return lambda df: model.transform(assemble.transform(df)).withColumn("probability", vector_to_array("probability")[1]).drop("__x", "rawPrediction", "prediction")


def isotonic(scored: DataFrame, score: str = "score", label: str = "label"):
    """Fits a monotone step curve, constant outside of the fitted range; adds `probability`."""
    from pyspark.ml.regression import IsotonicRegression

    rows = scored.select(F.col(score).cast("double").alias("__s"), F.col(label).cast("double").alias("__y"))
    model = IsotonicRegression(featuresCol="__s", labelCol="__y").fit(rows)
    return lambda df: model.setPredictionCol("probability").transform(df.withColumn("__s", F.col(score).cast("double"))).drop("__s")


def pairwise_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of one partition's pairs against another's, from the sizes of clusters and their overlaps."""
    two = lambda n: F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0))
    both = found.withColumnRenamed("cluster_id", "f").join(truth.withColumnRenamed("cluster_id", "t"), "item")
    hit = both.groupBy("f", "t").count().agg(two(F.col("count")).alias("hit"))
    n_found = both.groupBy("f").count().agg(two(F.col("count")).alias("n_found"))
    n_true = both.groupBy("t").count().agg(two(F.col("count")).alias("n_true"))
    r = hit.crossJoin(n_found).crossJoin(n_true)
    p, q = F.when(F.col("n_found") == 0, 1.0).otherwise(F.col("hit") / F.col("n_found")), F.when(F.col("n_true") == 0, 1.0).otherwise(F.col("hit") / F.col("n_true"))
    return r.select(p.alias("precision"), q.alias("recall"), F.when(p + q == 0, 0.0).otherwise(2 * p * q / (p + q)).alias("f1"))


def b_cubed(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean over items of the share of its cluster that belongs with it, and of its kin that is in its cluster."""
    both = found.withColumnRenamed("cluster_id", "f").join(truth.withColumnRenamed("cluster_id", "t"), "item").groupBy("f", "t").count()
    w = both.withColumn("nf", F.sum("count").over(Window.partitionBy("f"))).withColumn("nt", F.sum("count").over(Window.partitionBy("t")))
    n = F.col("count")
    return w.agg((F.sum(n * n / F.col("nf")) / F.sum(n)).alias("precision"), (F.sum(n * n / F.col("nt")) / F.sum(n)).alias("recall"))

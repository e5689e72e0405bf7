"""Facades: match two collections, deduplicate one, resolve several. Collections have columns id and item, ids from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.frames import Edges, check_sense
from linkspark.functions.similarity import comparators
from linkspark.operators.blocking import blockers, score_candidates
from linkspark.operators.clustering import clusterers
from linkspark.operators.features import TfIdf, cosine_by_terms, featurizers, similarity_matrix
from linkspark.operators.matching import harden, match_in_key_order, resolve_matcher, soft_match
from linkspark.operators.vectors import scored_within


def _sense(compare, sense: str | None) -> str:
    return check_sense(sense) if sense else comparators.trait(compare if compare is not None else "ratio").sense


def score(a: DataFrame, b: DataFrame | None, *, featurize=None, compare=None, block=None, sense: str | None = None) -> Edges:
    """Edges by the route that the options ask for: candidates scored, all pairs compared, or TF-IDF cosine."""
    if featurize is not None and compare is not None:
        raise ValueError("featurize and compare exclude each other")
    if compare is not None or block is not None and featurize is None:
        pairs = blockers.resolve(block, "all_pairs")(a, b)
        return score_candidates(a, b, pairs, comparators.resolve(compare, "ratio"), _sense(compare, sense))
    model = featurizers.resolve(featurize, "tfidf")
    if not isinstance(model, TfIdf):
        return featurized(model)(a, b, blockers.resolve(block, "all_pairs")(a, b))
    if block is None:
        return Edges(similarity_matrix(a, a if b is None else b, model, dense=True), sense or "maximize")
    model = model.fit(a if b is None else a.unionByName(b.withColumn("id", -F.col("id") - 1)))
    found = cosine_by_terms(model.transform(a), model.transform(a if b is None else b))
    pairs = blockers.resolve(block)(a, b).distinct()
    return Edges(pairs.join(found, ["i", "j"], "left").withColumn("score", F.coalesce("score", F.lit(0.0))), "maximize")


def featurized(featurizer, metric="cosine"):
    """Scores candidate pairs by a metric of their items' vectors. featurizer: a name, or a function from items (id, item)
    to vectors: a frame with id and vec, or with item replaced by its vector."""
    model, compare = featurizers.resolve(featurizer), comparators.resolve(metric)

    def vectors(items: DataFrame) -> DataFrame:
        found = model(items)
        return found.select("id", F.col("vec" if "vec" in found.columns else "item").cast("array<double>").alias("item"))

    def compare_pairs(a: DataFrame, b: DataFrame | None, pairs: DataFrame) -> Edges:
        return score_candidates(vectors(a), None if b is None else vectors(b), pairs, compare, _sense(metric, None))

    return compare_pairs


def featurized_within(featurizer, metric: str = "cosine"):
    """Scores (6 digits) of all pairs of items that agree in a column, by cosine, dot or angular of their vectors, in blocks. featurizer: as of featurized."""
    model = featurizers.resolve(featurizer)

    def compare_all(items: DataFrame, key: str) -> DataFrame:
        found = model(items.select("id", "item"))
        found = found.select("id", F.col("vec" if "vec" in found.columns else "item").alias("item"))
        return scored_within(items if featurizer == "identity" else items.select("id", key).join(found, "id"), key, metric)

    return compare_all


def match(a: DataFrame, b: DataFrame | None, *, featurize=None, compare=None, block=None, how: str = "assign", threshold: float | None = None, cluster=None, sense: str | None = None) -> DataFrame:
    """Pairs (i, j, score); with how='cluster' a partition of a, then b (ids of b after a's).

    how: a matcher's name, assign (optimal), soft or cluster. threshold filters edges first (cluster: 0.5 by default).
    """
    if b is None:
        raise ValueError("match() needs two collections; dedupe() takes one")
    edges = score(a, b, featurize=featurize, compare=compare, block=block, sense=sense)
    if how == "cluster":
        n_a, n_b = a.count(), b.count()
        pooled = edges.df.withColumn("j", F.col("j") + n_a)
        return clusterers.resolve(cluster, "connected_components")(pooled, n_a + n_b, 0.5 if threshold is None else threshold, edges.sense)
    if threshold is not None:
        keep = F.col("score") >= threshold if edges.sense == "maximize" else F.col("score") <= threshold
        edges = Edges(edges.df.filter(keep), edges.sense)
    if how == "soft":
        return harden(soft_match(edges)).drop("score").join(edges.df, ["i", "j"])
    return resolve_matcher("optimal" if how == "assign" else how)(edges)


def dedupe(a: DataFrame, *, compare="ratio", block=None, threshold: float = 0.7, cluster=None, sense: str | None = None) -> DataFrame:
    """A partition (item, cluster_id) of one collection. The comparator says whether scores are distances."""
    edges = score(a, None, compare=compare, block=block, sense=sense)
    return clusterers.resolve(cluster, "connected_components")(edges.df, a.count(), threshold, edges.sense)


def pool(*collections: DataFrame) -> DataFrame:
    """One collection: ids of each after those of the ones before."""
    out, n = None, 0
    for c in collections:
        part = c.select((F.col("id") + n).alias("id"), "item")
        out, n = part if out is None else out.unionByName(part), n + c.count()
    if out is None:
        raise ValueError("resolve() needs a collection")
    return out


def resolve(*collections: DataFrame, **options) -> DataFrame:
    return dedupe(pool(*collections), **options)


def match_keys_to_values(keys: DataFrame, values: DataFrame, matcher: str = "optimal", featurizer: TfIdf | None = None) -> DataFrame:
    """(key, value) texts matched by TF-IDF cosine."""
    pairs = resolve_matcher(matcher)(Edges(similarity_matrix(keys, values, featurizer, dense=True)))
    return labeled(pairs, keys, values)


def match_greedily(keys: DataFrame, values: DataFrame, compare="ratio", minimum: float = float("-inf")) -> DataFrame:
    """Keys in order each take their best remaining value; scores must be positive."""
    edges = score_candidates(keys, values, blockers.resolve("all_pairs")(keys, values), comparators.resolve(compare))
    return labeled(match_in_key_order(edges.df, minimum), keys, values)


def labeled(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.select(F.col("id").alias("i"), F.col("item").alias("key")), b.select(F.col("id").alias("j"), F.col("item").alias("value"))
    return pairs.join(left, "i").join(right, "j").select("key", "value", "score")


def collection(df: DataFrame, item: str, order: str) -> DataFrame:
    """id (0, 1, ... in the order of a unique column), item, and the column itself."""
    from linkspark.operators.blocking import number_rows

    return number_rows(df.select(F.col(order).alias("key"), F.col(item).alias("item")), ["key"], "id").select(F.col("id").cast("long").alias("id"), "item", "key")


def column_profile_similarity(left: DataFrame, right: DataFrame, low: int = 2, high: int = 3) -> DataFrame:
    """Jaccard of the distinct values of every pair of string columns: hints at join keys."""
    def values(df: DataFrame, n: str) -> DataFrame:
        names = [c for c, t in df.dtypes if t == "string"]
        return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias(n), F.lower(c).alias("v")) for c in names])).alias("x")).select("x.*").filter("v is not null").distinct()

    a, b = values(left, "a"), values(right, "b")
    sized = lambda df, n: df.groupBy(n).agg(F.count("*").alias(f"n{n}"))
    both = a.join(b, "v").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return both.join(sized(a, "a"), "a").join(sized(b, "b"), "b").select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b")))

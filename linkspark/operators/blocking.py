"""Blocking: which pairs are worth comparing. Blockers take (a, b) with columns id, item and return pairs (i, j).

b=None is a self-join: pairs with i < j.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.frames import Edges, Registry
from linkspark.functions import text
from linkspark.functions.similarity import comparators
from linkspark.operators.skew import join_blocks
from linkspark.operators.vectors import nearest
from linkspark.sources.storage import materialize

blockers = Registry("blocker")

#: MinHash permutes hashes modulo this.
PRIME = (1 << 31) - 1
#: A pair that is looked up by a bucket costs about as much as this many pairs in blocks of vectors.
SPARSE = 64
#: Rows of words that are handed to Python at a time to be signed.
SIGNED = 512


def _sides(a: DataFrame, b: DataFrame | None, *extra: Column) -> tuple[DataFrame, DataFrame, bool]:
    alone = b is None
    return a.select(F.col("id").alias("i"), *extra), (a if alone else b).select(F.col("id").alias("j"), *extra), alone


@blockers.add("all_pairs")
def all_pairs_blocker():
    def block(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
        left, right, alone = _sides(a, b)
        return left.join(right, F.col("i") < F.col("j")) if alone else left.crossJoin(right)

    return block


def _keyed(df: DataFrame, name: str, keys: Callable[[Column], Column]) -> DataFrame:
    """Distinct (name, k), without null keys."""
    return df.select(F.col("id").alias(name), F.explode(keys(F.col("item"))).alias("k")).filter("k is not null").distinct()


def _met(left: DataFrame, right: DataFrame, alone: bool = False) -> DataFrame:
    """Pairs (i, j) of the distinct rows (i, k), (j, k) that share a k, each once; alone: those with i < j. Only pairs of which both have
    several keys can repeat, so only these are made distinct."""
    own = lambda df, x: df.groupBy(x).agg(F.count("*").alias("n")).filter("n > 1").select(x, F.lit(True).alias(f"many{x}"))
    several = [own(df, x) for df, x in ((left, "i"), (right, "j"))]
    if any(x.isEmpty() for x in several):
        pairs = join_blocks(left, right, ["k"]).select("i", "j")
        return pairs.filter("i < j") if alone else pairs
    pairs = join_blocks(left.join(several[0], "i", "left"), right.join(several[1], "j", "left"), ["k"])
    pairs = pairs.filter("i < j") if alone else pairs
    twice = F.col("manyi").isNotNull() & F.col("manyj").isNotNull()
    return pairs.filter(~twice).select("i", "j").unionAll(pairs.filter(twice).select("i", "j").distinct())


@blockers.add("key")
def key_blocking(keys: Callable[[Column], Column] | None = None):
    """Pairs whose key arrays meet, each once. keys: item column to an array column."""
    keys = keys or text.whole_value()

    def block(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
        return _met(_keyed(a, "i", keys), _keyed(a if b is None else b, "j", keys), b is None)

    return block


def key_blocking_pruned(keys: Callable[[Column], Column], max_degree: int):
    """prune_frequent(key_blocking(keys)(a, b), max_degree) without the pairs of items that are too frequent by one key alone."""

    def block(a: DataFrame, b: DataFrame) -> DataFrame:
        left, right = _keyed(a, "i", keys), _keyed(b, "j", keys)
        often = lambda df: df.groupBy("k").count().filter(F.col("count") > max_degree).select("k")
        few = lambda df, other, x: df.join(df.join(often(other), "k", "left_semi").select(x).distinct(), x, "left_anti")
        few_left, few_right = few(left, right, "i"), few(right, left, "j")
        too = lambda pairs, x: pairs.groupBy(x).count().filter(F.col("count") > max_degree).select(x)
        few_left = few_left.join(too(_met(few_left, right), "i"), "i", "left_anti")
        few_right = few_right.join(too(_met(left, few_right), "j"), "j", "left_anti")
        return _met(few_left, few_right)

    return block


@blockers.add("first_chars")
def first_chars_blocker(n: int = 1, lowercase: bool = True):
    return key_blocking(text.first_chars(n, lowercase))


@blockers.add("qgrams")
def qgram_blocker(q: int = 2):
    return key_blocking(text.qgram_keys(q))


@blockers.add("phonetic")
def phonetic_blocker():
    return key_blocking(text.phonetic_key())


@blockers.add("sorted_neighborhood")
def sorted_neighborhood(window: int = 3, sort_key: Callable[[Column], Column] | None = None):
    """Pairs at most window - 1 apart in the order of the key. Across two sides, runs of equal keys alternate a, b.

    The order is one sequence over all items. Positions come from counts per range partition, so
    neither numbering nor pairing has a single task.
    """
    if window < 2:
        raise ValueError("window must be 2 at least")
    key = sort_key or (lambda x: x)

    def block(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
        pooled = a.select("id", key(F.col("item")).alias("k"), F.lit(0).alias("side"))
        if b is not None:
            pooled = pooled.unionByName(b.select("id", key(F.col("item")).alias("k"), F.lit(1).alias("side")))
            run = Window.partitionBy("k", "side").orderBy("id")
            pooled = pooled.withColumn("turn", F.row_number().over(run))
        else:
            pooled = pooled.withColumn("turn", F.lit(0))
        placed = number_rows(pooled, ["k", "turn", "side", "id"], "pos")
        steps = placed.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(window - 1))))
        first = steps.filter("step > 0").select(F.col("id").alias("x"), F.col("side").alias("sx"), (F.col("pos") + F.col("step")).alias("pos"))
        pairs = first.join(placed.select("pos", F.col("id").alias("y"), F.col("side").alias("sy")), "pos")
        if b is None:
            return pairs.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
        return pairs.filter("sx <> sy").select(F.when(F.col("sx") == 0, F.col("x")).otherwise(F.col("y")).alias("i"), F.when(F.col("sx") == 0, F.col("y")).otherwise(F.col("x")).alias("j"))

    return block


def number_rows(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Dense numbers from 0 in the order of `by` (a total order), without a single-task window."""
    part = materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id()), "numbered")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*by))
    counts = part.groupBy("__part").count()  # one row a partition
    start = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return part.withColumn("__n", within).join(F.broadcast(counts.select("__part", start.alias("__start"))), "__part").withColumn(name, F.col("__start") + F.col("__n") - 1).drop("__part", "__n", "__start")


def top_k(scores: DataFrame, k: int, sense: str = "maximize") -> DataFrame:
    """The k best j of each i: adds rank from 1; NaN last, ties to the lower j."""
    order = [F.isnan("score"), F.col("score").desc() if sense == "maximize" else F.col("score").asc(), "j"]
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(*order))).filter(F.col("rank") <= k)


@blockers.add("brute_knn")
def brute_knn_blocking(k: int = 5, similarity: Callable | None = None):
    """Exact k nearest of each item by cosine (items: arrays). Self-joins leave out the item itself and may name a pair twice."""

    def block(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
        if similarity is None:
            near = nearest(a, b, k, top_k)
            return near.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")) if b is None else near.select("i", "j")
        left = a.select(F.col("id").alias("i"), F.col("item").alias("x"))
        right = (a if b is None else b).select(F.col("id").alias("j"), F.col("item").alias("y"))
        pairs = left.crossJoin(right)
        if b is None:
            pairs = pairs.filter("i <> j")
        near = top_k(pairs.select("i", "j", similarity(F.col("x"), F.col("y")).alias("score")), k)
        return near.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")) if b is None else near.select("i", "j")

    return block


def ann_bands(a: DataFrame, b: DataFrame | None = None, tables: int = 24, rows: int = 4, width: float = 0.4, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """id, item, bands of either side: for each of `tables`, a hash of the buckets of `width` that its `rows` random projections fall into."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    from linkspark.functions.similarity import l2_normalize

    vec = array_to_vector(l2_normalize(F.col("item"))).alias("vec")
    left, right = a.select("id", "item", vec), (a if b is None else b).select("id", "item", vec)
    model = BucketedRandomProjectionLSH(inputCol="vec", outputCol="hashes", bucketLength=width, numHashTables=tables * rows, seed=seed).fit(left)
    band = lambda t: F.xxhash64(F.transform(F.slice("hashes", t * rows + 1, F.lit(rows)), lambda h: h.cast("string")))
    side = lambda df: model.transform(df).select("id", "item", F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), band).alias("bands"))
    return side(left), side(right)


def ann_candidates(a: DataFrame, b: DataFrame | None = None, **options) -> DataFrame:
    """Pairs (i, j) that meet: they have one of their bands (ann_bands, with its options) in common."""
    left, right = (x.select(F.col("id").alias(n), F.posexplode("bands").alias("t", "h")) for x, n in zip(ann_bands(a, b, **options), "ij", strict=True))
    met = left.join(right, ["t", "h"]).select("i", "j").distinct()
    return met.filter("i <> j") if b is None else met


@blockers.add("ann")
def ann_blocking(k: int = 5, **options):
    """Approximate k nearest by cosine: the best among those that meet in a bucket of random projections (ann_candidates).

    Where the buckets hold so many that going through them would cost more than all pairs in blocks (SPARSE), the same candidates are found in blocks.
    """

    def block(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
        left, right = ann_bands(a, b, **options)
        left = materialize(left, "bands")
        right = left if b is None else materialize(right, "bands")
        count = lambda df, n: df.select(F.posexplode("bands").alias("t", "h")).groupBy("t", "h").agg(F.count("*").alias(n))
        met = count(left, "x").join(count(right, "y"), ["t", "h"]).agg(F.sum(F.col("x").cast("double") * F.col("y"))).first()[0] or 0.0
        if met * SPARSE > float(left.count()) * right.count():
            return nearest(left, None if b is None else right, k, top_k, "bands").select("i", "j")
        x, y = (df.select(F.col("id").alias(n), F.posexplode("bands").alias("t", "h")) for df, n in ((left, "i"), (right, "j")))
        met = x.join(y, ["t", "h"]).select("i", "j").distinct()
        met = met.filter("i <> j") if b is None else met
        scored = met.join(left.select(F.col("id").alias("i"), F.col("item").alias("x")), "i").join(right.select(F.col("id").alias("j"), F.col("item").alias("y")), "j")
        return top_k(scored.select("i", "j", comparators.resolve("cosine")(F.col("x"), F.col("y")).alias("score")), k).select("i", "j")

    return block


def lsh_bands(threshold: float, num_perm: int) -> tuple[int, int]:
    """Bands and rows that minimise the summed areas of false positives below and false negatives above the threshold."""
    def area(f, lo: float, hi: float, n: int = 200) -> float:
        h = (hi - lo) / n
        return sum(f(lo + (k + 0.5) * h) for k in range(n)) * h

    best, choice = float("inf"), (1, num_perm)
    for b in range(1, num_perm + 1):
        for r in range(1, num_perm // b + 1):
            hit = lambda s, b=b, r=r: 1 - (1 - s**r) ** b
            error = area(hit, 0, threshold) + area(lambda s: 1 - hit(s), threshold, 1)  # noqa: B023
            if error < best:
                best, choice = error, (b, r)
    return choice


@blockers.add("minhash_lsh")
def minhash_lsh_blocking(threshold: float = 0.5, num_perm: int = 128, seed: int = 11):
    """Pairs whose MinHash signatures agree in a band. Sets: distinct words, split at blanks."""
    import random

    bands, rows = lsh_bands(threshold, num_perm)
    rng = random.Random(seed)
    coefficients = [(rng.randrange(1, PRIME), rng.randrange(PRIME)) for _ in range(bands * rows)]

    def block(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
        def banded(df: DataFrame, n: str) -> DataFrame:
            words = F.array_distinct(F.filter(F.split("item", r"\s+"), lambda w: w != ""))
            hashed = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))
            kind = df.schema["id"].dataType.simpleString()
            sig = df.select(F.col("id").alias(n), hashed.alias("h")).mapInArrow(lambda it: _signatures(it, coefficients), f"{n} {kind}, sig array<long>")
            each = F.array(*[F.xxhash64(F.lit(k), *[F.col("sig")[x] for x in range(k * rows, (k + 1) * rows)]) for k in range(bands)])
            return materialize(sig.select(n, each.alias("bands")), "signatures", arrow_rows=SIGNED)

        left = banded(a, "i")
        right = left.withColumnRenamed("i", "j") if b is None else banded(b, "j")
        pairs = join_blocks(left.select("i", F.explode("bands").alias("band")), right.select("j", F.explode("bands").alias("band")), ["band"]).select("i", "j")
        return (pairs.filter("i < j") if b is None else pairs).distinct()

    return block


def _signatures(batches: Iterator[pa.RecordBatch], coefficients: list[tuple[int, int]], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Least (p h + q) mod PRIME of each row's hashes, for every (p, q). Rows without hashes are left out; about `most` hashes are held at once."""
    for batch in batches:
        batch = batch.filter(pc.fill_null(pc.greater(pc.list_value_length(batch.column(1)), 0), False))
        if not batch.num_rows:
            continue
        lists = batch.column(1)
        values, sizes = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets, sig, first = np.concatenate([[0], np.cumsum(sizes)]), np.empty((len(sizes), len(coefficients)), np.int64), 0
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
            h, at = values[offsets[first] : offsets[last]], offsets[first:last] - offsets[first]
            for k, (p, q) in enumerate(coefficients):
                x = h * p + q
                for _ in range(2):  # 2^31 is 1 modulo PRIME
                    x = (x & PRIME) + (x >> 31)
                x[x == PRIME] = 0
                sig[first:last, k] = np.minimum.reduceat(x, at)
            first = last
        ends = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * np.int32(len(coefficients)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(sig.ravel()))], [batch.schema.names[0], "sig"])


# pairs as a bag

def dedupe_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.dropDuplicates(["i", "j"])


def prune_frequent(pairs: DataFrame, max_degree: int, self_join: bool = False) -> DataFrame:
    """Drops pairs that touch an item in more than max_degree pairs, repeats counted."""
    if self_join:
        degree = pairs.select(F.explode(F.array("i", "j")).alias("x")).groupBy("x").count().filter(F.col("count") > max_degree).select("x")
        return pairs.join(degree.withColumnRenamed("x", "i"), "i", "left_anti").join(degree.withColumnRenamed("x", "j"), "j", "left_anti").select("i", "j")
    often = lambda c: pairs.groupBy(c).count().filter(F.col("count") > max_degree).select(c)
    return pairs.join(often("i"), "i", "left_anti").join(often("j"), "j", "left_anti").select("i", "j")


def blocking_metrics(candidates: DataFrame, truth: DataFrame, n_a: int, n_b: int | None = None) -> DataFrame:
    """One row: pair completeness, reduction ratio, pair quality, number of candidates. n_b=None: self-join."""
    alone = n_b is None
    line = lambda df: (df.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")) if alone else df.select("i", "j")).distinct()
    cand, real = line(candidates), line(truth)
    total = n_a * (n_a - 1) / 2 if alone else n_a * n_b
    counts = cand.agg(F.count("*").alias("n")).crossJoin(real.agg(F.count("*").alias("t"))).crossJoin(cand.join(real, ["i", "j"]).agg(F.count("*").alias("hit")))
    return counts.select(
        F.when(F.col("t") == 0, 1.0).otherwise(F.col("hit") / F.col("t")).alias("pair_completeness"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("n") / F.lit(float(total or 1)))).alias("reduction_ratio"),
        F.when(F.col("n") == 0, 1.0).otherwise(F.col("hit") / F.col("n")).alias("pair_quality"),
        F.col("n").alias("n_candidates"),
    )


def score_candidates(a: DataFrame, b: DataFrame | None, pairs: DataFrame, compare: Callable, sense: str = "maximize") -> Edges:
    """Each distinct pair scored once. A pair that names an id that isn't there raises when it is read."""
    left = a.select(F.col("id").alias("i"), F.col("item").alias("x"), F.lit(True).alias("has_i"))
    right = (a if b is None else b).select(F.col("id").alias("j"), F.col("item").alias("y"), F.lit(True).alias("has_j"))
    both = dedupe_pairs(pairs).join(left, "i", "left").join(right, "j", "left")
    there = F.col("has_i").isNotNull() & F.col("has_j").isNotNull()
    score = F.when(there, compare(F.col("x"), F.col("y"))).otherwise(F.raise_error(F.lit("a candidate names an id that isn't there")).cast("double"))
    return Edges(both.select("i", "j", score.alias("score")), sense)

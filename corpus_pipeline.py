"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, redaction, mixing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), docs having the columns of
`documents`, and returns what it keeps. run() applies them in order, each result written as Parquet to
the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import common, decontaminate, jaccard, mixing, pii, quality


def _free(docs: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until the documents have no such column."""
    out = []
    for name in names:
        while name in docs.columns or name in out:
            name += "_"
        out.append(name)
    return out


def _same(docs: DataFrame, other: DataFrame, i: str, t: str):
    """A row is named by its id and its text, which no stage but redaction changes."""
    return docs["doc_id"].eqNullSafe(other[i]) & (F.xxhash64(docs["text"]) == other[t])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject."""
    return quality.filter_documents(docs, quality.trusted_ids(common.table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component (the smallest id, once) and every row without shingles, repeated or not."""
    i, t, again = _free(docs, "i", "t", "again")
    found = common.materialize(jaccard.jaccard_components(docs).filter("set_id is not null").select("doc_id", "th", "group_id"), "found")
    first = found.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("one"))
    rows = found.groupBy("group_id", "doc_id", "th").agg(F.count("*").alias("n")).join(first, "group_id")
    kept = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("th") == F.col("one.th"))
    # rows that go, and rows of which one goes on: the others need no look
    marks = rows.filter(~kept | (F.col("n") > 1)).select(F.col("doc_id").alias(i), F.col("th").alias(t), kept.alias(again))
    marked = common.materialize(docs.join(marks, _same(docs, marks, i, t), "left").drop(i, t), "marked")
    once = marked.filter(again).dropDuplicates(["doc_id", "text"])
    return marked.filter(F.col(again).isNull()).unionByName(once).drop(again)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    i, t = _free(docs, "i", "t")
    found = decontaminate.contaminated_keys(docs, common.table(spark, sf_dir, "benchmark")).toDF(i, t)
    return docs.join(found, _same(docs, found, i, t), "left_anti")


def redaction_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents to bring the sources to their targets; adds `copy`."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", redaction_stage),
    ("mixing", mixing_stage),
]

#: The stages' models and graph scores are not expressed in SQL; the tests compare what each stage does with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            common.discard(before)
        common.release(spark)
        before = docs
    return docs

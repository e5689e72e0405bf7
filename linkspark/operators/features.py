"""TF-IDF over character n-grams, kept sparse: one row per item and gram."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.frames import Registry, Trait, require
from linkspark.functions.text import char_ngrams

featurizers = Registry("featurizer")


@dataclass
class TfIdf:
    """idf = ln((1 + N) / (1 + df)) + 1; weights have length 1 per item; grams unseen in fitting are dropped."""

    low: int = 2
    high: int = 4
    lowercase: bool = True
    idf: DataFrame | None = None

    def _counts(self, items: DataFrame) -> DataFrame:
        grams = char_ngrams(F.col("item"), self.low, self.high, self.lowercase)
        return items.select("id", F.explode(grams).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))

    def fit(self, items: DataFrame) -> TfIdf:
        """items: id, item. The ids must differ."""
        n = items.select(F.count("*").alias("n_items"))
        df = self._counts(items).groupBy("gram").agg(F.count("*").alias("df"))
        self.idf = df.join(F.broadcast(n)).select("gram", (F.log((1 + F.col("n_items")) / (1 + F.col("df"))) + 1).alias("idf"))  # n is one row
        return self

    def transform(self, items: DataFrame) -> DataFrame:
        """id, gram, weight."""
        if self.idf is None:
            raise RuntimeError("fit() comes before transform()")
        raw = self._counts(items).join(self.idf, "gram").withColumn("w", F.col("tf") * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
        return raw.select("id", "gram", (F.col("w") / norm).alias("weight"))


@featurizers.add("tfidf", Trait(output="vector", normalized=True))
def tfidf(**options) -> TfIdf:
    return TfIdf(**options)


@featurizers.add("identity", Trait(output="structured"))
def identity():
    return lambda items: items


@featurizers.add("sbert", Trait(output="vector", normalized=True))
def sbert(model: str = "all-MiniLM-L6-v2"):
    """Sentence embeddings, loaded once per worker: id, vec."""
    require("sentence_transformers", "the sbert featurizer")

    def embed(items: DataFrame) -> DataFrame:
        def part(batches):
            from sentence_transformers import SentenceTransformer

            encoder = SentenceTransformer(model)
            for pdf in batches:
                pdf["vec"] = list(encoder.encode(pdf["item"].tolist(), normalize_embeddings=True))
                yield pdf[["id", "vec"]]

        return items.mapInPandas(part, "id long, vec array<double>")

    return embed


def cosine_by_terms(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, score for all pairs that share a gram (others are 0); a, b: id, gram, weight at length 1."""
    left = a.select(F.col("id").alias("i"), "gram", F.col("weight").alias("wa"))
    right = b.select(F.col("id").alias("j"), "gram", F.col("weight").alias("wb"))
    return left.join(right, "gram").groupBy("i", "j").agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))


def similarity_matrix(keys: DataFrame, values: DataFrame, featurizer: TfIdf | None = None, dense: bool = False) -> DataFrame:
    """Cosine of TF-IDF fitted on keys and values together. dense: pairs without a shared gram too, as 0."""
    model = featurizer or TfIdf()
    if model.idf is None:
        both = keys.select(F.concat(F.lit("a"), F.col("id")).alias("id"), "item").unionByName(values.select(F.concat(F.lit("b"), F.col("id")).alias("id"), "item"))
        model = TfIdf(model.low, model.high, model.lowercase).fit(both)
    found = cosine_by_terms(model.transform(keys), model.transform(values))
    if not dense:
        return found
    cells = keys.select(F.col("id").alias("i")).crossJoin(values.select(F.col("id").alias("j")))
    return cells.join(found, ["i", "j"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))

"""Language identification by error-correcting output codes.

Every language gets a codeword of bits; one linear classifier for each bit, on hashed byte 3-grams,
predicts it. Loss-weighted decoding picks the language whose codeword has the smallest weighted
logistic loss against the bit margins (weights: each bit classifier's training accuracy on that
language, normalised per language), and a document whose best two languages are close is flagged.

The classifiers are fitted on a bounded sample, MAX_PER_LANGUAGE documents a language, taken by a hash
of the id; everything else reads all documents, whole texts.

Edge cases: a null text or one without a letter is `und` with score 0 and is never learned from. A null
id counts as not held out. Repeated rows are predicted row by row. With no labelled text at
all every document is `und`; with one language every text with a letter gets it, score 1.
Ties go to the language first in code-point order. Other columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.llm import common

N_FEATURES = 2048
#: Documents of each language that the bit classifiers are fitted on, at most.
#: Parts of a language that are ranked by themselves first.
SALTS = 64
MAX_PER_LANGUAGE = 768
#: Less than this between the best two languages' scores is ambiguous.
MIN_GAP = 0.2

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, second string, ambiguous boolean"
_ROWS = 1024
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = True


class Model(NamedTuple):
    languages: list[str]
    codes: np.ndarray  # languages x bits, -1 and 1
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits, rows sum to 1


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """All 2^(k-1) - 1 splits for up to five languages, else the best-spread of some random codes."""
    if k < 2:
        return np.ones((k, 0))
    if k <= 5:
        splits = [s for s in itertools.product([1, -1], repeat=k) if s[0] == 1 and -1 in s]
        return np.array(splits, float).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    best, spread = None, -1
    for _ in range(64):
        m = rng.choice([-1.0, 1.0], (k, bits))
        m[0, np.abs(m.sum(0)) == k] *= -1
        d = (bits - m @ m.T) / 2
        if (s := d[~np.eye(k, dtype=bool)].min()) > spread:
            best, spread = m, s
    return best


def features(texts: pa.Array) -> np.ndarray:
    """Shares of the hashed byte 3-grams (A-Z lower-cased) of each text."""
    body, offsets = common.raw(texts)
    n = len(offsets) - 1
    if len(body) < 3:
        return np.zeros((n, N_FEATURES))
    b = common.LOWER[body].astype(np.uint32)
    h = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(21)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    whole = doc[:-2] == doc[2:]
    counts = np.bincount(doc[:-2][whole] * N_FEATURES + h[whole], minlength=n * N_FEATURES).reshape(n, N_FEATURES).astype(float)
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


def has_letter(texts: pa.Array) -> np.ndarray:
    body, offsets = common.raw(texts)
    some = common.segment_sum(_IS_LETTER[body].astype(np.int64), offsets) > 0
    for i in np.flatnonzero(~some):
        some[i] = any(map(str.isalpha, texts[int(i)].as_py().decode("utf-8", "ignore")))
    return some


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in common.slices(batch, "text", rows=_ROWS):
            keep = np.flatnonzero(has_letter(texts))
            x = features(texts)[keep].astype(np.float32)
            yield pa.RecordBatch.from_arrays([rows.column("lang").take(pa.array(keep)), pa.array([v.tobytes() for v in x], pa.binary())], ["lang", "x"])


def _fit_bits(x: np.ndarray, y: np.ndarray, rounds: int = 300, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions on scaled shares, all bits at once, by full-batch Adam."""
    n, d = x.shape
    w, m, v = (np.zeros((d + 1, y.shape[1]), np.float32) for _ in range(3))
    x1 = np.concatenate([x, np.ones((n, 1), np.float32)], 1)
    for t in range(1, rounds + 1):
        p = y / (1 + np.exp(np.clip(y * (x1 @ w), -30, 30)))
        g = l2 * w - x1.T @ p / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], w[-1]


def fit(labelled: DataFrame, *, max_per_language: int = MAX_PER_LANGUAGE) -> Model:
    """labelled: doc_id, text, lang. Different rows are ranked by a hash, without their texts, in salted parts first; those
    taken are at most max_per_language of a language, one of each that is repeated, whatever their ids."""
    labelled = labelled.filter("text is not null and lang is not null and text rlike '\\\\p{L}'").withColumn("h", F.xxhash64("lang", "doc_id", "text"))
    ranked = labelled.select("lang", "h").distinct().withColumn("salt", F.pmod("h", F.lit(SALTS)))
    for part in (["lang", "salt"], ["lang"]):
        ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy(*part).orderBy(F.xxhash64("h"), "h"))).filter(F.col("n") <= max_per_language)
    sample = labelled.join(F.broadcast(ranked.select(F.col("h").alias("taken"))), F.col("h") == F.col("taken"), "left_semi").dropDuplicates(["h"]).select("lang", "text")
    rows = sample.mapInArrow(_featurize, "lang string, x binary").collect()  # max_per_language vectors a language
    rows.sort(key=lambda r: (r.lang, bytes(r.x)))
    languages = sorted({r.lang for r in rows})
    codes = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, codes, np.zeros((N_FEATURES, 0)), np.zeros(0), np.ones((len(languages), 0)))
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows])
    at = np.array([languages.index(r.lang) for r in rows])
    scale = np.float32(1) / (x.std(0) + np.float32(1e-4))
    y = codes[at].astype(np.float32)
    weights, bias = _fit_bits(x * scale / np.float32(16), y)
    weights = weights * scale[:, None] / 16
    right = ((x @ weights + bias) * y) > 0
    trust = np.stack([right[at == k].mean(0) for k in range(len(languages))]) + 1e-3
    return Model(languages, codes, weights.astype(float), bias.astype(float), trust / trust.sum(1, keepdims=True))


def decode(model: Model, margins: np.ndarray) -> np.ndarray:
    """Scores of the languages (rows sum to 1): softmax of minus the weighted loss."""
    loss = np.stack([np.logaddexp(0, -margins * code) @ trust for code, trust in zip(model.codes, model.trust, strict=True)], 1)
    z = -loss * max(1, model.codes.shape[1])
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _predict(batches: Iterator[pa.RecordBatch], shared, min_gap: float) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    names = np.array([*model.languages, None], object)
    for batch in batches:
        for rows, texts in common.slices(batch, "text", rows=_ROWS):
            n, k = len(texts), len(model.languages)
            some = has_letter(texts) & (k > 0)
            if k > 1:
                scores = decode(model, features(texts) @ model.weights + model.bias)
                order = np.argsort(-scores, axis=1, kind="stable")
                first, second = order[:, 0], order[:, 1]
                top, gap = scores[np.arange(n), first], scores[np.arange(n), first] - scores[np.arange(n), second]
            else:
                first, second, top, gap = np.zeros(n, int), np.full(n, -1), np.ones(n), np.ones(n)
            best = np.where(some, names[first], "und")
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("held_out"), pa.array(best, pa.string()), pa.array(np.where(some, np.clip(top, 0, 1), 0.0)), pa.array(np.where(some, names[second], None), pa.string()), pa.array(some & (gap < min_gap))],
                ["doc_id", "held_out", "lang_pred", "score", "second", "ambiguous"],
            )


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def identify_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, max_per_language: int = MAX_PER_LANGUAGE, min_gap: float = MIN_GAP) -> DataFrame:
    """One row per document (SCHEMA). Learns from the rows outside of the held-out fold that have a language."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, folds, fold).alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = rows.filter("not held_out").select("doc_id", "text", "lang")
    model = docs.sparkSession.sparkContext.broadcast(fit(known, max_per_language=max_per_language))
    return rows.select("doc_id", "held_out", "text").mapInArrow(lambda it: _predict(it, model, min_gap), SCHEMA)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(common.table(spark, sf_dir, "documents"))


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}

"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words are runs of characters other than the ASCII blanks. Word 1-grams and 2-grams are hashed into a
fixed number of buckets; two multinomials over the buckets are counted, one over the trusted
documents and one over all documents, both with add-one smoothing. A document scores the mean
over its n-grams of ln(p_target / p_raw) and is kept when that reaches `min_llr` and it passes the
base rules (50 words at least, at most half of them in repeated three-word windows).

Edge cases: a null or empty text has no words, so it fails the base rules and scores 0. Repeated
rows and repeated ids are judged row by row and counted as often as they occur. Without a single
trusted document the target is the uniform multinomial. Columns other than the id and text are not
looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import common

N_BUCKETS = 1 << 16
#: Trusted documents that the target multinomial is fitted on, at most (taken by md5 of their id).
MAX_TRUSTED = 1 << 15
MIN_LLR = -0.1
MIN_WORDS = 50
#: Characters that count as symbols.
SYMBOLS = b"[#*$%&|<>]"[1:-1]

_IS_SYMBOL = np.zeros(256, np.uint8)
_IS_SYMBOL[list(SYMBOLS)] = 1
_LIMIT = 400_000

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"


class _Ids(dict):
    """Word to a dense number; the number's hash stands in .hashes."""

    def __init__(self) -> None:
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(int.from_bytes(hashlib.md5(word).digest()[:4], "big"))
        return n


def _tokens(texts: list[bytes], ids: _Ids) -> tuple[np.ndarray, np.ndarray]:
    numbers: list[int] = []
    ends = [0]
    for text in texts:
        numbers.extend(map(ids.__getitem__, text.split()))
        ends.append(len(numbers))
    return np.array(numbers, np.int64), np.array(ends, np.int64)


def _buckets(numbers: np.ndarray, ends: np.ndarray, ids: _Ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the 1-grams, those of the 2-grams, and where each text's 2-grams end."""
    h = np.array(ids.hashes, np.int64)[numbers] if len(numbers) else np.empty(0, np.int64)
    pair = np.ones(max(0, len(h) - 1), bool)
    cut = ends[1:-1]
    cut = cut[(cut > 0) & (cut < len(h))]
    pair[cut - 1] = False
    two = ((h[:-1] * 31 + h[1:]) % N_BUCKETS)[pair] if len(h) > 1 else np.empty(0, np.int64)
    return h % N_BUCKETS, two, np.concatenate([[0], np.cumsum(np.maximum(np.diff(ends) - 1, 0))])


def _repeated(numbers: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words of each text inside a three-word window that the text has twice or more."""
    n = len(numbers)
    if n < 3:
        return np.zeros(len(ends) - 1, np.int64)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    at = np.flatnonzero(doc[:-2] == doc[2:])
    a, b, c = numbers[at], numbers[at + 1], numbers[at + 2]
    if len(numbers) and numbers.max() >= 1 << 21:
        b = np.unique(np.stack([a, b]), axis=1, return_inverse=True)[1].ravel()
        key, low = b, c
        order = np.lexsort((low, key, doc[at]))
        same = (key[order][1:] == key[order][:-1]) & (low[order][1:] == low[order][:-1])
    else:
        key = (a << 42) | (b << 21) | c
        order = np.lexsort((key, doc[at]))
        same = key[order][1:] == key[order][:-1]
    same &= doc[at][order][1:] == doc[at][order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, np.int64)
    start = at[twice]
    covered[start] = covered[start + 1] = covered[start + 2] = 1
    return common.segment_sum(covered, ends)


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _count(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, trusted: np.ndarray) -> Iterator[pa.RecordBatch]:
    target, whole, ids = np.zeros(N_BUCKETS, np.int64), np.zeros(N_BUCKETS, np.int64), _Ids()
    for batch in batches:
        for rows, texts in common.slices(batch, text_col):
            ids = _Ids() if len(ids) > _LIMIT else ids
            numbers, ends = _tokens(texts.to_pylist(), ids)
            one, two, two_ends = _buckets(numbers, ends, ids)
            whole += np.bincount(one, minlength=N_BUCKETS) + np.bincount(two, minlength=N_BUCKETS)
            good = np.isin(np.array([-1 if x is None else x for x in rows.column(id_col).to_pylist()], np.int64), trusted) & ~rows.column(id_col).is_null().to_numpy(zero_copy_only=False)
            if good.any():
                target += np.bincount(one[np.repeat(good, np.diff(ends))], minlength=N_BUCKETS) + np.bincount(two[np.repeat(good, np.diff(two_ends))], minlength=N_BUCKETS)
    some = np.flatnonzero(whole)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(target[some]), pa.array(whole[some])], ["bucket", "target", "whole"])


def fit(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_trusted: int = MAX_TRUSTED) -> np.ndarray:
    """ln(p_target / p_raw) of every bucket. trusted: a frame with the ids of trusted documents."""
    rows = trusted.select(F.col(id_col).cast("long").alias("i")).filter("i is not null").distinct().orderBy(F.md5(F.col("i").cast("string")), "i").limit(max_trusted).collect()
    good = np.sort(np.array([r.i for r in rows], np.int64))
    parts = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(lambda it: _count(it, id_col, text_col, good), "bucket long, target long, whole long")
    counts = np.zeros((2, N_BUCKETS))
    for r in parts.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("whole").alias("whole")).collect():  # N_BUCKETS rows at most
        counts[:, r.bucket] = r.target, r.whole
    return np.log((counts[0] + 1) / (counts[0].sum() + N_BUCKETS)) - np.log((counts[1] + 1) / (counts[1].sum() + N_BUCKETS))


def _score(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, weights, min_llr: float, min_words: int) -> Iterator[pa.RecordBatch]:
    w, ids = weights.value, _Ids()
    for batch in batches:
        for rows, texts in common.slices(batch, text_col):
            ids = _Ids() if len(ids) > _LIMIT else ids
            body, offsets = common.raw(texts)
            listed = texts.to_pylist()
            numbers, ends = _tokens(listed, ids)
            one, two, two_ends = _buckets(numbers, ends, ids)
            n_words = np.diff(ends)
            n_grams = n_words + np.diff(two_ends)
            llr = (common.segment_sum(w[one], ends) + common.segment_sum(w[two], two_ends)) / np.maximum(n_grams, 1)
            repeat = _repeated(numbers, ends)
            failed = (n_words < min_words) | (100 * repeat > 50 * n_words)
            chars = common.segment_sum((((body & 0xC0) != 0x80) & ~common.IS_SPACE[body]).astype(np.int64), offsets)
            columns = [rows.column(id_col), n_words, chars, common.segment_sum(_IS_SYMBOL[body], offsets), np.array([_dup_lines(x) for x in listed], np.int64), repeat, failed, llr, ~failed & (llr >= min_llr)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], [x.split()[0] for x in SCHEMA.split(", ")])


def quality_rules(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_llr: float = MIN_LLR, min_words: int = MIN_WORDS, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """One row per document: the base counts, the ratio and the verdict (SCHEMA)."""
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, trusted, id_col=id_col, text_col=text_col, max_trusted=max_trusted))  # N_BUCKETS doubles
    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(lambda it: _score(it, id_col, text_col, weights, min_llr, min_words), SCHEMA)


def _filter(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, *rest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, _ in common.slices(batch, text_col):
            kept = pa.concat_arrays([x.column("kept") for x in _score(iter([rows]), id_col, text_col, *rest)])
            yield rows.filter(kept)


def filter_documents(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_llr: float = MIN_LLR, min_words: int = MIN_WORDS, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """The documents that the rules keep, with all their columns; decided where the row stands, without a join."""
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, trusted, id_col=id_col, text_col=text_col, max_trusted=max_trusted))
    return docs.mapInArrow(lambda it: _filter(it, id_col, text_col, weights, min_llr, min_words), docs.schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled good and not toxic."""
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(common.table(spark, sf_dir, "documents"), trusted_ids(common.table(spark, sf_dir, "labels")))
    return out.withColumn("llr", F.round("llr", 6))  # for the oracle; the verdict stands on the whole number


QUERIES = {"op1_quality_rules": op1_quality_rules}

ORACLES = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
good AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL)
         ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT {MAX_TRUSTED}),
ws AS (SELECT r, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
tok AS (SELECT r, doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM ws),
h AS (SELECT r, doc_id, p, w, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM tok),
n AS (SELECT r, doc_id, p, w, h, lead(h) OVER o AS h2, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM h WINDOW o AS (PARTITION BY r ORDER BY p)),
g AS (SELECT r, doc_id, h % {N_BUCKETS} AS b FROM n UNION ALL SELECT r, doc_id, (h * 31 + h2) % {N_BUCKETS} FROM n WHERE h2 IS NOT NULL),
c AS (SELECT b, count(*) AS k, count(*) FILTER (doc_id IN (SELECT doc_id FROM good)) AS t FROM g GROUP BY b),
s AS (SELECT sum(k) AS ks, sum(t) AS ts FROM c),
m AS (SELECT b, ln((t + 1) / (ts + {N_BUCKETS})) - ln((k + 1) / (ks + {N_BUCKETS})) AS v FROM c, s),
l AS (SELECT r, sum(v) / count(*) AS llr FROM g JOIN m USING (b) GROUP BY r),
rep AS (SELECT r, p, count(*) OVER (PARTITION BY r, w, w2, w3) AS k FROM n WHERE w3 IS NOT NULL),
cov AS (SELECT r, count(DISTINCT p + i) AS k FROM rep, (SELECT unnest([0, 1, 2]) AS i) WHERE k > 1 GROUP BY r),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d),
dl AS (SELECT r, count(*) - count(DISTINCT x) AS k FROM ln WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (SELECT d.r, d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dl.k, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.k, 0) AS BIGINT) AS n_repeat_words, coalesce(llr, 0) AS llr
         FROM d JOIN ws ON d.r = ws.r LEFT JOIN dl ON d.r = dl.r LEFT JOIN cov ON d.r = cov.r LEFT JOIN l ON d.r = l.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, round(llr, 6) AS llr,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND llr >= {MIN_LLR} AS kept FROM base
"""
}

"""Substring deduplication by content-defined chunking with a gear rolling hash.

h(i) = 2 h(i-1) + G[byte i] mod 2^32 looks back over 32 bytes; a chunk ends where its top bits are 0, at
least MIN and at most MAX bytes after its start, so boundaries depend on content and fall back into
step after an insertion. Chunks are keyed by a 128-bit digest; the first occurrence in order of
(doc_id, start) stays, every other is cut from its document.

Edge cases: a null or empty text has no chunk and stays empty. A repeated row (same id, same text) is
treated as one document: all its copies get the same result. The last chunk of a text may be shorter than MIN
and is a chunk like any other. Null ids come last in the order. Chunk ends may fall inside a
UTF-8 character; the kept bytes are returned as binary. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import common

#: Bytes. A boundary falls on one position in MEAN after the first MIN bytes, so a chunk has about MIN + MEAN.
#: 16 finds the most of passages of 50 words (330 bytes): above it the cut ends lose more, below it chunks fall into step too late.
MIN, MEAN, MAX = 32, 16, 1024

#: A byte's gear value comes from a rule, not a table: a mixed 64-bit number's top half.
GEAR = (common.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)

SCHEMA = "doc_id long, n_bytes long, n_chunks long, n_removed_chunks long, n_removed long, kept binary"


def gear(body: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte, by doubling: 1, 2, 4 ... 32 bytes back."""
    h = GEAR[body]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def boundaries(body: np.ndarray, offsets: np.ndarray, low: int = MIN, mean: int = MEAN, high: int = MAX) -> list[list[int]]:
    """Ends of the chunks of each text, counted from the text's start. low is 32 at least, the hash's reach."""
    cut = np.flatnonzero(gear(body) < np.uint32((1 << 32) // mean)) + 1 if len(body) else np.empty(0, np.int64)
    at = np.searchsorted(cut, offsets, "right")
    out = []
    for i in range(len(offsets) - 1):
        start, end = int(offsets[i]), int(offsets[i + 1])
        last, ends = start, []
        for c in cut[at[i] : at[i + 1]].tolist():
            while c - last > high:
                last += high
                ends.append(last - start)
            if c - last >= low:
                last = c
                ends.append(c - start)
        while end - last > high:
            last += high
            ends.append(last - start)
        if end > last:
            ends.append(end - start)
        out.append(ends)
    return out


def _chunk(batches: Iterator[pa.RecordBatch], sizes: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in common.slices(batch, "text"):
            parts = boundaries(*common.raw(texts), *sizes)
            digests, starts, lengths, owner = [], [], [], []
            for i, (text, ends) in enumerate(zip(texts, parts, strict=True)):
                data, last = text.as_py(), 0
                for end in ends:
                    digests.append(hashlib.blake2b(data[last:end], digest_size=16).digest())
                    starts.append(last)
                    lengths.append(end - last)
                    last = end
                owner.extend([i] * len(ends))
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(take), rows.column("th").take(take), pa.array(digests, pa.binary()), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32())], ["doc_id", "th", "digest", "start", "size"])


def _cut(batches: Iterator[pa.RecordBatch], sizes: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in common.slices(batch, "text"):
            parts = boundaries(*common.raw(texts), *sizes)
            columns: list[list] = [[], [], [], [], []]
            for text, ends, gone in zip(texts, parts, rows.column("starts").to_pylist(), strict=True):
                data, gone = text.as_py(), set(gone or ())
                kept = b"".join(data[a:b] for a, b in zip([0, *ends], ends) if a not in gone)
                for column, value in zip(columns, (len(data), len(ends), len(gone), len(data) - len(kept), kept), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *[pa.array(x, pa.int64()) for x in columns[:4]], pa.array(columns[4], pa.binary())], [x.split()[0] for x in SCHEMA.split(", ")])


def dedupe_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", low: int = MIN, mean: int = MEAN, high: int = MAX) -> DataFrame:
    """One row per document (SCHEMA), kept being the text without its later-seen chunks."""
    if low < 32:
        raise ValueError("low must be 32 at least, the reach of the rolling hash")
    sizes = (low, mean, high)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    chunks = rows.mapInArrow(lambda it: _chunk(it, sizes), "doc_id long, th long, digest binary, start int, size int")
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th", "start")
    seen = chunks.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    seen = common.materialize(seen, "chunks")
    later = common.join_unique(chunks, seen, "digest", weight="n", how="inner").filter(place != F.col("first"))
    later = later.groupBy("doc_id", "th").agg(F.collect_set("start").alias("starts")).select(F.col("doc_id").alias("i"), F.col("th").alias("t"), "starts")
    marked = rows.join(later, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left").select("doc_id", "text", "starts")
    return marked.mapInArrow(lambda it: _cut(it, sizes), SCHEMA)


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedupe_chunks(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_chunks", "n_removed_chunks", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_chunk_dedup": op7_chunk_dedup}
ORACLES: dict[str, str] = {}

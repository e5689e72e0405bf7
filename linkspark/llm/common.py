"""Helpers shared by the corpus operators: tables, shared scratch space, Arrow text buffers, skew."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.operators.skew import join_unique  # noqa: F401
from linkspark.sources.storage import discard, materialize, release, scratch, scratch_path  # noqa: F401

#: Texts are handed to numpy in slices of about this many bytes, whatever Arrow's batch size.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(text):
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(column: pa.Array) -> pa.Array:
    """A string or binary column as large_binary, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary()).cast(pa.large_binary()) if not pa.types.is_binary(column.type) else column.cast(pa.large_binary())
    return pc.fill_null(column, b"") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a large_binary array without nulls."""
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, n + 1, column.offset * 8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, np.uint8, hi - lo, lo) if hi > lo else np.empty(0, np.uint8)
    return body, offsets - lo


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of at most `rows` rows with about `most` bytes of text (one row at least), with their texts as bytes."""
    if batch.num_rows == 0:
        return
    column = utf8(batch.column(text))
    ends = raw(column)[1][1:]
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, base + most, "right"))))
        yield batch.slice(start, stop - start), column.slice(start, stop - start)
        start = stop


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]]; empty segments give 0."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=values.dtype if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


#: Words are runs of other characters than these six; the same bytes that bytes.split() cuts at.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (xor-shift and odd multipliers)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if size > 4 * SLICE_BYTES:
            return tables[0], tables[1]  # a very long text: not kept
        _powers[:] = tables
    return _powers[0], _powers[1]


#: Spans from this length on are hashed by blake2b: sums of powers modulo 2^64 are equal for some of 1,024 bytes (Thue-Morse words).
LONG_SPAN = 256


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of body[start:end], equal for equal bytes wherever they stand."""
    up, down = _power_tables(len(body) + 1)
    total = np.empty(len(body) + 1, np.uint64)
    total[0] = 0
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[: len(body)], out=total[1:])
    value = (total[ends] - total[starts]) * down[starts]
    for k in np.flatnonzero(ends - starts >= LONG_SPAN):
        value[k] = int.from_bytes(hashlib.blake2b(body[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return mix64(value + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_spans(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and how many words come before each text (n + 1)."""
    if len(body) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[body]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[edges < len(body)]
    first[edges] |= inside[edges]  # a text begins anew
    edges = offsets[1:-1]
    edges = edges[edges > 0]
    last[edges - 1] |= inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bits of a filter (MOST_BITS where it grows with the input), and how many of them travel in one row.
FILTER_BITS = 1 << 26
MOST_BITS = 1 << 28
_PACK_BITS = 1 << 17


def filter_bits(entries: int) -> int:
    """Bits of a filter for so many entries, FILTER_BITS at least and MOST_BITS at most."""
    return min(MOST_BITS, max(FILTER_BITS, 1 << max(0, entries - 1).bit_length()))


def _mark(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Filter bits of the hashes in column h, in packs."""
    marked, pack = np.zeros(bits // 8, np.uint8), _PACK_BITS // 8
    for batch in batches:
        at = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(bits - 1)
        np.bitwise_or.at(marked, at >> np.uint64(3), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))
    packs = [(k, x) for k in range(len(marked) // pack) if (x := marked[k * pack : (k + 1) * pack]).any()]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in packs], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for _, x in packs], pa.binary())], ["pack", "bits"])


def _any_bit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packs of a filter, one of each number."""
    packs: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column("pack").to_pylist(), batch.column("bits"), strict=True):
            part = np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
            packs[k] = packs[k] | part if k in packs else part
    yield pa.RecordBatch.from_arrays([pa.array(list(packs), pa.int32()), pa.array([x.tobytes() for x in packs.values()], pa.binary())], ["pack", "bits"])


def bit_filter(hashes: DataFrame, bits: int = FILTER_BITS):
    """A broadcast filter (so many bits, whatever the input) that lets every hash in column h (long) pass, and few others
    as long as there are far fewer hashes than bits."""
    packs = hashes.mapInArrow(lambda it: _mark(it, bits), "pack int, bits binary").repartition("pack").mapInArrow(_any_bit, "pack int, bits binary")
    packs = materialize(packs, "filter")
    marked = np.zeros(bits // 8, np.uint8)
    for r in packs.toLocalIterator():  # bits / 8 bytes, whatever the input
        marked[r.pack * _PACK_BITS // 8 : (r.pack + 1) * _PACK_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    discard(packs)
    return hashes.sparkSession.sparkContext.broadcast(marked)


def passing(column: pa.Array | np.ndarray, shared) -> np.ndarray:
    """Which hashes (64 bits) the filter lets pass."""
    values = column if isinstance(column, np.ndarray) else column.to_numpy(zero_copy_only=False)
    at = values.view(np.uint64) & np.uint64(8 * len(shared.value) - 1)
    return (shared.value[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)

"""Structured Streaming: windowed counts with late data, and incremental deduplication by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events per window and key. On a stream, windows close `late` after their end; on a table it is a plain aggregation."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w, key).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, time: str, key: str, late: str) -> DataFrame:
    """Drops repeats of a key within the watermark; the state holds only open keys."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def dedupe_batches(stream: DataFrame, link: Callable[[DataFrame, DataFrame | None], DataFrame], store: str, checkpoint: str):
    """foreachBatch: links each batch with what is stored and appends it and the links. link(new, old) gives pairs.

    Every batch writes to its own folder, so a batch that runs again replaces its output.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(*[f"{store}/items/batch={k}" for k in range(n)]) if n else None
        links = link(batch, old)
        links.write.mode("overwrite").parquet(f"{store}/links/batch={n}")
        batch.write.mode("overwrite").parquet(f"{store}/items/batch={n}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

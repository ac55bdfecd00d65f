"""Structured Streaming forms of stateful interval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_gap_groups(hits: DataFrame, gap_seconds: float, delay_seconds: float, keys: list[str] | None = None) -> DataFrame:
    """Groups of rows of one key whose next start is less than the gap after all ends before, as session windows on ``time`` and ``endtime`` (ns).

    A row's session lasts from its start to the gap after its end, so one long
    row bridges what begins within it; a microsecond is taken off, for sessions
    that touch are one to Spark.  The watermark bounds the state to sessions that
    may still grow.  Rows later than the delay are dropped by Spark;
    ``late_rows`` finds them.
    """
    keys = keys or ["channel"]
    micros = F.floor((F.col("endtime") - F.col("time")) / 1000) + round(gap_seconds * 1e6) - 1
    timed = _timed(hits).withWatermark("event_time", f"{delay_seconds} seconds")
    session = F.session_window("event_time", F.concat(F.greatest(micros, F.lit(1)).cast("string"), F.lit(" microseconds")))
    return timed.groupBy(*keys, session.alias("w")).agg(F.min("time").alias("time"), F.max("endtime").alias("endtime"), F.count(F.lit(1)).alias("n")).drop("w")


def late_rows(batch: DataFrame, watermark_ns: int) -> DataFrame:
    """Rows of a micro-batch (``foreachBatch``) that begin before the watermark which held when it began: what a stateful operator drops."""
    return batch.where(F.col("time") < watermark_ns)


def _timed(hits: DataFrame) -> DataFrame:
    return hits.withColumn("event_time", F.timestamp_micros(F.floor(F.col("time") / 1000)))

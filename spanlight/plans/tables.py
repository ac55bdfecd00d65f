"""Interval and waveform tables over the generic test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000_000


def hits(spark: SparkSession, d: str) -> DataFrame:
    ts = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    length = F.greatest(F.lit(1), F.round(F.col("value") * 1000).cast("long"))
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("event_id").alias("row_id"), ts.alias("time"), (ts + length * 1_000_000).alias("endtime"), F.col("user_id").alias("channel"), F.col("event_type").alias("kind"), F.round(F.col("value") * 100).cast("long").alias("area")
    )


def slots(spark: SparkSession, d: str) -> DataFrame:
    rows = hits(spark, d).where("kind = 'purchase'")
    order = Window.partitionBy("run_id").orderBy("time")
    return rows.select("run_id", "time", F.lead("time").over(order).alias("endtime"), (F.row_number().over(order) - 1).cast("long").alias("idx")).where("endtime IS NOT NULL")


def vetoes(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).where("kind = 'error'").select("run_id", "time", F.least("endtime", F.col("time") + 1_000_000_000).alias("endtime"))


def fine_hits(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).where("kind = 'click'")


def records(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(
        F.lit("0").alias("run_id"), F.col("vec_id").alias("row_id"), (F.col("vec_id") * 64).alias("time"), F.lit(64).alias("length"), F.lit(1).alias("dt"), F.col("label").alias("channel"), F.transform("embedding", lambda x: F.round(x.cast("double") * 10000).cast("int")).alias("data")
    )


HITS_SQL = "hits AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_id AS row_id, epoch_us(ts) * 1000 AS time, epoch_us(ts) * 1000 + greatest(1, CAST(round(value * 1000) AS BIGINT)) * 1000000 AS endtime, user_id AS channel, event_type AS kind, CAST(round(value * 100) AS BIGINT) AS area FROM events)"
SLOTS_SQL = "slots AS (SELECT * FROM (SELECT run_id, time, lead(time) OVER (PARTITION BY run_id ORDER BY time) AS endtime, row_number() OVER (PARTITION BY run_id ORDER BY time) - 1 AS idx FROM hits WHERE kind = 'purchase') WHERE endtime IS NOT NULL)"
VETOES_SQL = "vetoes AS (SELECT run_id, time, least(endtime, time + 1000000000) AS endtime FROM hits WHERE kind = 'error')"
FINE_SQL = "fine AS (SELECT * FROM hits WHERE kind = 'click')"
RECORDS_SQL = "records AS (SELECT vec_id AS row_id, vec_id * 64 AS time, label AS channel, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 10000) AS INTEGER)) AS data FROM embeddings)"
SAMPLES_SQL = f"{RECORDS_SQL}, samples AS (SELECT row_id, time, channel, unnest(data) AS x, generate_subscripts(data, 1) - 1 AS i FROM records)"

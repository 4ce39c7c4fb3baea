"""The driver's tables as timelines: a user is a session, an event a row of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr

#: The tables' events lie hours apart, so thresholds are in hours here.
HOUR = 3_600_000.0

E = """e AS (SELECT user_id AS session, event_id AS seq, epoch_us(ts) / 1000.0::DOUBLE AS ts, event_type AS type, value AS x,
  json_extract_string(props, '$.k')::DOUBLE AS y, value / (value + 50) AS confidence, value > 10 AS detected FROM events)"""
#: Every event as an interval of up to ten hours.
I = """i AS (SELECT session, seq, type, ts AS start, ts + y * 360000 AS "end", x, y, confidence FROM e)"""  # noqa: E741


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """session, seq, ts (ms), type, x, y, confidence, detected of all events, or of those given"""
    return (read(spark, sf_dir, "events") if events is None else events).select(
        F.col("user_id").alias("session"),
        F.col("event_id").alias("seq"),
        expr.session_ms().alias("ts"),
        F.col("event_type").alias("type"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        (F.col("value") / (F.col("value") + 50)).alias("confidence"),
        (F.col("value") > 10).alias("detected"),
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq, type, start, end, x, y, confidence"""
    return timeline(spark, sf_dir).select(
        "session", "seq", "type", F.col("ts").alias("start"), (F.col("ts") + F.col("y") * 360000).alias("end"), "x", "y", "confidence"
    )


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({c: expr.rounded(F.col(c), d) if kinds[c] == "double" else F.round(c, d) for c, d in digits.items()})

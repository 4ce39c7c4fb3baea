"""Timeline windows over streams: watermarked tumbling and session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(events: DataFrame, time: str, value: str, size: str, slide: str, late: str) -> DataFrame:
    """Mean value per session in hopping windows; rows later than `late` are dropped. Windows are aligned to the epoch, as a
    stream has no first sample to anchor them at."""
    w = F.window(time, size, slide)
    out = events.withWatermark(time, late).groupBy(w, "session").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return out.select("session", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "mean", "n")


def bursts(events: DataFrame, time: str, gap: str, late: str) -> DataFrame:
    """Runs of rows of a session with no pause of `gap` or longer."""
    w = F.session_window(time, gap)
    out = events.withWatermark(time, late).groupBy(w, "session").agg(F.count(F.lit(1)).alias("n"))
    return out.select("session", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")

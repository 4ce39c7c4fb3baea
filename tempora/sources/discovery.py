"""What there is to work on: sessions, iterations, durations, paths. File listings come in as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def screen_track(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """sessions with `video`: the normalised track where that file is listed (path), else the raw one."""
    f = files.select(F.col("path").alias("_path")).distinct()
    both = sessions.join(f, F.col("data.normalizedScreenTrack") == F.col("_path"), "left")
    return both.withColumn("video", F.coalesce("_path", "data.screenTrack")).drop("_path")


def with_baselines(sessions: DataFrame, baselines: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """Sessions that have a baseline; of the requested ones, if any are named."""
    found = sessions.join(baselines.select("identifier").distinct(), "identifier", "left_semi")
    return found if requested is None else found.filter(F.col("identifier").isin(requested))


def unknown(sessions: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested identifiers that no session has."""
    return requested.select("identifier").distinct().join(sessions, "identifier", "left_anti")


def unfinished(sessions: DataFrame, outputs: DataFrame) -> DataFrame:
    return sessions.join(outputs.select("identifier").distinct(), "identifier", "left_anti")


def latest_iteration(folders: DataFrame, by: str, name: str) -> DataFrame:
    """The greatest folder name that is a whole number, for each branch."""
    n = F.when(F.col(name).rlike("^[0-9]+$"), F.col(name).cast("int"))
    return folders.groupBy(by).agg(F.max(n).alias("iteration"))


def with_durations(sessions: DataFrame, probed: DataFrame) -> DataFrame:
    """Missing screen-track durations filled from (identifier, duration_ms), one decimal; null where nothing is known."""
    both = sessions.join(probed, "identifier", "left")
    return both.withColumn("screenTrackDurationMs", F.coalesce("screenTrackDurationMs", F.round("duration_ms", 1))).drop("duration_ms")


def reference_height(width: Column, height: Column, longest: int) -> Column:
    """Even height of a picture scaled so that its width is at most `longest`."""
    scaled = F.floor(height * F.least(F.lit(1.0), F.lit(float(longest)) / width) / 2) * 2
    return F.greatest(F.lit(2), scaled).cast("int")


def first_existing(candidates: DataFrame, by: str) -> DataFrame:
    """The path of the lowest rank that exists, from (by, path, rank, present)."""
    return candidates.filter("present").groupBy(by).agg(F.min_by("path", "rank").alias("path"))

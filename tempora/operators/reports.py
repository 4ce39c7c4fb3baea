"""Counts, costs, coverage and quality of timelines and runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr
from .windows import ordered


def at_places(rows: DataFrame, value: Column, by: list[str], places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The values of each group at places (from 1 on) of their rising order; a place is given from the number of values. One sort,
    and no group's values are gathered in a row. Nulls do not count; a place outside has null."""
    w = W.partitionBy(*by)
    ranked = rows.select(*by, value.alias("_v")).filter("_v IS NOT NULL")
    ranked = ranked.withColumns({"_k": F.row_number().over(w.orderBy("_v")), "_n": F.count(F.lit(1)).over(w)})
    return ranked.groupBy(*by).agg(*(F.max(F.when(F.col("_k") == at(F.col("_n")), F.col("_v"))).alias(name) for name, at in places.items()))


def upper_middle(n: Column) -> Column:
    """The place of the upper median: n // 2 counted from 0."""
    return F.floor(n / 2) + 1


def quality(trajectory: DataFrame, large_gap: float, long_absence: float) -> DataFrame:
    """Per session: samples, detections, rate, gaps between detections (upper median, p95 by position, greatest, large ones)."""
    seen = trajectory.filter("detected")
    gaps = seen.select("session", (F.col("ts") - F.lag("ts").over(ordered("ts", "seq"))).alias("gap"))
    late = lambda n: F.least(n, F.floor(n * 0.95) + 1)
    placed = at_places(gaps, F.col("gap"), ["session"], {"gap_median": upper_middle, "gap_p95": late})
    sums = gaps.groupBy("session").agg(F.max("gap").alias("gap_max"), F.count_if(F.col("gap") > large_gap).alias("large_gaps"), F.count_if(F.col("gap") > long_absence).alias("long_absences"))
    total = trajectory.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.count_if("detected").alias("n_detected"))
    out = total.withColumn("rate", F.col("n_detected") / F.col("n")).join(placed, "session", "left").join(sums, "session", "left")
    return out.select("session", "n", "n_detected", "rate", "gap_median", "gap_p95", "gap_max", "large_gaps", "long_absences")


def distance_bands(pairs: DataFrame, by: list[str], bands: list[float]) -> DataFrame:
    d = F.col("distance")
    known = pairs.filter(d.isNotNull())
    sums = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(d == 0).alias("identical"), *(F.count_if(d <= b).alias(f"within_{b:g}") for b in bands), F.avg(d).alias("mean"), F.max(d).alias("greatest")
    )
    return sums.join(at_places(known, d, by, {"median": upper_middle}), by)


def cost_rollup(facts: DataFrame, by: str, amounts: list[str]) -> DataFrame:
    """Sums by key and a TOTAL row in one pass."""
    rows = facts.rollup(by).agg(*(F.sum(a).alias(a) for a in amounts), F.count(F.lit(1)).alias("n"), F.grouping(by).alias("_all"))
    return rows.withColumn(by, F.when(F.col("_all") == 1, F.lit("TOTAL")).otherwise(F.col(by).cast("string"))).drop("_all")


def usage(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """Runs with their cost; a model without a price has none."""
    cost = F.col("input_tokens") * F.col("input_cost") + F.col("output_tokens") * F.col("output_cost")
    return runs.join(prices, "model", "left").withColumn("cost", cost)


def profile(df: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """How many rows have each field: neither null, empty nor 0, as `v/n`."""
    present = lambda c: F.col(c).isNotNull() & ~F.col(c).cast("string").isin("", "0", "0.0", "false")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *(F.concat(F.count_if(present(c)).cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string")).alias(c) for c in fields)
    )


def direction_mode(vectors: DataFrame, by: list[str]) -> DataFrame:
    """Commonest compass direction of (dx, dy, ok), its share and the mean length; without a valid vector: N, 0 and 0."""
    ok = vectors.withColumn("direction", F.when(F.col("ok"), expr.compass(F.atan2(-F.col("dy"), F.col("dx")))))
    counts = ok.groupBy(*by, "direction").agg(F.count(F.lit(1)).alias("n"), F.sum(F.hypot("dx", "dy")).alias("length"))
    seen = F.col("direction").isNotNull()
    total = F.sum(F.when(seen, F.col("n")))
    best = F.max_by("direction", F.when(seen, F.struct("n", -expr.compass_rank(F.col("direction")))))
    return counts.groupBy(*by).agg(
        F.coalesce(best, F.lit("N")).alias("direction"),
        F.coalesce(F.max(F.when(seen, F.col("n"))) / total, F.lit(0.0)).alias("uniformity"),
        F.coalesce(F.sum(F.when(seen, F.col("length"))) / total, F.lit(0.0)).alias("magnitude"),
    )


def union_box(boxes: DataFrame, by: list[str]) -> DataFrame:
    x2, y2 = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return boxes.groupBy(*by).agg(F.min("x").alias("x"), F.min("y").alias("y"), (x2 - F.min("x")).alias("w"), (y2 - F.min("y")).alias("h"))


def position_clusters(trajectory: DataFrame, cell: float, gap: float) -> DataFrame:
    """Visits of a grid cell: detections there, cut by gaps in time."""
    t = trajectory.filter("detected").withColumns({"cx": F.bround(F.col("x") / cell, 0), "cy": F.bround(F.col("y") / cell, 0)})
    w = ordered("ts", "seq", by=["session", "cx", "cy"])
    return t.withColumn("new", F.coalesce((F.col("ts") - F.lag("ts").over(w) > gap).cast("int"), F.lit(0))).groupBy("session", "cx", "cy").agg(
        (1 + F.sum("new")).alias("clusters"), F.count(F.lit(1)).alias("n")
    )


def calibrated_scales(samples: DataFrame, by: str, least: float) -> DataFrame:
    """(by, first, last) of the scale index range to keep: the commonest if it holds half of the sure samples, or the two
    commonest if they are neighbours and do so together, with one neighbour on either side."""
    c = samples.filter(F.col("confidence") >= least).groupBy(by, "scale").agg(F.count(F.lit(1)).alias("n"))
    w = ordered("rank", by=by)
    total = F.sum("n").over(W.partitionBy(by))
    c = c.withColumn("total", total).withColumn("rank", F.row_number().over(ordered(F.desc("n"), "scale", by=by)))
    c = c.withColumn("next", F.lead("scale").over(w)).withColumn("next_n", F.lead("n").over(w)).filter("rank = 1")
    one = F.col("n") * 2 >= F.col("total")
    two = (F.abs(F.col("scale") - F.col("next")) == 1) & ((F.col("n") + F.col("next_n")) * 2 >= F.col("total"))
    low, high = F.when(one, F.col("scale")).when(two, F.least("scale", "next")), F.when(one, F.col("scale")).when(two, F.greatest("scale", "next"))
    return c.filter(one | two).select(by, (low - 1).alias("first"), (high + 1).alias("last"))


def speakers(utterances: DataFrame) -> DataFrame:
    """Utterances (session, seq, label, text) by speaker, speakers in the order they are first heard."""
    u = utterances.withColumn("speaker", F.coalesce("label", F.lit("Unknown")))
    g = u.groupBy("session", "speaker").agg(
        F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")
    )
    return g.withColumn("position", F.row_number().over(ordered("first")))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.filter("ref_type <> hit_type").groupBy("ref_type", "hit_type").agg(F.count(F.lit(1)).alias("n"))


def effective_fps(runs: DataFrame, per_frame: int) -> DataFrame:
    """Frames a second that a run's tokens pay for."""
    return runs.withColumn("fps", F.try_divide(F.col("input_tokens") / per_frame, F.col("duration_ms") / 1000.0))

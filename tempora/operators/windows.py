"""Windows, islands and gaps over session timelines, as DataFrame expressions.

Every function works on all sessions at once. `session` is the partitioning column; (`ts`, `seq`) orders a session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr


def ordered(*order: str, by: str | list[str] = "session") -> W:
    return W.partitionBy(by).orderBy(*order)


def islands(df: DataFrame, breaks: Column, order: list[str], by: str | list[str] = "session", out: str = "island") -> DataFrame:
    """Number the runs of rows between rows where `breaks` holds."""
    w = ordered(*order, by=by)
    return df.withColumn(out, F.sum(F.when(F.coalesce(breaks, F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))


#: What running() can do: within a part, from the parts before it, and both together.
RUNNING: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "last": (lambda c: F.last(c, ignorenulls=True), lambda inside, ahead: F.coalesce(inside, ahead)),
    "max": (F.max, lambda inside, ahead: F.greatest(inside, ahead)),
    "sum": (F.sum, lambda inside, ahead: F.when(inside.isNotNull() | ahead.isNotNull(), F.coalesce(inside, F.lit(0)) + F.coalesce(ahead, F.lit(0)))),
}


def running(
    df: DataFrame, value: Column, out: str, order: list[str], how: str, by: str | list[str] = "session", current: bool = True, backwards: bool = False, part_ms: float | None = None
) -> DataFrame:
    """df with the last value that is not null, the greatest or the sum of all rows of its session up to each row (current: with it;
    backwards: in the opposite order). `order` begins with a time and tells any two rows apart.

    With part_ms a session's rows are dealt by time parts of that width, so that a very long session spreads over tasks: each part
    is worked out by itself, one row for each part is run over, and what came before joins on. Parts should be wide enough to
    be few against the rows, and narrow enough to fit a task.
    """
    by = [by] if isinstance(by, str) else list(by)
    over, both = RUNNING[how]
    turned = F.desc if backwards else F.asc
    frame = (W.unboundedPreceding, W.currentRow if current else -1)
    if part_ms is None:
        return df.withColumn(out, over(value).over(W.partitionBy(*by).orderBy(*(turned(c) for c in order)).rowsBetween(*frame)))
    df = df.withColumns({"_part": F.floor(F.col(order[0]) / part_ms), "_value": value})
    known = F.when(F.col("_value").isNotNull(), F.struct(*order))
    whole = {"last": (F.min_by if backwards else F.max_by)("_value", known), "max": F.max("_value"), "sum": F.sum("_value")}[how]
    parts = df.groupBy(*by, "_part").agg(whole.alias("_whole"))
    before = over(F.col("_whole")).over(W.partitionBy(*by).orderBy(turned("_part")).rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_part").alias("_of"), before.alias("_ahead"))
    inside = over(F.col("_value")).over(W.partitionBy(*by, "_part").orderBy(*(turned(c) for c in order)).rowsBetween(*frame))
    same = F.col("_part") == F.col("_of")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    joined = df.withColumn("_in", inside).join(parts, same)
    return joined.withColumn(out, both(F.col("_in"), F.col("_ahead"))).drop("_part", "_value", "_in", "_ahead", "_of", *(f"_by{i}" for i in range(len(by))))


def _numbered(df: DataFrame, breaks: Column, order: list[str], by: str | list[str], part_ms: float) -> DataFrame:
    """islands() for breaks that need no other row, by time parts."""
    marked = df.withColumn("_new", F.when(F.coalesce(breaks, F.lit(False)), 1).otherwise(0)).drop("_before")
    return running(marked, F.col("_new"), "island", order, "sum", by, part_ms=part_ms).drop("_new")


def gap_islands(df: DataFrame, gap: float, start: str = "ts", end: str = "ts", order: list[str] | None = None, part_ms: float | None = None) -> DataFrame:
    """A new island where a row starts more than `gap` after the end of the row before it. part_ms: as in running()."""
    order = order or ["ts", "seq"]
    if part_ms is None:
        return islands(df, F.col(start) - F.lag(end).over(ordered(*order)) > gap, order)
    seen = running(df, F.struct(F.col(end).alias("v")), "_before", order, "last", current=False, part_ms=part_ms)
    return _numbered(seen, F.col(start) - F.col("_before.v") > gap, order, "session", part_ms)


def overlap_islands(
    df: DataFrame, gap: float, start: str, end: str, order: list[str], by: str | list[str] = "session", part_ms: float | None = None
) -> DataFrame:
    """A new island where a row starts more than `gap` after the latest end of all rows before it. part_ms: as in running()."""
    seen = running(df, F.col(end), "_before", order, "max", by, current=False, part_ms=part_ms)
    if part_ms is None:
        return islands(seen, F.col(start) - F.col("_before") > gap, order, by=by).drop("_before")
    return _numbered(seen, F.col(start) - F.col("_before") > gap, order, by, part_ms)


def means_in_order(df: DataFrame, by: list[str], order: list[str], **values: Column) -> DataFrame:
    """(by, n, one mean for each of `values`): groups' rows are added up in this order. A sum of doubles has other last bits in
    another order, which a limit or the rounding of a half makes another result; so it is the same however rows are dealt."""
    so_far = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumns({f"_{n}": v for n, v in values.items()})
    sums = {n: (F.sum(f"_{n}").over(so_far) / F.count(f"_{n}").over(so_far)) for n in values}
    rows = df.select(*by, *order, F.count(F.lit(1)).over(so_far).alias("n"), *(c.alias(n) for n, c in sums.items()))
    return rows.groupBy(*by).agg(F.max_by(F.struct("n", *values), "n").alias("_last")).select(*by, "_last.*")


def hop_windows(samples: DataFrame, value: str, size: float, step: float) -> DataFrame:
    """Hopping windows anchored at a session's first sample: (session, w, start, end, mean), empty windows with mean 0.

    Each sample is sent to the ceil(size / step) windows that may hold it, so the join is an aggregation by window number;
    windows without samples come from the session's span alone. A session of one instant has no window. A window's samples
    are added up in order, so that a mean at a tier's limit does not hang on how rows were dealt.
    """
    span = samples.groupBy("session").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    reach = int(-(-size // step))
    at = samples.join(span, "session").withColumn("n", F.floor((F.col("ts") - F.col("first")) / step).cast("long"))
    sums = (
        at.withColumn("w", F.explode(F.sequence(F.greatest(F.lit(0), F.col("n") - reach), F.col("n"))))
        .withColumn("start", F.col("first") + F.col("w") * F.lit(float(step)))
        .filter((F.col("start") <= F.col("ts")) & (F.col("ts") < F.col("start") + size))
    )
    sums = means_in_order(sums, ["session", "w"], ["seq"] if "seq" in samples.columns else ["ts", value], mean=F.col(value)).drop("n")
    all_windows = span.filter("first < last").select(
        "session", "first", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("last") - F.col("first")) / step).cast("long") - 1)).alias("w")
    )
    start = F.col("first") + F.col("w") * F.lit(float(step))
    return all_windows.join(sums, ["session", "w"], "left").select(
        "session", "w", start.alias("start"), F.least(start + size, F.col("last")).alias("end"), F.coalesce("mean", F.lit(0.0)).alias("mean")
    )


def contained_windows(pairs: DataFrame, size: float, step: float, total: Column) -> DataFrame:
    """Windows from 0 in steps, while a whole one fits: (session, w, start) joined to the pairs that lie wholly inside.
    `pairs` has a, b (start and end from the session's origin); `total` is an expression on its rows. Empty windows go."""
    reach = int(-(-size // step))
    n = F.floor(F.col("a") / step).cast("long")
    at = pairs.withColumn("_total", total).withColumn("w", F.explode(F.sequence(F.greatest(F.lit(0), n - reach), n)))
    at = at.withColumn("start", F.col("w") * F.lit(float(step)))
    inside = (F.col("a") >= F.col("start")) & (F.col("b") <= F.col("start") + size) & (F.col("start") + size <= F.col("_total"))
    return at.filter(inside).drop("_total")


def tier_segments(windows: DataFrame, min_ms: float) -> DataFrame:
    """Runs of one tier, ends snapped halfway into the overlap, short runs given to the one before.

    Input: session, w, start, end, mean, tier. Output: session, segment, start, end, tier, mean, n_windows; the mean is that
    of the windows' means. A short first run stays, and neighbours that come to share a tier are not joined again.
    """
    order = ["w"]
    runs = islands(windows, F.col("tier") != F.lag("tier").over(ordered(*order)), order)
    so_far = ordered("w", by=["session", "island"]).rowsBetween(W.unboundedPreceding, W.currentRow)
    runs = runs.withColumn("_sum", F.sum("mean").over(so_far)).groupBy("session", "island").agg(
        F.min("start").alias("start"), F.max_by("end", "w").alias("end"), F.first("tier").alias("tier"), F.max_by("_sum", "w").alias("sum"), F.count("mean").alias("n")
    )
    w = ordered("island")
    before, after = F.lag("end").over(w), F.lead("start").over(w)
    snapped = runs.select(
        "session", "island", "tier", "sum", "n",
        F.when(F.col("start") < before, (F.col("start") + before) / 2).otherwise(F.col("start")).alias("start"),
        F.when(after < F.col("end"), (after + F.col("end")) / 2).otherwise(F.col("end")).alias("end"),
    )
    # A run that is pulled to its left border may end before the halfway point of its right one is known; both borders
    # come from the unsnapped neighbours, as each border is touched once.
    long = (F.col("end") - F.col("start") >= min_ms) | (F.row_number().over(w) == 1)
    grouped = islands(snapped, long, ["island"], out="segment")
    so_far = ordered("island", by=["session", "segment"]).rowsBetween(W.unboundedPreceding, W.currentRow)
    return grouped.withColumn("_sum", F.sum("sum").over(so_far)).groupBy("session", "segment").agg(
        F.min_by("start", "island").alias("start"),
        F.max_by("end", "island").alias("end"),
        F.min_by("tier", "island").alias("tier"),
        (F.max_by("_sum", "island") / F.sum("n")).alias("mean"),
        F.sum("n").alias("n_windows"),
    ).withColumn("segment", F.col("segment") - 1)


def gaps(points: DataFrame, total: Column, at: str, longer_than: float) -> DataFrame:
    """Gaps strictly longer than `longer_than` between 0, the points and the total: (session, gap_start, gap_end)."""
    bounds = points.select("session", F.col(at).alias("p")).union(points.select("session", F.lit(0.0))).union(
        points.select("session", total)
    ).distinct()
    nxt = F.lead("p").over(ordered("p"))
    return bounds.select("session", F.col("p").alias("gap_start"), nxt.alias("gap_end")).filter(F.col("gap_end") - F.col("gap_start") > longer_than)


def item_gaps(items: DataFrame, total: Column, longer_than: float) -> DataFrame:
    """Gaps beside items (start, end): before the first and after the last if there is any, between two if longer."""
    w = ordered("start", "seq")
    seen = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    first = F.row_number().over(w) == 1
    before = items.select("session", F.when(first, 0.0).otherwise(seen).alias("gap_start"), F.col("start").alias("gap_end"), first.alias("edge"))
    after = items.groupBy("session").agg(F.max("end").alias("gap_start"), F.max(total).alias("gap_end")).withColumn("edge", F.lit(True))
    rows = before.unionByName(after)
    return rows.filter(F.when(F.col("edge"), F.col("gap_end") > F.col("gap_start")).otherwise(F.col("gap_end") - F.col("gap_start") > longer_than)).drop("edge")


def interpolate(trajectory: DataFrame, max_gap: float) -> DataFrame:
    """Undetected rows between two detections at most `max_gap` apart get a place on the line between them and half the
    lesser confidence; they stay undetected."""
    w = ordered("ts", "seq")
    back, on = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    point = F.when(F.col("detected"), F.struct("ts", "x", "y", "confidence"))
    df = trajectory.withColumn("_a", F.last(point, ignorenulls=True).over(back)).withColumn("_b", F.first(point, ignorenulls=True).over(on))
    span = F.col("_b.ts") - F.col("_a.ts")
    fill = ~F.col("detected") & (span <= max_gap) & (span > 0)
    part = (F.col("ts") - F.col("_a.ts")) / span
    at = lambda c: F.when(fill, F.col(f"_a.{c}") + (F.col(f"_b.{c}") - F.col(f"_a.{c}")) * part).otherwise(F.col(c))
    sure = F.when(fill, F.least("_a.confidence", "_b.confidence") / 2).otherwise(F.col("confidence"))
    return df.select(*[at(c).alias(c) if c in "xy" else sure.alias(c) if c == "confidence" else F.col(c) for c in trajectory.columns])


def active_regions(trajectory: DataFrame, displacement: float, padding: float) -> DataFrame:
    """Padded intervals around detected moves longer than `displacement`, overlapping ones merged."""
    w = ordered("ts", "seq")
    both = F.col("detected") & F.lag("detected").over(w)
    far = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)) > displacement
    moves = trajectory.select(
        "session", "seq", F.greatest(F.lit(0.0), F.lag("ts").over(w) - padding).alias("start"), (F.col("ts") + padding).alias("end"), (both & far).alias("moved")
    ).filter("moved")
    merged = overlap_islands(moves, 0.0, "start", "end", ["start", "seq"])
    return merged.groupBy("session", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def change_clusters(frames: DataFrame, fps: float, scene_area: float, continuous_ms: float) -> DataFrame:
    """Adjacent change frames that are both large or touch each other: one event each, with its category.

    Input: session, seq, a, b (times), area (fraction), regions array<struct<x,y,w,h>>.
    """
    w = ordered("a", "seq")
    near = F.col("a") - F.lag("b").over(w) <= 1500.0 / fps
    large = (F.lag("area").over(w) >= scene_area) & (F.col("area") >= scene_area)
    touch = F.exists("_before", lambda p: F.exists("regions", lambda c: expr.box_iou(p, c) > 0))
    df = frames.withColumn("_before", F.lag("regions").over(w))
    df = islands(df.withColumn("_joined", near & (large | F.coalesce(touch, F.lit(False)))), ~F.coalesce("_joined", F.lit(False)), ["a", "seq"])
    cluster = df.groupBy("session", "island").agg(
        F.min_by("a", "seq").alias("start"), F.max_by("b", "seq").alias("end"), F.count(F.lit(1)).alias("n_frames"),
        F.max("area").alias("peak"), F.stddev_pop("area").alias("_std"), F.avg("area").alias("_mean"),
        F.min(F.array_min(F.transform("regions", lambda r: r["x"]))).alias("x"), F.min(F.array_min(F.transform("regions", lambda r: r["y"]))).alias("y"),
        F.max(F.array_max(F.transform("regions", lambda r: r["x"] + r["w"]))).alias("_x2"), F.max(F.array_max(F.transform("regions", lambda r: r["y"] + r["h"]))).alias("_y2"),
    )
    steady = F.when(F.col("_std") < F.col("_mean") * 0.5, "continuous_change").otherwise("scene_change")
    kind = F.when(F.col("end") - F.col("start") > continuous_ms, steady).when(F.col("peak") >= scene_area, "scene_change").otherwise("local_change")
    return cluster.select(
        "session", "island", "start", "end", "n_frames", "peak", kind.alias("category"), "x", "y", (F.col("_x2") - F.col("x")).alias("w"), (F.col("_y2") - F.col("y")).alias("h")
    )


def batches(df: DataFrame, gap: float, most: int) -> DataFrame:
    """Batch numbers: a new batch after a gap, and within an island after every `most` rows."""
    df = gap_islands(df, gap)
    in_island = F.row_number().over(ordered("ts", "seq", by=["session", "island"]))
    part = F.floor((in_island - 1) / most).cast("long")
    df = df.withColumn("_part", part)
    return df.withColumn("batch", F.dense_rank().over(ordered("island", "_part")) - 1).drop("_part", "island")


def merge_adjacent(moments: DataFrame, gap: float) -> DataFrame:
    """Moments at most `gap` after the latest end so far join it; the most important category and all ends are kept."""
    df = overlap_islands(moments, gap, "start", "end", ["start", "seq"])
    return df.groupBy("session", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("priority").alias("priority"),
        F.min_by("category", F.struct("priority", "start", "seq")).alias("category"), F.count(F.lit(1)).alias("n"),
    )


def flow_rollup(windows: DataFrame, gap: float) -> DataFrame:
    """Neighbouring scroll windows of one direction whose next start is at most `gap` after the end before it."""
    w = ordered("start", "seq")
    new = (F.col("direction") != F.lag("direction").over(w)) | (F.col("start") > F.lag("end").over(w) + gap)
    return islands(windows, new, ["start", "seq"]).groupBy("session", "island").agg(
        F.min("start").alias("start"), F.max_by("end", F.struct("start", "seq")).alias("end"), F.first("direction").alias("direction"), F.avg("magnitude").alias("magnitude")
    )


def segments(sessions: DataFrame, duration: str, longest: float, overlap: float) -> DataFrame:
    """ceil(duration / longest) equal parts, each reaching `overlap` into its neighbours."""
    n = F.greatest(F.lit(1), F.ceil(F.col(duration) / longest)).cast("int")
    part = F.col(duration) / F.col("n")
    start, end = F.col("index") * part, (F.col("index") + 1) * part
    rows = sessions.filter(F.col(duration) > 0).withColumn("n", n).withColumn("index", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.select(
        "session", "index", start.alias("start"), end.alias("end"),
        F.greatest(F.lit(0.0), start - overlap).alias("overlap_start"), F.least(F.col(duration), end + overlap).alias("overlap_end"),
    )


def absent_runs(trajectory: DataFrame, longer_than: float) -> DataFrame:
    """Runs of undetected rows from the first of them to the next detection; a run that nothing ends is not reported."""
    df = islands(trajectory, F.col("detected") != F.lag("detected").over(ordered("ts", "seq")), ["ts", "seq"])
    runs = df.groupBy("session", "island").agg(F.min("ts").alias("start"), F.first("detected").alias("detected"), F.count(F.lit(1)).alias("n"))
    runs = runs.withColumn("end", F.lead("start").over(ordered("island")))
    return runs.filter(~F.col("detected") & (F.col("end") - F.col("start") > longer_than)).select("session", "start", "end", "n")


def time_grid(df: DataFrame, start: str, end: str, step: float, out: str = "at") -> DataFrame:
    """Rows at start, start + step, ... up to and including the end."""
    n = F.floor((F.col(end) - F.col(start)) / step).cast("int")
    return df.withColumn("_i", F.explode(F.sequence(F.lit(0), n))).withColumn(out, F.col(start) + F.col("_i") * F.lit(float(step))).drop("_i")


def summary_windows(trajectory: DataFrame, scrolls: DataFrame, size: float, still_px: float, valid: Column | None = None) -> DataFrame:
    """Fixed tumbling windows from a session's first row with what the pointer does and the scroll in it, equal neighbours joined.

    activity: absent (no row that is valid, by default detected or with any confidence), still (all within still_px of the first),
    moving.
    """
    first = F.min("ts").over(W.partitionBy("session"))
    rows = trajectory.withColumn("w", F.floor((F.col("ts") - first) / size).cast("long")).withColumn("_0", first)
    a = rows.withColumn("_v", expr.valid() if valid is None else valid)
    a = a.withColumn("_fx", F.first(F.when(F.col("_v"), F.col("x")), True).over(ordered("ts", "seq", by=["session", "w"]).rowsBetween(W.unboundedPreceding, 0)))
    a = a.withColumn("_fy", F.first(F.when(F.col("_v"), F.col("y")), True).over(ordered("ts", "seq", by=["session", "w"]).rowsBetween(W.unboundedPreceding, 0)))
    per = a.groupBy("session", "w").agg(
        F.min("_0").alias("_0"), F.count(F.when(F.col("_v"), 1)).alias("n"),
        F.max(F.when(F.col("_v"), F.hypot(F.col("x") - F.col("_fx"), F.col("y") - F.col("_fy")))).alias("far"),
    )
    per = per.withColumn("start", F.col("_0") + F.col("w") * F.lit(float(size)))
    hit = per.join(scrolls.select("session", F.col("start").alias("s"), F.col("end").alias("e"), "direction"), "session").filter(
        "s < start + " + str(float(size)) + " AND start < e"
    )
    tag = hit.groupBy("session", "w").agg(F.min_by("direction", "s").alias("scroll"))
    kind = F.when(F.col("n") == 0, "absent").when(F.col("far") <= still_px, "still").otherwise("moving")
    per = per.join(tag, ["session", "w"], "left").select("session", "w", "start", kind.alias("activity"), F.coalesce("scroll", F.lit("")).alias("scroll"))
    w = ordered("w")
    new = (F.col("activity") != F.lag("activity").over(w)) | (F.col("scroll") != F.lag("scroll").over(w)) | (F.col("w") != F.lag("w").over(w) + 1)
    return islands(per, new, ["w"]).groupBy("session", "island").agg(
        F.min("start").alias("start"), (F.max("start") + size).alias("end"), F.first("activity").alias("activity"), F.first("scroll").alias("scroll")
    )

"""Two plans over whole recordings: a fine tracking pass only where a coarse one found moves, and the frames worth a look."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Frames, Trajectory
from ..functions import expr
from ..operators import folds, joins, windows
from ..sources.tables import written

#: The frames that an event of a type is seen on, and how much each reason counts (lower is more).
FRAME_RULES = {"dwell": ("event_mid",)}
BOTH_ENDS = ("event_start", "event_end")
FRAME_PRIORITY = {"event_start": 0, "event_end": 0, "event_mid": 0, "visual_change": 1, "baseline": 2}
#: Types of which the whole frame is looked at, not the part around the pointer.
WHOLE_FRAME = ("scroll",)


def two_pass(
    scan: Callable[[float | None, float | None], DataFrame],
    track: Callable[[DataFrame], DataFrame],
    coarse_ms: float,
    fine_ms: float,
    c: Trajectory = Trajectory(),
) -> DataFrame:
    """Trajectories tracked coarsely over whole recordings and finely where the pointer moved, then filled and smoothed.

    scan(first, last) reads the frames (session, seq, ts and what `track` needs) between two times, None for no bound; it should
    hand the bounds to its source, so that the fine pass reads only the files and row groups that can hold an active region.
    track(frames) gives (session, seq, ts, x, y, confidence, detected), a row for each frame.

    The coarse pass is written once, as the regions, the bounds and the union read it. Frames of overlapping regions come once;
    a recording without moves keeps its coarse samples, one without frames has none.
    """
    frames = scan(None, None)
    coarse = written(track(frames.join(folds.drifting_samples(frames, coarse_ms), ["session", "seq", "ts"], "left_semi")))
    regions = written(windows.active_regions(coarse.filter("detected"), c.displacement_px, c.padding_ms))
    first, last = regions.agg(F.min("start"), F.max("end")).first()
    if first is None:
        merged = coarse
    else:
        inside = located(scan(first, last), regions)
        picked = folds.drifting_samples(inside, fine_ms, by=["session", "island"]).drop("island")
        fine = track(inside.drop("island").join(picked, ["session", "seq", "ts"], "left_semi"))
        merged = joins.within_any(coarse, "ts", regions, "left_anti").unionByName(fine)
    return folds.smooth(windows.interpolate(merged, c.max_gap_ms), c.smooth_window, c.smooth_px)


def located(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """rows that lie in a region, ends included, with its number as `island`. Regions of a session do not overlap, so the last
    one that starts by a row's time is the only one that can hold it."""
    spans = regions.select("session", "start", F.struct("island", "end").alias("span"), F.lit(0).alias("seq"))
    at = joins.backward_asof(rows, "ts", spans, "start", "span")
    return at.filter(F.col("span.end") >= F.col("ts")).withColumn("island", F.col("span.island")).drop("span")


def selected_frames(
    events: DataFrame, diffs: DataFrame, trajectory: DataFrame, durations: DataFrame, width: int, height: int, c: Frames = Frames()
) -> DataFrame:
    """Frames to analyse: session, seq, ts, reason, event (null for others), and the region around the pointer (rx, ry, rw, rh).

    events: session, seq, type, start, end. diffs: session, seq, a, b (times of neighbouring samples), magnitude. durations:
    session, duration. An event's frames follow from its type; where no event frame stands for long, both samples of a
    visible change count; where still none does, the middle. Frames within dedup_ms of a kept one are it, the more important
    reason stays. seq numbers the frames of a session by time, reason and place in the plan.
    """
    rules = F.array(*map(F.lit, BOTH_ENDS))
    for kind, reasons in FRAME_RULES.items():
        rules = F.when(F.col("type") == kind, F.array(*map(F.lit, reasons))).otherwise(rules)
    by_reason = F.when(F.col("reason") == "event_start", F.col("start")).when(F.col("reason") == "event_end", F.col("end")).otherwise((F.col("start") + F.col("end")) / 2)
    seen = events.withColumn("reason", F.explode(rules)).select("session", by_reason.alias("ts"), "reason", F.col("seq").alias("event"), "type")
    none = [F.lit(None).cast("long").alias("event"), F.lit(None).cast("string").alias("type")]
    holes = gaps_of(seen, durations, c.scan_gap_ms)
    changed = diffs.filter(F.col("magnitude") > c.change)
    spans = holes.select("session", F.col("gap_start").alias("start"), F.col("gap_end").alias("end"))
    changed = joins.within_one(changed, "a", "b", spans).select("session", F.explode(F.array("a", "b")).alias("ts"), F.lit("visual_change").alias("reason"), *none)
    both = seen.unionByName(changed)
    middle = gaps_of(both, durations, c.baseline_gap_ms).select("session", ((F.col("gap_start") + F.col("gap_end")) / 2).alias("ts"), F.lit("baseline").alias("reason"), *none)
    rank = F.lit(max(FRAME_PRIORITY.values()))
    place = F.lit(len(FRAME_PRIORITY))
    for i, (reason, priority) in enumerate(FRAME_PRIORITY.items()):
        rank = F.when(F.col("reason") == reason, priority).otherwise(rank)
        place = F.when(F.col("reason") == reason, i).otherwise(place)
    rows = both.unionByName(middle).withColumns({"priority": rank, "_place": place})
    # Where frames share a time, events come first, in their order, as they are found first.
    order = windows.ordered("ts", "priority", F.coalesce("event", F.lit(0)), "_place")
    rows = written(rows.withColumn("seq", F.row_number().over(order).cast("long")))
    kept = folds.dedup_frames(rows, c.dedup_ms).select("session", "seq")
    out = joins.nearest_detected(rows.join(kept, ["session", "seq"], "left_semi"), "ts", trajectory, c.lookup_ms)
    region = expr.region_around(F.col("px"), F.col("py"), width, height, c.roi_size + 2 * c.roi_padding)
    own = F.when(F.col("event").isNotNull() & ~F.col("type").isin(*WHOLE_FRAME), region)
    return out.withColumn("_r", own).select("session", "seq", "ts", "reason", "event", *(F.col(f"_r.{n}").alias(n) for n in ("rx", "ry", "rw", "rh")))


def gaps_of(frames: DataFrame, durations: DataFrame, longer_than: float) -> DataFrame:
    """Gaps between 0, the frames and the end of each recording, recordings without a frame included."""
    ends = durations.select("session", F.lit(0.0).alias("ts"), "duration").unionByName(frames.join(durations, "session").select("session", "ts", "duration"))
    return windows.gaps(ends, F.col("duration"), "ts", longer_than)

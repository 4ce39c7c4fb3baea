"""Stages composed of the operators, each over all sessions at once; a stage can be replaced by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import EVENT_TYPES, MOMENT_PRIORITY, Behaviour, Change, Merge, Moments, Triage
from ..functions import expr
from ..functions.similarity import similar
from ..operators import folds, joins, windows
from ..operators.windows import ordered


def triage(diffs: DataFrame, durations: DataFrame, c: Triage = Triage()) -> DataFrame:
    """Frame differences (session, ts, magnitude) as activity segments with a frame rate; durations: (session, duration)."""
    hops = windows.hop_windows(diffs, "magnitude", c.window_ms, c.step_ms)
    tiers = hops.withColumn("tier", expr.tier(F.col("mean"), c.idle, c.low, c.medium))
    found = windows.tier_segments(tiers, c.min_segment_ms).join(durations, "session")
    return found.withColumn("end", F.least("end", "duration")).withColumn("fps", expr.tier_fps(F.col("tier"))).drop("duration")


def untriaged(durations: DataFrame) -> DataFrame:
    """One medium segment over each whole recording."""
    return durations.select("session", F.lit(0).alias("segment"), F.lit(0.0).alias("start"), F.col("duration").alias("end"), F.lit("medium").alias("tier"), F.lit(4.0).alias("fps"))


def scrolls(flow: DataFrame, c: Change = Change()) -> DataFrame:
    ok = (F.col("uniformity") >= c.flow_uniformity) & (F.col("magnitude") >= c.flow_magnitude) & F.col("direction").isin("N", "S")
    return flow.filter(ok).select("session", F.lit("scroll").alias("type"), "start", "end", F.lit(0.7).alias("confidence"))


def local_events(trajectory: DataFrame, flow: DataFrame, b: Behaviour = Behaviour()) -> DataFrame:
    """Hovers, dwells, thrashes, hesitations, click candidates and scrolls as one table in time order.

    Hovers inside a dwell go, and click candidates inside a hover or a dwell.
    """
    ok = expr.valid()
    dwell = folds.stops(trajectory, ok, b.dwell_px, b.dwell_ms)
    hover = joins.not_contained(folds.stops(trajectory, ok, b.hover_px, *b.hover_ms), dwell)
    thrash = folds.thrashes(trajectory, ok, b.thrash_ms, b.thrash_turns, b.thrash_speed, b.thrash_degrees)
    click = folds.clicks(trajectory, ok, b.click_px, b.click_ms)
    click = joins.not_contained(joins.not_contained(click, hover), dwell)
    pause = folds.stops(trajectory, ok, b.hesitation_px, *b.hesitation_ms)
    hesitate = joins.followed(pause, click.select("session", "start").union(scrolls(flow).select("session", "start")), b.follow_ms)
    parts = {"hover": (hover, 0.6), "dwell": (dwell, 0.7), "cursor_thrash": (thrash, 0.6), "click": (click, 0.3), "hesitate": (hesitate, 0.5)}
    out = None
    for kind, (df, sure) in parts.items():
        rows = df.select("session", F.lit(kind).alias("type"), "start", "end", "x", "y", F.lit(sure).alias("confidence"))
        out = rows if out is None else out.unionByName(rows)
    return out.unionByName(scrolls(flow), allowMissingColumns=True)


def moments(changes: DataFrame, flow_events: DataFrame, stops: DataFrame, others: DataFrame, durations: DataFrame, width: int, height: int, m: Moments = Moments()) -> DataFrame:
    """Changes, cursor stops and other cursor events as moments within a token budget.

    changes: session, seq, start, end, category, x, y, w, h. flow_events, stops, others: session, seq, start, end (flow with
    category). A change that overlaps a flow event is a scroll; stops and others that overlap what came before them go.
    """
    scroll = joins.first_overlap(changes, flow_events.withColumnRenamed("category", "_flow"), "_flow")
    kinds = F.when(F.col("_flow").isNotNull(), "scroll").when(F.col("category") == "continuous_change", "continuous").when(F.col("category") == "local_change", "interaction").otherwise("scene_change")
    made = scroll.select("session", "seq", "start", "end", kinds.alias("category"), F.col("w").alias("bw"), F.col("h").alias("bh"))
    no = F.lit(None).cast("double")
    pre = made.filter("category = 'scene_change'").select(
        "session", "seq", F.greatest(F.lit(0.0), F.col("start") - 500).alias("start"), F.col("start").alias("end"), F.lit("pre_scene_change").alias("category"), no.alias("bw"), no.alias("bh")
    )
    still = joins.without_overlap(stops, made).select("session", "seq", "start", "end", F.lit("cursor_stop").alias("category"), no.alias("bw"), no.alias("bh"))
    rest = joins.without_overlap(joins.without_overlap(others, made), still).select("session", "seq", "start", "end", F.lit("cursor_only").alias("category"), no.alias("bw"), no.alias("bh"))
    rank = F.lit(len(MOMENT_PRIORITY))
    for name, p in MOMENT_PRIORITY.items():
        rank = F.when(F.col("category") == name, p).otherwise(rank)
    all_ = made.unionByName(pre).unionByName(still).unionByName(rest).withColumn("priority", rank)
    joined = windows.overlap_islands(all_, m.merge_gap_ms, "start", "end", ["start", "seq"])
    best = F.struct("priority", "start", "seq")
    merged = joined.groupBy("session", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("category", best).alias("category"), F.min("priority").alias("priority"),
        F.first("bw", ignorenulls=True).alias("bw"), F.first("bh", ignorenulls=True).alias("bh"), F.min("seq").alias("seq"),
    )
    cost = expr.moment_tokens(F.col("category"), F.col("bw"), F.col("bh"), F.lit(width), F.lit(height), m.roi_size, m.roi_padding)
    priced = merged.withColumn("tokens", (cost * expr.base_frames(F.col("category"), F.col("bw"))).cast("long"))
    priced = priced.join(durations.select("session", (F.col("duration") / 60000).alias("minutes")), "session")
    chosen = folds.within_budget(priced.withColumn("priority", F.col("priority").cast("int")), m.tokens_per_minute)
    chosen = chosen.join(priced.select("session", "seq", "start", "end", "category"), ["session", "seq", "start", "category"])
    if m.per_minute > 0:
        most = F.greatest(F.lit(1), F.floor(F.col("duration") / 60000 * m.per_minute))
        n = F.row_number().over(ordered("priority", "start", "seq"))
        chosen = chosen.join(durations, "session").withColumn("_n", n).filter(F.col("_n") <= most).drop("_n", "duration")
    return chosen


def resolved(raw: DataFrame, frames: DataFrame, discard_context: bool = True) -> DataFrame:
    """Events by frame number (session, segment, first, last, ...) on the clock; an unmapped frame drops the event, and so do
    frames that are all context. frames: session, segment, frame, ts, is_context; the last row of a repeated frame counts."""
    f = frames.groupBy("session", "segment", "frame").agg(F.max_by(F.struct("ts", "is_context"), "seq").alias("f"))
    at = lambda name: f.select("session", "segment", F.col("frame").alias(name), F.col("f.ts").alias(f"_{name}"))
    out = raw.join(at("first"), ["session", "segment", "first"]).join(at("last"), ["session", "segment", "last"])
    out = out.withColumnRenamed("_first", "start").withColumnRenamed("_last", "end")
    if discard_context:
        c = f.select(F.col("session").alias("_s"), F.col("segment").alias("_g"), "frame", F.col("f.is_context").alias("c"))
        inside = out.join(c, (F.col("session") == F.col("_s")) & (F.col("segment") == F.col("_g")) & F.col("frame").between(F.col("first"), F.col("last")))
        only = inside.groupBy("session", "segment", "seq").agg(F.bool_and("c").alias("_context"))
        out = out.join(only, ["session", "segment", "seq"], "left").filter(~F.coalesce("_context", F.lit(False))).drop("_context")
    return out


def shifted(found: DataFrame, offset: str, types: tuple = EVENT_TYPES, fallback: str = EVENT_TYPES[-1]) -> DataFrame:
    """Segment-relative events on the session's clock; unknown types become the fallback, missing confidence 0.5."""
    return found.withColumns(
        {
            "start": F.col("start") + F.col(offset),
            "end": F.coalesce("end", "start") + F.col(offset),
            "type": F.when(F.col("type").isin(*types), F.col("type")).otherwise(fallback),
            "confidence": F.coalesce("confidence", F.lit(0.5)),
        }
    )


def merged(found: DataFrame, c: Merge = Merge()) -> DataFrame:
    """Events of all sources without duplicates, in the kept list's order."""
    columns = ["session", "seq", "type", "start", "end", "description", "confidence"]
    out = folds.dedup_events(found.select(*columns), c.tolerance_ms, c.similarity, similar)
    return out.withColumn("position", F.row_number().over(W.partitionBy("session").orderBy("slot_start", "slot_seq")))


STAGES: dict[str, Callable] = {"triage": triage, "observe": local_events, "moments": moments, "merge": merged}


def stage(name: str, overrides: dict[str, Callable] | None = None) -> Callable:
    """A stage by name; what `overrides` does not name falls through to the default."""
    return (overrides or {}).get(name, STAGES[name])

"""From measurements to finished events: which moments are looked at, what part of a frame, and what an event looks like at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exact import fixed, rounded
from .joins import backward_asof, interval_join

#: The moment categories each of the two analysis passes takes.
PASSES = {
    1: ("scene_change", "scroll", "continuous", "baseline"),
    2: ("interaction", "pre_scene_change", "cursor_stop", "cursor_only"),
}
#: Words for flow directions and kinds of change.
WAYS = {"S": "down", "N": "up"}
CHANGES = {"scene_change": "Scene change", "continuous_change": "Continuous change", "local_change": "Local change"}


#: The words that stand above the candidates of a prompt.
CANDIDATE_HEADING = (
    "## Local Event Candidates",
    "",
    "The following events were detected locally from cursor tracking and optical flow.",
    "Please confirm, reject, or modify each candidate based on what you see in the frames.",
    "",
    "",
)


def of_pass(moments: DataFrame, number: int) -> DataFrame:
    return moments.filter(F.col("category").isin(*PASSES[number]))


def enabled(moments: DataFrame, categories: list[str]) -> DataFrame:
    """Moments of the categories that are on; to be asked after merging, which may change a category."""
    return moments.filter(F.col("category").isin(*categories))


def lasting(changes: DataFrame, least_ms: float) -> DataFrame:
    """Changes that last at least so long; 0 or less keeps all."""
    return changes.filter(F.col("end") - F.col("start") >= least_ms) if least_ms > 0 else changes


def beside(x: Column, y: Column, bbox: dict[str, Column], padding: float) -> Column:
    """Whether a point lies in a box (x, y, w, h) widened by the padding, edges included; false without a point."""
    inside = x.between(bbox["x"] - padding, bbox["x"] + bbox["w"] + padding) & y.between(bbox["y"] - padding, bbox["y"] + bbox["h"] + padding)
    return F.coalesce(inside, F.lit(False))


def _span(low: Column, size: Column, frame: int) -> dict[str, Column]:
    """A range of whole pixels moved into a frame and cut to it."""
    start = F.greatest(F.lit(0), F.least(F.greatest(F.lit(0), low), F.lit(frame) - size))
    return {"at": start.cast("long"), "size": F.least(size, F.lit(frame)).cast("long")}


def moment_roi(category: Column, bbox: dict[str, Column], cursor: dict[str, Column], width: int, height: int, size: int = 256, padding: int = 64) -> Column:
    """struct(x, y, w, h) in whole pixels: a change's box with padding, of `size` at least and moved into the frame; without a
    change a square around the cursor, or around the frame's middle; the whole frame before a scene change without a cursor."""

    def changed(at: Column, extent: Column, frame: int) -> dict[str, Column]:
        low, high = F.greatest(F.lit(0), at - padding), F.least(F.lit(frame), at + extent + padding)
        room = F.greatest(F.lit(size), high - low)
        return _span(F.floor((low + high) / 2) - F.floor(room / 2), room, frame)

    def pointed(at: Column, frame: int) -> dict[str, Column]:
        side = F.lit(size + 2 * padding)
        return _span(F.coalesce(at.cast("long"), F.lit(frame // 2)) - (size + 2 * padding) // 2, side, frame)

    def box(h: dict[str, Column], v: dict[str, Column]) -> Column:
        return F.struct(h["at"].alias("x"), v["at"].alias("y"), h["size"].alias("w"), v["size"].alias("h"))

    whole = F.struct(*(F.lit(v).cast("long").alias(k) for k, v in zip("xywh", (0, 0, width, height))))
    return (
        F.when(bbox["x"].isNotNull(), box(changed(bbox["x"], bbox["w"], width), changed(bbox["y"], bbox["h"], height)))
        .when((category == "pre_scene_change") & cursor["x"].isNull(), whole)
        .otherwise(box(pointed(cursor["x"], width), pointed(cursor["y"], height)))
    )


def crop(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> Column:
    """struct(x0, y0, x1, y1): the part of a frame that a box asks for; its corner is kept on the last pixel at most."""
    near = lambda at, frame: F.greatest(F.lit(0), F.least(at, F.lit(frame - 1)))
    far = lambda at, frame: F.greatest(F.lit(0), F.least(at, F.lit(frame)))
    return F.struct(near(x, width).alias("x0"), near(y, height).alias("y0"), far(x + w, width).alias("x1"), far(y + h, height).alias("y1"))


def scroll_events(moments: DataFrame, scenes: DataFrame, offset: Column) -> DataFrame:
    """Scroll moments that have a flow (direction, magnitude, uniformity) as events on the session's clock, with the title of the
    latest scene (session, seq, at, page_title) at or before their start."""
    found = moments.filter((F.col("category") == "scroll") & F.col("direction").isNotNull())
    titled = backward_asof(found, "start", scenes, "at", "page_title")
    way = F.col("direction")
    for letter, word in WAYS.items():
        way = F.when(F.col("direction") == letter, word).otherwise(way)
    text = F.concat(F.lit("Scroll "), way, F.lit(" (magnitude: "), fixed(F.col("magnitude"), 1), F.lit(", uniformity: "), fixed(F.col("uniformity"), 2), F.lit(")"))
    return titled.select(
        "session", "seq", F.lit("scroll").alias("type"), (F.col("start") + offset).alias("start"), (F.col("end") + offset).alias("end"),
        text.alias("description"), F.lit(0.8).alias("confidence"), "page_title",
    )


def certain_events(local: DataFrame, offset: Column) -> DataFrame:
    """Local events that need no enrichment as events on the session's clock. `positions` holds the cursor's places
    (array of struct x, y): thrashing stands at their mean, everything else at the first, without any at none."""
    n = F.size("positions")
    total = lambda c: F.aggregate("positions", F.lit(0.0), lambda t, p: t + p[c])
    place = lambda c: F.when(n > 0, F.when(F.col("type") == "cursor_thrash", total(c) / n).otherwise(F.try_element_at("positions", F.lit(1))[c]))
    return local.filter("NOT needs_enrichment").select(
        "session", "seq", "type", (F.col("start") + offset).alias("start"), (F.col("end") + offset).alias("end"), "description", "confidence",
        place("x").alias("x"), place("y").alias("y"),
    )


def final_events(found: DataFrame, sessions: DataFrame, source: str, optional: list[str]) -> DataFrame:
    """Finished events with their source and the ids of their session: transcript_id and study_id from sessions (session,
    identifier, study_id). Optional texts that are empty become null, and so does a cursor_position (struct x, y) that lacks a
    coordinate, so that JSON leaves them out. An event of an unknown session keeps null ids."""
    known = sessions.select("session", F.col("identifier").alias("transcript_id"), "study_id")
    out = found.drop("transcript_id", "study_id").join(known, "session", "left")
    fields = {"source": F.lit(source)} | {c: F.nullif(F.col(c), F.lit("")) for c in optional}
    if "cursor_position" in found.columns:
        fields["cursor_position"] = F.when(F.col("cursor_position.x").isNotNull() & F.col("cursor_position.y").isNotNull(), F.col("cursor_position"))
    return out.withColumns(fields)


def annotations(changes: DataFrame, flows: DataFrame, offset: Column, least_area: float, kinds: list[str] | None = None) -> DataFrame:
    """Changes and scrolling flows as baseline annotations in time order (ties by seq): times at one decimal of their exact value, halves to even, the box for local
    changes only; scene changes over at least `least_area` of the frame. kinds: the categories of change that are wanted."""
    kinds = list(CHANGES) if kinds is None else kinds
    kept = changes.filter(F.col("category").isin(*kinds) & ((F.col("category") != "scene_change") | (F.col("area") >= least_area)))
    text = F.lit("")
    for name, words in CHANGES.items():
        text = F.when(F.col("category") == name, words).otherwise(text)
    times = [rounded(F.col(c) + offset, 1).alias(c) for c in ("start", "end")]
    box = F.when(F.col("category") == "local_change", F.struct("x", "y", "w", "h"))
    seen = kept.select("session", "seq", F.lit("change_ui_state").alias("type"), *times, text.alias("description"), box.alias("bbox"))
    moved = flows.filter(F.col("category").isin("scroll", "pan")).select(
        "session", "seq", F.lit("scroll").alias("type"), *times, F.concat_ws(" ", "category", "direction").alias("description"), F.lit(None).cast(seen.schema["bbox"].dataType).alias("bbox")
    )
    return seen.unionByName(moved)


def appended(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both lists with `position`, their place in time order of the session; at equal times what was there comes first."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("position", F.row_number().over(W.partitionBy("session").orderBy("start", "_new", "seq"))).drop("_new")


def candidate_lines(local: DataFrame, segments: DataFrame, width: float, heading: bool = True) -> DataFrame:
    """(session, segment, text): a segment's local events that need enrichment and touch it, ends included, as numbered lines in
    the events' order, under the heading of the analysis prompt; a segment without such events has no row. width: the time
    bins of the join. positions as in certain_events(). The text of a segment is one value, as the prompt wants it."""
    wanted = local.filter("needs_enrichment")
    hit = interval_join(segments.select("session", "segment", "start", "end"), wanted, width, strict=False).select("l.segment", "r.*")
    at = F.try_element_at("positions", F.lit(1))
    cursor = F.when(F.size("positions") > 0, F.concat(F.lit(" at cursor ("), fixed(at["x"], 0), F.lit(", "), fixed(at["y"], 0), F.lit(")"))).otherwise("")
    n = F.row_number().over(W.partitionBy("session", "segment").orderBy("start", "seq"))
    span = F.concat(fixed(F.col("start"), 0), F.lit("ms-"), fixed(F.col("end"), 0), F.lit("ms"))
    name = F.concat(F.lit("- **Candidate "), F.col("_n").cast("string"), F.lit("**: "), F.col("type"))
    line = F.concat_ws(" | ", name, span, F.concat(F.lit("confidence="), fixed(F.col("confidence"), 2), cursor), F.col("description"))
    each = hit.withColumn("_n", n).withColumn("_line", line)
    lines = F.array_sort(F.collect_list(F.struct("_n", "_line")))
    text = F.array_join(F.transform(lines, lambda s: s["_line"]), "\n")
    return each.groupBy("session", "segment").agg((F.concat(F.lit("\n".join(CANDIDATE_HEADING)), text, F.lit("\n")) if heading else text).alias("text"))


def observe_summary(trajectory: DataFrame, local: DataFrame, moments: DataFrame, budgets: DataFrame) -> DataFrame:
    """A row per session: frames, detections and their rate, templates met, local events by type, moments by category, tokens used
    of the budget in per cent. Counts by name are maps; nothing but counts is gathered. budgets: (session, budget)."""

    def by(df: DataFrame, key: str, out: str) -> DataFrame:
        each = df.groupBy("session", key).agg(F.count(F.lit(1)).alias("n"))
        return each.groupBy("session").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(out))

    seen = F.count_if("detected")
    base = trajectory.groupBy("session").agg(F.count(F.lit(1)).alias("frames"), seen.alias("detections"), rounded(seen / F.count(F.lit(1)), 4).alias("rate"))
    used = moments.groupBy("session").agg(F.count(F.lit(1)).alias("moments"), F.sum("tokens").alias("used"))
    parts = [by(trajectory.filter("detected"), "template", "templates"), by(local, "type", "events"), by(moments, "category", "categories"), used, budgets]
    for part in parts:
        base = base.join(part, "session", "left")
    zero = base.fillna(0, ["moments", "used"])
    share = F.when(F.col("budget") > 0, rounded(F.col("used") / F.col("budget") * 100, 1)).otherwise(0.0)
    return zero.withColumn("used_percent", share)


def first_of_each(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group: a report's shortened lists."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def gate(canary: DataFrame, runs: DataFrame, least_f1: float = 0.05, severity: str = "critical") -> DataFrame:
    """runs (experiment, session) with `runs`: whether the session is to be started. An experiment whose canary (experiment,
    session, f1, severity) scores under `least_f1` and is judged critical runs no further session; missing scores count as 0."""
    failed = (F.coalesce("f1", F.lit(0.0)) < least_f1) & F.coalesce(F.col("severity") == severity, F.lit(False))
    seen = canary.select("experiment", F.col("session").alias("_first"), failed.alias("_failed"))
    both = runs.join(seen, "experiment", "left")
    go = (F.col("session") == F.col("_first")) | ~F.coalesce("_failed", F.lit(False))
    return both.select("experiment", "session", F.coalesce(go, F.lit(True)).alias("runs"))

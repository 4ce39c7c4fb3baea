"""Events found segment by segment as one timeline: shifted, without what two segments both saw, with the pointer's places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Merge
from ..functions import expr
from ..functions.exact import rounded
from ..functions.similarity import similar
from ..operators import alike, folds, joins
from ..operators.windows import ordered
from ..sources.tables import written
from .stages import shifted

#: Types whose place is the pointer's at their start, and those whose place is its mean.
AT_START = ("click", "hover", "dwell", "select")
MEAN_INSIDE = ("cursor_thrash", "drag")


def overlaps(segments: DataFrame) -> DataFrame:
    """(session, start, end) where a segment reaches into the next one. segments: session, segment, start, end."""
    nxt = segments.withColumn("_next", F.lead("start").over(ordered("segment")))
    return nxt.filter(F.col("_next") < F.col("end")).select("session", F.col("_next").alias("start"), "end")


def placed(events: DataFrame, trajectory: DataFrame, types: list[str], tolerance: float = 500.0, width: float = 10_000.0) -> DataFrame:
    """events (session, seq, type, start, end, x, y) with the pointer's places in whole pixels, halves to even: that nearest to the
    start, nearer than the tolerance, or for thrashing and drags the mean from start to end. Events of `types` without such a
    place lose theirs; other types, and all events of sessions without a trajectory, keep what they have."""
    found = joins.cursor_positions(events.select("session", "seq", "type", "start", "end"), trajectory, expr.valid(), tolerance, list(AT_START), list(MEAN_INSIDE), width)
    known = trajectory.groupBy("session").agg(F.lit(True).alias("_known"))
    both = events.join(found.select("session", "seq", "px", "py"), ["session", "seq"], "left").join(known, "session", "left")
    asked = F.coalesce("_known", F.lit(False)) & F.col("type").isin(list(types))
    return both.withColumns({c: F.when(asked, F.rint(f"p{c}")).otherwise(F.col(c)) for c in "xy"}).select(*events.columns)


def standalone(found: DataFrame, segments: DataFrame, trajectory: DataFrame, offsets: DataFrame, cursor_types: list[str] = [*AT_START, *MEAN_INSIDE], c: Merge = Merge(), by_text: DataFrame | None = None) -> DataFrame:
    """Final events on the stored clock: session, position (from 1 on), type, start, end, description, confidence, x, y.

    found: session, segment, seq, type, start, end (from the segment's start), description, confidence, cursor_x, cursor_y.
    segments: session, segment, start, end (of the video). trajectory: session, seq, ts (of the video), x, y, confidence,
    detected. offsets: session, offset (ms between the two clocks). Duplicates that overlapping segments both saw go first,
    then all others; each walk goes over what the one before it kept, in its order. With by_text (text, description) found has a key
    `text` instead of a description; rows carry keys only, and descriptions come to what is left.
    """
    if by_text is None:
        found, by_text = alike.keyed(found)
    starts = segments.select("session", "segment", F.col("start").alias("_begin")).join(offsets, "session")
    rows = shifted(found.join(starts.withColumn("_shift", F.col("_begin") + F.col("offset")), ["session", "segment"]), "_shift")
    rows = rows.withColumn("_at", F.col("start"))
    own = F.col("cursor_x").isNotNull() & F.col("cursor_y").isNotNull()
    rows = rows.withColumns({n: F.when(own, rounded(F.col(f"cursor_{n}"), 1)) for n in "xy"})
    rows = rows.withColumn("seq", F.row_number().over(ordered("start", "segment", "seq")).cast("long"))
    columns = ["session", "seq", "type", "start", "end", "text", "confidence"]
    rows = written(rows.select(*columns, "x", "y"))
    spans = overlaps(segments).join(offsets, "session").select("session", (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end"))
    first = folds.dedup_overlaps(joins.marked_within(rows.select(*columns), "start", spans, "in_overlap"), c.overlap_close_ms, c.overlap_similarity, similar, by_text)
    second = folds.dedup_events(first.drop("in_overlap"), c.tolerance_ms, c.similarity, similar, slots=True, by_text=by_text)
    kept = second.select("session", "seq", "slot_start", "slot_seq").join(rows, ["session", "seq"]).join(offsets, "session")
    moved = kept.withColumns({n: F.col(n) - F.col("offset") for n in ("start", "end")})
    out = placed(moved, trajectory, cursor_types).withColumns({n: F.col(n) + F.col("offset") for n in ("start", "end")})
    out = out.withColumn("position", F.row_number().over(ordered("slot_start", "slot_seq")))
    out = alike.described(out.select("session", "position", "type", "start", "end", "text", "confidence", "x", "y"), by_text)
    return out.withColumn("description", F.coalesce("description", F.lit("")))

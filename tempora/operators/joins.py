"""Interval, nearest and as-of joins. All carry the session as an equality key, so no plan is a Cartesian product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import ordered, running


def binned(df: DataFrame, start: str, end: str, width: float, out: str = "bin") -> DataFrame:
    """A row for each time bin that a row's interval touches."""
    return df.withColumn(out, F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))))


def interval_join(left: DataFrame, right: DataFrame, width: float, strict: bool = True, by: tuple | list = ("session",)) -> DataFrame:
    """Pairs of a session (or of equal `by`) whose intervals (start, end) overlap, left and right columns as structs l and r.

    Both sides are dealt by (session, time bin), so that a long session spreads over tasks; a pair is kept in the bin where
    its overlap begins, which makes it come once. strict: half-open intervals that only touch do not overlap.
    """
    keys = list(by)
    a = binned(left.select(*keys, F.struct("*").alias("l")).withColumns({"s": F.col("l.start"), "e": F.col("l.end")}), "s", "e", width)
    b = binned(right.select(*keys, F.struct("*").alias("r")).withColumns({"s2": F.col("r.start"), "e2": F.col("r.end")}), "s2", "e2", width)
    meet = (F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e")) if strict else (F.col("s") <= F.col("e2")) & (F.col("s2") <= F.col("e"))
    home = F.floor(F.greatest("s", "s2") / width).cast("long") == F.col("bin")
    return a.join(b, [*keys, "bin"]).filter(meet & home).select(*keys, "l", "r")


def _reached(left: DataFrame, at: Column, right: DataFrame, value: Column, before: bool, backwards: bool = False, part_ms: float | None = None) -> DataFrame:
    """left with _seen: the greatest `value` of right's rows that start by `at` (backwards: the start of the next one from `at`
    on); rows that start right at it count if `before`. One sort of both sides together; no row is multiplied. part_ms: as in
    windows.running(), of which rows that tie in all need the same."""
    side = 1 if before != backwards else -1
    l = left.select("session", at.alias("_t"), F.lit(side).alias("_side"), F.struct("*").alias("_l"), F.lit(None).cast("double").alias("_v"))
    r = right.select("session", F.col("start").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), value.cast("double").alias("_v"))
    both = running(l.unionByName(r), F.col("_v"), "_seen", ["_t", "_side"], "last" if backwards else "max", backwards=backwards, part_ms=part_ms)
    return both.filter("_l IS NOT NULL").select("_l.*", "_seen")


def without_overlap(left: DataFrame, right: DataFrame, key: str = "seq", part_ms: float | None = None) -> DataFrame:
    """Rows of left that overlap no interval of right (half-open): of those that start before its end, none ends after its start."""
    both = _reached(left, F.col("end"), right, F.col("end"), before=False, part_ms=part_ms)
    return both.filter(F.coalesce(F.col("_seen") <= F.col("start"), F.lit(True))).drop("_seen")


def within_any(left: DataFrame, at: str, right: DataFrame, how: str = "left_semi", part_ms: float | None = None, closed: bool = True) -> DataFrame:
    """Rows of left whose time lies in an interval of right, its end included if `closed` (left_anti: in none)."""
    seen = F.col("_seen")
    inside = F.coalesce(seen >= F.col(at) if closed else seen > F.col(at), F.lit(False))
    both = _reached(left, F.col(at), right, F.col("end"), before=True, part_ms=part_ms)
    return both.filter(inside if how == "left_semi" else ~inside).drop("_seen")


def marked_within(left: DataFrame, at: str, right: DataFrame, out: str, part_ms: float | None = None) -> DataFrame:
    """left with a boolean: whether its time lies in an interval of right, ends included."""
    both = _reached(left, F.col(at), right, F.col("end"), before=True, part_ms=part_ms)
    return both.withColumn(out, F.coalesce(F.col("_seen") >= F.col(at), F.lit(False))).drop("_seen")


def within_one(left: DataFrame, a: str, b: str, spans: DataFrame, part_ms: float | None = None) -> DataFrame:
    """Rows of left with [a, b] inside one of the spans (start, end), which do not overlap in a session: of those that start by
    a, the last one ends latest."""
    both = _reached(left, F.col(a), spans, F.col("end"), before=True, part_ms=part_ms)
    return both.filter(F.coalesce(F.col("_seen") >= F.col(b), F.lit(False))).drop("_seen")


def not_contained(left: DataFrame, right: DataFrame, part_ms: float | None = None) -> DataFrame:
    """Rows of left that no interval of right contains."""
    both = _reached(left, F.col("start"), right, F.col("end"), before=True, part_ms=part_ms)
    return both.filter(~F.coalesce(F.col("_seen") >= F.col("end"), F.lit(False))).drop("_seen")


def followed(left: DataFrame, right: DataFrame, within: float, part_ms: float | None = None) -> DataFrame:
    """Rows of left after whose end a row of right starts within the open interval (0, within)."""
    both = _reached(left, F.col("end"), right, F.col("start"), before=False, backwards=True, part_ms=part_ms)
    return both.filter(F.col("_seen") - F.col("end") < within).drop("_seen")


def backward_asof(left: DataFrame, at: str, right: DataFrame, right_at: str, value: str, part_ms: float | None = None) -> DataFrame:
    """left with the value of the latest row of right at or before its time; of ties the first seen (least seq).

    One sort of both sides together; no row is multiplied. part_ms: as in windows.running(), so that a very long session spreads.
    """
    l = left.select("session", F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_l"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(False).alias("_has"))
    first = right.groupBy("session", F.col(right_at).alias("_t")).agg(F.min_by(value, "seq").alias("_v"))
    r = first.select("session", "_t", F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), "_v", F.lit(True).alias("_has"))
    seen = running(l.unionByName(r), F.when(F.col("_has"), F.struct("_v")), "_seen", ["_t", "_side"], "last", part_ms=part_ms)
    return seen.filter("_side = 1").select("_l.*", F.col("_seen._v").alias(value))


def nearest_neighbours(left: DataFrame, at: str, trajectory: DataFrame, tolerance: float, valid: Column) -> DataFrame:
    """left with px, py of the nearest valid row among the three around the place where its time would be inserted.

    The rows tried are the last before the time and the two from it on; an invalid one can hide a valid one further off.
    Nearer than the tolerance (strict), ties to the earlier row. left needs a column `seq` that is unique in a session.
    """
    t = trajectory.withColumn("_ok", valid).select(
        "session", F.col("ts").alias("_t"), F.lit(0).alias("_side"), "seq", F.struct("ts", "x", "y", F.col("_ok").alias("ok"), "seq").alias("_d")
    )
    q = left.select("session", F.col(at).alias("_t"), F.lit(-1).alias("_side"), "seq", F.lit(None).cast(t.schema["_d"].dataType).alias("_d"), F.struct("*").alias("_l"))
    # Looking ahead is looking back in the opposite order: a frame from the start of a session grows by a row at a time.
    w = W.partitionBy("session").orderBy("_t", "_side", "seq").rowsBetween(W.unboundedPreceding, -1)
    back = W.partitionBy("session").orderBy(F.desc("_t"), F.desc("_side"), F.desc("seq"))
    ahead = back.rowsBetween(W.unboundedPreceding, -1)
    both = q.unionByName(t.withColumn("_l", F.lit(None).cast(q.schema["_l"].dataType)))
    # A trajectory's row carries the one after it along.
    both = both.withColumn("_next", F.when(F.col("_side") == 0, F.struct("_d", F.last("_d", ignorenulls=True).over(ahead).alias("_then"))))
    both = both.withColumn("_two", F.last("_next", ignorenulls=True).over(ahead))
    both = both.withColumn("_c", F.array(F.last("_d", ignorenulls=True).over(w), F.col("_two._d"), F.col("_two._then"))).filter("_side = -1")
    near = F.filter("_c", lambda d: d.isNotNull() & d["ok"] & (F.abs(d["ts"] - F.col("_t")) < tolerance))
    best = F.array_min(F.transform(near, lambda d: F.struct(F.abs(d["ts"] - F.col("_t")).alias("gap"), d["ts"].alias("ts"), d["seq"].alias("seq"), d["x"].alias("x"), d["y"].alias("y"))))
    return both.withColumn("_b", best).select("_l.*", F.col("_b.x").alias("px"), F.col("_b.y").alias("py"))


def nearest_detected(left: DataFrame, at: str, trajectory: DataFrame, tolerance: float) -> DataFrame:
    """left with px, py of the nearest detected row of all, nearer than the tolerance (strict), ties to the earlier row: the last
    one up to the time and the first one from it on, by one sort each way."""
    place = F.struct("x", "y")
    t = trajectory.filter("detected").groupBy("session", F.col("ts").alias("_t")).agg(F.min_by(place, "seq").alias("_p"))
    t = t.select("session", "_t", F.lit(0).alias("_side"), F.struct(F.col("_t").alias("ts"), "_p").alias("_d"))
    q = left.select("session", F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(t.schema["_d"].dataType).alias("_d"), F.struct("*").alias("_l"))
    both = q.unionByName(t.withColumn("_l", F.lit(None).cast(q.schema["_l"].dataType)))
    seen = lambda *order: F.last("_d", ignorenulls=True).over(W.partitionBy("session").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    both = both.withColumn("_c", F.array(seen("_t", "_side"), seen(F.desc("_t"), "_side"))).filter("_side = 1")
    gap = lambda d: F.abs(d["ts"] - F.col("_t"))
    near = F.filter("_c", lambda d: d.isNotNull() & (gap(d) < tolerance))
    best = F.array_min(F.transform(near, lambda d: F.struct(gap(d).alias("gap"), d["ts"].alias("ts"), d["_p"].alias("p"))))["p"]
    return both.withColumn("_b", best).select("_l.*", F.col("_b.x").alias("px"), F.col("_b.y").alias("py"))


def mean_inside(left: DataFrame, trajectory: DataFrame, valid: Column, width: float = 10_000.0) -> DataFrame:
    """left with px, py averaged over the valid rows in [start, end). Both sides are dealt by (session, time bin of `width`), and
    a bin's sums are added up."""
    t = trajectory.filter(valid).select("session", F.floor(F.col("ts") / width).cast("long").alias("bin"), F.col("ts").alias("_t"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    spans = binned(left.filter(F.col("end") > F.col("start")).select("session", "seq", F.col("start").alias("_s"), F.col("end").alias("_e")), "_s", "_e", width)
    hit = spans.join(t, ["session", "bin"]).filter((F.col("_t") >= F.col("_s")) & (F.col("_t") < F.col("_e")))
    mean = hit.groupBy("session", "seq").agg(F.avg("_x").alias("px"), F.avg("_y").alias("py"))
    return left.join(mean, ["session", "seq"], "left").select(left["*"], "px", "py")


def cursor_positions(events: DataFrame, trajectory: DataFrame, valid: Column, tolerance: float, point: list[str], mean: list[str], width: float = 10_000.0) -> DataFrame:
    """px, py by kind of event: nearest at the start for `point` types, mean inside for `mean` types, null for others."""
    near = nearest_neighbours(events.filter(F.col("type").isin(point)), "start", trajectory, tolerance, valid)
    inside = mean_inside(events.filter(F.col("type").isin(mean)), trajectory, valid, width)
    none = F.lit(None).cast("double")
    rest = events.filter(~F.col("type").isin(*point, *mean)).withColumns({"px": none, "py": none})
    return near.unionByName(inside).unionByName(rest)


def first_overlap(left: DataFrame, right: DataFrame, value: str, width: float = 10_000.0) -> DataFrame:
    """left with the value of the first row of right, in its order, that overlaps it; found by time bins of `width`."""
    hit = interval_join(left.select("session", "seq", "start", "end"), right.select("session", "seq", "start", "end", value), width)
    best = hit.groupBy("session", F.col("l.seq").alias("seq")).agg(F.min_by(F.col("r")[value], F.struct("r.start", "r.seq")).alias(value))
    return left.join(best, ["session", "seq"], "left")


def upsert(coarse: DataFrame, fine: DataFrame, regions: DataFrame) -> DataFrame:
    """Coarse samples outside the regions with the fine ones inside."""
    return within_any(coarse, "ts", regions, "left_anti").unionByName(within_any(fine, "ts", regions))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Trajectories joined on equal times, the last of repeated times winning: distance and who detects."""
    last = lambda d, s: d.groupBy("session", "ts").agg(F.max_by(F.struct("x", "y", "detected"), "seq").alias(s))
    both = last(a, "a").join(last(b, "b"), ["session", "ts"])
    far = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    return both.select("session", "ts", F.col("a.detected").alias("in_a"), F.col("b.detected").alias("in_b"), F.when(F.col("a.detected") & F.col("b.detected"), far).alias("distance"))


#: Frames that a task of neighbours_context() sorts, some 100 bytes each; the number of tasks follows from it.
TASK_FRAMES = 500_000


def neighbours_context(segments: DataFrame, frames: DataFrame, n: int) -> DataFrame:
    """For each segment the last n frames of the one before and the first n of the one after: (session, index, side, ts).

    Frames are counted first and dealt by session to as many tasks as they need; left to themselves, shuffles that compress well
    are put together until a task sorts very many rows."""
    context = frames.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, -(-frames.count() // TASK_FRAMES))
    f = frames.select("session", "ts", "seq").repartition(tasks, "session").join(segments.repartition(tasks, "session"), "session")
    f = f.filter("ts >= start AND ts < end").select("session", "index", "ts", "seq")
    early = f.withColumn("k", F.row_number().over(ordered("ts", "seq", by=["session", "index"]))).filter(F.col("k") <= n)
    late = f.withColumn("k", F.row_number().over(W.partitionBy("session", "index").orderBy(F.desc("ts"), F.desc("seq")))).filter(F.col("k") <= n)
    known = segments.select("session", "index")
    before = late.select("session", (F.col("index") + 1).alias("index"), F.lit("before").alias("side"), "ts")
    after = early.select("session", (F.col("index") - 1).alias("index"), F.lit("after").alias("side"), "ts")
    return before.unionByName(after).join(known, ["session", "index"], "left_semi")


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys (key, value) that differ between two configurations or are in one only."""
    return a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), "key", "full").filter(~F.col("a").eqNullSafe(F.col("b")))

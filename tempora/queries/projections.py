"""Projection, union and gap-filling queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Change
from ..functions import expr
from ..operators import folds, joins, matching, moments, windows
from ..plans import stages
from ..sources import discovery
from .base import HOUR, E, I, intervals, read, rounded, timeline

QUERIES: dict = {}
ORACLE: dict = {}
H = HOUR


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query(
    f"""WITH {E}, {I} SELECT session, seq, start + session * 1000 AS start, coalesce(CASE WHEN seq % 4 > 0 THEN "end" END, start) + session * 1000 AS "end",
  CASE WHEN type IN ('click', 'view') THEN type ELSE 'change_ui_state' END AS type, coalesce(CASE WHEN seq % 5 > 0 THEN confidence END, 0.5) AS confidence FROM i"""
)
def clip_shift(spark, sf_dir):
    i = intervals(spark, sf_dir).withColumns(
        {"offset": F.col("session") * F.lit(1000.0), "end": F.when(F.col("seq") % 4 > 0, F.col("end")), "confidence": F.when(F.col("seq") % 5 > 0, F.col("confidence"))}
    )
    return stages.shifted(i, "offset", ["click", "view"]).select("session", "seq", "start", "end", "type", "confidence")


@query(
    f"""WITH {E}, g AS (SELECT session, seq, ts, type, CASE WHEN seq % 3 = 0 THEN 0 ELSE 1 END AS segment, (seq % 10)::INTEGER AS frame FROM e),
f AS (SELECT session, segment, frame, arg_max(ts, seq) AS ts, arg_max(type = 'view', seq) AS c FROM g GROUP BY ALL),
r AS (SELECT session, segment, seq, frame AS a, frame + (seq % 3)::INTEGER AS z FROM g WHERE type = 'click'),
j AS (SELECT r.session, r.segment, r.seq, x.ts AS start, y.ts AS "end", (SELECT bool_and(c) FROM f WHERE f.session = r.session AND f.segment = r.segment AND f.frame BETWEEN r.a AND r.z) AS all_context
  FROM r JOIN f x ON x.session = r.session AND x.segment = r.segment AND x.frame = r.a JOIN f y ON y.session = r.session AND y.segment = r.segment AND y.frame = r.z)
SELECT session, segment, seq, start, "end" FROM j WHERE NOT coalesce(all_context, false)"""
)
def frames_resolved(spark, sf_dir):
    t = timeline(spark, sf_dir).withColumns({"segment": F.when(F.col("seq") % 3 == 0, 0).otherwise(1), "frame": (F.col("seq") % 10).cast("int")})
    frames = t.select("session", "segment", "seq", "frame", "ts", (F.col("type") == "view").alias("is_context"))
    raw = t.filter("type = 'click'").select("session", "segment", "seq", F.col("frame").alias("first"), (F.col("frame") + (F.col("seq") % 3).cast("int")).alias("last"))
    return stages.resolved(raw, frames).select("session", "segment", "seq", "start", "end")


@query(f"""WITH {E}, {I} SELECT session, seq, round(start / 1000, 1) AS start_s, round("end" / 1000, 1) AS end_s, coalesce(CASE WHEN seq % 2 = 0 THEN confidence END, 0) AS confidence FROM i""")
def viewer_events(spark, sf_dir):
    i = intervals(spark, sf_dir)
    sure = F.coalesce(F.when(F.col("seq") % 2 == 0, F.col("confidence")), F.lit(0.0))
    return i.select("session", "seq", expr.rounded(F.col("start") / 1000, 1).alias("start_s"), expr.rounded(F.col("end") / 1000, 1).alias("end_s"), sure.alias("confidence"))


CATEGORY = "CASE type WHEN 'error' THEN 'scene_change' WHEN 'click' THEN 'interaction' WHEN 'view' THEN 'continuous' WHEN 'signup' THEN 'pre_scene_change' ELSE 'baseline' END"


def categories(spark, sf_dir):
    names = {"error": "scene_change", "click": "interaction", "view": "continuous", "signup": "pre_scene_change"}
    kind = F.lit("baseline")
    for k, v in names.items():
        kind = F.when(F.col("type") == k, v).otherwise(kind)
    return intervals(spark, sf_dir).withColumn("category", kind)


@query(
    f"""WITH {E}, {I}, m AS (SELECT *, {CATEGORY} AS category FROM i)
SELECT session, seq, CASE category WHEN 'scene_change' THEN "end" + 250 WHEN 'continuous' THEN start ELSE (start + "end") / 2 END AS "at" FROM m"""
)
def moment_times(spark, sf_dir):
    return categories(spark, sf_dir).select("session", "seq", moments.representative_time(F.col("category"), F.col("start"), F.col("end")).alias("at"))


@query(f"""WITH {E} SELECT session, seq, lag(seq) OVER o AS before, round(abs(x - lag(x) OVER o), 6) AS magnitude, ts - lag(ts) OVER o AS gap FROM e WINDOW o AS (PARTITION BY session ORDER BY ts, seq)""")
def adjacent_changes(spark, sf_dir):
    t = moments.beside_rows(timeline(spark, sf_dir), ["ts", "seq"], {"before": "seq", "_x": "x", "_ts": "ts"})
    return rounded(t.select("session", "seq", "before", F.abs(F.col("x") - F.col("_x")).alias("magnitude"), (F.col("ts") - F.col("_ts")).alias("gap")), magnitude=6)


@query(
    f"""WITH {E}, a AS (SELECT q.session, q.seq, arg_min({{'x': t.x, 'y': t.y}}, (abs(t.ts - q.ts), t.ts, t.seq)) AS d FROM e q JOIN e t ON t.session = q.session AND t.detected AND t.type = 'view' AND abs(t.ts - q.ts) < {24 * H} WHERE q.type = 'click' GROUP BY ALL),
b AS (SELECT q.session, q.seq, arg_min({{'x': t.x, 'y': t.y}}, (abs(t.ts - q.ts), t.ts, t.seq)) AS d FROM e q JOIN e t ON t.session = q.session AND t.detected AND t.type = 'error' AND abs(t.ts - q.ts) < {24 * H} WHERE q.type = 'click' GROUP BY ALL)
SELECT q.session, count(*) AS n, count(*) FILTER (WHERE a.d IS NOT NULL AND b.d IS NULL) AS lost, count(*) FILTER (WHERE a.d IS NULL AND b.d IS NOT NULL) AS gained,
  round(avg(sqrt((a.d.x - b.d.x) ** 2 + (a.d.y - b.d.y) ** 2)), 6) AS distance FROM e q LEFT JOIN a USING (session, seq) LEFT JOIN b USING (session, seq) WHERE q.type = 'click' GROUP BY q.session"""
)
def enrichment_comparison(spark, sf_dir):
    t = timeline(spark, sf_dir)
    q = t.filter("type = 'click'").select("session", "seq", "ts")
    a = joins.nearest_detected(q, "ts", t.filter("type = 'view'"), 24 * H).withColumnsRenamed({"px": "ax", "py": "ay"})
    both = joins.nearest_detected(a, "ts", t.filter("type = 'error'"), 24 * H)
    lost, gained = F.col("ax").isNotNull() & F.col("px").isNull(), F.col("ax").isNull() & F.col("px").isNotNull()
    far = F.sqrt(F.pow(F.col("ax") - F.col("px"), 2) + F.pow(F.col("ay") - F.col("py"), 2))
    return both.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.count_if(lost).alias("lost"), F.count_if(gained).alias("gained"), expr.rounded(F.avg(far), 6).alias("distance"))


@query(
    """SELECT c_custkey, c_nationkey, n_name, b.c_custkey IS NOT NULL AS has_baseline FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'F') b USING (c_custkey)"""
)
def session_dimension(spark, sf_dir):
    c, n, o = (read(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    done = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("_b")).distinct()
    both = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(done, "c_custkey", "left")
    return both.select("c_custkey", "c_nationkey", "n_name", F.col("_b").isNotNull().alias("has_baseline"))


@query("""SELECT user_id AS session, 'event' AS kind, event_id AS item, event_type AS label FROM events UNION ALL SELECT conv_id, 'speech', turn, role FROM conversations""")
def columns_union(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.lit("event").alias("kind"), F.col("event_id").alias("item"), F.col("event_type").alias("label"))
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.lit("speech").alias("kind"), F.col("turn").alias("item"), F.col("role").alias("label"))
    return e.unionByName(c, allowMissingColumns=True)


@query(
    f"""WITH {E}, o AS (SELECT session, ts - min(ts) OVER (PARTITION BY session) AS p FROM e), a AS (SELECT session, p FROM o UNION SELECT session, 0 FROM o UNION SELECT session, {720 * H} FROM o),
b AS (SELECT session, p AS s, lead(p) OVER (PARTITION BY session ORDER BY p) AS z FROM a), g AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY s) AS n FROM b WHERE z - s > {24 * H})
SELECT session, round((s + z) / 2, 3) AS at FROM g WHERE n * 258 <= 1000"""
)
def gap_fillers(spark, sf_dir):
    t = timeline(spark, sf_dir).withColumn("p", F.col("ts") - F.min("ts").over(W.partitionBy("session")))
    gaps = windows.gaps(t, F.lit(720 * H), "p", 24 * H).withColumn("left", F.lit(1000.0))
    return rounded(folds.fill_gaps(gaps, 258.0), at=3)


@query(
    f"""WITH {E}, {I}, m AS (SELECT *, {CATEGORY} AS category, (seq % 6 - 1)::INTEGER AS frames, seq % 5 > 0 AS has FROM i),
p AS (SELECT *, category IN ('interaction', 'pre_scene_change') AND has AS pair FROM m), n AS (SELECT *, CASE WHEN frames > 0 THEN frames WHEN pair THEN 2 ELSE 1 END AS n FROM p),
t AS (SELECT session, seq, CASE WHEN pair AND n <= 2 THEN [greatest(0, start - 250), "end" + 250]
  WHEN pair THEN list_concat(list_concat([greatest(0, start - 250)], list_transform(range(1, n - 1), lambda k: start + ("end" - start) * k / (n - 1))), ["end" + 250])
  WHEN n <= 1 OR "end" <= start THEN [(start + "end") / 2] ELSE list_transform(range(0, n), lambda k: start + ("end" - start) * k / (n - 1)) END AS times FROM n)
SELECT session, seq, unnest(range(0, len(times))) AS k, round(unnest(times), 2) AS at FROM t"""
)
def spread_frames(spark, sf_dir):
    """The times at which moments are seen, numbered."""
    times = moments.frame_times(F.col("category"), F.col("start"), F.col("end"), (F.col("seq") % 6 - 1).cast("int"), F.col("seq") % 5 > 0)
    m = categories(spark, sf_dir).select("session", "seq", F.posexplode(times).alias("k", "at"))
    return rounded(m.withColumn("k", F.col("k").cast("long")), at=2)


@query(
    """WITH d AS (SELECT source, doc_id, n_chars, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS before, text FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (WHERE text = before) AS identical, count(*) FILTER (WHERE before IS NOT NULL AND text <> before) AS changed FROM d GROUP BY source"""
)
def summary_changes(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("text"))  # only digests are sorted
    d = d.withColumn("before", F.lag("text").over(W.partitionBy("source").orderBy("doc_id")))
    same = F.col("text") == F.col("before")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("identical"), F.count_if(F.col("before").isNotNull() & ~same).alias("changed"))


@query(
    f"""WITH {E}, p AS (SELECT *, 400 + seq % 300 AS w, 300 + seq % 200 AS h FROM e), c AS (SELECT *, least(w / 1920::DOUBLE, h / 1080::DOUBLE) AS s FROM p),
v AS (SELECT *, floor(greatest(0, least(1920, (x * 4 - (10 + (w - 1920 * s) / 2)) / s)) + 0.5)::BIGINT AS px, floor(greatest(0, least(1080, (y * 4 - (20 + (h - 1080 * s) / 2)) / s)) + 0.5)::BIGINT AS py FROM c)
SELECT session, seq, px, py, floor(ts + 12.5 + 0.5)::BIGINT AS stored, CASE WHEN abs(px - 960) >= 5 AND abs(py - 540) >= 5 THEN least(px, 960) END AS box_x, CASE WHEN abs(px - 960) >= 5 AND abs(py - 540) >= 5 THEN abs(py - 540) END AS box_h FROM v"""
)
def native_coordinates(spark, sf_dir):
    """Points on players of many shapes in pixels of a 1920 x 1080 video, boxes from its middle to them, times on the stored clock."""
    t = timeline(spark, sf_dir)
    w, h = 400 + F.col("seq") % 300, 300 + F.col("seq") % 200
    t = t.withColumn("p", moments.native_point(F.col("x") * 4, F.col("y") * 4, F.lit(10), F.lit(20), w, h, 1920, 1080))
    t = t.withColumn("b", moments.drag_box(F.struct(F.lit(960).cast("long").alias("x"), F.lit(540).cast("long").alias("y")), F.col("p")))
    return t.select("session", "seq", F.col("p.x").alias("px"), F.col("p.y").alias("py"), moments.stored_ms(F.col("ts"), F.lit(12.5)).alias("stored"), F.col("b.x").alias("box_x"), F.col("b.h").alias("box_h"))


@query("""SELECT session, max(n) FILTER (WHERE ok)::INTEGER AS iteration FROM (SELECT user_id AS session, event_id % 23 AS n, event_id % 2 = 0 AS ok FROM events) GROUP BY session""")
def numbered_folders(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 23).cast("string")).otherwise("draft")
    return discovery.latest_iteration(e.select(F.col("user_id").alias("session"), name.alias("name")), "session", "name")


@query(
    f"""WITH {E}, {I}, h AS (SELECT session, count(*) AS n, round(avg("end" - start), 3) AS mean FROM i WHERE confidence >= 0.3 AND x >= 5 AND type IN ('click', 'view') GROUP BY session) SELECT * FROM h"""
)
def scroll_filter(spark, sf_dir):
    way = F.when(F.col("type") == "click", "N").when(F.col("type") == "view", "S").otherwise("E")
    i = intervals(spark, sf_dir).withColumns({"uniformity": F.col("confidence"), "magnitude": F.col("x"), "direction": way})
    kept = stages.scrolls(i, Change(flow_uniformity=0.3, flow_magnitude=5.0))
    return kept.groupBy("session").agg(F.count(F.lit(1)).alias("n"), expr.rounded(F.avg(F.col("end") - F.col("start")), 3).alias("mean"))


@query(f"""WITH {E}, p AS (SELECT session, x, y, lag(x) OVER o AS ax, lag(y) OVER o AS ay, lead(x) OVER o AS bx, lead(y) OVER o AS by_ FROM e WINDOW o AS (PARTITION BY session ORDER BY ts, seq))
SELECT session, round(sum(CASE WHEN sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) > 0 THEN abs((bx - ax) * (ay - y) - (ax - x) * (by_ - ay)) / sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) ELSE sqrt((x - ax) ** 2 + (y - ay) ** 2) END), 4) AS off_line FROM p WHERE ax IS NOT NULL AND bx IS NOT NULL GROUP BY session""")
def off_line(spark, sf_dir):
    w = windows.ordered("ts", "seq")
    t = timeline(spark, sf_dir).select("session", "x", "y", *(f(c).over(w).alias(n + c) for n, f in (("a", F.lag), ("b", F.lead)) for c in "xy")).filter("ax IS NOT NULL AND bx IS NOT NULL")
    d = expr.point_line(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return t.groupBy("session").agg(expr.rounded(F.sum(d), 4).alias("off_line"))


@query(
    f"""WITH {E}, {I}, p AS (SELECT a.session, a.seq AS b, z.seq AS e, a.start AS bs, CASE WHEN a.seq % 4 = 0 THEN 0 ELSE a."end" END AS be, z.start AS es, z."end" AS ee FROM i a JOIN i z ON z.session = a.session AND z.seq = a.seq)
SELECT session, round(avg(abs(bs - es)), 3) AS start_error, round(avg(CASE WHEN be <> 0 THEN abs(be - ee) END), 3) AS end_error FROM p GROUP BY session"""
)
def timing_errors(spark, sf_dir):
    i = intervals(spark, sf_dir)
    base = i.withColumn("end", F.when(F.col("seq") % 4 == 0, 0.0).otherwise(F.col("end")))
    pairs = i.select("session", F.col("seq").alias("b"), F.col("seq").alias("e"))
    return rounded(matching.timing_error(pairs, base, i), start_error=3, end_error=3)


@query(
    f"""WITH {E}, d AS (SELECT session, seq, x - lag(x) OVER o AS ax, y - lag(y) OVER o AS ay, lead(x) OVER o - x AS bx, lead(y) OVER o - y AS by_ FROM e WINDOW o AS (PARTITION BY session ORDER BY ts, seq)),
n AS (SELECT *, sqrt(ax * ax + ay * ay) AS a, sqrt(bx * bx + by_ * by_) AS b FROM d) SELECT session, seq,
  round(CASE WHEN a > 0.5 AND b > 0.5 THEN degrees(acos(greatest(-1, least(1, (ax * bx + ay * by_) / (a * b))))) END, 5) AS angle FROM n WHERE a IS NOT NULL AND b IS NOT NULL"""
)
def turning_angles(spark, sf_dir):
    w = windows.ordered("ts", "seq")
    step = [(F.col(c) - F.lag(c).over(w)).alias("a" + c) for c in "xy"] + [(F.lead(c).over(w) - F.col(c)).alias("b" + c) for c in "xy"]
    d = timeline(spark, sf_dir).select("session", "seq", *step).filter("ax IS NOT NULL AND bx IS NOT NULL")
    return d.select("session", "seq", expr.rounded(expr.turning_angle(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")), 5).alias("angle"))


@query(
    f"""WITH {E}, c AS (SELECT session, seq, type, y * 100 AS d, CASE WHEN type = 'view' THEN x END AS bw FROM e),
b AS (SELECT *, CASE WHEN type = 'click' OR (type = 'view' AND bw IS NOT NULL) THEN 2 ELSE 1 END AS base FROM c)
SELECT session, seq, CASE WHEN d <= 0 THEN base ELSE greatest(base, least(6, CASE WHEN base = 2 THEN 2 + greatest(0, floor(d / 1000) - 1) ELSE greatest(1, ceil(d / 1000)) END)) END::INTEGER AS frames FROM b"""
)
def ideal_frames(spark, sf_dir):
    t = timeline(spark, sf_dir)
    kind = F.when(F.col("type") == "click", "pre_scene_change").when(F.col("type") == "view", "interaction").otherwise("cursor_stop")
    box = F.when(F.col("type") == "view", F.col("x"))
    return t.select("session", "seq", expr.ideal_frames(kind, box, F.col("y") * 100, 1000.0, 6).alias("frames"))

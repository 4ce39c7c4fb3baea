"""Join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import joins as op
from ..operators import moments
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


def of(df, *types):
    return df.filter(F.col("type").isin(*types))


@query(f"""WITH {E}, {I} SELECT session, seq FROM i a WHERE type = 'view' AND NOT EXISTS (SELECT 1 FROM i b WHERE b.type IN ('click', 'purchase') AND a.session = b.session AND a.start < b."end" AND b.start < a."end")""")
def overlap_anti(spark, sf_dir):
    i = intervals(spark, sf_dir)
    return op.without_overlap(of(i, "view"), of(i, "click", "purchase"), part_ms=72 * H).select("session", "seq")


@query(f"""WITH {E}, {I} SELECT a.session, a.seq, b.seq AS other FROM i a JOIN i b ON a.session = b.session AND a.start < b."end" AND b.start < a."end" WHERE a.type = 'view' AND b.type = 'click'""")
def overlap_pairs(spark, sf_dir):
    i = intervals(spark, sf_dir)
    return op.interval_join(of(i, "view"), of(i, "click"), 12 * H).select("session", F.col("l.seq").alias("seq"), F.col("r.seq").alias("other"))


@query(
    f"""WITH {E}, {I}, j AS (SELECT a.session, a.seq, arg_min(b.type, (b.start, b.seq)) AS category FROM i a JOIN i b ON a.session = b.session AND a.start < b."end" AND b.start < a."end"
  WHERE a.type = 'view' AND b.type IN ('click', 'error') GROUP BY a.session, a.seq) SELECT a.session, a.seq, j.category FROM i a LEFT JOIN j USING (session, seq) WHERE a.type = 'view'"""
)
def first_overlap(spark, sf_dir):
    i = intervals(spark, sf_dir)
    right = of(i, "click", "error").withColumn("category", F.col("type"))
    return op.first_overlap(of(i, "view"), right, "category", 6 * H).select("session", "seq", "category")


@query(f"""WITH {E} SELECT session, seq FROM e a WHERE type = 'view' AND EXISTS (SELECT 1 FROM e b WHERE b.type = 'purchase' AND a.session = b.session AND b.ts - a.ts > 0 AND b.ts - a.ts < {24 * H})""")
def followed_by(spark, sf_dir):
    t = timeline(spark, sf_dir).withColumns({"start": F.col("ts"), "end": F.col("ts")})
    return op.followed(of(t, "view"), of(t, "purchase"), 24 * H).select("session", "seq")


@query(f"""WITH {E}, {I} SELECT session, seq FROM i a WHERE type = 'click' AND NOT EXISTS (SELECT 1 FROM i b WHERE b.type = 'view' AND a.session = b.session AND b.start <= a.start AND b."end" >= a."end")""")
def contained_anti(spark, sf_dir):
    i = intervals(spark, sf_dir)
    return op.not_contained(of(i, "click"), of(i, "view")).select("session", "seq")


@query(f"""WITH {E}, {I} SELECT session, seq FROM e a WHERE type = 'error' AND EXISTS (SELECT 1 FROM i b WHERE b.type = 'view' AND a.session = b.session AND a.ts >= b.start AND a.ts <= b."end")""")
def range_exists_semi(spark, sf_dir):
    return op.within_any(of(timeline(spark, sf_dir), "error"), "ts", of(intervals(spark, sf_dir), "view")).select("session", "seq")


@query(f"""WITH {E} SELECT a.session, a.seq, b.x AS value FROM (SELECT * FROM e WHERE type = 'click') a ASOF LEFT JOIN (SELECT * FROM e WHERE type = 'view') b ON a.session = b.session AND a.ts >= b.ts""")
def asof_back(spark, sf_dir):
    t = timeline(spark, sf_dir)
    views = of(t, "view").withColumn("value", F.col("x"))
    return op.backward_asof(of(t, "click"), "ts", views, "ts", "value", part_ms=72 * H).select("session", "seq", "value")


@query(
    f"""WITH {E}, t AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, seq) AS rn FROM e WHERE type <> 'click'),
q AS (SELECT c.session, c.seq, c.ts, (SELECT count(*) FROM t WHERE t.session = c.session AND t.ts < c.ts) AS c FROM e c WHERE type = 'click'),
j AS (SELECT q.session, q.seq, arg_min({{'x': t.x, 'y': t.y}}, (abs(t.ts - q.ts), t.rn)) AS d FROM q JOIN t ON t.session = q.session AND t.rn BETWEEN q.c AND q.c + 2
  WHERE (t.detected AND t.y >= 30) AND abs(t.ts - q.ts) < {12 * H} GROUP BY q.session, q.seq)
SELECT q.session, q.seq, d.x AS px, d.y AS py FROM q LEFT JOIN j USING (session, seq)"""
)
def nearest_neighbour3(spark, sf_dir):
    t = timeline(spark, sf_dir)
    ok = F.col("detected") & (F.col("y") >= 30)
    return op.nearest_neighbours(of(t, "click"), "ts", t.filter("type <> 'click'"), 12 * H, ok).select("session", "seq", "px", "py")


NEAREST = f"""SELECT q.session, q.seq, arg_min({{'x': t.x, 'y': t.y}}, (abs(t.ts - q.ts), t.ts, t.seq)) AS d FROM e q JOIN e t ON t.session = q.session AND t.detected AND abs(t.ts - q.ts) < {12 * H}
  WHERE q.type = 'click' AND t.type <> 'click' GROUP BY q.session, q.seq"""


@query(f"""WITH {E}, j AS ({NEAREST}) SELECT q.session, q.seq, d.x AS px, d.y AS py FROM e q LEFT JOIN j USING (session, seq) WHERE q.type = 'click'""")
def nearest_full(spark, sf_dir):
    t = timeline(spark, sf_dir)
    return op.nearest_detected(of(t, "click"), "ts", t.filter("type <> 'click'"), 12 * H).select("session", "seq", "px", "py")


@query(
    f"""WITH {E}, {I}, j AS (SELECT q.session, q.seq, avg(t.x) AS px, avg(t.y) AS py FROM i q JOIN e t ON t.session = q.session AND t.ts >= q.start AND t.ts < q."end" AND (t.detected OR t.confidence > 0)
  WHERE q.type = 'error' GROUP BY q.session, q.seq)
SELECT q.session, q.seq, round(px, 6) AS px, round(py, 6) AS py FROM i q LEFT JOIN j USING (session, seq) WHERE q.type = 'error'"""
)
def mean_inside(spark, sf_dir):
    found = op.mean_inside(of(intervals(spark, sf_dir), "error"), timeline(spark, sf_dir), expr.valid(), 6 * H)
    return rounded(found.select("session", "seq", "px", "py"), px=6, py=6)


@query(
    f"""WITH {E}, {I}, n AS (SELECT q.session, q.seq, arg_min({{'x': t.x, 'y': t.y}}, (abs(t.ts - q.start), t.rn)) AS d FROM
  (SELECT *, (SELECT count(*) FROM e t WHERE t.session = i.session AND t.ts < i.start) AS c FROM i WHERE type IN ('click', 'view')) q
  JOIN (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, seq) AS rn FROM e) t ON t.session = q.session AND t.rn BETWEEN q.c AND q.c + 2
  WHERE (t.detected OR t.confidence > 0) AND abs(t.ts - q.start) < {6 * H} GROUP BY q.session, q.seq),
m AS (SELECT q.session, q.seq, avg(t.x) AS px, avg(t.y) AS py FROM i q JOIN e t ON t.session = q.session AND t.ts >= q.start AND t.ts < q."end" AND (t.detected OR t.confidence > 0) WHERE q.type = 'error' GROUP BY q.session, q.seq)
SELECT i.session, i.seq, i.type, round(CASE WHEN type = 'error' THEN m.px ELSE n.d.x END, 6) AS px, round(CASE WHEN type = 'error' THEN m.py ELSE n.d.y END, 6) AS py
FROM i LEFT JOIN n USING (session, seq) LEFT JOIN m USING (session, seq)"""
)
def cursor_positions(spark, sf_dir):
    i, t = intervals(spark, sf_dir).drop("x", "y", "confidence"), timeline(spark, sf_dir)
    found = op.cursor_positions(i, t, expr.valid(), 6 * H, ["click", "view"], ["error"], 6 * H)
    return rounded(found.select("session", "seq", "type", "px", "py"), px=6, py=6)


@query(
    f"""WITH {E}, {I}, r AS (SELECT * FROM i WHERE type = 'view')
SELECT session, seq, 'coarse' AS grid FROM e a WHERE seq % 3 = 0 AND NOT EXISTS (SELECT 1 FROM r WHERE r.session = a.session AND a.ts BETWEEN r.start AND r."end")
UNION ALL SELECT session, seq, 'fine' FROM e a WHERE seq % 3 <> 0 AND EXISTS (SELECT 1 FROM r WHERE r.session = a.session AND a.ts BETWEEN r.start AND r."end")"""
)
def sample_upsert(spark, sf_dir):
    t = timeline(spark, sf_dir)
    regions = of(intervals(spark, sf_dir), "view")
    coarse = t.filter("seq % 3 = 0").withColumn("grid", F.lit("coarse"))
    return op.upsert(coarse, t.filter("seq % 3 <> 0").withColumn("grid", F.lit("fine")), regions).select("session", "seq", "grid")


@query(
    f"""WITH {E}, b AS (SELECT session, ts, x + seq % 4 AS x, y, y >= 20 AS detected FROM e WHERE seq % 5 <> 0)
SELECT session, ts, a.detected AS in_a, b.detected AS in_b, round(CASE WHEN a.detected AND b.detected THEN sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) END, 6) AS distance FROM e a JOIN b USING (session, ts)"""
)
def trajectory_agreement(spark, sf_dir):
    t = timeline(spark, sf_dir)
    other = t.filter("seq % 5 <> 0").withColumn("x", F.col("x") + F.col("seq") % 4).withColumn("detected", F.col("y") >= 20)
    return rounded(op.agreement(t, other), distance=6)


@query(
    f"""WITH {E}, s AS (SELECT session, unnest(range(0, 8))::INTEGER AS index, min(ts) + unnest(range(0, 8)) * {90 * H} AS start, min(ts) + (unnest(range(0, 8)) + 1) * {90 * H} AS "end" FROM e GROUP BY session),
f AS (SELECT session, index, ts, row_number() OVER (PARTITION BY session, index ORDER BY ts, seq) AS a, row_number() OVER (PARTITION BY session, index ORDER BY ts DESC, seq DESC) AS z
  FROM e JOIN s USING (session) WHERE ts >= start AND ts < "end")
SELECT session, index + 1 AS index, 'before' AS side, ts FROM f WHERE z <= 2 AND index < 7 UNION ALL SELECT session, index - 1, 'after', ts FROM f WHERE a <= 2 AND index > 0"""
)
def context_frames(spark, sf_dir):
    t = timeline(spark, sf_dir)
    s = t.groupBy("session").agg(F.min("ts").alias("first")).withColumn("index", F.explode(F.sequence(F.lit(0), F.lit(7))))
    s = s.select("session", "index", (F.col("first") + F.col("index") * (90 * H)).alias("start"), (F.col("first") + (F.col("index") + 1) * (90 * H)).alias("end"))
    return op.neighbours_context(s, t, 2)


@query(f"""WITH {E} SELECT session, seq, lag(seq) OVER o AS previous, lead(seq) OVER o AS next FROM e WINDOW o AS (PARTITION BY session ORDER BY ts, seq)""")
def adjacent_rows(spark, sf_dir):
    t = moments.beside_rows(timeline(spark, sf_dir), ["ts", "seq"], {"previous": "seq"}, {"next": "seq"})
    return t.select("session", "seq", "previous", "next")


@query(
    """WITH a AS (SELECT user_id || '/' || event_type AS key, count(*) AS a FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id || '/' || event_type AS key, count(*) AS b FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT key, a, b FROM a FULL JOIN b USING (key) WHERE a IS DISTINCT FROM b"""
)
def config_diff(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("key", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    side = lambda r: e.filter(F.col("event_id") % 2 == r).groupBy("key").agg(F.count(F.lit(1)).alias("value"))
    return op.config_diff(side(0), side(1)).select("key", "a", "b")


@query(f"""WITH {E} SELECT session FROM e WHERE type = 'purchase' AND x > 100 INTERSECT SELECT session FROM e WHERE type = 'error' AND x > 100""")
def sessions_in_both(spark, sf_dir):
    t = timeline(spark, sf_dir).filter("x > 100")
    return of(t, "purchase").select("session").intersect(of(t, "error").select("session"))


@query(f"""WITH {E} SELECT session FROM e WHERE type = 'purchase' EXCEPT SELECT session FROM e WHERE type = 'error' AND x > 150""")
def unknown_sessions(spark, sf_dir):
    t = timeline(spark, sf_dir)
    return of(t, "purchase").select("session").subtract(of(t, "error").filter("x > 150").select("session"))


@query("""SELECT DISTINCT t FROM (SELECT event_type AS t FROM events UNION ALL SELECT role FROM conversations)""")
def types_of_both(spark, sf_dir):
    e, c = read(spark, sf_dir, "events"), read(spark, sf_dir, "conversations")
    return e.select(F.col("event_type").alias("t")).union(c.select("role")).distinct()


@query(
    f"""WITH {E}, g AS (SELECT session, min(ts) + unnest(range(0, 10)) * {70 * H} AS target FROM e GROUP BY session),
f AS (SELECT session, ts, seq FROM e), c AS (SELECT g.session, target, arg_min(f.ts, (abs(f.ts - target), f.ts)) AS frame FROM g JOIN f USING (session) GROUP BY g.session, target)
SELECT session, target, frame FROM c"""
)
def nearest_frames(spark, sf_dir):
    t = timeline(spark, sf_dir)
    g = t.groupBy("session").agg(F.min("ts").alias("first")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).select("session", F.col("k").cast("long").alias("seq"), (F.col("first") + F.col("k") * (70 * H)).alias("target"))
    # The last frame at or before a target and the first after it; a target past the end keeps the last frame.
    before = op.backward_asof(g, "target", t.withColumn("prev", F.col("ts")), "ts", "prev")
    later = t.select("session", (-F.col("ts")).alias("ts"), "seq", F.col("ts").alias("next"))
    both = op.backward_asof(before.withColumn("_neg", -F.col("target")), "_neg", later, "ts", "next")
    near = F.when(F.col("prev").isNull() | (F.col("next") - F.col("target") < F.col("target") - F.col("prev")), F.col("next")).otherwise(F.col("prev"))
    return both.select("session", "target", near.alias("frame"))

"""Queries of pointer tracking: which match of a frame counts, a fine pass where a coarse one found moves, frames worth a look.

Four events of a user in a row are the matches of a frame, or each event is a frame of its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Frames, Trajectory
from ..operators import tracking as op
from ..operators.windows import ordered
from ..plans import observe
from .base import HOUR, E, read, rounded, timeline

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


M = f"""{E}, a AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, seq) - 1 AS place FROM e),
m AS (SELECT session, place // 4 AS frame, seq AS k, type, x, y, confidence, detected FROM a),
fr AS (SELECT session, place // 4 AS frame, min(ts) AS ts FROM a GROUP BY ALL)"""


def matched(spark, sf_dir):
    """(frames, matches): a frame has the detected ones of four events as matches."""
    place = F.row_number().over(ordered("ts", "seq")) - 1
    t = timeline(spark, sf_dir).withColumn("frame", F.floor(place / 4))
    frames = t.groupBy("session", "frame").agg(F.min("ts").alias("ts")).withColumnRenamed("frame", "seq")
    matches = t.filter("detected").select("session", F.col("frame").alias("seq"), F.col("seq").alias("k"), F.col("type").alias("template"), "x", "y", "confidence")
    return frames, matches


@query(
    f"""WITH RECURSIVE {M}, v AS (SELECT * FROM m WHERE detected AND confidence > 0.3),
b AS (SELECT session, frame, max(confidence) AS best, arg_max(k, row(confidence, -k)) AS first FROM v GROUP BY session, frame),
c AS (SELECT v.*, row_number() OVER (PARTITION BY session, frame ORDER BY confidence DESC, k) AS rn FROM v JOIN b USING (session, frame) WHERE CASE WHEN best >= 0.7 THEN k = first ELSE confidence >= best - 0.3 END),
r AS (SELECT session, frame, rn, k, x, y, confidence, true AS keep, [{{'x': x, 'y': y}}] AS had FROM c WHERE rn = 1
  UNION ALL SELECT c.session, c.frame, c.rn, c.k, c.x, c.y, c.confidence, far, CASE WHEN far THEN list_append(had, {{'x': c.x, 'y': c.y}}) ELSE had END
  FROM r JOIN c ON c.session = r.session AND c.frame = r.frame AND c.rn = r.rn + 1,
  LATERAL (SELECT len(list_filter(had, lambda p: sqrt((c.x - p.x) ** 2 + (c.y - p.y) ** 2) < 40)) = 0 AS far))
SELECT session, frame AS seq, k, x, y, confidence FROM r WHERE keep"""
)
def distinct_candidates(spark, sf_dir):
    return op.distinct_candidates(matched(spark, sf_dir)[1], 0.3, 0.3, 0.7, 40.0)


WON = """w AS (SELECT session, frame, type, CASE WHEN count(*) FILTER (WHERE confidence >= 0.6) > 0 THEN min(k) FILTER (WHERE confidence >= 0.6) ELSE arg_max(k, row(confidence, -k)) END AS k
  FROM m WHERE detected AND confidence > 0.3 GROUP BY ALL),
u AS (SELECT session, frame, CASE WHEN count(*) FILTER (WHERE confidence >= 0.6) > 0 THEN min(k) FILTER (WHERE confidence >= 0.6) ELSE arg_max(k, row(confidence, -k)) END AS k
  FROM m WHERE detected AND confidence > 0.3 GROUP BY ALL)"""


@query(f"""WITH {M}, {WON} SELECT session, frame AS seq, k, type AS template, x, y, confidence FROM u JOIN m USING (session, frame, k)""")
def first_or_best(spark, sf_dir):
    return op.first_or_best(matched(spark, sf_dir)[1], 0.3, 0.6)


@query(
    f"""WITH RECURSIVE {M}, {WON},
s AS (SELECT session, -1::BIGINT AS frame, NULL::BIGINT AS k, NULL::VARCHAR AS last FROM fr GROUP BY session
  UNION ALL SELECT fr.session, fr.frame, coalesce(w.k, u.k), coalesce(w.type, z.type)
  FROM s JOIN fr ON fr.session = s.session AND fr.frame = s.frame + 1
  LEFT JOIN w ON w.session = fr.session AND w.frame = fr.frame AND w.type = s.last
  LEFT JOIN u ON u.session = fr.session AND u.frame = fr.frame LEFT JOIN m z ON z.session = u.session AND z.frame = u.frame AND z.k = u.k)
SELECT s.session, s.frame AS seq, fr.ts, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(confidence, 0) AS confidence, coalesce(last, '') AS template, last IS NOT NULL AS detected
FROM s JOIN fr USING (session, frame) LEFT JOIN m ON m.session = s.session AND m.frame = s.frame AND m.k = s.k"""
)
def sticky_matches(spark, sf_dir):
    return op.sticky_matches(*matched(spark, sf_dir), 0.3, 0.6)


@query(
    f"""WITH RECURSIVE {M}, c AS (SELECT *, round_even(x / 20, 0) AS cx, round_even(y / 20, 0) AS cy FROM m JOIN fr USING (session, frame) WHERE detected),
p AS (SELECT session, cx, cy, 1 + count(*) FILTER (WHERE apart) AS clusters FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY session, cx, cy ORDER BY ts, frame) > {100 * H} AS apart FROM c) GROUP BY ALL),
h AS (SELECT session, frame, count(*) AS n, min(k) AS k FROM c GROUP BY ALL),
o AS (SELECT fr.*, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN {{'t': fr.ts, 'x': round_even(c.x * 2, 0), 'y': round_even(c.y * 2, 0)}} END AS d, c.confidence, c.type
  FROM fr LEFT JOIN h USING (session, frame) LEFT JOIN c ON c.session = h.session AND c.frame = h.frame AND c.k = h.k),
l AS (SELECT *, first_value(d IGNORE NULLS) OVER (PARTITION BY session ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM o),
f AS (SELECT session, seq, ts AS start, ts + y * 720000 AS "end", x / 20 AS magnitude, confidence AS uniformity, ['N', 'SE', 'W', 'x'][(seq % 4) + 1] AS direction FROM e WHERE seq % 3 = 0),
v AS (SELECT l.session, l.frame, arg_min({{'m': magnitude, 'u': uniformity, 'd': direction}}, row(f.start, f.seq)) AS flow FROM l JOIN f ON f.session = l.session AND f.start <= l.ts AND l.ts <= f."end" WHERE n > 1 GROUP BY ALL),
q AS (SELECT l.*, v.flow FROM l LEFT JOIN v USING (session, frame)),
s AS (SELECT session, -1::BIGINT AS frame, NULL::STRUCT(t DOUBLE, x DOUBLE, y DOUBLE) AS prev, NULL::BIGINT AS k FROM fr GROUP BY session
  UNION ALL SELECT q.session, q.frame, coalesce(CASE WHEN n = 1 THEN q.d WHEN n > 1 THEN {{'t': q.ts, 'x': round_even(w.x * 2, 0), 'y': round_even(w.y * 2, 0)}} END, s.prev), w.k
  FROM s JOIN q ON q.session = s.session AND q.frame = s.frame + 1 LEFT JOIN LATERAL (
    SELECT k, x, y FROM (
      SELECT c.k, c.x, c.y, c.confidence + CASE WHEN ex IS NULL THEN 0 WHEN away < 20 THEN 0.03 WHEN away < 100 THEN 0.03::DOUBLE * (1 - (away - 20) / 80) ELSE -0.02 END
        - CASE WHEN s.prev IS NOT NULL AND q.flow.m >= 3 AND q.flow.u >= 0.6 AND size > 1 THEN 0.03::DOUBLE * greatest(0, (mx / size) * ux + (my / size) * uy) * (least(q.flow.m / 3, 1) * q.flow.u) ELSE 0 END
        - CASE WHEN clusters > 2 THEN 0.02::DOUBLE * least((clusters - 2) / 5::DOUBLE, 1) ELSE 0 END AS score
      FROM c JOIN p USING (session, cx, cy),
      LATERAL (SELECT CASE WHEN s.prev IS NOT NULL AND q.nxt IS NOT NULL THEN s.prev.x + (q.nxt.x - s.prev.x) * ((q.ts - s.prev.t) / (q.nxt.t - s.prev.t)) ELSE coalesce(s.prev.x, q.nxt.x) END / 2 AS ex,
        CASE WHEN s.prev IS NOT NULL AND q.nxt IS NOT NULL THEN s.prev.y + (q.nxt.y - s.prev.y) * ((q.ts - s.prev.t) / (q.nxt.t - s.prev.t)) ELSE coalesce(s.prev.y, q.nxt.y) END / 2 AS ey,
        c.x * 2 - s.prev.x AS mx, c.y * 2 - s.prev.y AS my, sqrt((c.x * 2 - s.prev.x) ** 2 + (c.y * 2 - s.prev.y) ** 2) AS size,
        CASE q.flow.d WHEN 'SE' THEN 0.707 WHEN 'W' THEN -1 ELSE 0 END AS ux, CASE q.flow.d WHEN 'N' THEN -1 WHEN 'SE' THEN 0.707 ELSE 0 END AS uy),
      LATERAL (SELECT sqrt((c.x - ex) ** 2 + (c.y - ey) ** 2) AS away)
      WHERE c.session = q.session AND c.frame = q.frame AND q.n > 1)
    ORDER BY score DESC, k LIMIT 1) w ON true)
SELECT o.session, o.frame AS seq, o.ts, coalesce(round_even(c.x * 2, 0), o.d.x, 0) AS x, coalesce(round_even(c.y * 2, 0), o.d.y, 0) AS y,
  coalesce(c.confidence, CASE WHEN n = 1 THEN o.confidence END, 0) AS confidence, coalesce(c.type, CASE WHEN n = 1 THEN o.type END, '') AS template, n > 0 AS detected
FROM o JOIN s USING (session, frame) LEFT JOIN c ON c.session = s.session AND c.frame = s.frame AND c.k = s.k"""
)
def resolved_candidates(spark, sf_dir):
    t = timeline(spark, sf_dir).filter("seq % 3 = 0")
    names = F.element_at(F.array(*map(F.lit, ("N", "SE", "W", "x"))), (F.col("seq") % 4 + 1).cast("int"))
    flows = t.select("session", "seq", F.col("ts").alias("start"), (F.col("ts") + F.col("y") * 720000).alias("end"), (F.col("x") / 20).alias("magnitude"), F.col("confidence").alias("uniformity"), names.alias("direction"))
    return op.resolved_candidates(*matched(spark, sf_dir), flows, 2.0, 20.0, 100 * H, 2, 10 * H)


def _sampled(rows: str, by: str, interval: float, out: str) -> str:
    """Of `rows` the first of each group of `by`, then each first one at least `interval` after the one taken before."""
    keys = ", ".join(f"n.{c}" for c in by.split(", "))
    same = " AND ".join(f"n.{c} = r.{c}" for c in by.split(", "))
    return f"""{out}n AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ts, seq) AS rn FROM {rows}),
{out}r AS (SELECT {by}, rn, seq, ts + {interval} AS nxt, true AS keep FROM {out}n WHERE rn = 1
  UNION ALL SELECT {keys}, n.rn, n.seq, CASE WHEN n.ts >= r.nxt THEN n.ts + {interval} ELSE r.nxt END, n.ts >= r.nxt FROM {out}r r JOIN {out}n n ON {same} AND n.rn = r.rn + 1),
{out} AS (SELECT n.* EXCLUDE (rn) FROM {out}n n JOIN {out}r r ON {same} AND n.rn = r.rn WHERE r.keep)"""


TWO_PASS = Trajectory(displacement_px=60.0, padding_ms=12 * H, max_gap_ms=30 * H, smooth_window=3, smooth_px=120.0)


@query(
    f"""WITH RECURSIVE {E}, {_sampled("e", "session", 40 * H, "coarse")},
d AS (SELECT *, lag(ts) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py FROM coarse WHERE detected WINDOW w AS (PARTITION BY session ORDER BY ts, seq)),
v AS (SELECT session, seq, greatest(0, pt - {12 * H}) AS start, ts + {12 * H} AS "end" FROM d WHERE sqrt((x - px) ** 2 + (y - py) ** 2) > 60),
i AS (SELECT *, sum(coalesce((start > before)::INT, 0)) OVER (PARTITION BY session ORDER BY start, seq) AS island
  FROM (SELECT *, max("end") OVER (PARTITION BY session ORDER BY start, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v)),
g AS (SELECT session, island, min(start) AS start, max("end") AS "end" FROM i GROUP BY ALL),
inside AS (SELECT e.*, island FROM e JOIN g ON g.session = e.session AND ts BETWEEN start AND "end"),
{_sampled("inside", "session, island", 10 * H, "fine")},
u AS (SELECT * FROM coarse WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.session = coarse.session AND ts BETWEEN start AND "end") UNION ALL SELECT * EXCLUDE (island) FROM fine),
p AS (SELECT *, CASE WHEN detected THEN {{'ts': ts, 'x': x, 'y': y, 'c': confidence}} END AS d FROM u),
b AS (SELECT *, last_value(d IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
  first_value(d IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS z FROM p),
f AS (SELECT session, seq, ts, detected, CASE WHEN fill THEN a.x + (z.x - a.x) * ((ts - a.ts) / (z.ts - a.ts)) ELSE x END AS x, CASE WHEN fill THEN a.y + (z.y - a.y) * ((ts - a.ts) / (z.ts - a.ts)) ELSE y END AS y,
  CASE WHEN fill THEN least(a.c, z.c) / 2 ELSE confidence END AS confidence, row_number() OVER (PARTITION BY session ORDER BY ts, seq) AS rn
  FROM b, LATERAL (SELECT NOT detected AND coalesce(z.ts - a.ts <= {30 * H} AND z.ts > a.ts, false) AS fill)),
c AS (SELECT session, max(rn) AS last FROM f GROUP BY session),
k AS (SELECT *, detected OR confidence > 0 AS ok FROM f),
s AS (SELECT session, seq, rn, x, y FROM k WHERE rn = 1
  UNION ALL SELECT n.session, n.seq, n.rn, CASE WHEN t THEN list_avg(list_filter([CASE WHEN pr.ok THEN r.x END, n.x, CASE WHEN nx.ok THEN nx.x END], lambda q: q IS NOT NULL)) ELSE n.x END,
    CASE WHEN t THEN list_avg(list_filter([CASE WHEN pr.ok THEN r.y END, n.y, CASE WHEN nx.ok THEN nx.y END], lambda q: q IS NOT NULL)) ELSE n.y END
  FROM s r JOIN k n ON n.session = r.session AND n.rn = r.rn + 1 JOIN k pr ON pr.session = r.session AND pr.rn = r.rn JOIN c ON c.session = n.session LEFT JOIN k nx ON nx.session = n.session AND nx.rn = n.rn + 1,
  LATERAL (SELECT n.ok AND n.rn < c.last AND coalesce(sqrt((abs(n.x - r.x) + abs(nx.x - n.x)) ** 2 + (abs(n.y - r.y) + abs(nx.y - n.y)) ** 2) <= 120, false) AS t))
SELECT session, seq, round(s.x, 6) AS x, round(s.y, 6) AS y, round(confidence, 9) AS confidence, detected FROM s JOIN f USING (session, seq)"""
)
def two_pass_tracking(spark, sf_dir):
    def scan(first, last):
        events = read(spark, sf_dir, "events")
        if first is not None:  # on the stored column, a second wider than the bounds, so that the scan can skip row groups
            at = lambda ms: F.timestamp_seconds(F.lit(ms / 1000.0)).cast(events.schema["ts"].dataType)
            events = events.filter(F.col("ts").between(at(first - 1000), at(last + 1000)))
        return timeline(spark, sf_dir, events)

    made = observe.two_pass(scan, lambda frames: frames.drop("type"), 40 * H, 10 * H, TWO_PASS)
    return rounded(made.select("session", "seq", "x", "y", "confidence", "detected"), x=6, y=6, confidence=9)


FRAMES = Frames(scan_gap_ms=20 * H, change=60.0, baseline_gap_ms=30 * H, dedup_ms=3 * H, lookup_ms=8 * H)


@query(
    f"""WITH RECURSIVE {E}, o AS (SELECT session, min(ts) AS first FROM e GROUP BY session),
t AS (SELECT session, seq, ts - first AS ts, type, x, y, detected FROM e JOIN o USING (session)),
u AS (SELECT session, {720 * H} AS duration FROM o),
v AS (SELECT session, seq, CASE type WHEN 'view' THEN 'dwell' WHEN 'purchase' THEN 'scroll' ELSE type END AS type, ts AS start, ts + y * 360000 AS "end" FROM t WHERE seq % 5 = 0),
s AS (SELECT session, seq AS event, type, CASE reason WHEN 'event_start' THEN start WHEN 'event_end' THEN "end" ELSE (start + "end") / 2 END AS ts, reason, 0 AS priority,
    CASE reason WHEN 'event_start' THEN 0 WHEN 'event_end' THEN 1 ELSE 2 END AS place
  FROM (SELECT *, unnest(CASE WHEN type = 'dwell' THEN ['event_mid'] ELSE ['event_start', 'event_end'] END) AS reason FROM v)),
q AS (SELECT session, ts FROM s UNION SELECT session, 0 FROM u UNION SELECT session, duration FROM u),
h AS (SELECT session, ts AS a, lead(ts) OVER (PARTITION BY session ORDER BY ts) AS z FROM q),
d AS (SELECT session, ts AS a, lead(ts) OVER (PARTITION BY session ORDER BY ts, seq) AS b, x AS magnitude FROM t WHERE seq % 5 <> 0),
c AS (SELECT d.session, NULL::BIGINT AS event, NULL AS type, unnest([d.a, d.b]) AS ts, 'visual_change' AS reason, 1 AS priority, 3 AS place FROM d JOIN h ON h.session = d.session AND d.a >= h.a AND d.b <= h.z AND h.z - h.a > {20 * H} WHERE magnitude > 60),
w AS (SELECT * FROM s UNION ALL SELECT * FROM c),
j AS (SELECT session, ts FROM w UNION SELECT session, 0 FROM u UNION SELECT session, duration FROM u),
g AS (SELECT session, ts AS a, lead(ts) OVER (PARTITION BY session ORDER BY ts) AS z FROM j),
k AS (SELECT * FROM w UNION ALL SELECT session, NULL, NULL, (a + z) / 2, 'baseline', 2, 4 FROM g WHERE z - a > {30 * H}),
n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, priority, coalesce(event, 0), place) AS rn FROM k),
r AS (SELECT session, rn, rn AS kept, ts AS kts, priority AS kp, 1 AS slot FROM n WHERE rn = 1
  UNION ALL SELECT n.session, n.rn, CASE WHEN new OR n.priority < r.kp THEN n.rn ELSE r.kept END, CASE WHEN new OR n.priority < r.kp THEN n.ts ELSE r.kts END,
    CASE WHEN new OR n.priority < r.kp THEN n.priority ELSE r.kp END, CASE WHEN new THEN r.slot + 1 ELSE r.slot END
  FROM r JOIN n ON n.session = r.session AND n.rn = r.rn + 1, LATERAL (SELECT n.ts - r.kts > {3 * H} AS new)),
f AS (SELECT session, arg_max(kept, rn) AS rn FROM r GROUP BY session, slot),
z AS (SELECT n.session, n.rn, arg_min({{'x': floor(t.x * 10)::INT, 'y': (t.y * 8)::INT}}, row(abs(t.ts - n.ts), t.ts, t.seq)) AS near FROM f JOIN n USING (session, rn) JOIN t ON t.session = n.session AND t.detected AND abs(t.ts - n.ts) < {8 * H} GROUP BY ALL),
p AS (SELECT n.*, CASE WHEN event IS NOT NULL AND type <> 'scroll' THEN true ELSE false END AS own, z.near FROM f JOIN n USING (session, rn) LEFT JOIN z USING (session, rn))
SELECT session, rn AS seq, round(ts, 3) AS ts, reason, event, CASE WHEN own THEN CASE WHEN near IS NULL THEN 768 ELSE greatest(0, least(near.x - 192, 1920 - 384)) END END::INT AS rx,
  CASE WHEN own THEN CASE WHEN near IS NULL THEN 348 ELSE greatest(0, least(near.y - 192, 1080 - 384)) END END::INT AS ry, CASE WHEN own THEN 384 END AS rw, CASE WHEN own THEN 384 END AS rh FROM p"""
)
def selected_frames(spark, sf_dir):
    t = timeline(spark, sf_dir)
    first = t.groupBy("session").agg(F.min("ts").alias("_first"))
    t = t.join(first, "session").withColumn("ts", F.col("ts") - F.col("_first")).drop("_first")
    kind = F.when(F.col("type") == "view", "dwell").when(F.col("type") == "purchase", "scroll").otherwise(F.col("type"))
    events = t.filter("seq % 5 = 0").select("session", "seq", kind.alias("type"), F.col("ts").alias("start"), (F.col("ts") + F.col("y") * 360000).alias("end"))
    rest = t.filter("seq % 5 <> 0")
    diffs = rest.select("session", "seq", F.col("ts").alias("a"), F.lead("ts").over(ordered("ts", "seq")).alias("b"), F.col("x").alias("magnitude"))
    places = t.withColumns({"x": F.floor(F.col("x") * 10), "y": F.col("y") * 8})
    made = observe.selected_frames(events, diffs, places, first.select("session", F.lit(720 * H).alias("duration")), 1920, 1080, FRAMES)
    return rounded(made, ts=3)

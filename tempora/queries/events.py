"""Queries of moments, regions and finished events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import events as op
from .base import HOUR, E, I, intervals

QUERIES: dict = {}
ORACLE: dict = {}
H = HOUR
HEADING = "\n".join(op.CANDIDATE_HEADING)


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


#: The tables' event types as moment categories, events as changes with a box and a cursor.
M = f"""{E}, {I}, m AS (SELECT *, CASE type WHEN 'error' THEN 'scene_change' WHEN 'click' THEN 'interaction' WHEN 'view' THEN 'scroll' WHEN 'signup' THEN 'pre_scene_change' ELSE 'cursor_stop' END AS category,
  ['N', 'S', 'E', 'W'][(seq % 4 + 1)::INTEGER] AS direction, floor(x) * 10 AS bx, floor(y) * 10 AS "by", (seq % 700)::DOUBLE AS bw, (seq % 500)::DOUBLE AS bh FROM i)"""


def moments(spark, sf_dir):
    kind = F.when(F.col("type") == "error", "scene_change").when(F.col("type") == "click", "interaction").when(F.col("type") == "view", "scroll")
    kind = kind.when(F.col("type") == "signup", "pre_scene_change").otherwise("cursor_stop")
    way = F.element_at(F.array(*map(F.lit, "NSEW")), (F.col("seq") % 4 + 1).cast("int"))
    return intervals(spark, sf_dir).withColumns(
        {"category": kind, "direction": way, "bx": F.floor("x") * 10.0, "by": F.floor("y") * 10.0, "bw": (F.col("seq") % 700).cast("double"), "bh": (F.col("seq") % 500).cast("double")}
    )


@query(f"""WITH {M} SELECT session, category, CASE WHEN category IN ('scene_change', 'scroll') THEN 1 ELSE 2 END AS pass, count(*) AS n FROM m WHERE "end" - start >= {2 * H} AND category <> 'cursor_stop' GROUP BY ALL""")
def pass_moments(spark, sf_dir):
    m = op.enabled(op.lasting(moments(spark, sf_dir), 2 * H), ["scene_change", "interaction", "scroll", "pre_scene_change"])
    parts = [op.of_pass(m, k).groupBy("session", "category").agg(F.lit(k).alias("pass"), F.count(F.lit(1)).alias("n")) for k in (1, 2)]
    return parts[0].unionByName(parts[1])


def _roi_sql(at: str, extent: str, cursor: str, frame: int, names: str) -> str:
    low, high = f"greatest(0, {at} - 64)", f"least({frame}, {at} + {extent} + 64)"
    room = f"greatest(256, {high} - {low})"
    changed = f"greatest(0, least(greatest(0, floor(({low} + {high}) / 2) - floor({room} / 2)), {frame} - {room}))"
    pointed = f"greatest(0, least(coalesce(trunc({cursor}), {frame // 2}) - 192, {frame - 384}))"
    return f"""(CASE WHEN has THEN {changed} WHEN category = 'pre_scene_change' AND cx IS NULL THEN 0 ELSE {pointed} END)::BIGINT AS {names[0]},
  (CASE WHEN has THEN least({room}, {frame}) WHEN category = 'pre_scene_change' AND cx IS NULL THEN {frame} ELSE 384 END)::BIGINT AS {names[1]}"""


@query(
    f"""WITH {M}, c AS (SELECT *, seq % 3 = 0 AS has, CASE WHEN seq % 5 > 0 THEN x * 10 END AS cx, CASE WHEN seq % 5 > 0 THEN y * 10 END AS cy FROM m)
SELECT session, seq, {_roi_sql("bx", "bw", "cx", 1920, "xw")}, {_roi_sql('"by"', "bh", "cy", 1080, "yh")} FROM c"""
)
def moment_rois(spark, sf_dir):
    m, has, seen = moments(spark, sf_dir), F.col("seq") % 3 == 0, F.col("seq") % 5 > 0
    box = {k: F.when(has, F.col(f"b{k}")) for k in "xywh"}
    cursor = {k: F.when(seen, F.col(k) * 10) for k in "xy"}
    return m.select("session", "seq", op.moment_roi(F.col("category"), box, cursor, 1920, 1080).alias("r")).select("session", "seq", "r.*")


@query(
    f"""WITH {M} SELECT session, seq, greatest(0, least(bx - 300, 1919)) AS x0, greatest(0, least("by" - 300, 1079)) AS y0, greatest(0, least(bx - 300 + bw, 1920)) AS x1,
  greatest(0, least("by" - 300 + bh, 1080)) AS y1 FROM m"""
)
def crops(spark, sf_dir):
    c = op.crop(F.col("bx") - 300, F.col("by") - 300, F.col("bw"), F.col("bh"), 1920, 1080)
    return moments(spark, sf_dir).select("session", "seq", c.alias("c")).select("session", "seq", "c.*")


@query(f"""WITH {M} SELECT session, seq, coalesce(CASE WHEN seq % 5 > 0 THEN x * 10 BETWEEN bx - 64 AND bx + bw + 64 AND y * 11 BETWEEN "by" - 64 AND "by" + bh + 64 END, false) AS beside FROM m""")
def beside_change(spark, sf_dir):
    seen = F.col("seq") % 5 > 0
    near = op.beside(F.when(seen, F.col("x") * 10), F.when(seen, F.col("y") * 11), {k: F.col(f"b{k}") for k in "xywh"}, 64)
    return moments(spark, sf_dir).select("session", "seq", near.alias("beside"))


@query(
    f"""WITH {M}, t AS (SELECT session, start AS at, 'page ' || seq AS page_title, seq FROM m WHERE type = 'error')
SELECT m.session, m.seq, 'scroll' AS type, m.start + 500 AS start, m."end" + 500 AS "end", 0.8::DOUBLE AS confidence,
  'Scroll ' || CASE direction WHEN 'S' THEN 'down' WHEN 'N' THEN 'up' ELSE direction END || printf(' (magnitude: %.1f, uniformity: %.2f)', x, confidence) AS description,
  (SELECT arg_max(page_title, row(t.at, -t.seq)) FROM t WHERE t.session = m.session AND t.at <= m.start) AS page_title FROM m WHERE category = 'scroll' AND seq % 7 > 0"""
)
def scroll_events(spark, sf_dir):
    m = moments(spark, sf_dir)
    scenes = m.filter("type = 'error'").select("session", "seq", F.col("start").alias("at"), F.concat(F.lit("page "), "seq").alias("page_title"))
    m = m.withColumns({"direction": F.when(F.col("seq") % 7 > 0, F.col("direction")), "magnitude": F.col("x"), "uniformity": F.col("confidence")})
    return op.scroll_events(m, scenes, F.lit(500.0))


LOCAL = """l AS (SELECT *, CASE type WHEN 'purchase' THEN 'cursor_thrash' ELSE type END AS kind, (seq % 4)::INTEGER AS n_pos, seq % 3 > 0 AS needs, (seq % 400) / 400::DOUBLE AS sure FROM m)"""


def local(spark, sf_dir):
    place = lambda k: F.struct((F.col("x") + k).alias("x"), (F.col("y") + 2 * k).alias("y"))
    n = (F.col("seq") % 4).cast("int")
    return moments(spark, sf_dir).withColumns(
        {
            "type": F.when(F.col("type") == "purchase", "cursor_thrash").otherwise(F.col("type")),
            "positions": F.slice(F.array(place(F.lit(0)), place(F.lit(1)), place(F.lit(2))), F.lit(1), n),
            "needs_enrichment": F.col("seq") % 3 > 0,
            "confidence": (F.col("seq") % 400) / 400,
            "description": F.concat(F.lit("event "), "seq"),
        }
    )


@query(
    f"""WITH {M}, {LOCAL} SELECT session, seq, kind AS type, start - 250 AS start, "end" - 250 AS "end", 'event ' || seq AS description, sure AS confidence,
  round(CASE WHEN n_pos = 0 THEN NULL WHEN kind = 'cursor_thrash' THEN x + (n_pos - 1) / 2 ELSE x END, 6) AS x,
  round(CASE WHEN n_pos = 0 THEN NULL WHEN kind = 'cursor_thrash' THEN y + (n_pos - 1) ELSE y END, 6) AS y FROM l WHERE NOT needs"""
)
def certain_events(spark, sf_dir):
    return op.certain_events(local(spark, sf_dir), F.lit(-250.0)).withColumns({c: expr.rounded(F.col(c), 6) for c in "xy"})


@query(
    f"""WITH {M}, s AS (SELECT DISTINCT session, 'recording ' || session AS transcript_id, CASE WHEN session % 5 > 0 THEN 'study ' || session % 7 END AS study_id FROM m WHERE session % 11 > 0)
SELECT m.session, seq, 'engine' AS source, transcript_id, study_id, nullif(CASE WHEN seq % 3 = 0 THEN '' ELSE type END, '') AS page_title,
  nullif(CASE WHEN seq % 4 = 0 THEN '' WHEN seq % 4 > 1 THEN direction END, '') AS target, CASE WHEN seq % 5 > 0 THEN x END AS cursor_x FROM m LEFT JOIN s USING (session)"""
)
def final_events(spark, sf_dir):
    m = moments(spark, sf_dir).withColumn("page_title", F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("type")))
    m = m.withColumn("target", F.when(F.col("seq") % 4 == 0, "").when(F.col("seq") % 4 > 1, F.col("direction")))
    m = m.withColumn("cursor_position", F.struct(F.when(F.col("seq") % 5 > 0, F.col("x")).alias("x"), "y"))
    study = F.when(F.col("session") % 5 > 0, F.concat(F.lit("study "), (F.col("session") % 7).cast("string")))
    known = m.filter("session % 11 > 0").select("session").distinct().withColumns({"identifier": F.concat(F.lit("recording "), "session"), "study_id": study})
    made = op.final_events(m, known, "engine", ["page_title", "target"])
    return made.select("session", "seq", "source", "transcript_id", "study_id", "page_title", "target", F.col("cursor_position.x").alias("cursor_x"))


@query(
    f"""WITH {M}, a AS (SELECT session, seq, 'change_ui_state' AS type, printf('%.1f', start + 100.0625)::DOUBLE AS start, CASE category WHEN 'scene_change' THEN 'Scene change' ELSE 'Local change' END AS description,
  CASE WHEN category = 'interaction' THEN bx END AS left_edge, 1 AS new FROM m WHERE category = 'interaction' OR (category = 'scene_change' AND confidence >= 0.3)
  UNION ALL SELECT session, seq, 'scroll', printf('%.1f', start + 100.0625)::DOUBLE, 'scroll ' || direction, NULL, 1 FROM m WHERE category = 'scroll'
  UNION ALL SELECT session, seq, 'old', start, NULL, NULL, 0 FROM m WHERE category = 'cursor_stop')
SELECT session, seq, type, start, description, left_edge, row_number() OVER (PARTITION BY session ORDER BY start, new, seq) AS position FROM a"""
)
def baseline_annotations(spark, sf_dir):
    m = moments(spark, sf_dir)
    kind = F.when(F.col("category") == "interaction", "local_change").otherwise(F.col("category"))
    changes = m.select("session", "seq", "start", "end", kind.alias("category"), F.col("confidence").alias("area"), *(F.col(f"b{k}").alias(k) for k in "xywh"))
    new = op.annotations(changes, m, F.lit(100.0625), 0.3)
    old = m.filter("category = 'cursor_stop'").select("session", "seq", F.lit("old").alias("type"), "start")
    return op.appended(old, new).select("session", "seq", "type", "start", "description", F.col("bbox.x").alias("left_edge"), "position")


@query(
    f"""WITH {M}, {LOCAL}, s AS (SELECT session, seq AS segment, start, "end" FROM m WHERE type = 'error'),
h AS (SELECT s.session, segment, l.*, row_number() OVER (PARTITION BY s.session, segment ORDER BY l.start, l.seq) AS k FROM s JOIN l ON l.session = s.session AND needs AND l."end" + 0.5 >= s.start AND l.start + 0.5 <= s."end")
SELECT session, segment, '{HEADING}' || string_agg('- **Candidate ' || k || '**: ' || kind || printf(' | %.0fms-%.0fms | confidence=%.2f', start + 0.5, "end" + 0.5, sure)
  || CASE WHEN n_pos > 0 THEN printf(' at cursor (%.0f, %.0f)', x, y) ELSE '' END || ' | event ' || seq, chr(10) ORDER BY k) || chr(10) AS text FROM h GROUP BY session, segment"""
)
def candidate_lines(spark, sf_dir):
    halves = local(spark, sf_dir).withColumns({"start": F.col("start") + 0.5, "end": F.col("end") + 0.5})
    segments = moments(spark, sf_dir).filter("type = 'error'").select("session", F.col("seq").alias("segment"), "start", "end")
    return op.candidate_lines(halves, segments, 12 * H)


@query(
    f"""WITH {M}, u AS (SELECT session, count(*) AS moments, sum(seq % 900)::BIGINT AS used FROM m WHERE category IN ('scene_change', 'interaction') GROUP BY session),
k AS (SELECT session, string_agg(category || '=' || n, ',' ORDER BY category) AS categories FROM (SELECT session, category, count(*) AS n FROM m WHERE category IN ('scene_change', 'interaction') GROUP BY ALL) GROUP BY session),
t AS (SELECT session, string_agg(direction || '=' || n, ',' ORDER BY direction) AS templates FROM (SELECT session, direction, count(*) AS n FROM m WHERE seq % 6 > 0 GROUP BY ALL) GROUP BY session)
SELECT session, count(*) AS frames, count(*) FILTER (WHERE seq % 6 > 0) AS detections, printf('%.4f', count(*) FILTER (WHERE seq % 6 > 0) / count(*))::DOUBLE AS rate,
  coalesce(any_value(templates), '') AS templates, coalesce(any_value(categories), '') AS categories, coalesce(any_value(u.moments), 0) AS moments, printf('%.1f', coalesce(any_value(used), 0) / 5000 * 100)::DOUBLE AS used_percent
FROM m LEFT JOIN u USING (session) LEFT JOIN k USING (session) LEFT JOIN t USING (session) GROUP BY session"""
)
def observe_summary(spark, sf_dir):
    m = moments(spark, sf_dir).withColumns({"detected": F.col("seq") % 6 > 0, "template": F.col("direction"), "tokens": F.col("seq") % 900})
    budgets = m.select("session").distinct().withColumn("budget", F.lit(5000))
    out = op.observe_summary(m, m, m.filter("category IN ('scene_change', 'interaction')"), budgets)
    text = lambda c: F.coalesce(F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","), F.lit(""))
    return out.select("session", "frames", "detections", "rate", text("templates").alias("templates"), text("categories").alias("categories"), "moments", "used_percent")


@query(f"""WITH {M} SELECT session, type, seq FROM (SELECT *, row_number() OVER (PARTITION BY session, type ORDER BY x DESC, seq) AS n FROM m) WHERE n <= 5""")
def shortened_lists(spark, sf_dir):
    return op.first_of_each(moments(spark, sf_dir), ["session", "type"], [F.desc("x"), F.asc("seq")], 5).select("session", "type", "seq")


@query(
    f"""WITH {M}, c AS (SELECT session AS experiment, min(seq) AS first, arg_min(coalesce(CASE WHEN seq % 3 > 0 THEN confidence END, 0), seq) AS f1, arg_min(seq % 2 = 0, seq) AS critical FROM m GROUP BY session)
SELECT experiment, seq AS session, seq = first OR NOT (f1 < 0.05 AND critical) AS runs FROM m JOIN c ON experiment = m.session"""
)
def canary_gate(spark, sf_dir):
    m = moments(spark, sf_dir)
    score, grade = F.when(F.col("seq") % 3 > 0, F.col("confidence")), F.when(F.col("seq") % 2 == 0, "critical").otherwise("noise")
    first = m.groupBy(F.col("session").alias("experiment")).agg(F.min(F.struct("seq", score.alias("f1"), grade.alias("severity"))).alias("c"))
    canary = first.select("experiment", F.col("c.seq").alias("session"), "c.f1", "c.severity")
    return op.gate(canary, m.select(F.col("session").alias("experiment"), F.col("seq").alias("session")))

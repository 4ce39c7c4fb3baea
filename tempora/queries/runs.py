"""Queries of whole runs: stages whose tables are kept, events improved by answers, samples for a judge, texts and exact rounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Merge
from ..functions import exact
from ..operators import enrich, joins, matching, texts
from ..operators import folds as folded
from ..operators import windows as op
from ..plans import merge
from ..plans.graph import Graph, Stage, fingerprint
from ..sources.tables import shared_dir
from . import folds as folded_queries
from . import windows
from .base import HOUR, E, I, intervals, rounded, timeline

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


@query(windows.ORACLE["tier_segment_list"])
def staged_segments(spark, sf_dir):
    """Activity segments by a graph of kept stages: hopping windows, tiers, segments. A second run on the same events reads them."""
    graph = Graph(
        f"{shared_dir(spark)}/timelines-stages",
        [
            Stage("hops", lambda t, size: op.hop_windows(t["events"], "x", *size), ("events",), (24 * H, 6 * H), version="2"),
            Stage("tiers", lambda t, limits: t["hops"].withColumn("tier", windows.expr.tier(F.col("mean"), *limits)), ("hops",), (20.0, 45.0, 70.0), version="2"),
            Stage("segments", lambda t, least: op.tier_segments(t["tiers"], least), ("tiers",), 18 * H, version="2"),
        ],
    )
    events = (fingerprint(spark, f"{sf_dir}/events.parquet"), timeline(spark, sf_dir))
    graph.run(spark, {"events": events}, stop_after="tiers")
    tables, _ = graph.run(spark, {"events": events})
    return rounded(tables["segments"].withColumn("fps", windows.expr.tier_fps(F.col("tier"))), start=3, end=3, mean=6)


EVENTS = f"""{E}, v AS (SELECT session, seq, type, confidence, CASE seq % 4 WHEN 1 THEN 'short ' || type WHEN 2 THEN '    ' WHEN 3 THEN 'a long enough description of event ' || seq END AS description,
  CASE seq % 3 WHEN 0 THEN type WHEN 1 THEN '' END AS interaction_target, CASE WHEN seq % 6 > 2 THEN 'page ' || seq END AS page_title, CASE seq % 5 WHEN 0 THEN 'seen before' WHEN 1 THEN '' END AS frame_description FROM e)"""


def events(spark, sf_dir):
    k = lambda n: F.col("seq") % n
    text = F.when(k(4) == 1, F.concat(F.lit("short "), "type")).when(k(4) == 2, "    ").when(k(4) == 3, F.concat(F.lit("a long enough description of event "), F.col("seq").cast("string")))
    return timeline(spark, sf_dir).select(
        "session", "seq", "type", "confidence", text.alias("description"), F.when(k(3) == 0, F.col("type")).when(k(3) == 1, "").alias("interaction_target"),
        F.when(k(6) > 2, F.concat(F.lit("page "), F.col("seq").cast("string"))).alias("page_title"), F.when(k(5) == 0, "seen before").when(k(5) == 1, "").alias("frame_description"),
    )


@query(
    f"""WITH {EVENTS}, a AS (SELECT session, seq, unnest([1, 2]) AS place FROM v WHERE seq % 7 < 5),
t AS (SELECT *, CASE WHEN place = 1 THEN 'an answer at length, number ' || seq WHEN seq % 2 = 0 THEN 'too short' ELSE 'the second answer at length' END AS description,
  CASE WHEN place = 1 OR seq % 3 = 0 THEN 'target ' || place ELSE '' END AS target, CASE WHEN place = 2 THEN 'title' END AS title, CASE WHEN seq % 4 > 0 THEN 'frame ' || place END AS frame FROM a),
n AS (SELECT session, seq, arg_max(description, place) FILTER (WHERE length(description) >= 15) AS d, arg_max(target, place) FILTER (WHERE target <> '') AS t,
  arg_max(title, place) FILTER (WHERE title <> '') AS p, arg_max(frame, place) FILTER (WHERE frame <> '') AS f FROM t GROUP BY ALL)
SELECT session, seq, CASE WHEN d IS NOT NULL AND coalesce(length(trim(v.description)) < 15, true) THEN d ELSE v.description END AS description,
  CASE WHEN t IS NOT NULL AND coalesce(interaction_target, '') = '' THEN t ELSE interaction_target END AS interaction_target,
  CASE WHEN p IS NOT NULL AND coalesce(page_title, '') = '' THEN p ELSE page_title END AS page_title, coalesce(f, frame_description) AS frame_description FROM v LEFT JOIN n USING (session, seq)"""
)
def merged_fields(spark, sf_dir):
    e = events(spark, sf_dir)
    a = e.filter("seq % 7 < 5").select("session", "seq", F.explode(F.array(F.lit(1), F.lit(2))).alias("place"))
    n, p = F.col("seq").cast("string"), F.col("place").cast("string")
    one = F.col("place") == 1
    answers = a.select(
        "session", "seq", "place",
        F.when(one, F.concat(F.lit("an answer at length, number "), n)).when(F.col("seq") % 2 == 0, "too short").otherwise("the second answer at length").alias("description"),
        F.when(one | (F.col("seq") % 3 == 0), F.concat(F.lit("target "), p)).otherwise("").alias("interaction_target"),
        F.when(~one, "title").alias("page_title"),
        F.when(F.col("seq") % 4 > 0, F.concat(F.lit("frame "), p)).alias("frame_description"),
    )
    return enrich.merged_fields(e, answers).select("session", "seq", "description", "interaction_target", "page_title", "frame_description")


@query(
    f"""WITH {EVENTS}, n AS (SELECT *, coalesce(frame_description, '') = '' AS open FROM v), t AS (SELECT session, string_agg(type || '=' || n, ',' ORDER BY type) AS by_type FROM (SELECT session, type, count(*) AS n FROM n WHERE open GROUP BY ALL) GROUP BY session)
SELECT session, count(*) AS events, count(*) FILTER (WHERE open) AS needy, count(*) FILTER (WHERE open) AS frame_description, count(*) FILTER (WHERE open AND coalesce(length(trim(description)) < 15, true)) AS description,
  count(*) FILTER (WHERE open AND coalesce(interaction_target, '') = '') AS interaction_target, count(*) FILTER (WHERE open AND coalesce(page_title, '') = '') AS page_title,
  count(*) FILTER (WHERE open) AS page_location, coalesce(any_value(by_type), '') AS by_type FROM n LEFT JOIN t USING (session) GROUP BY session"""
)
def needs_summary(spark, sf_dir):
    s = enrich.needs_summary(events(spark, sf_dir))
    pairs = F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return s.withColumn("by_type", F.coalesce(F.array_join(pairs, ","), F.lit("")))


SAMPLE = f"""{E}, c AS (SELECT session, type, count(*) AS n, 12 + session % 9 AS most FROM e GROUP BY session, type),
g AS (SELECT *, sum(n) OVER (PARTITION BY session) AS every FROM c), s AS (SELECT *, least(most, every) AS seats, least(most, every) * n // every AS whole, least(most, every) * n % every AS rest FROM g),
r AS (SELECT *, seats - sum(whole) OVER (PARTITION BY session) AS spare, row_number() OVER (PARTITION BY session ORDER BY rest DESC, type) AS place FROM s),
h AS (SELECT e.*, whole, spare, place, row_number() OVER (PARTITION BY session, type ORDER BY md5('7|' || session || '|' || seq), seq) AS k FROM e JOIN r USING (session, type))"""


@query(f"""WITH {SAMPLE} SELECT session, seq, type FROM h WHERE k <= whole + (place <= spare)::INT""")
def validation_sample(spark, sf_dir):
    return enrich.validation_sample(timeline(spark, sf_dir), 12 + F.col("session") % 9, "stratified", seed=7).select("session", "seq", "type")


@query(
    f"""WITH {SAMPLE}, f AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY confidence, seq) AS least FROM h WHERE k > whole)
SELECT session, seq, type FROM h WHERE k <= whole UNION ALL SELECT session, seq, type FROM f WHERE least <= spare"""
)
def validation_sample_unsure(spark, sf_dir):
    return enrich.validation_sample(timeline(spark, sf_dir), 12 + F.col("session") % 9, "all", "confidence", 7).select("session", "seq", "type")


def _verdicts_sql() -> str:
    said = "CASE ((seq + {k}) * 7 % 5)::INTEGER WHEN 0 THEN 'correct' WHEN 1 THEN 'partially_correct' WHEN 2 THEN 'incorrect' WHEN 3 THEN 'unverifiable' ELSE 'correct' END"
    parts = []
    for k, a in enumerate(enrich.ASPECTS):
        v = said.format(k=k)
        parts += [f"count(*) FILTER (WHERE {v} = '{r}') AS {a}_{r}" for r in enrich.RATINGS]
        parts.append(f"round(count(*) FILTER (WHERE {v} = 'correct') / nullif(count(*) FILTER (WHERE {v} <> 'unverifiable'), 0)::DOUBLE, 9) AS {a}_accuracy")
    return f"WITH {E} SELECT session, count(*) AS events, {', '.join(parts)} FROM e GROUP BY session"


@query(_verdicts_sql())
def verdict_summary(spark, sf_dir):
    names = F.array(*map(F.lit, (*enrich.RATINGS, "correct")))
    judged = timeline(spark, sf_dir).withColumns({f"{a}_verdict": F.element_at(names, ((F.col("seq") + k) * 7 % 5 + 1).cast("int")) for k, a in enumerate(enrich.ASPECTS)})
    return rounded(enrich.verdicts(judged, ["session"]), **{f"{a}_accuracy": 9 for a in enrich.ASPECTS})


ROLLED = f"""f AS (SELECT session, seq, start, "end", x, CASE WHEN y < 50 THEN 'N' ELSE 'S' END AS direction FROM i WHERE x > 20),
g AS (SELECT *, CASE WHEN direction <> lag(direction) OVER o OR start > lag("end") OVER o + {6 * H} THEN 1 ELSE 0 END AS new FROM f WINDOW o AS (PARTITION BY session ORDER BY start, seq)),
k AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY start, seq) AS island FROM g),
z AS (SELECT session, min(start) AS start, arg_max("end", (start, seq)) AS "end", CASE any_value(direction) WHEN 'N' THEN 'scroll-up' ELSE 'scroll-down' END AS direction, avg(x) AS magnitude FROM k GROUP BY session, island),
s AS (SELECT session, min(ts) AS first FROM e GROUP BY session),
l AS (SELECT session, string_agg(trunc(start - first)::BIGINT || '-' || trunc("end" - first)::BIGINT || 'ms: ' || direction || ' magnitude=' || printf('%.1f', magnitude), chr(10) ORDER BY start, "end") AS text FROM z JOIN s USING (session) GROUP BY session)"""


def flow_texts(spark, sf_dir):
    i = intervals(spark, sf_dir).filter("x > 20").withColumn("magnitude", F.col("x")).withColumn("direction", F.when(F.col("y") < 50, "N").otherwise("S"))
    spans = op.flow_rollup(i, 6 * H).withColumns({"segment": F.lit(0), "direction": F.when(F.col("direction") == "N", "scroll-up").otherwise("scroll-down")})
    segments = timeline(spark, sf_dir).groupBy("session").agg(F.min("ts").alias("start")).withColumn("segment", F.lit(0))
    return texts.flow_lines(spans, segments)


@query(f"""WITH {E}, {I}, {ROLLED} SELECT session, coalesce(text, '') AS text FROM s LEFT JOIN l USING (session)""")
def flow_summaries(spark, sf_dir):
    return flow_texts(spark, sf_dir).select("session", "text")


@query(
    f"""WITH {E}, {I}, {ROLLED} SELECT session, 'Part 1 of ' || (session % 4 + 1) || chr(10) || CASE WHEN coalesce(text, '') <> '' THEN 'Flow:' || chr(10) || text || chr(10) ELSE '' END
  || CASE WHEN session % 3 = 0 THEN 'First part.' ELSE '' END || '{{unknown}}' AS prompt FROM s LEFT JOIN l USING (session)"""
)
def prompts(spark, sf_dir):
    """Prompts of a segment each, with a section for its flows if it has any and one for first segments."""
    template = F.lit("Part {index} of {total}\n{flow_section}{first_section}{unknown}")
    sections = {"flow_section": (F.col("text") != "", F.lit("Flow:\n{flow}\n")), "first_section": (F.col("session") % 3 == 0, F.lit("First part."))}
    values = {"index": F.lit(1), "total": F.col("session") % 4 + 1, "flow": F.col("text")}
    return flow_texts(spark, sf_dir).select("session", texts.rendered(template, values, sections).alias("prompt"))


@query()
def summary_diffs(spark, sf_dir):
    """Cursor summaries of each session from its detected events, and from those that are left after still runs are blanked."""
    t = timeline(spark, sf_dir)
    segments = t.groupBy("session").agg(F.min("ts").alias("start")).withColumn("segment", F.lit(0))
    said = lambda rows: texts.cursor_lines(folded.cursor_rollup(rows).withColumn("segment", F.lit(0)), segments)
    other = said(folded.static_filter(t, 30.0, 6 * H))
    return texts.text_changes(said(t), other, ["session", "segment"]).drop("segment")


@query(
    f"""WITH {E}, c AS (SELECT session, type, count(*) AS n, avg(x) AS mean, avg(CASE WHEN y > 98 THEN y END) AS late FROM e GROUP BY session, type)
SELECT session, '| Type | Events | Mean | Late |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || replace(type, 'click', 'click\\|tap') || ' | ' || n || ' | ' || printf('%.2f', mean) || ' | ' || coalesce(printf('%.1f', late), '-') || ' |', chr(10) ORDER BY type) AS text
FROM c GROUP BY session"""
)
def type_reports(spark, sf_dir):
    """A Markdown table of each session's events by type."""
    c = op.means_in_order(timeline(spark, sf_dir), ["session", "type"], ["seq"], mean=F.col("x"), late=F.when(F.col("y") > 98, F.col("y")))
    cells = {"Type": F.replace("type", F.lit("click"), F.lit("click|tap")), "Events": F.col("n"), "Mean": exact.fixed(F.col("mean"), 2), "Late": exact.fixed(F.col("late"), 1)}
    return texts.table_text(c, cells, ["type"], ["session"])


@query(
    f"""WITH {E}, r AS (SELECT session, ts AS start, ts + 10 * {H} AS "end" FROM e WHERE type = 'error')
SELECT session, seq FROM e WHERE type = 'error' AND EXISTS (SELECT 1 FROM r WHERE r.session = e.session AND r.start <= e.ts - 10 * {H} AND e.ts - 10 * {H} < r."end")"""
)
def range_half_open(spark, sf_dir):
    """Errors with another one at most ten hours before the ten hours before them; the end of a range is outside."""
    t = timeline(spark, sf_dir).filter("type = 'error'")
    ranges = t.select("session", F.col("ts").alias("start"), (F.col("ts") + 10 * H).alias("end"))
    return joins.within_any(t.select("session", "seq", (F.col("ts") - 10 * H).alias("at")), "at", ranges, closed=False).select("session", "seq")


@query()
def standalone_merge(spark, sf_dir):
    """A user's events as what three overlapping segments found, with whole dialogue turns as descriptions, made one timeline again."""
    told, texts = folded_queries.spoken(spark, sf_dir)
    first = told.groupBy("session").agg(F.min("start").alias("_0"))
    rows = told.join(first, "session").withColumns({c: F.col(c) - F.col("_0") for c in ("start", "end")})
    segments = first.select("session", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("segment"))
    segments = segments.select("session", "segment", (F.col("segment") * 200 * H).alias("start"), (F.col("segment") * 200 * H + 260 * H).alias("end"))
    seen = rows.join(segments.withColumnsRenamed({"start": "_a", "end": "_z"}), "session").filter("start >= _a AND start <= _z")
    at = {c: F.col(c) - F.col("_a") for c in ("start", "end")}
    found = seen.withColumns(at | {"cursor_x": F.lit(None).cast("double"), "cursor_y": F.lit(None).cast("double")})
    path = timeline(spark, sf_dir).join(first, "session").withColumn("ts", F.col("ts") - F.col("_0"))
    offsets = first.select("session", F.lit(500.0).alias("offset"))
    limits = Merge(tolerance_ms=12 * H, similarity=0.6, overlap_close_ms=12 * H, overlap_similarity=0.3)
    return merge.standalone(found, segments, path, offsets, c=limits, by_text=texts)


@query(
    f"""WITH {E}, m AS (SELECT session, count(*) FILTER (WHERE seq % 2 = 0) AS b, count(*) FILTER (WHERE seq % 2 = 1) AS f, count(*) FILTER (WHERE seq % 2 = 1 AND x > 30) AS m, avg(x) AS start_error, avg(CASE WHEN y > 50 THEN y END) AS end_error FROM e GROUP BY session)
SELECT session, b AS n_baseline, f AS n_found, m AS n_matched, printf('%.4f', coalesce(m / nullif(f, 0)::DOUBLE, 0))::DOUBLE AS precision, printf('%.4f', coalesce(m / nullif(b, 0)::DOUBLE, 0))::DOUBLE AS recall,
  printf('%.1f', start_error)::DOUBLE AS start_error, printf('%.1f', end_error)::DOUBLE AS end_error FROM m"""
)
def reported_metrics(spark, sf_dir):
    """Session metrics as a report has them: ratios at four digits, errors at one."""
    t = timeline(spark, sf_dir)
    base, found = t.filter("seq % 2 = 0"), t.filter("seq % 2 = 1")
    m = matching.session_metrics(found.filter("x > 30"), base, found, ["session"])
    errors = op.means_in_order(t, ["session"], ["seq"], start_error=F.col("x"), end_error=F.when(F.col("y") > 50, F.col("y"))).drop("n")
    return matching.reported(m.join(errors, "session")).drop("f1")


@query(f"""WITH {E} SELECT session, seq, printf('%.2f', x) AS two, printf('%.0f', y + 0.5) AS none, printf('%.4f', -confidence) AS four, printf('%.1f', (seq % 40) / 16::DOUBLE)::DOUBLE AS near FROM e""")
def exact_digits(spark, sf_dir):
    t = timeline(spark, sf_dir)
    return t.select(
        "session", "seq", exact.fixed(F.col("x"), 2).alias("two"), exact.fixed(F.col("y") + 0.5, 0).alias("none"), exact.fixed(-F.col("confidence"), 4).alias("four"),
        exact.rounded((F.col("seq") % 40) / 16, 1).alias("near"),
    )

"""Report, selection and expression queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import expr
from ..operators import enrich, matching, moments, reports
from ..operators.joins import agreement
from ..operators.windows import ordered
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
    """SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'TOTAL' ELSE l_returnflag END AS l_returnflag, round(sum(l_extendedprice), 2) AS price, round(sum(l_quantity), 2) AS quantity, count(*) AS n
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())"""
)
def cost_rollup(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    return rounded(reports.cost_rollup(li, "l_returnflag", ["price", "quantity"]), price=2, quantity=2)


@query(
    """WITH c(model, input_cost, output_cost) AS (VALUES ('1-URGENT', 0.5::DOUBLE, 3.0::DOUBLE), ('2-HIGH', 0.25, 2.0), ('3-MEDIUM', 0.1, 0.4)),
r AS (SELECT o_orderpriority AS model, o_totalprice AS a, o_orderkey % 1000 AS b FROM orders)
SELECT model, count(*) AS runs, round(sum(a * input_cost + b * output_cost), 2) AS cost, sum(b)::BIGINT AS output_tokens FROM r LEFT JOIN c USING (model) GROUP BY model"""
)
def usage_by_model(spark, sf_dir):
    prices = spark.createDataFrame([("1-URGENT", 0.5, 3.0), ("2-HIGH", 0.25, 2.0), ("3-MEDIUM", 0.1, 0.4)], "model string, input_cost double, output_cost double")
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_totalprice").alias("input_tokens"), (F.col("o_orderkey") % 1000).alias("output_tokens"))
    u = reports.usage(runs, prices)
    return u.groupBy("model").agg(F.count(F.lit(1)).alias("runs"), expr.rounded(F.sum("cost"), 2).alias("cost"), F.sum("output_tokens").alias("output_tokens"))


@query(
    f"""WITH {E}, p AS (SELECT type AS ref_type, lead(type) OVER (PARTITION BY session ORDER BY ts, seq) AS hit_type FROM e) SELECT ref_type, hit_type, count(*) AS n FROM p WHERE ref_type <> hit_type GROUP BY ALL"""
)
def type_confusion(spark, sf_dir):
    t = timeline(spark, sf_dir)
    return reports.confusion(t.select(F.col("type").alias("ref_type"), F.lead("type").over(ordered("ts", "seq")).alias("hit_type")))


PRF = """round(coalesce(m / nullif(f, 0)::DOUBLE, 0), 9) AS precision, round(coalesce(m / nullif(b, 0)::DOUBLE, 0), 9) AS recall,
  round(coalesce(2.0 * m / nullif(b + f, 0), 0), 9) AS f1"""


@query(
    f"""WITH d AS (SELECT source, doc_id, quality, n_chars > 800 AS found FROM documents JOIN labels USING (doc_id)),
c AS (SELECT source AS session, sum(quality)::BIGINT AS b, count(*) FILTER (WHERE found) AS f, count(*) FILTER (WHERE found AND quality = 1) AS m FROM d GROUP BY source HAVING b > 0 OR f > 0)
SELECT session, b AS n_baseline, f AS n_found, m AS n_matched, {PRF} FROM c"""
)
def prf_by_type(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("session"), "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    truth, found = d.filter("quality = 1"), d.filter("n_chars > 800")
    m = matching.session_metrics(truth.filter("n_chars > 800"), truth, found, ["session"])
    return rounded(m, precision=9, recall=9, f1=9)


CUM = f"""{E}, c AS (SELECT session, count(*) FILTER (WHERE type IN ('click', 'view')) AS b, count(*) FILTER (WHERE x > 30) AS f, count(*) FILTER (WHERE x > 30 AND type IN ('click', 'view')) AS m FROM e GROUP BY session),
s AS (SELECT *, coalesce(2.0 * m / nullif(b + f, 0), 0)::DOUBLE AS f1, row_number() OVER (ORDER BY session) - 1 AS i FROM c),
u AS (SELECT *, sum(b) OVER o AS sb, sum(f) OVER o AS sf, sum(m) OVER o AS sm, regr_slope(f1, i) OVER o AS k FROM s WINDOW o AS (ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _counts(spark, sf_dir):
    t = timeline(spark, sf_dir)
    base, found = F.col("type").isin("click", "view"), F.col("x") > 30
    c = t.groupBy("session").agg(F.count_if(base).alias("n_baseline"), F.count_if(found).alias("n_found"), F.count_if(base & found).alias("n_matched"))
    return c.withColumns(matching.ratios(F.col("n_matched"), F.col("n_baseline"), F.col("n_found"))).withColumn("all", F.lit(0))


@query(
    f"""WITH {CUM} SELECT session, round(2.0 * sm / nullif(sb + sf, 0), 9)::DOUBLE AS cum_f1, CASE WHEN i < 2 THEN 'stable' WHEN k > 0.02 THEN 'improving' WHEN k < -0.02 THEN 'declining' ELSE 'stable' END AS trend FROM u"""
)
def cumulative_f1(spark, sf_dir):
    return rounded(matching.cumulative(_counts(spark, sf_dir), "session", 0.02, ["all"]).select("session", "cum_f1", "trend"), cum_f1=9)


@query(
    f"""WITH {CUM}, d AS (SELECT *, i >= 1 AND coalesce(lag(f1) OVER (ORDER BY session) - f1 >= 0.25, false) AS breaks FROM s),
p AS (SELECT *, coalesce(max(breaks::INT) OVER (ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM d) SELECT session, breaks FROM p WHERE past = 0"""
)
def early_break(spark, sf_dir):
    return matching.early_break(_counts(spark, sf_dir), "session", 0.25, 2, ["all"]).select("session", "breaks")


@query(f"""WITH {CUM}, t AS (SELECT sum(b)::BIGINT AS b, sum(f)::BIGINT AS f, sum(m)::BIGINT AS m FROM c) SELECT b AS n_baseline, f AS n_found, m AS n_matched, {PRF} FROM t""")
def micro_average(spark, sf_dir):
    return rounded(matching.micro(_counts(spark, sf_dir)), precision=9, recall=9, f1=9)


@query(
    f"""WITH {E}, g AS (SELECT session, ts - lag(ts) OVER (PARTITION BY session ORDER BY ts, seq) AS gap FROM e WHERE detected),
l AS (SELECT session, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS l, max(gap) AS top, count(*) FILTER (WHERE gap > {24 * H}) AS large, count(*) FILTER (WHERE gap > {48 * H}) AS long FROM g GROUP BY session),
n AS (SELECT session, count(*) AS n, count(*) FILTER (WHERE detected) AS d FROM e GROUP BY session)
SELECT session, n, d AS n_detected, round(d / n, 9) AS rate, l[len(l) // 2 + 1] AS gap_median, l[least(len(l), floor(len(l) * 0.95)::BIGINT + 1)] AS gap_p95, top AS gap_max, large AS large_gaps, long AS long_absences FROM n JOIN l USING (session)"""
)
def gap_quality(spark, sf_dir):
    return rounded(reports.quality(timeline(spark, sf_dir), 24 * H, 48 * H), rate=9)


@query(
    f"""WITH {E}, b AS (SELECT session, ts, x + seq % 4 AS x, y, y >= 20 AS detected FROM e WHERE seq % 5 <> 0),
p AS (SELECT session, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM e a JOIN b USING (session, ts) WHERE a.detected AND b.detected),
l AS (SELECT session, list_sort(list(d)) AS l, count(*) AS n, avg(d) AS m, max(d) AS top, count(*) FILTER (WHERE d = 0) AS z, count(*) FILTER (WHERE d <= 1) AS a, count(*) FILTER (WHERE d <= 5) AS b FROM p GROUP BY session)
SELECT session, n, z AS identical, a AS within_1, b AS within_5, round(m, 6) AS mean, round(l[len(l) // 2 + 1], 6) AS median, round(top, 6) AS greatest FROM l"""
)
def drift_bands(spark, sf_dir):
    t = timeline(spark, sf_dir)
    other = t.filter("seq % 5 <> 0").withColumn("x", F.col("x") + F.col("seq") % 4).withColumn("detected", F.col("y") >= 20)
    return rounded(reports.distance_bands(agreement(t, other), ["session"], [1, 5]), mean=6, median=6, greatest=6)


@query(
    """SELECT source, count(*) AS n, count(*) FILTER (WHERE text IS NOT NULL AND text <> '') || '/' || count(*) AS text, count(*) FILTER (WHERE lang IS NOT NULL AND lang <> '') || '/' || count(*) AS lang,
  count(*) FILTER (WHERE n_chars IS NOT NULL AND n_chars <> 0) || '/' || count(*) AS n_chars FROM documents GROUP BY source"""
)
def coverage_profile(spark, sf_dir):
    return reports.profile(read(spark, sf_dir, "documents"), ["text", "lang", "n_chars"], ["source"])


@query(
    """WITH g AS (SELECT conv_id AS session, coalesce(role, 'Unknown') AS speaker, min(turn) AS first, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY session ORDER BY first)::INTEGER AS position FROM g"""
)
def speaker_groups(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.col("role").alias("label"), "text")
    return reports.speakers(c)


@query(
    f"""WITH {E}, v AS (SELECT session, type, x - 40 AS dx, y - 50 AS dy, detected FROM e),
b AS (SELECT *, CASE WHEN detected THEN (['E', 'NE', 'N', 'NW', 'W', 'SW', 'S', 'SE'])[(floor((((degrees(atan2(-dy, dx)) % 360) + 360) % 360 + 22.5) / 45)::BIGINT % 8) + 1] END AS d FROM v),
c AS (SELECT session, type, d, count(*) AS n, sum(sqrt(dx * dx + dy * dy)) AS s FROM b GROUP BY ALL)
SELECT session, type, coalesce(arg_max(d, (n, -list_position(['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'], d))) FILTER (WHERE d IS NOT NULL), 'N') AS direction,
  round(coalesce(max(n) FILTER (WHERE d IS NOT NULL) / sum(n) FILTER (WHERE d IS NOT NULL), 0), 9) AS uniformity, round(coalesce(sum(s) FILTER (WHERE d IS NOT NULL) / sum(n) FILTER (WHERE d IS NOT NULL), 0), 6) AS magnitude
FROM c GROUP BY session, type"""
)
def compass_mode(spark, sf_dir):
    v = timeline(spark, sf_dir).select("session", "type", (F.col("x") - 40).alias("dx"), (F.col("y") - 50).alias("dy"), F.col("detected").alias("ok"))
    return rounded(reports.direction_mode(v, ["session", "type"]), uniformity=9, magnitude=6)


@query(
    f"""WITH {E}, b AS (SELECT session, seq, x, y, 50.0::DOUBLE AS w, 40.0::DOUBLE AS h, lag(x) OVER o AS px, lag(y) OVER o AS py FROM e WINDOW o AS (PARTITION BY session ORDER BY ts, seq)),
i AS (SELECT *, greatest(0, 50 - abs(x - px)) * greatest(0, 40 - abs(y - py)) AS shared FROM b)
SELECT session, min(x) AS x, min(y) AS y, round(max(x + w) - min(x), 6) AS w, round(max(y + h) - min(y), 6) AS h, round(coalesce(sum(shared / (4000 - shared)), 0), 6) AS iou FROM i GROUP BY session"""
)
def bbox_iou(spark, sf_dir):
    w = ordered("ts", "seq")
    t = timeline(spark, sf_dir).select("session", "x", "y", F.lit(50.0).alias("w"), F.lit(40.0).alias("h"), F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py"))
    both = expr.iou(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("px"), F.col("py"), F.col("w"), F.col("h"))
    share = t.withColumn("iou", F.when(F.col("px").isNotNull(), both)).groupBy("session").agg(F.coalesce(F.sum("iou"), F.lit(0.0)).alias("iou"))
    return rounded(reports.union_box(t, ["session"]).join(share, "session"), w=6, h=6, iou=6)


@query(
    f"""WITH {E}, c AS (SELECT session, ts, seq, round_even(x / 30, 0) AS cx, round_even(y / 30, 0) AS cy FROM e WHERE detected),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session, cx, cy ORDER BY ts, seq) > {24 * H} THEN 1 ELSE 0 END AS new FROM c) SELECT session, cx, cy, (1 + sum(new))::BIGINT AS clusters, count(*) AS n FROM g GROUP BY ALL"""
)
def position_clusters(spark, sf_dir):
    return reports.position_clusters(timeline(spark, sf_dir), 30.0, 24 * H)


@query(
    f"""WITH {E}, c AS (SELECT session, (seq % 4)::BIGINT AS scale, count(*) AS n FROM e WHERE confidence >= 0.5 GROUP BY ALL),
r AS (SELECT *, row_number() OVER o AS k, lead(scale) OVER o AS s2, lead(n) OVER o AS n2, sum(n) OVER (PARTITION BY session) AS t FROM c WINDOW o AS (PARTITION BY session ORDER BY n DESC, scale))
SELECT session, CASE WHEN 2 * n >= t THEN scale ELSE least(scale, s2) END - 1 AS first, CASE WHEN 2 * n >= t THEN scale ELSE greatest(scale, s2) END + 1 AS last FROM r
WHERE k = 1 AND (2 * n >= t OR (abs(scale - s2) = 1 AND 2 * (n + n2) >= t))"""
)
def scale_calibration(spark, sf_dir):
    t = timeline(spark, sf_dir).select("session", (F.col("seq") % 4).alias("scale"), "confidence")
    return reports.calibrated_scales(t, "session", 0.5)


@query("""SELECT o_orderkey AS run, round((o_totalprice / 258) / ((o_orderkey % 50 + 1) * 1000 / 1000.0), 6)::DOUBLE AS fps FROM orders""")
def effective_fps(spark, sf_dir):
    r = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("input_tokens"), ((F.col("o_orderkey") % 50 + 1) * 1000).alias("duration_ms"))
    return rounded(reports.effective_fps(r, 258).select("run", "fps"), fps=6)


@query(f"""WITH {E} SELECT session, type, count(*) AS n FROM e GROUP BY session, type""")
def counts_by_type(spark, sf_dir):
    return timeline(spark, sf_dir).groupBy("session", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {E} SELECT session, sum(floor(x * 10))::BIGINT AS used, round_even(100 * sum(floor(x * 10)) / 50000.0, 1)::DOUBLE AS percent FROM e GROUP BY session"""
)
def token_totals(spark, sf_dir):
    t = timeline(spark, sf_dir).groupBy("session").agg(F.sum(F.floor(F.col("x") * 10)).alias("used"))
    return t.withColumn("percent", F.bround(100 * F.col("used") / F.lit(50000.0), 1))


@query(
    f"""WITH {E}, {I} SELECT session, seq, coalesce(nullif(CASE WHEN seq % 7 = 0 THEN 0 WHEN seq % 11 = 0 THEN NULL ELSE "end" END, 0), start) AS "end" FROM i"""
)
def effective_end(spark, sf_dir):
    raw = F.when(F.col("seq") % 7 == 0, F.lit(0.0)).when(F.col("seq") % 11 == 0, F.lit(None)).otherwise(F.col("end"))
    return intervals(spark, sf_dir).select("session", "seq", expr.effective_end(F.col("start"), raw).alias("end"))


@query(
    f"""WITH {E}, c AS (SELECT session, seq, CASE seq % 4 WHEN 0 THEN 'scene_change' WHEN 1 THEN 'interaction' WHEN 2 THEN 'pre_scene_change' ELSE 'cursor_stop' END AS category, CASE WHEN seq % 3 > 0 THEN floor(x)::BIGINT END AS bw, CASE WHEN seq % 3 > 0 THEN (y * 8)::BIGINT END AS bh FROM e),
t AS (SELECT *, category = 'scene_change' OR (category = 'pre_scene_change' AND bw IS NULL) AS whole, coalesce(least(greatest(256, bw + 128), 1920), 384) AS rw, coalesce(least(greatest(256, bh + 128), 1080), 384) AS rh FROM c)
SELECT session, seq, category, CASE WHEN whole THEN 1548 ELSE ceil(rw / 768.0) * ceil(rh / 768.0) * 258 END::BIGINT AS tokens, CASE WHEN category = 'pre_scene_change' OR (category = 'interaction' AND bw IS NOT NULL) THEN 2 ELSE 1 END::INTEGER AS frames FROM t"""
)
def moment_tokens(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("scene_change", "interaction", "pre_scene_change", "cursor_stop")))
    t = timeline(spark, sf_dir).withColumn("category", F.element_at(kinds, (F.col("seq") % 4 + 1).cast("int")))
    box = F.col("seq") % 3 > 0
    t = t.withColumns({"bw": F.when(box, F.floor("x")), "bh": F.when(box, (F.col("y") * 8).cast("long"))})
    return t.select(
        "session", "seq", "category", expr.moment_tokens(F.col("category"), F.col("bw"), F.col("bh"), F.lit(1920), F.lit(1080)).alias("tokens"), expr.base_frames(F.col("category"), F.col("bw")).alias("frames")
    )


@query(
    """WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN doc_id || 'ms' WHEN 2 THEN doc_id || '.5s' WHEN 3 THEN (doc_id % 60) || ':' || (doc_id % 50) || '.25' ELSE 'x' || doc_id END AS t FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN doc_id WHEN 1 THEN doc_id WHEN 2 THEN (doc_id + 0.5) * 1000 WHEN 3 THEN (doc_id % 60) * 60000 + (doc_id % 50 + 0.25) * 1000 END::DOUBLE AS ms FROM p"""
)
def position_grammar(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 5
    minutes = F.concat((F.col("doc_id") % 60).cast("string"), F.lit(":"), (F.col("doc_id") % 50).cast("string"), F.lit(".25"))
    text = F.when(k == 0, d).when(k == 1, F.concat(d, F.lit("ms"))).when(k == 2, F.concat(d, F.lit(".5s"))).when(k == 3, minutes).otherwise(F.concat(F.lit("x"), d))
    return read(spark, sf_dir, "documents").select("doc_id", expr.position_ms(text).alias("ms"))


@query(
    """WITH s AS (SELECT event_id, event_type, floor(value * 10) * 100 AS ms, 'event ' || event_id || ' of user ' || user_id || ' with properties ' || props || ' seen in the timeline of the run' AS t FROM events)
SELECT event_id, '[' || floor(floor(ms) / 60000)::BIGINT || ':' || lpad(printf('%.1f', floor(ms) / 1000 - floor(floor(ms) / 60000) * 60), 4, '0') || '] ' || event_type || ': ' || CASE WHEN length(t) > 80 THEN substr(t, 1, 77) || '...' ELSE t END AS line FROM s"""
)
def event_lines(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    text = F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" of user "), F.col("user_id").cast("string"), F.lit(" with properties "), F.col("props"), F.lit(" seen in the timeline of the run"))
    return e.select("event_id", expr.one_line(F.col("event_type"), (F.floor(F.col("value") * 10) * 100).cast("double"), text).alias("line"))


@query("""SELECT event_id, replace(replace('{user} did {type} and {other}', '{user}', user_id::VARCHAR), '{type}', event_type) AS t FROM events""")
def template_fill(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", expr.filled(F.lit("{user} did {type} and {other}"), {"user": F.col("user_id").cast("string"), "type": F.col("event_type")}).alias("t"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events""")
def json_events(spark, sf_dir):
    """A single object is read as an array of one; what is malformed is skipped."""
    text = F.when(F.col("props").startswith("{"), F.concat(F.lit("["), F.col("props"), F.lit("]"))).otherwise(F.col("props"))
    rows = read(spark, sf_dir, "events").select("event_id", F.explode(F.from_json(text, "array<struct<k:bigint>>")).alias("o"))
    return rows.select("event_id", F.col("o.k").alias("k"))


@query(
    """WITH v AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN '-12' WHEN 2 THEN '1.5' WHEN 3 THEN 'abc' WHEN 4 THEN '' ELSE '2e3' END AS t FROM documents)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'boolean' WHEN 1 THEN 'integer' WHEN 2 THEN 'float' WHEN 3 THEN 'string' WHEN 4 THEN 'ignored' ELSE 'float' END AS kind FROM v"""
)
def override_kinds(spark, sf_dir):
    values = F.array(*map(F.lit, ("true", "-12", "1.5", "abc", "", "2e3")))
    text = F.element_at(values, (F.col("doc_id") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", expr.typed_override(text).alias("kind"))


@query("""SELECT doc_id, substr(sha256(source || '|' || lang || '|' || n_chars), 1, 8) AS key FROM documents""")
def cache_keys(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", expr.cache_key(F.col("source"), F.col("lang"), F.col("n_chars").cast("string")).alias("key"))


@query(
    """SELECT doc_id, CASE WHEN 1548 * floor(2.0 * n_chars * 60 / 1000) <= 20 * n_chars THEN 2.0 ELSE greatest(0.5, floor(20 * n_chars / 1548.0) / (n_chars * 60 / 1000.0)) END::DOUBLE AS fps FROM documents"""
)
def budget_fps(spark, sf_dir):
    n = F.col("n_chars").cast("double")
    return read(spark, sf_dir, "documents").select("doc_id", expr.budget_fps(F.lit(2.0), n * 60, n * 20).alias("fps"))


@query(
    """WITH f AS (SELECT doc_id, text, lang, source, doc_id % 3 = 0 AS blank FROM documents)
SELECT doc_id, blank OR length(trim(text)) < 15 AS weak_text, lang = 'de' AS no_title, coalesce(nullif(CASE WHEN blank THEN '' ELSE source END, ''), lang) AS filled FROM f"""
)
def enrichment_needs(spark, sf_dir):
    blank = F.col("doc_id") % 3 == 0
    text = F.when(blank, "").otherwise(F.col("text"))
    title = F.when(F.col("lang") == "de", "").otherwise(F.col("lang"))
    return read(spark, sf_dir, "documents").select(
        "doc_id", enrich.weak(text).alias("weak_text"), (~enrich.present(title)).alias("no_title"), F.coalesce(F.nullif(F.when(blank, "").otherwise(F.col("source")), F.lit("")), F.col("lang")).alias("filled")
    )


@query(
    f"""WITH {E} SELECT session, seq, greatest(0, least(floor(x)::BIGINT * 4 - 128, 1664)) AS rx, greatest(0, least((y * 10)::BIGINT - 128, 824)) AS ry FROM e"""
)
def roi_rects(spark, sf_dir):
    r = expr.region_around(F.floor("x") * 4, (F.col("y") * 10).cast("long"), 1920, 1080, 256)
    return timeline(spark, sf_dir).select("session", "seq", r.alias("r")).select("session", "seq", "r.rx", "r.ry")


@query("""SELECT user_id AS session, max((event_id % 17)::INTEGER) AS iteration, count(DISTINCT event_id % 17) AS iterations FROM events GROUP BY user_id""")
def latest_iteration(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 17).cast("string").alias("name"))
    n = F.col("name").cast("int")
    return e.groupBy("session").agg(F.max(n).alias("iteration"), F.count_distinct("name").alias("iterations"))


@query(
    f"""WITH {E}, s AS (SELECT session, max(ts) - min(ts) AS d FROM e GROUP BY session), n AS (SELECT session, d, greatest(1, ceil(d / {75 * H})) AS n FROM s WHERE d > 0)
SELECT session, sum(floor(((k + 1) * (d / n) - k * (d / n)) / 1000 * 0.001 * 263))::BIGINT AS tokens FROM (SELECT *, unnest(range(0, n::BIGINT)) AS k FROM n) GROUP BY session"""
)
def estimated_tokens(spark, sf_dir):
    from ..operators.windows import segments

    s = timeline(spark, sf_dir).groupBy("session").agg((F.max("ts") - F.min("ts")).alias("d"))
    return moments.estimated_tokens(segments(s, "d", 75 * H, 0.0), 0.001)

"""Exact rounding, kept stages, field-level merge, judge samples and texts, each against a plain statement of its rule."""

import difflib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tempora.functions import exact
from tempora.operators import enrich, matching, texts
from tempora.plans import graph


def test_rounding_is_that_of_the_exact_binary_value(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 2.675, 0.125, 0.375, 1000.25, 1000.35, 0.5, 1.5, 2.5, -0.5, 1e-30, -1e-30, 5e-324, 2.0**52 + 1, 2.0**53, 9.2e18, -2.675]
    values += [rng.uniform(-1e6, 1e6) for _ in range(2000)] + [rng.randint(-(10**7), 10**7) / 2 ** rng.randint(0, 20) for _ in range(2000)]
    values += [rng.randint(-(10**6), 10**6) / 10 ** rng.randint(0, 6) for _ in range(2000)] + [math.ldexp(rng.random(), rng.randint(-80, 60)) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for n in (0, 1, 2, 4):
        for r in df.select("x", exact.fixed(F.col("x"), n).alias("text"), exact.rounded(F.col("x"), n).alias("value")).collect():
            assert (r["text"], r["value"]) == (f"{r['x']:.{n}f}", round(r["x"], n))
    odd = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (-math.inf,)], "x double")
    assert [r[0] for r in odd.select(exact.fixed(F.col("x"), 2)).collect()] == [None, "nan", "inf", "-inf"]
    assert [str(r[0]) for r in odd.select(exact.rounded(F.col("x"), 2)).collect()] == ["None", "nan", "inf", "-inf"]
    with pytest.raises(ValueError):
        exact.fixed(F.col("x"), 10)


def test_reported_metrics_have_the_digits_of_a_report(spark):
    df = spark.createDataFrame([(0.12345, 0.00005, 2.25, None)], "precision double, f1 double, start_error double, end_error double")
    assert tuple(matching.reported(df).first()) == (round(0.12345, 4), round(0.00005, 4), 2.2, None)


def _stages(calls, least=2):
    def low(t, least):
        calls.append("low")
        return t["rows"].filter(F.col("v") >= least)

    def sums(t, _):
        calls.append("sums")
        return t["low"].groupBy("k").agg(F.sum("v").alias("v"))

    def notes(t, _):
        calls.append("notes")
        return t["rows"].select(F.lit("note").alias("text")).limit(1)

    def report(t, _):
        calls.append("report")
        n = 0 if t["notes"] is None else t["notes"].count()
        return t["sums"].withColumn("notes", F.lit(n))

    return [
        graph.Stage("low", low, ("rows",), {"least": least}["least"]),
        graph.Stage("sums", sums, ("low",)),
        graph.Stage("notes", notes, ("rows",), {"b": (1, 2), "a": {"x"}}),
        graph.Stage("report", report, ("sums", "notes")),
    ]


def test_stages_are_kept_by_what_they_are_made_from(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, i) for i in range(9)], "k long, v long")
    source, calls = {"rows": ("one", rows)}, []
    run = lambda stages, **more: graph.Graph(f"file://{tmp_path}/a", stages).run(spark, source, **more)
    tables, made = run(_stages(calls), stop_after="sums")
    assert made == calls == ["low", "sums"] and set(tables) == {"low", "sums"}
    tables, made = run(_stages(calls))
    assert made == ["notes", "report"] and {tuple(r) for r in tables["report"].collect()} == {(0, 9, 1), (1, 11, 1), (2, 15, 1)}
    assert run(_stages(calls))[1] == []
    calls.clear()
    tables, made = run(_stages(calls, least=4))  # what does not depend on it is read
    assert made == calls == ["low", "sums", "report"] and {tuple(r) for r in tables["report"].collect()} == {(0, 6, 1), (1, 11, 1), (2, 13, 1)}
    tables, made = run(_stages(calls), skip=["notes"])
    assert made == ["report"] and {r["notes"] for r in tables["report"].collect()} == {0} and "notes" not in tables
    changed = graph.Graph(f"file://{tmp_path}/a", _stages(calls)).run(spark, {"rows": ("two", rows.limit(1))})[1]
    assert changed == ["low", "sums", "notes", "report"]
    for bad in ({"skip": ["x"]}, {"stop_after": "x"}):
        with pytest.raises(ValueError):
            run(_stages(calls), **bad)
    with pytest.raises(ValueError):
        graph.Graph("r", [graph.Stage("a", None, ("nowhere",))]).keys({})
    with pytest.raises(ValueError):
        graph.Graph("r", [graph.Stage("a", None), graph.Stage("a", None)])


def test_a_broken_run_goes_on_and_tables_are_copied(spark, tmp_path):
    rows, calls = spark.createDataFrame([(1, 5)], "k long, v long"), []
    g = graph.Graph(f"file://{tmp_path}/a", _stages(calls))
    g.run(spark, {"rows": ("one", rows)})
    broken = g.path("sums", g.keys({"rows": "one"})["sums"]).removeprefix("file://")
    import os

    os.unlink(f"{broken}/_SUCCESS")
    assert g.run(spark, {"rows": ("one", rows)})[1] == ["sums"]
    os.unlink(f"{broken}/_SUCCESS")
    copied = graph.backfill(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b")
    assert sorted(c.rpartition("-")[0] for c in copied) == ["low", "notes", "report"]  # not the broken one
    assert graph.backfill(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b") == []
    assert graph.Graph(f"file://{tmp_path}/b", _stages(calls)).run(spark, {"rows": ("one", rows)})[1] == ["sums"]
    assert graph.backfill(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/b") == []


def test_fingerprint_follows_the_files(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    one = graph.fingerprint(spark, f"file://{tmp_path}/t")
    assert one == graph.fingerprint(spark, f"file://{tmp_path}/t")
    spark.range(3).write.mode("append").parquet(f"{tmp_path}/t")
    assert one != graph.fingerprint(spark, f"file://{tmp_path}/t")


TEXT = [None, "", "   ", "short", "just fifteen ch", "long enough to say something", " wide space "]


def test_fields_are_merged_by_their_rules(spark):
    rng = random.Random(5)
    fields = list(enrich.RULES)
    schema = "session long, seq long, " + ", ".join(f"{c} string" for c in fields)
    events = [(1, i, *(rng.choice(TEXT) for _ in fields)) for i in range(80)]
    answers = [(1, rng.randrange(90), p, *(rng.choice(TEXT) for _ in fields)) for p in range(120)]
    e = spark.createDataFrame(events, schema).withColumn("_new", F.lit(7))
    a = spark.createDataFrame(answers, schema.replace("seq long,", "seq long, place long,"))
    strong = lambda t: t is not None and len(t.strip()) >= 15

    def expect(row):
        out = list(row[2:])
        for k, c in enumerate(fields):
            rule = enrich.RULES[c]
            said = [x[3 + k] for x in answers if x[1] == row[1] and (strong(x[3 + k]) if rule == "weak" else x[3 + k])]
            if said and (rule == "set" or (rule == "weak" and not strong(out[k])) or (rule == "missing" and not out[k])):
                out[k] = said[-1]
        return tuple(out)

    once = enrich.merged_fields(e, a)
    found = {r["seq"]: tuple(r[c] for c in fields) for r in once.collect()}
    assert found == {r[1]: expect(r) for r in events} and once.columns == e.columns
    assert {r["seq"]: tuple(r[c] for c in fields) for r in enrich.merged_fields(once, a).collect()} == found
    n = {r["seq"]: r for r in enrich.needs(e).collect()}
    for r in events:
        row = dict(zip(fields, r[2:]))
        assert n[r[1]]["needs_any"] == (not row["frame_description"]) and n[r[1]]["needs_description"] == (not strong(row["description"]))
        assert n[r[1]]["needs_page_title"] == (not row["page_title"])
    assert enrich.merged_fields(e, a.limit(0)).exceptAll(e).count() == 0


@pytest.mark.parametrize("strategy, fill", [("stratified", "remainder"), ("all", "confidence"), ("low_confidence", "remainder")])
def test_validation_sample(spark, strategy, fill):
    rng = random.Random(6)
    rows = [(s, i, rng.choice("aabbbbcd"), rng.choice([None, 0.1, 0.5, 0.9])) for s in range(6) for i in range(rng.randint(1, 60))]
    df = spark.createDataFrame(rows, "session long, seq long, type string, confidence double")
    most = {0: 0, 1: 5, 2: 7, 3: 13, 4: 20, 5: 1000}
    limit = F.element_at(F.create_map(*(F.lit(v) for kv in most.items() for v in kv)), F.col("session").cast("int"))
    found = [tuple(r)[:3] for r in enrich.validation_sample(df, limit, strategy, fill, seed=3).collect()]
    again = [tuple(r)[:3] for r in enrich.validation_sample(df.repartition(3, "type"), limit, strategy, fill, seed=3).collect()]
    assert sorted(found) == sorted(again) and len(set(found)) == len(found)
    for s, m in most.items():
        own = [r for r in rows if r[0] == s]
        seats = len(own) if m <= 0 else min(m, len(own))
        got = [r for r in found if r[0] == s]
        assert len(got) == seats
        unsure = sorted(own, key=lambda r: (-1 if r[3] is None else r[3], r[1]))
        if strategy == "low_confidence":
            assert sorted(got) == sorted(r[:3] for r in unsure[:seats])
            continue
        n = Counter(r[2] for r in own)
        quota = {t: Fraction(seats * c, len(own)) for t, c in n.items()}
        share = {t: math.floor(q) for t, q in quota.items()}
        if fill == "remainder":
            for t in sorted(quota, key=lambda t: (share[t] - quota[t], t))[: seats - sum(share.values())]:
                share[t] += 1
            assert Counter(r[2] for r in got) == Counter({t: c for t, c in share.items() if c})
        else:
            assert all(Counter(r[2] for r in got)[t] >= c for t, c in share.items())
    with pytest.raises(ValueError):
        enrich.validation_sample(df, limit, "some")


def test_verdicts(spark):
    rows = [(1, "correct"), (1, "incorrect"), (1, "unverifiable"), (1, None), (1, "?"), (1, "partially_correct"), (2, "unverifiable")]
    df = spark.createDataFrame(rows, "session long, v string").select("session", *(F.col("v").alias(f"{a}_verdict") for a in enrich.ASPECTS))
    r = {x["session"]: x for x in enrich.verdicts(df, ["session"]).collect()}
    assert (r[1]["events"], r[1]["type_correct"], r[1]["timing_unverifiable"], r[1]["overall_accuracy"]) == (6, 1, 3, 1 / 3)
    assert r[2]["target_accuracy"] is None


def test_text_changes_are_those_of_difflib(spark):
    rng = random.Random(7)
    ends = ["\n", "\n", "\n", "\r\n", "\x0b", " ", "\r"]

    def text(words, n):
        t = "".join(rng.choice(words) + rng.choice(ends) for _ in range(n))
        return t if rng.random() < 0.7 else t.rstrip()

    base, other = {}, {}
    for i in range(60):
        base[i] = text("abcdefgh", rng.randint(0, 40))
        kept = base[i].split("\n")
        for _ in range(rng.randint(0, 4)):
            kept.insert(rng.randrange(len(kept) + 1), rng.choice("xyz"))
        other[i] = "\n".join(kept) if i % 4 else base[i]
    base[90], other[91], base[92], other[92] = "only here\n", "only there", "", None
    base[93], other[93] = text("ab", 400), text("ab", 400)  # popular lines
    a, b = (spark.createDataFrame(list(d.items()), "session long, text string") for d in (base, other))
    rows = {r["session"]: r for r in texts.text_changes(a, b, ["session"], labels=("one", "two")).collect()}
    assert set(rows) == set(base) | set(other)
    for i, r in rows.items():
        x, y = ((d.get(i) or "").splitlines(keepends=True) for d in (base, other))
        diff = list(difflib.unified_diff(x, y, f"{i} (one)", f"{i} (two)", lineterm=""))
        assert (r["base_lines"], r["other_lines"], r["identical"], r["diff"]) == (len(x), len(y), not diff, "\n".join(diff) if diff else None)
        assert (r["base_present"], r["other_present"]) == (i in base, i in other)


def test_summary_lines_and_prompts(spark):
    spans = spark.createDataFrame(
        [(1, 0, 1500.7, 1700.2, "stationary", 3.0, 4.0, 3.0, 4.0), (1, 0, 1100.0, 1500.0, "moved", 1.0, 2.0, 3.0, 4.0), (1, 1, 9.0, 10.0, "not-detected", None, None, None, None)],
        "session long, segment int, start double, end double, kind string, x double, y double, to_x double, to_y double",
    )
    segments = spark.createDataFrame([(1, 0, 1000.0), (1, 1, 0.0), (1, 2, 5.0)], "session long, segment int, start double")
    found = {r["segment"]: r["text"] for r in texts.cursor_lines(spans, segments).collect()}
    assert found == {0: "100-500ms: moved from (1,2) to (3,4)\n500-700ms: stationary pos=(3,4)", 1: "9-10ms: not-detected", 2: ""}
    flows = spark.createDataFrame([(1, 0, 1000.0, 1250.0, "scroll-down", 4.25)], "session long, segment int, start double, end double, direction string, magnitude double")
    assert texts.flow_lines(flows, segments).filter("segment = 0").first()["text"] == "0-250ms: scroll-down magnitude=4.2"
    df = spark.createDataFrame([("a {n} {s}{t}{u}", 3, True, "x{n}"), ("{s}", None, False, None)], "t string, n int, ok boolean, v string")
    out = df.select(texts.rendered(F.col("t"), {"n": F.col("n"), "v": F.col("v")}, {"s": (F.col("ok"), F.lit("[{v}]")), "t": (~F.col("ok"), F.lit("no"))})).collect()
    assert [r[0] for r in out] == ["a 3 [x{n}]{u}", ""]


def test_needs_summary_counts_types(spark):
    df = spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", "seen"), (1, 2, "a", ""), (2, 0, "a", "seen")], "session long, seq long, type string, frame_description string")
    rows = defaultdict(dict, {r["session"]: r.asDict() for r in enrich.needs_summary(df).collect()})
    assert (rows[1]["events"], rows[1]["needy"], rows[1]["by_type"]) == (3, 2, {"a": 2}) and rows[2]["needy"] == 0 and not rows[2]["by_type"]


def test_report_tables_keep_a_row_on_a_line(spark):
    df = spark.createDataFrame([(1, 2, "a|b"), (1, 1, "x\ny"), (2, 1, None)], "session long, seq long, v string")
    out = {r["session"]: r["text"] for r in texts.table_text(df, {"No": F.col("seq"), "Text": F.col("v")}, ["seq"], ["session"]).collect()}
    assert out == {1: "| No | Text |\n|---|---|\n| 1 | x y |\n| 2 | a\\|b |", 2: "| No | Text |\n|---|---|\n| 1 | - |"}

"""Sources, composed stages, provider interface and streams on small tables."""

import json
from datetime import datetime

import numpy as np
import pytest

from tempora import config
from tempora.plans import stages
from tempora.sources import discovery, provider
from tempora.sources import json as source
from tempora.streaming import windows as streams


def test_events_and_runs(spark, tmp_path):
    for name, text in (("a", '[{"type": "click", "time_start": 1.0}, {"no": 1}]'), ("b", '{"type": "hover", "time_start": 2.0}'), ("c", "[]")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "events.json").write_text(text)
    rows = source.events(spark, f"{tmp_path}/*/events.json").orderBy("session_id").collect()
    assert [(r["session_id"], r["type"]) for r in rows] == [("a", "click"), ("b", "hover")]
    assert source.events(spark, f"{tmp_path}/*/none.json").count() == 0
    for i, text in enumerate(('{"session": "s", "timestamp": "2026-01-01"}', "{broken", '{"session": "t", "timestamp": "2026-02-01"}')):
        (tmp_path / f"run{i}.json").write_text(text)
    assert [r["session"] for r in source.runs(spark, f"{tmp_path}/run*.json").collect()] == ["t", "s"]


def test_written_events_drop_nulls(spark, tmp_path):
    df = spark.createDataFrame(
        [("s", 0, 1.0, "click", None), ("s", 1, 2.0, "navigate", None)], "session_id string, seq long, time_start double, type string, cursor_position struct<x:double,y:double>"
    )
    source.write_events(df, f"{tmp_path}/e")
    source.write_cursor_events(df, f"{tmp_path}/c", ["click"])
    lines = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/c").collect()]
    assert [("cursor_position" in x) for x in sorted(lines, key=lambda x: x["seq"])] == [True, False]
    assert all("cursor_position" not in json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/e").collect())


def test_stage_tables(spark, tmp_path):
    assert source.stage(spark, f"{tmp_path}/none", "a LONG") is None
    source.write_stage(spark.range(3).withColumnRenamed("id", "a"), f"{tmp_path}/t")
    assert source.stage(spark, f"{tmp_path}/t", "a LONG").count() == 3
    with pytest.raises(ValueError):
        source.stage(spark, f"{tmp_path}/t", "a STRING")


def test_discovery(spark):
    f = spark.createDataFrame([("x", "2"), ("x", "10"), ("x", "old")], "branch string, name string")
    assert discovery.latest_iteration(f, "branch", "name").first()["iteration"] == 10


def test_sessions(spark, tmp_path):
    text = [{"identifier": i, "data": {"screenTrack": f"{i}.mov", "normalizedScreenTrack": f"{i}.mp4"}} for i in "ab"]
    (tmp_path / "m.json").write_text(json.dumps(text))
    s = source.manifest(spark, f"{tmp_path}/m.json")
    files = spark.createDataFrame([("b.mp4",)], "path string")
    assert {r["identifier"]: r["video"] for r in discovery.screen_track(s, files).collect()} == {"a": "a.mov", "b": "b.mp4"}
    only_b = s.filter("identifier = 'b'")
    assert [r["identifier"] for r in discovery.with_baselines(s, only_b).collect()] == ["b"]
    assert [r["identifier"] for r in discovery.unfinished(s, only_b).collect()] == ["a"]
    asked = spark.createDataFrame([("a",), ("z",)], "identifier string")
    assert [r["identifier"] for r in discovery.unknown(s, asked).collect()] == ["z"]
    probed = spark.createDataFrame([("a", 12.34)], "identifier string, duration_ms double")
    assert {r["identifier"]: r["screenTrackDurationMs"] for r in discovery.with_durations(s, probed).collect()} == {"a": 12.3, "b": None}
    source.write_manifest(s, f"{tmp_path}/out")
    assert sorted(source.manifest(spark, f"{tmp_path}/out").collect()) == sorted(s.collect())
    answers = spark.createDataFrame([(1, '{"type": "click", "description": "x"}'), (2, "not json"), (3, '[{"type": "hover", "confidence": 0.9}, {"no": 1}]')], "r long, text string")
    found = source.parsed_responses(answers, "text", "type: string, description: string, confidence: double").collect()
    assert sorted((r["r"], r["type"], r["confidence"]) for r in found) == [(1, "click", 0.5), (3, "hover", 0.9)]


def test_provider_isolates_failures(spark):
    def answer(prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        return provider.Answer(prompt.upper(), 1, 2)

    waits = []
    with pytest.raises(RuntimeError):
        provider.ask(answer, "bad", sleep=waits.append)
    assert waits == [2.0, 4.0]
    quick = lambda p: provider.Answer(p.upper(), 1, 2)
    df = spark.createDataFrame([("1", "ok")], "request_id string, prompt string")
    assert provider.ask_all(df, quick).first()["text"] == "OK"


def test_pixels():
    a, b = np.zeros((40, 60), np.uint8), np.zeros((40, 60), np.uint8)
    b[5:15, 10:30] = 255
    b[30:35, 50:55] = 255
    magnitude, box = provider.frame_difference(a, b)
    assert box == (10, 5, 45, 30) and abs(magnitude - 225 / 2400) < 1e-9
    assert provider.changed_regions(a, b, least=20) == [(10, 5, 20, 10, 200), (50, 30, 5, 5, 25)]
    assert provider.changed_regions(a, b, least=100) == [(10, 5, 20, 10, 200)]


def test_triage_covers_the_recording(spark):
    rows = [(1, i, i * 200.0, 0.001 if i < 100 else 0.2) for i in range(200)]
    diffs = spark.createDataFrame(rows, "session long, seq long, ts double, magnitude double")
    total = spark.createDataFrame([(1, 40000.0)], "session long, duration double")
    out = stages.triage(diffs, total).orderBy("segment").collect()
    assert out[0]["start"] == 0.0 and out[-1]["end"] == 39800.0
    assert all(a["end"] == b["start"] for a, b in zip(out, out[1:]))
    assert (out[0]["tier"], out[0]["fps"], out[-1]["tier"], out[-1]["fps"]) == ("idle", 0.5, "high", 10.0)


def test_local_events_and_moments(spark):
    still = [(1, i, i * 100.0, 50.0, 50.0, 1.0, True) for i in range(30)]
    move = [(1, 30 + i, 3000.0 + i * 100, 50.0 + 40 * i, 50.0, 1.0, True) for i in range(10)]
    t = spark.createDataFrame(still + move, "session long, seq long, ts double, x double, y double, confidence double, detected boolean")
    flow = spark.createDataFrame([(1, 0, 3200.0, 4200.0, 5.0, "N", 0.9)], "session long, seq long, start double, end double, magnitude double, direction string, uniformity double")
    kinds = {r["type"] for r in stages.local_events(t, flow).collect()}
    assert {"dwell", "scroll"} <= kinds and "hover" not in kinds
    changes = spark.createDataFrame(
        [(1, 0, 5000.0, 5500.0, "scene_change", 0.0, 0.0, 900.0, 900.0), (1, 1, 20000.0, 20100.0, "local_change", 5.0, 5.0, 100.0, 50.0)],
        "session long, seq long, start double, end double, category string, x double, y double, w double, h double",
    )
    none = "session long, seq long, start double, end double, category string"
    stop = spark.createDataFrame([(1, 5, 30000.0, 30500.0)], "session long, seq long, start double, end double")
    total = spark.createDataFrame([(1, 60000.0)], "session long, duration double")
    m = stages.moments(changes, spark.createDataFrame([], none), stop, stop.limit(0), total, 1920, 1080).orderBy("start").collect()
    assert [r["category"] for r in m] == ["scene_change", "interaction", "cursor_stop"]
    assert m[0]["tokens"] == 1548


def test_frames_resolve_and_context_goes(spark):
    frames = spark.createDataFrame([(1, 0, 0, 0, 100.0, True), (1, 0, 1, 1, 200.0, False), (1, 0, 2, 2, 300.0, True)], "session long, segment int, seq long, frame int, ts double, is_context boolean")
    raw = spark.createDataFrame([(1, 0, 0, 0, 1), (1, 0, 1, 2, 2), (1, 0, 2, 1, 9)], "session long, segment int, seq long, first int, last int")
    assert [(r["seq"], r["start"], r["end"]) for r in stages.resolved(raw, frames).collect()] == [(0, 100.0, 200.0)]


def test_overridden_stage():
    assert stages.stage("merge", {"triage": len}) is stages.merged and stages.stage("triage", {"triage": len}) is len


def test_stream(spark, tmp_path):
    rows = [(1, datetime(2026, 1, 1, 0, 0, s), float(s)) for s in (1, 2, 3, 30)]
    spark.createDataFrame(rows, "session long, at timestamp, x double").write.parquet(f"{tmp_path}/in")
    read = spark.readStream.schema("session long, at timestamp, x double").parquet(f"{tmp_path}/in")
    q = streams.activity(read, "at", "x", "10 seconds", "10 seconds", "1 minute").writeStream.outputMode("complete").format("memory").queryName("activity").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["n"], r["mean"]) for r in spark.sql("SELECT * FROM activity").collect()) == [(1, 30.0), (3, 2.0)]


def test_defaults():
    assert config.Triage().medium == 0.08 and config.Merge().similarity == 0.7 and config.Evaluation().two_pass_ms == 5000


def test_manifest_round_trip(spark, tmp_path):
    rows = [(f"s{i}", f"study{i % 2}") for i in range(5)]
    first = spark.createDataFrame(rows, "identifier string, studyId string").repartition(2)
    source.write_manifest(first, str(tmp_path / "m"))
    again = source.manifest(spark, str(tmp_path / "m"))
    assert sorted((r["identifier"], r["studyId"]) for r in again.collect()) == rows
    source.write_manifest(again.coalesce(1), str(tmp_path / "n"))
    assert sorted(source.manifest(spark, str(tmp_path / "n")).collect()) == sorted(again.collect())


def test_settings_and_layers(spark, tmp_path):
    (tmp_path / "base.yaml").write_text("triage:\n  idle: 0.01\n  fps: {low: 2}\nname: base\n")
    base = source.settings(spark, str(tmp_path / "base.yaml"))
    assert source.settings(spark, str(tmp_path / "none.yaml")) == {}
    found = config.resolve(base, None, {"triage": {"fps": {"low": 3, "high": 9}}}, config.overrides(["name=x"]))
    assert found == {"triage": {"idle": 0.01, "fps": {"low": 3, "high": 9}}, "name": "x"}
    assert config.resolve({"a": {"b": 1}}, {"a": {}}) == {"a": {"b": 1}}
    assert config.resolve({"a": {"b": 1}}, {"a": 2}) == {"a": 2} and config.resolve({"a": 2}, {"a": {"b": 1}}) == {"a": {"b": 1}}


def _flooded(on):
    out, seen = [], set()
    for start in zip(*on.nonzero()):
        if start in seen:
            continue
        part, todo = {start}, [start]
        while todo:
            y, x = todo.pop()
            for p in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if p not in part and 0 <= p[0] < on.shape[0] and 0 <= p[1] < on.shape[1] and on[p]:
                    part.add(p)
                    todo.append(p)
        seen |= part
        ys, xs = [int(p[0]) for p in part], [int(p[1]) for p in part]
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(part)))
    return sorted(out, key=lambda r: (r[1], r[0]))


def test_changed_regions_against_flooding():
    import time

    import numpy as np

    from tempora.sources import provider

    rng = np.random.default_rng(1)
    for density in (0.05, 0.3, 0.45, 0.8):
        b = (rng.random((40, 50)) < density).astype(np.uint8) * 200
        found = provider.changed_regions(np.zeros((40, 50), np.uint8), b, least=2)
        assert sorted(found) == sorted(r for r in _flooded(b > 25) if r[4] >= 2)
    snake = np.zeros((401, 400), np.uint8)  # one region with a very long way through it
    snake[::2], snake[1::4, -1], snake[3::4, 0] = 200, 200, 200
    t = time.time()
    assert [r[4] for r in provider.changed_regions(np.zeros_like(snake), snake)] == [int((snake > 0).sum())]
    assert time.time() - t < 5
    assert provider.changed_regions(snake, snake) == []

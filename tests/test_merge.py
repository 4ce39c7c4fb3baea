"""The standalone merge against the plain rule, and the moments' functions."""

import random

import pytest
from pyspark.sql import functions as F

from tempora import config
from tempora.config import Merge
from tempora.functions.similarity import ratio
from tempora.operators import moments
from tempora.plans import merge


def _deduped(events, same):
    keep = []
    for e in events:
        k = next((i for i, o in enumerate(keep) if e["type"] == o["type"] and same(e, o)), None)
        if k is None:
            keep.append(e)
        elif e["confidence"] > keep[k]["confidence"]:
            keep[k] = e
    return keep


@pytest.mark.parametrize("seed", [1, 2])
def test_standalone_merge(spark, seed):
    rng = random.Random(seed)
    words = "open close the menu file save press link".split()
    segments = [(s, k, k * 9_000.0, k * 9_000.0 + 11_000.0) for s in (1, 2, 3) for k in range(4)]
    offsets = {1: 500.0, 2: -250.0, 3: 0.0}
    found = []
    for s, k, *_ in segments:
        for i in range(14):
            a = float(rng.randint(0, 10_900))
            text = " ".join(rng.choices(words, k=rng.randint(1, 4)))
            found.append((s, k, i, rng.choice(["click", "drag", "hover", "odd", "navigate"]), a, a + rng.choice([0.0, 300.0]), text, rng.choice([None, 0.3, 0.6, 0.9]), rng.choice([None, 7.25]), 8.0))
    track = [(s, i, i * 170.0, rng.random() * 100, float(i % 50) + 0.5, rng.choice([0.0, 0.4]), rng.random() < 0.4) for s in (1, 2) for i in range(220)]
    df = spark.createDataFrame(found, "session long, segment long, seq long, type string, start double, end double, description string, confidence double, cursor_x double, cursor_y double")
    seg = spark.createDataFrame(segments, "session long, segment long, start double, end double")
    path = spark.createDataFrame(track, "session long, seq long, ts double, x double, y double, confidence double, detected boolean")
    off = spark.createDataFrame(list(offsets.items()), "session long, offset double")
    c = Merge(tolerance_ms=2500.0, similarity=0.45, overlap_close_ms=1500.0, overlap_similarity=0.3)
    rows = {}
    for r in merge.standalone(df, seg, path, off, c=c).collect():
        rows.setdefault(r["session"], []).append((r["position"], r["type"], r["start"], r["end"], r["description"], r["confidence"], r["x"], r["y"]))
    for s, shift in offsets.items():
        events = []
        for f in found:
            if f[0] == s:
                begin = f[1] * 9_000.0 + shift
                own = f[8] is not None
                events.append(dict(type=f[3] if f[3] in config.EVENT_TYPES else "change_ui_state", start=f[4] + begin, end=f[5] + begin, text=f[6], confidence=0.5 if f[7] is None else f[7], x=round(f[8], 1) if own else None, y=8.0 if own else None, key=(f[4] + begin, f[1], f[2])))
        events.sort(key=lambda e: e["key"])
        spans = [(b[2] + shift, a[3] + shift) for a, b in zip(segments[:4], segments[1:4])]
        inside = lambda t: any(a <= t <= z for a, z in spans)
        first = _deduped(events, lambda e, o: (inside(e["start"]) or inside(o["start"])) and abs(e["start"] - o["start"]) <= 1500 and ratio(e["text"], o["text"]) >= 0.3)
        second = _deduped(first, lambda e, o: e["start"] <= o["end"] + 2500 and o["start"] <= e["end"] + 2500 and ratio(e["text"], o["text"]) >= 0.45)
        mine = [t for t in track if t[0] == s]
        valid = lambda t: t[6] or t[5] > 0
        for e in second:
            if mine and e["type"] in (*merge.AT_START, *merge.MEAN_INSIDE):
                a, z = e["start"] - shift, e["end"] - shift
                if e["type"] in merge.MEAN_INSIDE:
                    hit = [t for t in mine if a <= t[2] < z and valid(t)]
                    e["x"], e["y"] = (float(round(sum(t[k] for t in hit) / len(hit))) if hit else None for k in (3, 4))
                else:
                    at = next((i for i, t in enumerate(mine) if t[2] >= a), len(mine))
                    near = [t for t in mine[max(0, at - 1) : at + 2] if valid(t) and abs(t[2] - a) < 500]
                    best = min(near, key=lambda t: abs(t[2] - a), default=None)
                    e["x"], e["y"] = (float(round(best[3])), float(round(best[4]))) if best else (None, None)
        want = [(i + 1, e["type"], e["start"], e["end"], e["text"], e["confidence"], e["x"], e["y"]) for i, e in enumerate(second)]
        assert len(first) < len(events) and len(second) < len(first)
        assert [r[:6] for r in sorted(rows[s])] == [w[:6] for w in want]
        assert [r[6:] for r in sorted(rows[s])] == [w[6:] for w in want]


def test_frame_times_of_moments(spark):
    df = spark.createDataFrame([("interaction", 100.0, 500.0, 4, True), ("interaction", 100.0, 500.0, 0, True), ("interaction", 100.0, 500.0, 0, False), ("scroll", 0.0, 90.0, 4, True), ("scroll", 5.0, 5.0, 4, None), ("scroll", 0.0, 90.0, 1, True)], "c string, a double, b double, n int, has boolean")
    out = [r[0] for r in df.select(moments.frame_times(F.col("c"), F.col("a"), F.col("b"), F.col("n"), F.col("has"))).collect()]
    assert out == [[0.0, 100 + 400 / 3, 100 + 800 / 3, 750.0], [0.0, 750.0], [300.0], [0.0, 30.0, 60.0, 90.0], [5.0], [45.0]]


def test_points_of_the_viewer_in_the_video(spark):
    df = spark.range(1)
    point = lambda x, y, w, h, nw=200, nh=100: df.select(moments.native_point(F.lit(x), F.lit(y), F.lit(0), F.lit(0), F.lit(w), F.lit(h), nw, nh)).first()[0]
    assert tuple(point(50.0, 100.0, 100, 200)) == (100, 50)  # bars above and below
    assert tuple(point(100.0, 25.0, 200, 50)) == (100, 50)  # bars on the sides
    assert tuple(point(-9.0, 999.0, 100, 200)) == (0, 100)
    assert point(1.0, 1.0, 100, 200, 0, 100) is None
    box = lambda b: df.select(moments.drag_box(F.struct(F.lit(10).alias("x"), F.lit(20).alias("y")), F.struct(F.lit(b[0]).alias("x"), F.lit(b[1]).alias("y")))).first()[0]
    assert tuple(box((4, 30))) == (4, 20, 6, 10) and box((14, 90)) is None and box((90, 24)) is None


def test_density_cap_keeps_one_at_least(spark):
    df = spark.createDataFrame([(1, i, float(i), 9 - i) for i in range(9)], "session long, seq long, start double, priority int")
    assert sorted(r["seq"] for r in moments.density_cap(df, F.lit(2.5), 1.0).collect()) == [7, 8]
    assert moments.density_cap(df, F.lit(0.1), 1.0).count() == 1 and moments.density_cap(df, F.lit(1.0), 0.0).count() == 9


def test_overrides_build_one_layer():
    assert config.overrides([" a.b = 1 ", "a.c=x=y", "d=TRUE", "e=", "=3", "f", "a.b=2.5", "g.h.i=-4"]) == {"a": {"b": 2.5, "c": "x=y"}, "d": True, "g": {"h": {"i": -4}}}
    assert config.overrides(["a=1", "a.b=2"]) == {"a": {"b": 2}}

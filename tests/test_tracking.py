"""Tracking operators and plans against direct statements of their rules on random rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tempora.config import Frames, Trajectory
from tempora.operators import tracking
from tempora.plans import observe

MATCH = "session long, seq long, k long, template string, x double, y double, confidence double"


def matches(rng, frames=60, most=6, size=60):
    return [
        (s, f, k, rng.choice("abc"), float(rng.randint(0, size)), float(rng.randint(0, size)), rng.randint(0, 20) / 20)
        for s in (1, 2) for f in range(frames) for k in range(rng.randint(0, most))
    ]


def _distinct(rows, threshold, within, early, distance):
    rows = [r for r in rows if r[6] > threshold]
    if not rows:
        return []
    best = max(rows, key=lambda r: (r[6], -r[2]))
    if best[6] >= early:
        return [best]
    out = []
    for r in sorted((r for r in rows if r[6] >= best[6] - within), key=lambda r: (-r[6], r[2])):
        if all(math.hypot(r[4] - o[4], r[5] - o[5]) >= distance for o in out):
            out.append(r)
    return out


@pytest.mark.parametrize("early, size", [(0.95, 60), (2.0, 60), (2.0, 2000)])
def test_distinct_candidates(spark, early, size):
    rng = random.Random(1)
    rows = matches(rng, 30, 40, size)
    df = spark.createDataFrame([*rows, (1, 3, 99, "a", None, 1.0, 0.9), (1, 3, 98, "a", 1.0, 1.0, None)], MATCH)
    want = sorted(r[:3] + r[4:] for s in (1, 2) for f in range(30) for r in _distinct([r for r in rows if r[:2] == (s, f)], 0.2, 0.5, early, 20.0))
    assert sorted(map(tuple, tracking.distinct_candidates(df, 0.2, 0.5, early, 20.0).collect())) == want
    assert tracking.distinct_candidates(df.limit(0), 0.2, 0.5, early, 20.0).count() == 0


def test_points_apart_look_at_few_others():
    import time

    import numpy as np

    rng = np.random.default_rng(0)
    x, y = rng.random(60_000) * 3000, rng.random(60_000) * 3000
    t = time.time()
    kept = tracking.apart(x, y, 20.0)
    assert time.time() - t < 10
    near = [min(math.hypot(x[i] - x[j], y[i] - y[j]) for j in kept if j != i) for i in kept[:200]]
    assert min(near) >= 20.0


def _one(rows, threshold, early):
    best, sure = None, threshold
    for r in rows:
        if r[6] > sure:
            best, sure = r, r[6]
            if sure >= early:
                break
    return best


def test_first_or_best_and_sticky_matches(spark):
    rng = random.Random(2)
    rows = matches(rng, 80, 5)
    df, frames = spark.createDataFrame(rows, MATCH), spark.createDataFrame([(s, f, f * 10.0) for s in (1, 2) for f in range(80)], "session long, seq long, ts double")
    want, sticky = set(), set()
    for s in (1, 2):
        last = None
        for f in range(80):
            own = [r for r in rows if r[:2] == (s, f)]
            best = _one(own, 0.3, 0.8)
            if best:
                want.add((s, f, best[2]))
            found = _one([r for r in own if r[3] == last], 0.3, 0.8) or best
            last = found[3] if found else None
            sticky.add((s, f, found[4], found[5], found[6], last, True) if found else (s, f, 0.0, 0.0, 0.0, "", False))
    assert {(r["session"], r["seq"], r["k"]) for r in tracking.first_or_best(df, 0.3, 0.8).collect()} == want
    found = tracking.sticky_matches(frames, df, 0.3, 0.8).drop("ts").collect()
    assert len(found) == 160 and set(map(tuple, found)) == sticky
    assert tracking.sticky_matches(frames.limit(0), df, 0.3, 0.8).count() == 0


def _resolved(frames, rows, flows, scale, cell, gap, visits):
    """The rule said plainly: frames in order, unambiguous ones first."""
    own = {f: [r for r in rows if r[1] == f] for f, _ in frames}
    times = {}
    for f, t in frames:
        for r in own[f]:
            times.setdefault((round(r[4] / cell), round(r[5] / cell)), []).append(t)
    clusters = {c: 1 + sum(b - a > gap for a, b in zip(sorted(v), sorted(v)[1:])) for c, v in times.items()}
    place = lambda r, t: (t, float(round(r[4] * scale)), float(round(r[5] * scale)), r[6], r[3], True)
    done = [(t, 0.0, 0.0, 0.0, "", False) if not own[f] else place(own[f][0], t) if len(own[f]) == 1 else None for f, t in frames]
    for i, (f, t) in enumerate(frames):
        if done[i] is not None:
            continue
        prev = next((d for d in reversed(done[:i]) if d and d[5]), None)
        after = next((d for d in done[i + 1 :] if d and d[5]), None)
        expected = None
        if prev and after:
            if after[0] > prev[0]:
                p = (t - prev[0]) / (after[0] - prev[0])
                expected = [(prev[d] + (after[d] - prev[d]) * p) / scale for d in (1, 2)]
        elif prev or after:
            expected = [(prev or after)[d] / scale for d in (1, 2)]
        flow = next((w for w in flows if w[2] <= t <= w[3]), None)

        def score(r):
            value = r[6]
            if expected:
                away = math.hypot(r[4] - expected[0], r[5] - expected[1])
                value += 0.03 if away < 20 else 0.03 * (1 - (away - 20) / 80) if away < 100 else -0.02
            if flow and prev and flow[4] >= 3.0 and flow[5] >= 0.6:
                dx, dy = r[4] * scale - prev[1], r[5] * scale - prev[2]
                if math.hypot(dx, dy) > 1:
                    ux, uy = tracking.DIRECTIONS[flow[6]]
                    value -= 0.03 * max(0, (dx * ux + dy * uy) / math.hypot(dx, dy)) * min(flow[4] / 3.0, 1) * flow[5]
            n = clusters[round(r[4] / cell), round(r[5] / cell)]
            return value - (0.02 * min((n - visits) / 5, 1) if n > visits else 0)

        done[i] = place(max(own[f], key=score), t)
    return done


def test_resolved_candidates(spark):
    rng = random.Random(3)
    rows = [r[:6] + (r[6] + rng.random() / 1000,) for r in matches(rng, 70, 3, 120)]
    frames = [(f, f * 7.0 + 3) for f in range(70)]
    flows = [(s, i, a := rng.random() * 400, a + 90, rng.random() * 6, rng.random(), rng.choice(list(tracking.DIRECTIONS))) for s in (1, 2) for i in range(9)]
    df = spark.createDataFrame(rows, MATCH)
    timed = spark.createDataFrame([(s, *f) for s in (1, 2) for f in frames], "session long, seq long, ts double")
    flow = spark.createDataFrame(flows, "session long, seq long, start double, end double, magnitude double, uniformity double, direction string")
    found = {}
    for r in tracking.resolved_candidates(timed, df, flow, 1.5, 10.0, 30.0, 2, 50.0).collect():
        found[r["session"], r["seq"]] = tuple(r)[2:]
    for s in (1, 2):
        mine = sorted((w for w in flows if w[0] == s), key=lambda w: (w[2], w[1]))
        want = _resolved(frames, [r for r in rows if r[0] == s], mine, 1.5, 10.0, 30.0, 2)
        assert [found[s, f] for f, _ in frames] == want
    assert tracking.resolved_candidates(timed, df.limit(0), flow, 1.5).filter("detected").count() == 0


def _sample(frames, interval):
    out, nxt = [], -math.inf
    for f in frames:
        if f[2] >= nxt:
            out.append(f)
            nxt = f[2] + interval
    return out


def test_two_pass_scans_only_where_it_moved(spark, tmp_path):
    rng = random.Random(4)
    rows, x = [], 0.0
    for i in range(3000):
        if 1200 < i < 1400 or 2000 < i < 2050:
            x += rng.choice([0, 0, 90.0])
        rows.append((1, i, i * 10.0, x, 0.0, 0.9, rng.random() < 0.9))
    rows += [(2, i, i * 10.0, 5.0, 0.0, 0.9, True) for i in range(300)]
    columns = "session long, seq long, ts double, x double, y double, confidence double, detected boolean"
    spark.createDataFrame(rows, columns).withColumn("part", F.floor(F.col("ts") / 1000)).repartition("part").sortWithinPartitions("ts").write.partitionBy("part").parquet(f"{tmp_path}/frames")
    scans = []

    def scan(first, last):
        df = spark.read.parquet(f"{tmp_path}/frames")
        if first is not None:
            df = df.filter(F.col("part").between(int(first // 1000), int(last // 1000)) & F.col("ts").between(first, last))
        scans.append(df)
        return df.drop("part")

    c = Trajectory(displacement_px=30.0, padding_ms=200.0, max_gap_ms=0.0, smooth_window=3, smooth_px=-1.0)
    found = sorted((r["session"], r["seq"], r["x"], r["detected"]) for r in observe.two_pass(scan, lambda f: f, 500.0, 20.0, c).collect())
    want = []
    for s in (1, 2):
        frames = [r for r in rows if r[0] == s]
        coarse = _sample(frames, 500.0)
        seen = [r for r in coarse if r[6]]
        spans = []
        for a, b in zip(seen, seen[1:]):
            if abs(b[3] - a[3]) > 30:
                lo, hi = max(0.0, a[2] - 200), b[2] + 200
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
        inside = lambda r: any(a <= r[2] <= b for a, b in spans)
        picked = [r for r in coarse if not inside(r)] + [r for a, b in spans for r in _sample([r for r in frames if a <= r[2] <= b], 20.0)]
        want += [(s, r[1], r[3], r[6]) for r in picked]
    assert found == sorted(want)
    assert len(scans) == 2 and scans[1].count() < scans[0].count() / 2
    plan = scans[1]._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(part" in plan and "GreaterThanOrEqual(ts" in plan
    assert observe.two_pass(lambda a, b: spark.read.parquet(f"{tmp_path}/frames").drop("part").limit(0), lambda f: f, 500.0, 20.0, c).count() == 0


def test_selected_frames(spark):
    events = spark.createDataFrame([(1, 0, "click", 1000.0, 1100.0), (1, 1, "dwell", 2000.0, 4000.0), (1, 2, "scroll", 9000.0, 9500.0)], "session long, seq long, type string, start double, end double")
    diffs = spark.createDataFrame([(1, 0, 4000.0, 5000.0, 0.5), (1, 1, 5000.0, 6000.0, 0.01), (1, 2, 6100.0, 7000.0, 0.031), (1, 3, 8000.0, 9400.0, 0.9)], "session long, seq long, a double, b double, magnitude double")
    track = spark.createDataFrame([(1, 0, 950.0, 700.4, 30.0, True), (1, 1, 2900.0, 1900.0, 1070.0, False)], "session long, seq long, ts double, x double, y double, detected boolean")
    durations = spark.createDataFrame([(1, 20_000.0), (2, 12_000.0)], "session long, duration double")
    rows = observe.selected_frames(events, diffs, track, durations, 1920, 1080, Frames()).orderBy("session", "ts").collect()
    assert [(r["session"], r["ts"], r["reason"], r["event"]) for r in rows] == [
        (1, 1000.0, "event_start", 0),
        (1, 3000.0, "event_mid", 1),
        (1, 4000.0, "visual_change", None),
        (1, 5000.0, "visual_change", None),
        (1, 6100.0, "visual_change", None),
        (1, 7000.0, "visual_change", None),
        (1, 9000.0, "event_start", 2),
        (1, 9500.0, "event_end", 2),
        (1, 14_750.0, "baseline", None),
        (2, 6000.0, "baseline", None),
    ]
    assert [(r["rx"], r["ry"], r["rw"], r["rh"]) for r in rows if r["event"] is not None] == [(508, 0, 384, 384), (768, 348, 384, 384), (None,) * 4, (None,) * 4]

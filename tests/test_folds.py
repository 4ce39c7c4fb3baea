"""Hand-computed cases of the order-dependent operators and the rules that decide ties and ends."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora import config
from tempora.functions import expr, similarity
from tempora.operators import folds, joins, matching, reports, windows

TRAJECTORY = "session long, seq long, ts double, x double, y double, confidence double, detected boolean"


def trajectory(spark, rows):
    return spark.createDataFrame([(1, i, float(t), float(x), float(y), float(c), d) for i, (t, x, y, c, d) in enumerate(rows)], TRAJECTORY)


def test_single_sample_has_no_window(spark):
    one = spark.createDataFrame([(1, 0, 0.0, 1.0)], "session long, seq long, ts double, x double")
    assert windows.hop_windows(one, "x", 3000, 1000).count() == 0


def test_short_first_segment_stays(spark):
    rows = [(1, 0, 0.0, 2000.0, 0.0, "idle"), (1, 1, 2000.0, 22000.0, 1.0, "high")]
    w = spark.createDataFrame(rows, "session long, w long, start double, end double, mean double, tier string")
    assert [r["tier"] for r in windows.tier_segments(w, 5000).orderBy("segment").collect()] == ["idle", "high"]


def test_stationary_takes_the_first_rows_only():
    x = np.array([0.0, 5, 10, 30])
    assert folds.stationary_runs(np.arange(4.0), x, np.zeros(4), 10) == [(0, 2)]


def test_stationary_cut_at_far_steps_changes_nothing(spark):
    rng = np.random.default_rng(3)
    x, y = rng.uniform(0, 60, 300), rng.uniform(0, 60, 300)
    t = np.arange(300.0)
    df = trajectory(spark, [(a, b, c, 1, True) for a, b, c in zip(t, x, y)])
    found = sorted((r["start"], r["end"]) for r in folds.stationary(df, expr.valid(), 20.0).collect())
    assert found == [(t[a], t[b]) for a, b in folds.stationary_runs(t, x, y, 20.0)]


def test_interpolation(spark):
    rows = [(0, 0, 0, 0.8, True), (100, 7, 7, 0, False), (200, 10, 0, 0.6, True)]
    r = windows.interpolate(trajectory(spark, rows), 500).orderBy("ts").collect()[1]
    assert (r["x"], r["y"], r["confidence"], r["detected"]) == (5.0, 0.0, 0.3, False)
    rows[2] = (501, 10, 0, 0.6, True)
    r = windows.interpolate(trajectory(spark, rows), 500).orderBy("ts").collect()[1]
    assert (r["x"], r["confidence"]) == (7.0, 0.0)


def test_smoothing_is_in_place(spark):
    t = trajectory(spark, [(i, x, 0, 1.0, True) for i, x in enumerate([0.0, 6, 0, 6, 0])])
    assert [round(r["x"], 3) for r in folds.smooth(t, 3, 50).orderBy("ts").collect()] == [0, 2, 2.667, 2.889, 0]


def _walks(n=400, seed=0):
    """Random walks of two sessions with pauses, jumps, gaps and invalid rows: (session, ts, seq, x, y, confidence, detected)."""
    rng = np.random.default_rng(seed)
    rows = []
    for session in (1, 2):
        t = x = y = 0.0
        for i in range(n):
            t += float(rng.choice([50, 100, 400, 7000], p=[0.5, 0.3, 0.18, 0.02]))
            step = rng.choice([0.0, 0.6, 3.0, 9.0, 80.0], p=[0.3, 0.25, 0.2, 0.15, 0.1])
            x, y = x + float(step * rng.standard_normal()), y + float(step * rng.standard_normal())
            rows.append((session, t, i, x, y, float(rng.choice([0.0, 0.5, 0.9])), bool(rng.random() < 0.9)))
    return rows


WALK = "session long, ts double, seq long, x double, y double, confidence double, detected boolean"


@pytest.mark.parametrize("seed,window", [(0, 3), (1, 3), (2, 5)])
def test_smoothing_of_walks(spark, seed, window):
    rows, half, want = _walks(seed=seed), window // 2, []
    for s in (1, 2):
        mine = [list(r) for r in rows if r[0] == s]
        ok = [r[6] or r[5] > 0 for r in mine]
        for i in range(half, len(mine) - half):
            if ok[i]:
                bend = [abs(mine[i][k] - mine[i - 1][k]) + abs(mine[i + 1][k] - mine[i][k]) for k in (3, 4)]
                if np.hypot(*bend) <= 12.0:
                    use = [j for j in range(i - half, i + half + 1) if ok[j]]
                    mine[i][3], mine[i][4] = (float(np.mean([mine[j][k] for j in use])) for k in (3, 4))
        want += [(s, r[2], round(r[3], 6), round(r[4], 6)) for r in mine]
    found = folds.smooth(spark.createDataFrame(rows, WALK), window, 12.0).collect()
    assert sorted((r["session"], r["seq"], round(r["x"], 6), round(r["y"], 6)) for r in found) == want


@pytest.mark.parametrize("seed", [3, 4])
def test_click_candidates_of_walks(spark, seed):
    rows, want = _walks(seed=seed), []
    for s in (1, 2):
        p = [r for r in rows if r[0] == s]
        d = lambda a, b: np.hypot(p[a][3] - p[b][3], p[a][4] - p[b][4])  # noqa: E731, B023
        start = 1
        while start < len(p) - 1:
            stay = next((k for k in range(start + 1, len(p)) if d(k, start) > 5), len(p)) - 1
            brief = p[stay][1] - p[start][1] <= 450
            moves = d(start, start - 1) > 5 or (stay + 1 < len(p) and d(stay + 1, stay) > 5)
            if brief and moves:
                want.append((s, p[start][1], p[stay][1], stay - start + 1))
            start = stay + 1 if brief and moves else start + 1
    found = folds.clicks(spark.createDataFrame(rows, WALK), F.lit(True), 5.0, 450.0).collect()
    assert len(want) > 20 and sorted((r["session"], r["start"], r["end"], r["n"]) for r in found) == sorted(want)


def test_click_places_on_a_still_pointer_are_linear():
    import time

    n = 200_000
    g = {"ts": np.arange(n) * 10.0, "x": np.zeros(n), "y": np.zeros(n), "inner": np.ones(n, bool), "arrives": np.zeros(n, bool), "leaves": np.zeros(n, bool)}
    g["arrives"][5], g["leaves"][n - 3] = True, True
    t = time.time()
    assert folds.click_places(g, 5.0, 450.0) == []
    assert time.time() - t < 5
    g["x"][n - 2 :] = 99.0
    assert folds.click_places(g, 5.0, 450.0) == [(n - 48, n - 3)]


def test_nearest_neighbours_grow_with_the_rows(spark):
    """One session of 60,000 rows; a quadratic plan would take minutes."""
    n = 60_000
    t = spark.range(n).selectExpr("1L AS session", "id AS seq", "CAST(id * 10 AS double) AS ts", "CAST(id AS double) AS x", "0.0D AS y", "1.0D AS confidence", "id % 7 <> 0 AS detected")
    at = spark.range(n).selectExpr("1L AS session", "id AS seq", "CAST(id * 10 + 4 AS double) AS at")
    got = joins.nearest_neighbours(at, "at", t, 200, F.col("detected")).agg(F.sum("px"), F.count("px")).first()
    # The row 4 before, else (where that is undetected) the one 6 after.
    want = [i if i % 7 else i + 1 for i in range(n)]
    assert tuple(got) == (float(sum(want)), n)


def test_an_invalid_neighbour_hides_a_valid_one(spark):
    rows = [(90, 1, 1, 0, False), (100, 2, 2, 0, False), (110, 3, 3, 0, False), (120, 4, 4, 1, True)]
    at = spark.createDataFrame([(1, 7, 100.0)], "session long, seq long, at double")
    t = trajectory(spark, rows)
    assert joins.nearest_neighbours(at, "at", t, 200, expr.valid()).first()["px"] is None
    assert joins.nearest_detected(at, "at", t, 200).first()["px"] == 4.0


def test_followed_by_is_open_at_both_ends(spark):
    pause = spark.createDataFrame([(1, 0, 500.0, 1000.0)], "session long, seq long, start double, end double")
    for onset, hit in ((1000.0, 0), (1500.0, 1), (2000.0, 0)):
        action = spark.createDataFrame([(1, onset)], "session long, start double")
        assert joins.followed(pause, action, 1000).count() == hit


def test_dedup_keeps_the_surest(spark):
    rows = [(1, i, "click", i * 100.0, i * 100.0, "press the button", c) for i, c in enumerate((0.5, 0.9, 0.7))]
    df = spark.createDataFrame(rows, "session long, seq long, type string, start double, end double, description string, confidence double")
    assert [r["confidence"] for r in folds.dedup_events(df, 2000, 0.7, similarity.similar).collect()] == [0.9]


def test_frame_dedup_is_closed(spark):
    df = spark.createDataFrame([(1, 0, 100.0, 2), (1, 1, 300.0, 0)], "session long, seq long, ts double, priority int")
    assert [r["seq"] for r in folds.dedup_frames(df, 200).collect()] == [1]


def test_greedy_match(spark):
    pairs = spark.createDataFrame([(1, "a", 0, 0, 5, 0.6), (1, "a", 0, 1, 5, 0.8)], "session long, type string, island long, b long, e long, score double")
    assert [(r["b"], r["e"]) for r in matching.greedy(pairs).collect()] == [(1, 5)]


@pytest.mark.parametrize("end,want", [(None, 3.0), (0.0, 3.0), (5.0, 5.0)])
def test_effective_end(spark, end, want):
    df = spark.createDataFrame([(3.0, end)], "s double, e double")
    assert df.select(expr.effective_end(F.col("s"), F.col("e"))).first()[0] == want


def test_upper_median(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (4, 1, 3, 2)] + [(1, None), (2, 5.0), (3, None)], "session long, v double")
    out = reports.at_places(df, F.col("v"), ["session"], {"median": reports.upper_middle, "second": lambda n: F.lit(2)})
    assert sorted(map(tuple, out.collect())) == [(1, 3.0, 2.0), (2, 5.0, None)]


def test_budget_skips_and_goes_on(spark):
    rows = [(1, i, float(i), "interaction", i, t, 1.0) for i, t in enumerate((6, 5, 4))]
    df = spark.createDataFrame(rows, "session long, seq long, start double, category string, priority int, tokens long, minutes double")
    assert sorted(r["tokens"] for r in folds.within_budget(df, 10.0).collect()) == [4, 6]


def test_flow_without_a_vector_is_north(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, False)], "session long, dx double, dy double, ok boolean")
    r = reports.direction_mode(df, ["session"]).first()
    assert (r["direction"], r["uniformity"]) == ("N", 0.0)


def test_trend(spark):
    rows = [(i, 0, 10, 10, m, f) for i, (m, f) in enumerate(((1, 0.1), (3, 0.3), (2, 0.2)))]
    df = spark.createDataFrame(rows, "session long, all int, n_baseline long, n_found long, n_matched long, f1 double")
    assert matching.cumulative(df, "session", 0.02, ["all"]).orderBy("session").collect()[-1]["trend"] == "improving"


def test_overrides():
    assert config.overrides(["a.b=1", "a.c=x", "d=true", "e="]) == {"a": {"b": 1, "c": "x"}, "d": True}
    assert config.resolve({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


EVENTS = "session long, seq long, type string, start double, end double, description string, confidence double, in_overlap boolean"


def _events(seed, n=90):
    rng = np.random.default_rng(seed)
    words = "open the menu close save file button press link tab".split()
    rows, t = [], 0.0
    for i in range(n):
        t += float(rng.choice([0, 300, 1500, 9000], p=[0.1, 0.5, 0.3, 0.1]))
        text = " ".join(rng.choice(words, rng.integers(1, 6)))
        rows.append((int(i % 2), i, str(rng.choice(["click", "hover"])), t, t + float(rng.choice([0, 200, 4000])), text, float(rng.choice([0.3, 0.6, 0.9])), bool(rng.random() < 0.4)))
    return rows


def _kept(rows, same):
    out = []
    for key in sorted({(r[0], r[2]) for r in rows}):
        kept = []
        for r in sorted((r for r in rows if (r[0], r[2]) == key), key=lambda r: (r[3], r[1])):
            k = next((i for i, other in enumerate(kept) if same(r, other)), None)
            if k is None:
                kept.append(r)
            elif r[6] > kept[k][6]:
                kept[k] = r
        out += [(r[0], r[1]) for r in kept]
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_dedup_against_brute_force(spark, seed):
    rows = _events(seed)
    df = spark.createDataFrame(rows, EVENTS)
    alike = lambda a, b: similarity.ratio(a[5], b[5]) >= 0.6
    close = lambda a, b: a[3] <= b[4] + 2000 and b[3] <= a[4] + 2000 and alike(a, b)
    found = folds.dedup_events(df.drop("in_overlap"), 2000, 0.6, similarity.similar).collect()
    assert sorted((r["session"], r["seq"]) for r in found) == _kept(rows, close)
    over = lambda a, b: (a[7] or b[7]) and abs(a[3] - b[3]) <= 3000 and alike(a, b)
    found = folds.dedup_overlaps(df, 3000, 0.6, similarity.similar).collect()
    assert sorted((r["session"], r["seq"]) for r in found) == _kept(rows, over)


def test_similarity_bounds_change_nothing():
    texts = [r[5] for r in _events(5)] + ["", None, "MENU"]
    for a in texts:
        for b in texts:
            for least in (0.0, 0.3, 0.7, 1.0):
                assert similarity.similar(a, b, least) == (similarity.ratio(a, b) >= least)


@pytest.mark.parametrize("seed", [6, 7])
def test_cursor_rollup_of_walks(spark, seed):
    """Cut sessions give the spans that one pass over the whole session gives."""
    rows, want = _walks(seed=seed), []
    for s in (1, 2):
        mine, spans, run = [r for r in rows if r[0] == s], [], []
        for r in [*mine, None]:
            if r is not None and r[6]:
                run.append(r)
                continue
            i = 0
            while i < len(run):
                x, y, c = run[i][3], run[i][4], run[i][5]
                j = i
                while j + 1 < len(run) and abs(run[j + 1][3] - x) <= 1 and abs(run[j + 1][4] - y) <= 1 and abs(run[j + 1][5] - c) <= 0.1:
                    j += 1
                kind = "stationary"
                if j == i:
                    while j + 1 < len(run):
                        dx, dy = run[j + 1][3] - x, run[j + 1][4] - y
                        if np.hypot(dx, dy) < 1 or any(abs(dx * (y - p[4]) - (x - p[3]) * dy) / np.hypot(dx, dy) > 5 for p in run[i + 1 : j + 1]):
                            break
                        j += 1
                    kind = "moved" if j > i else kind
                span = [s, run[i][1], run[j][1], kind, x, y]
                p = spans[-1] if spans else None
                if p and p[3] == kind == "stationary" and abs(p[4] - x) <= 2 and abs(p[5] - y) <= 2 and span[1] - p[2] <= 5000:
                    p[2] = span[2]
                else:
                    spans.append(span)
                i = j + 1
            run = []
        want += [tuple(p) for p in spans]
    found = folds.cursor_rollup(spark.createDataFrame(rows, WALK)).collect()
    assert sorted((r["session"], r["start"], r["end"], r["kind"], r["x"], r["y"]) for r in found) == sorted(want)

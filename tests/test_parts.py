"""Sessions dealt by time parts give what one sort of each session gives."""

import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import joins, windows

PART = 700.0


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    made = [(rng.choice([1, 1, 1, 2, None]), i, float(rng.randint(0, 9000)), rng.choice([None, 5.0, 60.0, 900.0])) for i in range(600)]
    df = spark.createDataFrame(made, "session long, seq long, ts double, wide double")
    return df.select("session", "seq", "ts", F.col("ts").alias("start"), (F.col("ts") + F.coalesce("wide", F.lit(0.0))).alias("end"), "wide")


def _same(a, b):
    assert a.columns == b.columns
    key = lambda r: tuple((v is None, v) for v in r)
    x, y = (sorted(map(tuple, d.collect()), key=key) for d in (a, b))
    assert len(x) > 5 and x == y


@pytest.mark.parametrize("how", ["last", "max", "sum"])
@pytest.mark.parametrize("current", [True, False])
@pytest.mark.parametrize("backwards", [True, False])
def test_running_values(rows, how, current, backwards):
    run = lambda p: windows.running(rows, F.col("wide"), "out", ["ts", "seq"], how, current=current, backwards=backwards, part_ms=p)
    _same(run(None), run(PART))


def test_islands(rows):
    for make in (
        lambda p: windows.gap_islands(rows, 40.0, part_ms=p),
        lambda p: windows.gap_islands(rows, 40.0, "start", "end", ["start", "seq"], part_ms=p),
        lambda p: windows.overlap_islands(rows, 20.0, "start", "end", ["start", "seq"], part_ms=p),
    ):
        _same(make(None), make(PART))


def test_joins(rows):
    a, b = rows.filter("seq % 3 = 0 AND session IS NOT NULL"), rows.filter("seq % 3 > 0 AND seq % 5 = 0")
    for make in (
        lambda p: joins.backward_asof(a, "ts", b, "ts", "wide", part_ms=p),
        lambda p: joins.without_overlap(a, b, part_ms=p),
        lambda p: joins.within_any(a, "ts", b, part_ms=p),
        lambda p: joins.not_contained(a, b, part_ms=p),
        lambda p: joins.followed(a, b, 60.0, part_ms=p),
    ):
        _same(make(None), make(PART))


def test_one_long_session_is_many_tasks(spark):
    """The sort of a session of one part each is that of a part: no partition of the plan holds the whole session."""
    df = spark.range(200_000).select(F.lit(1).cast("long").alias("session"), F.col("id").alias("seq"), F.col("id").cast("double").alias("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = windows.gap_islands(df, 5.0, part_ms=5_000.0)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 150_000 and sum(sizes) == 200_000


def test_context_is_dealt_to_as_many_tasks_as_frames_need(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_FRAMES", 20)
    rng = random.Random(3)
    frames = sorted((rng.randint(1, 40), float(rng.randint(0, 3000)), i) for i in range(600))
    df = spark.createDataFrame(frames, "session long, ts double, seq long")
    segments = spark.range(1, 41).selectExpr("id AS session", "explode(sequence(0, 2)) AS index").selectExpr("session", "index", "index * 1000D AS start", "(index + 1) * 1000D AS end")
    found = joins.neighbours_context(segments, df, 2)
    assert "hashpartitioning(session#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 30)" in plan
    want = []
    for s in range(1, 41):
        inside = [[ts for who, ts, _ in frames if who == s and k * 1000 <= ts < (k + 1) * 1000] for k in range(3)]
        want += [(s, k + 1, "before", ts) for k in (0, 1) for ts in inside[k][-2:]] + [(s, k - 1, "after", ts) for k in (1, 2) for ts in inside[k][:2]]
    assert sorted(map(tuple, found.collect())) == sorted(want)

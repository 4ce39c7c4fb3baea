"""Streams of order-dependent operators give the rows of the batch operators, whatever order and batches the rows come in."""

import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import folds, windows
from tempora.streaming import folds as streams

ROWS = "session long, seq long, ts double, x double, y double, confidence double, detected boolean"
IDLE = 5_000.0


@pytest.fixture(scope="module")
def walks():
    rng, rows = random.Random(3), []
    for s in (1, 2, 3):
        t, x = 1_000_000.0, 0.0
        for i in range(150):
            t += rng.choice([10.0, 10.0, 100.0, 400.0])
            x += rng.choice([0.0, 0.0, 1.0, -2.0, 30.0])
            seen = rng.random() < 0.7
            rows.append((s, i, t, x, float(rng.randint(0, 3)), 0.5 + i % 5 / 10 if seen or rng.random() < 0.2 else 0.0, seen))
    return rows


def _streamed(spark, folder, rows, apply, late=None):
    """Files of rows in time order, shuffled within a second; then a row of another session far ahead, so that all ends."""
    rng = random.Random(5)
    mixed = sorted(rows, key=lambda r: r[2] + rng.random() * 900)
    parts = [mixed[i : i + 60] for i in range(0, len(mixed), 60)] + ([late] if late else []) + [[(99, 0, 9e9, 0.0, 0.0, 0.5, True)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, ROWS).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
    read = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    q = apply(read).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None
    return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").collect() if r["session"] != 99)


def test_stationary_stream(spark, walks, tmp_path):
    batch = spark.createDataFrame(walks, ROWS)
    want = sorted(map(tuple, folds.stationary(batch, F.lit(True), 10.0).collect()))
    late = [(1, 500, 1_000_001.0, 900.0, 0.0, 0.9, True)]  # long after the watermark: dropped
    found = _streamed(spark, tmp_path, walks, lambda s: streams.stationary(s, 10.0, "1 second", IDLE), late)
    assert len(want) > 20 and found == want


def test_interpolated_stream(spark, walks, tmp_path):
    batch = spark.createDataFrame(walks, ROWS)
    want = sorted(map(tuple, windows.interpolate(batch, 500.0).select(*ROWS.replace(" long", "").replace(" double", "").replace(" boolean", "").split(", ")).collect()))
    found = _streamed(spark, tmp_path, walks, lambda s: streams.interpolated(s, 500.0, "1 second", IDLE))
    assert len(found) == len(want) == len(walks)
    assert all(a[:2] == b[:2] and a[3:] == pytest.approx(b[3:]) for a, b in zip(found, want))


@pytest.mark.parametrize("window", [3, 5])
def test_smoothed_stream(spark, walks, tmp_path, window):
    batch = spark.createDataFrame(walks, ROWS)
    want = sorted(map(tuple, folds.smooth(batch, window, 40.0).collect()))
    found = _streamed(spark, tmp_path, walks, lambda s: streams.smoothed(s, window, 40.0, "1 second", IDLE))
    assert len(found) == len(want)
    assert all(a[:2] == b[:2] and a[3:] == pytest.approx(b[3:]) for a, b in zip(found, want))

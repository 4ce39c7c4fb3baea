"""Halves at the last digit are rounded as the SQL rounds them, not by the shortest decimal of the double."""

import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest

from tempora import queries

NAMES = ["activity_segments", "hop_windows", "tier_segment_list", "hop_contained"]


@pytest.fixture(scope="module")
def halves(spark, tmp_path_factory):
    """Sessions that last some whole milliseconds and a half, with values that end in a half of the sixth digit."""
    d = str(tmp_path_factory.mktemp("halves"))
    rng, start, rows = random.Random(6), datetime(2026, 1, 1), []
    for user in range(1500):
        micros = rng.randrange(80 * 3_600_000) * 1000 + 500
        for at in (0, *sorted(rng.sample(range(1000, micros, 1000), 6)), micros):
            value = rng.randrange(90_000_000) / 1e6 + 5e-7
            rows.append((len(rows), start + timedelta(microseconds=at), user, "view", value, '{"k": 1}'))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", NAMES)
def test_halves(spark, halves, name):
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{halves}/events.parquet/*.parquet'")
    want = con.sql(queries.ORACLE[name])
    columns = sorted(want.columns)
    rows = lambda frame: Counter(frame[columns].itertuples(index=False, name=None))
    found = rows(queries.QUERIES[name](spark, halves).toPandas())
    assert found and found == rows(want.df())

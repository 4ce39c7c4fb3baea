"""Events of value 0, which are neither detected nor sure, are rows of the path like others: the same rows as the SQL's."""

import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest

from tempora import queries

NAMES = ["stationary", "click_candidates", "dwells", "hesitations", "hovers", "thrashes", "inplace_smooth", "fixed_summary"]


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("zeros"))
    rng, at, rows = random.Random(4), datetime(2026, 1, 1), []
    for i in range(1200):
        at += timedelta(minutes=rng.randint(1, 40), microseconds=rng.randint(0, 999_999))
        value = 0.0 if rng.random() < 0.3 else round(rng.expovariate(1 / 30), 2)
        rows.append((i, at, rng.randrange(8), rng.choice(["view", "click", "error", "purchase", "signup"]), value, '{"k": %d}' % rng.randint(0, 99)))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", NAMES)
def test_zero_values(spark, zeros, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{zeros}/events.parquet/*.parquet'")
    want = con.sql(queries.ORACLE[name])
    columns = sorted(want.columns)
    rows = lambda frame: Counter(frame[columns].itertuples(index=False, name=None))
    found = rows(queries.QUERIES[name](spark, zeros).toPandas())
    assert found and found == rows(want.df())

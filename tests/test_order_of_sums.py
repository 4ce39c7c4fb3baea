"""Means are the same however rows are dealt to files and tasks, also at a tier's limit and at a half that is rounded."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from tempora import queries
from tempora.plans.graph import Graph, Stage, fingerprint
from tempora.sources.tables import shared_dir

NAMES = ["hop_windows", "activity_segments", "tier_segment_list", "staged_segments", "type_reports", "reported_metrics"]


@pytest.fixture(scope="module")
def dealt(spark, tmp_path_factory):
    """The same events in one file in order, and in nine files out of order; some users have means of just 20, a limit, some of 20.05, a half."""
    rng, start, rows = random.Random(8), datetime(2026, 1, 1), []
    for user in range(400):
        at, middle = start + timedelta(seconds=user), [20.0, 20.05, None, None][user % 4]
        for _ in range(16):
            at += timedelta(hours=rng.randint(1, 18))
            off = rng.randint(1, 999) / 100
            for value in (middle + off, middle - off, middle) if middle else (rng.uniform(0, 50),):
                at += timedelta(seconds=1)
                rows.append((len(rows), at, user, rng.choice(["view", "click"]), round(value, 2), '{"k": %d}' % rng.randint(0, 99)))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    one, many = (str(tmp_path_factory.mktemp(n)) for n in ("one", "many"))
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{one}/events.parquet")
    rng.shuffle(rows)
    spark.createDataFrame(rows, schema).repartition(9).write.parquet(f"{many}/events.parquet")
    return one, many


@pytest.mark.parametrize("name", NAMES)
def test_order_of_sums(spark, dealt, name):
    a, b = (Counter(map(tuple, queries.QUERIES[name](spark, d).collect())) for d in dealt)
    assert a and a == b


def test_stages_kept_by_other_code_are_not_read(spark, dealt):
    """Tables under the keys of the first version, whose sums hung on how rows were dealt, lie in the shared folder."""
    source = {"events": fingerprint(spark, f"{dealt[0]}/events.parquet")}
    h = 3_600_000.0
    stages = [Stage("hops", None, ("events",), (24 * h, 6 * h)), Stage("tiers", None, ("hops",), (20.0, 45.0, 70.0)), Stage("segments", None, ("tiers",), 18 * h)]
    graph = Graph(f"{shared_dir(spark)}/timelines-stages", stages)
    want = queries.QUERIES["tier_segment_list"](spark, dealt[0])
    for name, key in graph.keys(source).items():
        want.limit(0).drop("fps").write.mode("overwrite").parquet(graph.path(name, key))
    found = queries.QUERIES["staged_segments"](spark, dealt[0])
    assert Counter(map(tuple, found.select(want.columns).collect())) == Counter(map(tuple, want.collect()))

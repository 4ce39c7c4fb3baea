"""ratio() against difflib, and texts compared once for each pair of keys."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tempora.functions import similarity
from tempora.operators import folds, matching
from tempora.plans import merge


def changed(rng, text, letters):
    out = list(text)
    for _ in range(rng.randint(0, 12)):
        at = rng.randint(0, len(out))
        out[at : at + rng.randint(0, 9)] = rng.choices(letters, k=rng.randint(0, 9))
    return "".join(out)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh  .,", "abcdefghijklmnopqrstuvwxyzäé ABCÉİ\n0123456789", "a\ud800😀b"])
def test_ratio_is_that_of_difflib(letters):
    rng = random.Random(len(letters))
    for _ in range(150):
        weight = [rng.random() ** 6 + 0.001 for _ in letters]
        a = "".join(rng.choices(letters, weight, k=rng.choice([0, 1, 5, 60, 199, 200, 700])))
        b = changed(rng, a, letters) if rng.random() < 0.5 else "".join(rng.choices(letters, weight, k=rng.choice([0, 1, 60, 200, 201, 900])))
        want = SequenceMatcher(None, a.lower(), b.lower())
        assert similarity.ratio(a, b) == want.ratio()
        assert similarity.ratio(a, a) == SequenceMatcher(None, a.lower(), a.lower()).ratio()
        least = rng.random()
        assert similarity.possible(a, b, least) == (want.real_quick_ratio() >= least and want.quick_ratio() >= least)


def test_texts_with_too_many_equal_characters(monkeypatch):
    a, b = "abc " * 30, "bca " * 30
    want = similarity.ratio(a, b)
    monkeypatch.setattr(similarity, "SEEDS", 10)
    assert similarity.ratio(a, b) == want


@pytest.fixture(scope="module")
def told(spark):
    """(events with descriptions, the same with keys of texts, the texts): 600 events of 12 texts, one of them without a row."""
    rng = random.Random(4)
    texts = {k: " ".join(rng.choices("open close the menu file save press link".split(), k=rng.randint(1, 6))) for k in range(11)} | {11: ""}
    rows = []
    for i in range(600):
        a = float(rng.randint(0, 60_000))
        rows.append((rng.randint(1, 3), i, rng.choice(["click", "drag"]), a, a + rng.choice([0.0, 900.0]), rng.randint(0, 11), rng.random(), rng.random() < 0.5))
    keys = spark.createDataFrame(rows, "session long, seq long, type string, start double, end double, text long, confidence double, in_overlap boolean")
    whole = [(*r[:5], texts[r[5]], *r[6:]) for r in rows]
    events = spark.createDataFrame(whole, "session long, seq long, type string, start double, end double, description string, confidence double, in_overlap boolean")
    return events, keys, spark.createDataFrame([(k, t) for k, t in texts.items() if t], "text long, description string")


def scanned(events, same):
    """The plain rule over collected rows: (session, seq) of the rows kept."""
    kept = []
    for r in sorted(events.collect(), key=lambda r: (r["start"], r["seq"])):
        k = next((i for i, o in enumerate(kept) if (r["session"], r["type"]) == (o["session"], o["type"]) and same(r, o) and similarity.similar(r["description"], o["description"], 0.6)), None)
        if k is None:
            kept.append(r)
        elif r["confidence"] > kept[k]["confidence"]:
            kept[k] = r
    return {(r["session"], r["seq"]) for r in kept}


def test_overlap_dedup_by_keys(told):
    events, keys, texts = told
    want = scanned(events, lambda r, k: (r["in_overlap"] or k["in_overlap"]) and abs(r["start"] - k["start"]) <= 900)
    found = folds.dedup_overlaps(keys, 900.0, 0.6, similarity.similar, texts)
    assert "description" not in found.columns and {(r["session"], r["seq"]) for r in found.collect()} == want
    assert {(r["session"], r["seq"]) for r in folds.dedup_overlaps(events, 900.0, 0.6, similarity.similar).collect()} == want


def test_fuzzy_dedup_by_keys(told):
    events, keys, texts = told
    want = scanned(events, lambda r, k: r["start"] <= k["end"] + 700 and k["start"] <= r["end"] + 700)
    found = folds.dedup_events(keys.drop("in_overlap"), 700.0, 0.6, similarity.similar, by_text=texts)
    assert "description" not in found.columns and {(r["session"], r["seq"]) for r in found.collect()} == want
    assert {(r["session"], r["seq"]) for r in folds.dedup_events(events.drop("in_overlap"), 700.0, 0.6, similarity.similar).collect()} == want


def test_matches_by_keys(told):
    events, keys, texts = told
    two = lambda d: (d.filter("seq % 2 = 0"), d.filter("seq % 2 = 1"))
    a, b = (sorted(map(tuple, matching.scored_pairs(*two(d), 700.0, 0.5, similarity.obershelp, t).collect())) for d, t in ((events, None), (keys, texts)))
    assert len(a) > 100 and a == b


def test_standalone_merge_by_keys(spark, told):
    events, keys, texts = told
    segments = spark.createDataFrame([(s, k, k * 50_000.0, k * 50_000.0 + 70_000.0) for s in (1, 2, 3) for k in (0, 1)], "session long, segment long, start double, end double")
    path = spark.createDataFrame([(s, i, i * 500.0, 1.0 * i, 2.0, 0.5, True) for s in (1, 2) for i in range(200)], "session long, seq long, ts double, x double, y double, confidence double, detected boolean")
    offsets = spark.createDataFrame([(s, 10.0) for s in (1, 2, 3)], "session long, offset double")
    found = [d.drop("in_overlap").withColumns({"segment": F.col("seq") % 2, "cursor_x": F.lit(None).cast("double"), "cursor_y": F.lit(None).cast("double")}) for d in (events, keys)]
    a, b = (sorted(map(tuple, merge.standalone(d, segments, path, offsets, by_text=t).collect())) for d, t in zip(found, (None, texts)))
    assert len(a) > 20 and a == b

"""Every timeline query with SQL gives the same rows in DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tempora import queries

TABLES = Path("/root/testdata/sf0.001")


def _rows(frame):
    def text(v):
        if pd.isna(v):
            return "null"
        return repr(float(v)) if hasattr(v, "__float__") and not isinstance(v, (str, bool)) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(text, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sql, name):
    found = queries.QUERIES[name](spark, str(TABLES)).toPandas()
    if name in queries.ORACLE:
        assert _rows(found) == _rows(sql.sql(queries.ORACLE[name]).df())
    else:
        assert list(found.columns)


def test_entry_without_corpus_operators(tmp_path):
    """In a copy from which the corpus operators and their pipeline are gone, everything else imports."""
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tempora", tmp_path / "tempora", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'activity_segments' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_matches_of_whole_texts_of_all_documents(spark, tmp_path):
    """Descriptions are whole texts, letters beyond ASCII included, of documents whose ids have holes; the matches of greedy_match are
    those of the plain rule: pairs by falling score, each side once."""
    import random
    from datetime import datetime, timedelta

    from tempora.functions.similarity import ratio

    rng = random.Random(9)
    texts = [f"{'ouvrir le café, schließen: ' * 3}{i * 7919 % 1009} {chr(97 + i % 26) * 9}é" for i in range(60)]
    docs = [(3 * i + 10_000 * (i % 4), t) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    at = datetime(2026, 1, 1)
    rows = [(i, i // 2 % 20, at + timedelta(hours=rng.randint(0, 400), seconds=i), rng.choice(["view", "click"]), 20.0, '{"k": %d}' % rng.randint(0, 40)) for i in range(800)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    events = {r["seq"]: r for r in queries.folds.described(spark, str(tmp_path)).collect()}
    in_order = [t for _, t in sorted(docs)]
    assert len(events) == 800
    assert all(r["description"] == in_order[int((r["session"] * 7 + r["start"] // (48 * 3_600_000.0)) % 60)] for r in events.values())
    day = 24 * 3_600_000.0
    pairs = {}
    for a in events.values():
        for b in events.values():
            if a["seq"] % 2 == 0 and b["seq"] % 2 == 1 and (a["session"], a["type"]) == (b["session"], b["type"]) and a["start"] <= b["end"] + day and b["start"] <= a["end"] + day:
                close = max(0.0, 1 - abs((a["start"] + a["end"]) / 2 - (b["start"] + b["end"]) / 2) / (2 * day))
                score = 0.7 * ratio(a["description"], b["description"]) + 0.3 * close
                if score >= 0.4:
                    pairs[a["session"], a["type"], a["seq"], b["seq"]] = score
    want, used = {}, set()
    for key, score in sorted(pairs.items(), key=lambda kv: (-kv[1], kv[0][2], kv[0][3])):
        if not used & {("b", key[2]), ("e", key[3])}:
            used |= {("b", key[2]), ("e", key[3])}
            want[key] = score
    found = {(r["session"], r["type"], r["b"], r["e"]): r["score"] for r in queries.QUERIES["greedy_match"](spark, str(tmp_path)).collect()}
    assert len(want) > 100 and set(found) == set(want) and all(abs(found[k] - want[k]) < 1e-8 for k in want)


def test_documents_are_numbered_without_holes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i * i,) for i in range(200)], "doc_id long")
    rows = queries.folds.numbered(df, ["doc_id"], F.floor(F.col("doc_id") / 1000)).collect()
    assert sorted((r["doc_id"], r["_d"]) for r in rows) == [(i * i, i) for i in range(200)]


def test_weak_text_is_judged_on_the_whole_text(spark, tmp_path):
    rows = [(1, " " * 20 + "a text long enough", "en", "s"), (2, "short" + " " * 30, "en", "s"), (4, "a b" + " " * 18 + "c", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["weak_text"] for r in queries.QUERIES["enrichment_needs"](spark, str(tmp_path)).collect()}
    assert found == {1: False, 2: True, 4: False}

"""Texts compared by key: events carry a key for each text, so that whole texts move once for each pair of unlike keys that is asked
about, however many events tell it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

#: similar(a, b, least) of two texts, which is the same for any text and itself.
Similar = Callable[[str, str, float], bool]


def keyed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with `text` in the place of description, (text, description) of all of them). Null has the key null."""
    events = written(events)
    key = F.sha2(F.col("description"), 256).alias("text")
    known = events.filter("description IS NOT NULL").select(key, "description").dropDuplicates(["text"])
    return events.select(*(key if c == "description" else c for c in events.columns)), known


def described(events: DataFrame, by_text: DataFrame) -> DataFrame:
    """events with the description in the place of its key."""
    known = by_text.select(F.col("text").alias("_key"), "description")
    return events.join(known, F.col("text") == F.col("_key"), "left").select(*("description" if c == "text" else c for c in events.columns))


def both_texts(pairs: DataFrame, by_text: DataFrame) -> DataFrame:
    """pairs of keys (a, b) with their texts x and y; a key without a text counts as empty."""
    for key, out in (("a", "x"), ("b", "y")):
        known = by_text.select(F.col("text").alias("_key"), F.col("description").alias(out))
        pairs = pairs.join(known, F.col(key) == F.col("_key"), "left").drop("_key").withColumn(out, F.coalesce(out, F.lit("")))
    return pairs


def similar_pairs(pairs: DataFrame, by_text: DataFrame, similar: Similar, threshold: float) -> DataFrame:
    """The distinct pairs of keys (a, b) whose texts are similar."""

    @F.pandas_udf("boolean")
    def yes(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similar(p, q, threshold) for p, q in zip(x, y)], dtype=bool)

    return both_texts(pairs.select("a", "b").distinct(), by_text).filter(yes("x", "y")).select("a", "b")


def pair_scores(pairs: DataFrame, by_text: DataFrame, similarity: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """(a, b, similarity) of the distinct pairs of keys in (a, b, least), with the least that any of them asks for."""
    least = pairs.groupBy("a", "b").agg(F.min("least").alias("least"))
    return both_texts(least, by_text).select("a", "b", similarity(F.col("x"), F.col("y"), F.col("least")).alias("similarity"))


def on_pairs(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """pairs joined to what was found for their (a, b)."""
    found = found.withColumnsRenamed({"a": "_a", "b": "_b"})
    return pairs.join(found, F.col("a").eqNullSafe(F.col("_a")) & F.col("b").eqNullSafe(F.col("_b"))).drop("_a", "_b")

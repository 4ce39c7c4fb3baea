"""Exact dedup by progressive refinement: length, then prefix hash, then full hash, then content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import skew_join, stored, table

#: Space and the control characters 9 to 13.
WHITE = "[\\x20\\x09-\\x0D]"


def _shared(rows: DataFrame, by: list[str]) -> DataFrame:
    """Keys that more than one row has, and how many; counts are combined before the shuffle, so a hot key is one row per task."""
    return stored(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, verify_content: bool = True
) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256 of the text without white space.

    Null text counts as empty; empty texts are equal to one another. Of equal texts the row with the most code points,
    then the smallest id (null last) stays; keep_id is null where that row has no id. Rows that repeat an id or have none are rows
    like any others: all of a group whose id is keep_id have kept true. Extra columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.regexp_replace(text, WHITE, "")
    facts = stored(
        docs.select(F.col(id_col).alias("_id"), text.alias("_text"), bare.alias("_bare")).select(
            "_id",
            F.length("_text").alias("_points"),
            F.length("_bare").alias("_length"),
            F.xxhash64(F.substring("_bare", 1, prefix_chars)).alias("_prefix"),
            F.sha2("_bare", 256).alias("_full"),
        )
    )
    left, keys = facts, ["_length"]
    for more in ("_prefix", "_full"):  # each step reads only the rows that still share everything looked at so far
        left = stored(skew_join(left, _shared(left, keys), keys, "_n", "left_semi"))
        keys.append(more)
    groups = left.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.struct(F.col("_points"), (-F.col("_id")).alias("_neg"))).alias("_best"),
    )
    groups = stored(groups.filter("_n > 1"))
    if verify_content:
        # Only texts of surviving groups are read on: by length and prefix first, so that few others are hashed again.
        wanted = stored(groups.groupBy("_length", "_prefix").agg(F.sum("_n").alias("_n")))
        again = docs.select(F.col(id_col).alias("_id"), bare.alias("_bare")).select(
            "_id", "_bare", F.length("_bare").alias("_length"), F.xxhash64(F.substring("_bare", 1, prefix_chars)).alias("_prefix")
        )
        # Equal least and greatest content means that all of it is equal; copies are combined before the shuffle.
        content = (
            skew_join(again, wanted, ["_length", "_prefix"], "_n", "left_semi")
            .groupBy("_length", F.sha2("_bare", 256).alias("_full"))
            .agg((F.min("_bare") == F.max("_bare")).alias("_same"))
        )
        groups = stored(
            groups.join(content, ["_length", "_full"]).filter(
                F.when(F.col("_same"), True).otherwise(F.raise_error("different texts share length and SHA-256"))
            )
        )
    groups = groups.select("_length", "_full", "_n", F.col("_n").alias("_size"), "_best")
    joined = skew_join(facts, groups, ["_length", "_full"], "_n")
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(-F.col("_best._neg"))
    return joined.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("_id")).alias("kept"),
        F.col("_full").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each text (white space aside), with its columns: the longest, then the one with the smallest id.

    That holds whatever the ids are: of rows that repeat an id or have none, and have one text, one of the longest stays, a
    fixed one unless they differ in nothing. Columns of any name go along. Null text counts as empty; an empty table gives none.
    """
    groups = stored(exact_groups(docs, id_col, text_col))
    ids = groups.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.bool_or("kept").alias("stays"))
    ids = stored(ids.filter(f"n > 1 OR NOT stays OR `{id_col}` IS NULL"))
    out = docs.join(ids.filter(f"`{id_col}` IS NOT NULL").select(id_col), id_col, "left_anti").filter(F.col(id_col).isNotNull())
    odd = ids.filter(f"n > 1 OR `{id_col}` IS NULL").select(id_col)  # what stays of these is not settled by the id
    if odd.isEmpty():
        return out.select(*docs.columns)
    row, text = F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text_col), F.lit(""))
    sha = F.sha2(F.regexp_replace(text, WHITE, ""), 256)
    some = docs.join(odd.filter(f"`{id_col}` IS NOT NULL"), id_col, "left_semi").unionByName(docs.filter(F.col(id_col).isNull()))
    some = some.select(row, sha.alias("sha"), F.struct(F.length(text).alias("points"), F.xxhash64(*docs.columns)).alias("rank"), F.col(id_col).alias("id"))
    # A group's best row has its keep_id; copies are combined before the shuffle, so a hot text is one row a task.
    keep = groups.select(F.col("text_sha256").alias("sha"), F.col("keep_id").alias("id"))
    keep = keep.join(some.select("sha").distinct(), "sha", "left_semi").distinct()
    best = some.groupBy("sha", "id").agg(F.max_by("row", "rank").alias("row"))
    best = best.join(keep.withColumnRenamed("id", "keep"), "sha").filter(F.col("id").eqNullSafe(F.col("keep")))
    return out.select(*docs.columns).unionByName(best.select("row.*"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(length(text), 0) AS points,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS bare
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS kept,
       sha256(bare) AS text_sha256
FROM t
"""

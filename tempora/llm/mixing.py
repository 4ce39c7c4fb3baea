"""Mixing sources by temperature: token shares to a power, found by bisection, realised as budgeted block permutations."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import part_sums, prefix_sums, stored, table

#: Each round of the bisection cuts the interval into so many parts; ROUNDS rounds leave an interval of PARTS**-ROUNDS.
PARTS, ROUNDS = 32, 4
WORDS = "[^\\x20\\x09-\\x0D]+"


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS))


def _key(source_col: str) -> Column:
    """A source's key: a null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))


def exponent(totals: DataFrame, budget: int, max_repeat: float | None, target_entropy: float | None) -> float:
    """The exponent a in [0, 1] that meets the target, from (source, total).

    max_repeat: the least a at which no source is repeated more often than this (1 where even the natural shares are).
    target_entropy (nats): the greatest a at which the mixture has at least this entropy (0 where none has).
    Repetition and entropy both fall as a grows, so each round keeps the part of the interval in which the answer lies.
    Only the round's few sums reach the driver.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / PARTS for i in range(PARTS + 1)]
        at = totals.select("total", F.posexplode(F.array(*map(F.lit, grid))).alias("i", "a"))
        power = F.exp(F.col("a") * F.log("total"))
        sums = at.groupBy("i").agg(
            F.sum(power).alias("z"),
            F.max(power / F.col("total")).alias("most"),
            F.sum(power * F.col("a") * F.log("total")).alias("plogp"),
        )
        seen = {r["i"]: r for r in sums.collect()}
        if not seen:
            return 1.0
        if max_repeat is not None:
            met = [i for i in range(PARTS + 1) if seen[i]["most"] / seen[i]["z"] * budget <= max_repeat]
            if not met:
                return 1.0
            low, high = grid[max(met[0] - 1, 0)], grid[met[0]]
        else:
            met = [i for i in range(PARTS + 1) if log(seen[i]["z"]) - seen[i]["plogp"] / seen[i]["z"] >= target_entropy]
            if not met:
                return 0.0
            low, high = grid[met[-1]], grid[min(met[-1] + 1, PARTS)]
        if low == high:
            break
    return high if max_repeat is not None else low


def temperature_mix(
    docs: DataFrame,
    tokens: Column | None = None,
    budget: int | None = None,
    max_repeat: float | None = None,
    target_entropy: float | None = None,
    block_tokens: int = 1 << 20,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """docs' columns with n_tokens, weight, copy, block and place (in place of such columns): one row for each time a row is
    taken.

    Source s with T tokens gets weight w = T**a / sum T**a and w * budget tokens (budget: all tokens unless given). Its rows
    stand in a seeded order of their ids' hashes; whole passes over the source come first, and the rest of its budget is a
    prefix of that order, the last row included when it starts within the budget. Progress through a source's budget
    decides the block, so that each block of about block_tokens holds every source by its weight; place orders a block.

    Exactly one of max_repeat and target_entropy is given. Rows without a token (null, empty and blank texts) have no share
    and are not taken. A null source is a source of its own; repeated rows are rows of their own; an empty table gives none.
    Only sums of few numbers reach the driver; no source is gathered in one task.
    """
    if (max_repeat is None) == (target_entropy is None):
        raise ValueError("give max_repeat or target_entropy")
    order = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    own = [c for c in docs.columns if c not in ("n_tokens", "weight", "copy", "block", "place")]
    rows = docs.select(
        F.struct(*own).alias("_doc"),
        (word_count(text_col) if tokens is None else tokens).cast("long").alias("_n"),
        _key(source_col).alias("_source"),
        order.alias("_order"),
        F.xxhash64(text_col).alias("_tie"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
    ).filter("_n > 0")
    sums = part_sums(rows, ["_source"], "_order", "_n")  # the only pass over the rows before they are placed
    totals = stored(sums.groupBy("_source").agg(F.sum("_sum").alias("total")))
    given = budget if budget is not None else totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    a = exponent(totals, given, max_repeat, target_entropy)
    power = F.exp(F.lit(a) * F.log("total"))
    z = totals.agg(F.sum(power)).first()[0] or 1.0
    weight = power / F.lit(z)
    shares = stored(
        totals.select("_source", F.col("total").alias("_total"), weight.alias("_weight"), F.floor(weight * F.lit(float(given))).cast("long").alias("_budget"))
    )
    n_blocks = max(1, ceil(given / block_tokens))
    placed = prefix_sums(rows, sums, ["_source"], "_order", "_tie", "_n", "_start").join(shares, "_source")
    copies = F.when(F.col("_start") < F.col("_budget"), F.ceil((F.col("_budget") - F.col("_start")) / F.col("_total"))).otherwise(0).cast("int")
    taken = placed.filter(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    at = F.col("_copy").cast("long") * F.col("_total") + F.col("_start")
    return taken.select(
        "_doc.*",
        F.col("_n").alias("n_tokens"),
        F.col("_weight").alias("weight"),
        F.col("_copy").alias("copy"),
        F.floor(at * F.lit(n_blocks) / F.col("_budget")).cast("long").alias("block"),
        F.md5(F.concat_ws("/", F.lit(seed), "_id", F.col("_copy").cast("string"))).alias("place"),
    )


def op8_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed so that no source is repeated more than twice; weight at nine digits."""
    docs = table(spark, sf_dir, "documents")
    # Words are counted once; a digest stands for the text, which only orders rows that repeat an id.
    narrow = stored(docs.select("doc_id", "source", word_count().alias("words"), F.xxhash64("text").alias("text")))
    made = temperature_mix(narrow, F.col("words"), max_repeat=2.0)
    return made.select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), F.col("copy").cast("long").alias("copy"), "block", "place")


def _round_sql(i: int) -> str:
    """One round of the bisection: the part of the interval that holds the least exponent meeting the limit."""
    return f"""
g{i} AS (SELECT i, low + (high - low) * i / 32.0::DOUBLE AS a FROM r{i - 1}, range(33) x(i)),
m{i} AS (SELECT i, any_value(a) AS a, max(exp(a * ln(total)) / total) / sum(exp(a * ln(total))) * (SELECT sum(total) FROM t) AS repeat FROM g{i}, t GROUP BY i),
k{i} AS (SELECT min(i) FILTER (WHERE repeat <= 2.0) AS k FROM m{i}),
r{i} AS (SELECT coalesce((SELECT a FROM m{i} WHERE i = greatest(k - 1, 0)), 1.0) AS low, coalesce((SELECT a FROM m{i} WHERE i = k), 1.0) AS high FROM k{i})"""


OP8_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n,
         ('0x' || substr(md5('mix' || doc_id), 1, 15))::BIGINT AS o FROM documents),
t AS (SELECT source, sum(n)::DOUBLE AS total FROM d WHERE n > 0 GROUP BY source),
r0 AS (SELECT 0.0::DOUBLE AS low, 1.0::DOUBLE AS high),"""
    + ",".join(_round_sql(i) for i in range(1, ROUNDS + 1))
    + f""",
w AS (SELECT source, total::BIGINT AS total, exp(high * ln(total)) / sum(exp(high * ln(total))) OVER () AS weight FROM t, r{ROUNDS}),
b AS (SELECT *, floor(weight * (SELECT sum(total) FROM t))::BIGINT AS budget FROM w),
s AS (SELECT doc_id, d.source, n, weight, total, budget, (sum(n) OVER (PARTITION BY d.source ORDER BY o) - n)::BIGINT AS start
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source WHERE n > 0),
c AS (SELECT *, unnest(range(0, ceil((budget - start) / total::DOUBLE)::BIGINT)) AS copy FROM s WHERE start < budget)
SELECT doc_id, source, n::BIGINT AS n_tokens, round(weight, 9) AS weight, copy,
       floor((copy * total + start) * greatest(1, ceil((SELECT sum(total) FROM t) / {1 << 20})) / budget::DOUBLE)::BIGINT AS block,
       md5('mix/' || doc_id || '/' || copy) AS place
FROM c
"""
)

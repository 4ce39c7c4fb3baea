"""Chat formatting by perspective rotation: every participant of a dialogue in turn speaks as the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

ASSISTANT, SYSTEM, END = "<|assistant|>\n", "<|system|>\n", "<|end|>\n"


def escaped(col: Column, name: bool = False) -> Column:
    """Text in which no mark can be forged: `<|` becomes `<\\|`, and one more backslash goes into what looks escaped already, so
    that taking one out again gives the text. In names `|>` is escaped alike."""
    col = F.regexp_replace(col, r"<(\\*)\|", r"<\\$1|")
    return F.regexp_replace(col, r"\|(\\*)>", r"|\\$1>") if name else col


def rotate(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    system_role: str = "system",
    block_turns: int | None = None,
) -> DataFrame:
    """One row per dialogue and participant: conv_id, speaker, block (0), at (0), n_turns, text, mask, n_masked.

    Seen from `speaker`, each of their turns is rendered `<|assistant|>\\n...<|end|>\\n`, each other participant's
    `<|user name=NAME|>\\n...<|end|>\\n` and each system turn `<|system|>\\n...<|end|>\\n`; texts and names are escaped(), so
    that only turns make marks. mask lists [start, end) in code points of the text: what the speaker says, with its closing
    mark, which is what a model is trained on. n_masked is their total length. System turns are context for every participant
    and nobody's perspective.

    Null roles are a participant named `unknown`; null texts render as empty; rows with a null conv_id or turn are
    left out, as they have no place in a dialogue; repeated rows are all rendered; ties of a turn are ordered by role, then
    text, by their bytes. A dialogue with system turns alone, or an empty table, gives no row. Extra columns are ignored.

    A rendering is one value, so it has to fit into a row. For dialogues beyond that give block_turns: a rendering then comes
    as rows that each hold a fixed range of that many turn numbers, with their place `at` in the whole; in the order of
    `block` their texts make up the same rendering, and their masks plus `at` the same mask.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        (F.floor(F.col(turn_col) / block_turns) if block_turns else F.lit(0)).cast("long").alias("block"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("words"),
    ).filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    head = F.when(F.col("role") == system_role, F.lit(SYSTEM)).otherwise(F.concat(F.lit("<|user name="), escaped(F.col("role"), True), F.lit("|>\n")))
    # One shuffle by dialogue serves both windows and the grouping.
    dealt = rows.repartition("conv_id").withColumns({"head": head, "body": F.concat(escaped(F.col("words")), F.lit(END))})
    # Where a turn stands in its own speaker's rendering: all that comes before, less what their shorter heads save.
    size, saved = F.length("head") + F.length("body"), F.length("head") - len(ASSISTANT)
    of = lambda *by: W.partitionBy(*by).orderBy("turn", "role", "words").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("_before", F.coalesce(F.sum(size).over(of("conv_id")), F.lit(0)))
    start = F.col("_before") - F.coalesce(F.sum(saved).over(of("conv_id", "role")), F.lit(0)) + len(ASSISTANT)
    placed = placed.withColumn("start", start.cast("long")).withColumn("end", (F.col("start") + F.length("body")).cast("long"))
    said = placed.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "words", "head", "body", "start", "end"))).alias("said"))
    if block_turns:  # a participant may say nothing in some block
        speakers = rows.filter(F.col("role") != system_role).select("conv_id", F.col("role").alias("speaker")).distinct()
        seen = said.join(speakers, "conv_id")
    else:
        speakers = F.array_distinct(F.transform(F.filter("said", lambda s: s["role"] != system_role), lambda s: s["role"]))
        seen = said.withColumn("speaker", F.explode(speakers))
    own = F.transform(F.filter("said", lambda s: s["role"] == F.col("speaker")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    seen = seen.withColumn("mask", own)
    parts = F.transform("said", lambda s: F.concat(F.when(s["role"] == F.col("speaker"), F.lit(ASSISTANT)).otherwise(s["head"]), s["body"]))
    made = seen.withColumn("text", F.array_join(parts, ""))
    before = W.partitionBy("conv_id", "speaker").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)) if block_turns else F.lit(0)
    made = made.withColumn("at", at.cast("long"))
    mask = F.transform("mask", lambda m: F.struct((m["start"] - F.col("at")).alias("start"), (m["end"] - F.col("at")).alias("end")))
    return made.select(
        "conv_id",
        "speaker",
        "block",
        "at",
        F.size("said").cast("long").alias("n_turns"),
        "text",
        mask.alias("mask"),
        F.aggregate("mask", F.lit(0).cast("long"), lambda n, m: n + m["end"] - m["start"]).alias("n_masked"),
    )


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mask as text `start-end,start-end`."""
    made = rotate(table(spark, sf_dir, "conversations")).drop("block", "at")
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return made.withColumn("mask", spans)


OP1_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> 'system'),
h AS (
  SELECT r.conv_id, speaker, turn, role, text, role = speaker AS own,
         CASE WHEN role = speaker THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || regexp_replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') || '|>' || chr(10) END AS head,
         regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) AS body
  FROM r JOIN p USING (conv_id)),
o AS (
  SELECT *, row_number() OVER w AS n,
         sum(length(head) + length(body)) OVER w AS stop
  FROM h WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn, lower(hex(encode(role))), lower(hex(encode(text)))
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, speaker, count(*) AS n_turns, string_agg(head || body, '' ORDER BY n) AS text,
       coalesce(string_agg((stop - length(body))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY n) FILTER (WHERE own), '') AS mask,
       coalesce(sum(length(body)) FILTER (WHERE own), 0)::BIGINT AS n_masked
FROM o GROUP BY conv_id, speaker
"""

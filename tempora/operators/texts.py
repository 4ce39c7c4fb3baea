"""Texts made of timelines: summary lines of a segment, prompts with conditional sections, and what two runs' texts differ in."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import unified_diff

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import fixed

#: Characters that end a line, as Python's str.splitlines() has them; \r\n is one end.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"


def whole(x: Column) -> Column:
    """The whole part of a number, as text."""
    return x.cast("long").cast("string")


def lines_of(rows: DataFrame, line: Column, order: list[str], by: list[str], out: str = "text") -> DataFrame:
    """One text for each group: its lines in order. A summary is one value, as a prompt wants it; a long recording is summed up
    segment by segment."""
    each = rows.select(*by, F.struct(*order, line.alias("_line")).alias("_l"))
    return each.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_l")), lambda s: s["_line"]), "\n").alias(out))


def table_text(rows: DataFrame, cells: dict[str, Column], order: list[str], by: list[str], out: str = "text") -> DataFrame:
    """A report's Markdown table for each group: a heading, a rule and a line for each row in order. A missing value is a dash; bars
    and line ends inside a value are escaped, so that a row stays one line."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("-")), "\\|", "\\\\|"), LINE_ENDS, " ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(safe(c) for c in cells.values())), F.lit(" |"))
    heading = "| " + " | ".join(cells) + " |\n|" + "---|" * len(cells)
    made = lines_of(rows, line, order, by, out)
    return made.withColumn(out, F.concat(F.lit(heading + "\n"), out))


def cursor_lines(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """(session, segment, text): rolled-up spans (session, segment, start, end, kind, x, y, to_x, to_y) as lines with times from the
    segment's start: `S-Ems: stationary pos=(x,y)` and `S-Ems: moved from (x,y) to (x,y)`. A segment without spans has an
    empty text. segments: session, segment, start."""
    place = lambda x, y: F.concat(F.lit("("), whole(F.col(x)), F.lit(","), whole(F.col(y)), F.lit(")"))
    rest = F.when(F.col("kind") == "stationary", F.concat(F.lit(" pos="), place("x", "y"))).when(F.col("kind") == "moved", F.concat(F.lit(" from "), place("x", "y"), F.lit(" to "), place("to_x", "to_y")))
    return _from_start(spans, segments, F.concat(F.col("kind"), F.coalesce(rest, F.lit(""))))


def flow_lines(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """(session, segment, text): rolled-up flows (session, segment, start, end, direction, magnitude) as `S-Ems: DIRECTION
    magnitude=M` with M at one decimal; as cursor_lines() otherwise."""
    return _from_start(spans, segments, F.concat(F.col("direction"), F.lit(" magnitude="), fixed(F.col("magnitude"), 1)))


def _from_start(spans: DataFrame, segments: DataFrame, said: Column) -> DataFrame:
    own = segments.select("session", "segment", F.col("start").alias("_0"))
    time = F.concat(whole(F.col("start") - F.col("_0")), F.lit("-"), whole(F.col("end") - F.col("_0")), F.lit("ms: "))
    made = lines_of(spans.join(own, ["session", "segment"]), F.concat(time, said), ["start", "end"], ["session", "segment"])
    return own.drop("_0").join(made, ["session", "segment"], "left").fillna("", "text")


def rendered(template: Column, values: dict[str, Column], sections: dict[str, tuple[Column, Column]] | None = None) -> Column:
    """A template with each `{name}` replaced by its value as text, in the order of the dictionaries; names without a value stay.
    A section is its text where its condition holds and empty elsewhere; values may stand inside sections, which go first."""
    for name, (when, text) in (sections or {}).items():
        template = F.replace(template, F.lit("{" + name + "}"), F.when(when, text).otherwise(""))
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def line_count(text: Column) -> Column:
    """How many lines a text has; the end of the last one opens no other."""
    ends = F.regexp_count(text, F.lit(LINE_ENDS))
    closed = text.rlike(f"(?:{LINE_ENDS})$(?![\\s\\S])")
    return F.when(text.isNull() | (text == ""), 0).otherwise(ends + F.when(closed, 0).otherwise(1)).cast("long")


def diffed(a: Column, b: Column, name: Column, a_label: str, b_label: str) -> Column:
    """The unified diff of two texts with three lines of context, its lines joined by \\n; an Arrow function, as edit scripts are
    beyond SQL. Only pairs that differ should get here."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y, n in batches:
            yield pd.Series(["\n".join(unified_diff((p or "").splitlines(keepends=True), (q or "").splitlines(keepends=True), f"{s} ({a_label})", f"{s} ({b_label})", lineterm="")) for p, q, s in zip(x, y, n)], dtype="object")

    return run(a, b, name)


def text_changes(base: DataFrame, other: DataFrame, by: list[str], text: str = "text", labels: tuple[str, str] = ("base", "other")) -> DataFrame:
    """Texts of two runs joined on `by`: base_lines, other_lines, base_present, other_present, identical and diff (null where
    identical). What is in one run only is compared with nothing. Equal texts are told apart in the JVM, so only the pairs that
    differ reach Python, whole lines at a time; keys should be unique in each run."""
    a, b = (d.select(*by, F.col(text).alias(n), F.lit(True).alias(f"{n}_present")) for d, n in ((base, "_a"), (other, "_b")))
    both = a.join(b, by, "full").withColumn("identical", F.coalesce("_a", F.lit("")) == F.coalesce("_b", F.lit("")))
    name = F.concat_ws("/", *(F.col(c).cast("string") for c in by))
    facts = [
        *by, line_count(F.col("_a")).alias("base_lines"), line_count(F.col("_b")).alias("other_lines"),
        F.coalesce("_a_present", F.lit(False)).alias("base_present"), F.coalesce("_b_present", F.lit(False)).alias("other_present"), "identical",
    ]
    same = both.filter("identical").select(*facts, F.lit(None).cast("string").alias("diff"))
    return same.unionByName(both.filter("NOT identical").select(*facts, diffed(F.col("_a"), F.col("_b"), name, *labels).alias("diff")))

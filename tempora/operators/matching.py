"""One timeline scored against another: 1:1 matches, precision, recall, F1, trends, early stops."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exact import rounded
from ..sources.tables import written
from . import alike
from .folds import fold
from .joins import interval_join
from .windows import islands, ordered, overlap_islands


def scored_pairs(
    baseline: DataFrame, found: DataFrame, tolerance: float, threshold: float, similarity: Callable[[Column, Column, Column], Column], by_text: DataFrame | None = None
) -> DataFrame:
    """Pairs of one session and type that overlap within the tolerance and score at least the threshold.

    score = 0.7 similarity + 0.3 closeness, closeness falling from 1 to 0 over twice the tolerance between middles.
    similarity(a, b, least) may give any value below `least` where two texts are less alike than that: such pairs do not count.
    Inputs: session, seq, type, start, end (already the start where missing), description. Pairs are found by time bins, so a
    dense session spreads over tasks. Both sides are cut together at gaps over the tolerance, which no pair bridges; greedy()
    matches within these islands. With by_text (text, description) the inputs have a key `text` instead of a description. Rows
    carry keys only, and each pair of texts is compared once, with the least that any pair of rows needs of it.
    """
    if by_text is None:
        both, by_text = alike.keyed(baseline.withColumn("side", F.lit("b")).unionByName(found.withColumn("side", F.lit("e"))))
        baseline, found = (both.filter(F.col("side") == s) for s in "be")
    rows = lambda d, s: d.select("session", "type", "seq", "start", "end", "text", F.lit(s).alias("side"))
    both = overlap_islands(rows(baseline, "b").unionByName(rows(found, "e")), tolerance, "start", "end", ["start", "seq", "side"], by=["session", "type"])
    side = lambda s: both.filter(F.col("side") == s).drop("side")
    wide = side("b").withColumns({"_start": F.col("start"), "_end": F.col("end"), "start": F.col("start") - tolerance, "end": F.col("end") + tolerance})
    near = interval_join(wide, side("e"), 4 * tolerance, strict=False, by=["session", "type"])
    middle = F.abs((F.col("l._start") + F.col("l._end")) / 2 - (F.col("r.start") + F.col("r.end")) / 2)
    close = F.greatest(F.lit(0.0), 1.0 - middle / (2 * tolerance))
    # A hair less than needed is asked for, so that rounding loses no pair; the score itself decides.
    least = (F.lit(threshold) - 0.3 * F.col("_close")) / 0.7 - 1e-9
    pairs = near.select("session", "type", F.col("l.island").alias("island"), F.col("l.seq").alias("_l"), F.col("r.seq").alias("_r"), F.col("l.text").alias("a"), F.col("r.text").alias("b"), close.alias("_close"))
    pairs = written(pairs.withColumn("least", least))
    scored = alike.on_pairs(pairs, written(alike.pair_scores(pairs, by_text, similarity)))
    scored = scored.select("session", "type", "island", F.col("_l").alias("b"), F.col("_r").alias("e"), (0.7 * F.col("similarity") + 0.3 * F.col("_close")).alias("score"))
    return scored.filter(F.col("score") >= threshold)


def greedy(pairs: DataFrame) -> DataFrame:
    """1:1 matches of scored_pairs() by falling score, ties by baseline, then found order. Islands never meet, so each is a fold
    of its own."""

    def step(g: dict[str, np.ndarray]) -> list[tuple]:
        b, e, keep = set(), set(), []
        for r in zip(g["session"], g["type"], g["b"], g["e"], g["score"]):
            if r[2] not in b and r[3] not in e:
                b.add(r[2])
                e.add(r[3])
                keep.append(r)
        return keep

    rows = pairs.withColumn("_rank", -F.col("score"))
    return fold(rows, ["session", "type", "island"], ["_rank", "b", "e"], step, "session long, type string, b long, e long, score double")


def match_by_time(reference: DataFrame, found: DataFrame, tolerance: float) -> DataFrame:
    """Two passes over (session, seq, type, start): each reference in time order takes the closest free row of its type at
    most `tolerance` away, then the rest take any type. Ties go to the lowest seq. No match bridges a gap over the tolerance,
    so sessions are cut there, and a reference looks only at the rows around it."""

    def step(g: dict[str, np.ndarray]) -> list[tuple]:
        refs, cand = np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1)
        start, seq, kind = g["start"], g["seq"], g["type"]
        at = start[cand]
        used: set = set()
        out: dict = {}
        for same in (True, False):
            for r in refs:
                if r in out:
                    continue
                lo, hi = np.searchsorted(at, start[r] - tolerance, "left"), np.searchsorted(at, start[r] + tolerance, "right")
                best = min(
                    ((abs(start[c] - start[r]), seq[c], c) for c in cand[max(lo - 1, 0) : hi + 1] if c not in used and abs(start[c] - start[r]) <= tolerance and (not same or kind[c] == kind[r])),
                    default=None,
                )
                if best:
                    used.add(best[2])
                    out[r] = (g["session"][0], seq[r], best[1], same)
        return list(out.values())

    both = reference.select("session", "seq", "type", "start", F.lit(0).alias("side")).unionByName(found.select("session", "seq", "type", "start", F.lit(1).alias("side")))
    order = ["start", "seq"]
    rows = islands(both, F.col("start") - F.lag("start").over(ordered(*order)) > tolerance, order)
    return fold(rows, ["session", "island"], order, step, "session long, ref long, hit long, same_type boolean")


def ratios(matched: Column, baseline: Column, found: Column) -> dict[str, Column]:
    """precision, recall and F1, each 0 where its denominator is."""
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide(matched, found), zero), F.coalesce(F.try_divide(matched, baseline), zero)
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), zero)}


def session_metrics(matches: DataFrame, baseline: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Counts and ratios by `by` (session, or session and type) over the union of what either side has."""
    count = lambda d, name: d.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    all_ = count(baseline, "n_baseline").join(count(found, "n_found"), by, "full").join(count(matches, "n_matched"), by, "left").fillna(0)
    return all_.withColumns(ratios(F.col("n_matched"), F.col("n_baseline"), F.col("n_found")))


def timing_error(matches: DataFrame, baseline: DataFrame, found: DataFrame) -> DataFrame:
    """Mean distance of matched starts, and of ends where the baseline has one that is not 0. Raw ends are wanted here."""
    b = baseline.select("session", F.col("seq").alias("b"), F.col("start").alias("bs"), F.col("end").alias("be"))
    e = found.select("session", F.col("seq").alias("e"), F.col("start").alias("es"), F.col("end").alias("ee"))
    both = matches.join(b, ["session", "b"]).join(e, ["session", "e"])
    end = F.when(F.coalesce(F.col("be"), F.lit(0.0)) != 0, F.abs(F.col("be") - F.coalesce(F.nullif("ee", F.lit(0.0)), "es")))
    return both.groupBy("session").agg(F.avg(F.abs(F.col("bs") - F.col("es"))).alias("start_error"), F.avg(end).alias("end_error"))


def reported(metrics: DataFrame, ratios_at: int = 4, errors_at: int = 1) -> DataFrame:
    """metrics as a report has them: ratios and similarities (precision, recall, f1, similarity) at four digits, timing errors
    (start_error, end_error) at one, each to the nearest by its exact value, halves to even; missing ones stay missing."""
    digits = dict.fromkeys(("precision", "recall", "f1", "similarity"), ratios_at) | dict.fromkeys(("start_error", "end_error"), errors_at)
    return metrics.withColumns({c: rounded(F.col(c), n) for c, n in digits.items() if c in metrics.columns})


def micro(metrics: DataFrame) -> DataFrame:
    """One row over all sessions: sums first, then ratios."""
    total = metrics.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_baseline", "n_found", "n_matched")))
    return total.withColumns(ratios(F.col("n_matched"), F.col("n_baseline"), F.col("n_found")))


def cumulative(metrics: DataFrame, order: str, slope: float, by: list[str] | None = None) -> DataFrame:
    """Running micro-averages in session order with the trend of F1 by least squares; fewer than three sessions: stable.
    Sessions are few; give `by` to run many sequences at once."""
    by = by or []
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = metrics.withColumns({f"sum_{c}": F.sum(c).over(w) for c in ("n_baseline", "n_found", "n_matched")})
    sums = sums.withColumn("_i", F.row_number().over(w) - 1)
    k = F.regr_slope(F.col("f1"), F.col("_i")).over(w)
    trend = F.when(F.col("_i") < 2, "stable").when(k > slope, "improving").when(k < -slope, "declining").otherwise("stable")
    r = ratios(F.col("sum_n_matched"), F.col("sum_n_baseline"), F.col("sum_n_found"))
    return sums.withColumns({f"cum_{n}": c for n, c in r.items()} | {"trend": trend}).drop("_i")


def early_break(running: DataFrame, order: str, decline: float, least: int, by: list[str]) -> DataFrame:
    """Rows up to and with the first one, from the `least`-th on, whose F1 lies `decline` or more under the one before."""
    w = W.partitionBy(*by).orderBy(order)
    fall = F.lag("f1").over(w) - F.col("f1")
    marked = running.withColumn("_n", F.row_number().over(w)).withColumn("breaks", (F.col("_n") >= least) & F.coalesce(fall >= decline, F.lit(False)))
    past = F.coalesce(F.max(F.col("breaks").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("_past", past).filter("_past = 0").drop("_past", "_n")

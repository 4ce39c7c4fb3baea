"""Pointer tracking from scored matches: which match of a frame counts.

Matches are rows (session, seq, ts, k, template, x, y, confidence): a frame (session, seq, ts) has one for each template and scale
tried, in the order k. Frames are dealt out; what a frame needs of those before it is a state, so sessions are cut where the
state does not matter.
"""

from __future__ import annotations

from math import floor, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import fold
from .joins import interval_join
from .reports import position_clusters
from .windows import islands, ordered

FRAME = ["session", "seq"]
#: Unit steps of the compass directions of a flow.
DIRECTIONS = {
    "N": (0.0, -1.0), "NE": (0.707, -0.707), "E": (1.0, 0.0), "SE": (0.707, 0.707),
    "S": (0.0, 1.0), "SW": (-0.707, 0.707), "W": (-1.0, 0.0), "NW": (-0.707, -0.707),
}


def apart(x: np.ndarray, y: np.ndarray, distance: float) -> list[int]:
    """Of points in order of preference those that keep the distance from all taken before them. A grid of cells as wide as the
    distance holds the taken ones, so a point looks at nine cells, each with a few of them at most."""
    taken: dict[tuple[int, int], list[int]] = {}
    out = []
    for i, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
        cx, cy = floor(a / distance), floor(b / distance)
        near = (j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in taken.get((cx + dx, cy + dy), ()))
        if all(sqrt((a - x[j]) ** 2 + (b - y[j]) ** 2) >= distance for j in near):
            taken.setdefault((cx, cy), []).append(i)
            out.append(i)
    return out


def distinct_candidates(matches: DataFrame, threshold: float, within: float, early: float, distance: float) -> DataFrame:
    """The matches (session, seq, k, x, y, confidence) of a frame that may be the pointer.

    Over the threshold (strict) and at most `within` below the frame's best; of those nearer to one another than `distance` the
    surer one, then the earlier. Where the best reaches `early`, it alone. Frames are cut between matches whose x are a
    distance apart, as these never meet, so even a crowded frame is many small groups. Rows with a null place or confidence
    are no matches.
    """
    m = matches.select("session", "seq", "k", "x", "y", "confidence").dropna(subset=["k", "x", "y", "confidence"]).filter(F.col("confidence") > threshold)
    best = m.groupBy(*FRAME).agg(F.max("confidence").alias("_best"), F.max_by("k", F.struct("confidence", -F.col("k"))).alias("_first"))
    m = m.join(best, FRAME).filter(F.when(F.col("_best") >= early, F.col("k") == F.col("_first")).otherwise(F.col("confidence") >= F.col("_best") - within))
    m = m.select("session", "seq", "k", "x", "y", "confidence", (-F.col("confidence")).alias("_order"))
    m = islands(m, F.col("x") - F.lag("x").over(ordered("x", "k", by=FRAME)) >= distance, ["x", "k"], by=FRAME)

    def step(g: dict[str, np.ndarray]) -> list[tuple]:
        own = [g[c] for c in ("session", "seq", "k", "x", "y", "confidence")]
        return [tuple(c[i] for c in own) for i in apart(g["x"], g["y"], distance)]

    return fold(m, [*FRAME, "island"], ["_order", "k"], step, "session long, seq long, k long, x double, y double, confidence double")


def _winner(threshold: float, early: float) -> Column:
    """Of a group of matches the first that reaches `early`, else the surest over the threshold (of equal ones the first).

    Structs compare by their first field: reached or not, then place in order or confidence.
    """
    sure = F.col("confidence") >= early
    rank = F.struct(sure.cast("int").alias("sure"), F.when(sure, -F.col("k").cast("double")).otherwise(F.col("confidence")).alias("by"), (-F.col("k")).alias("first"))
    return F.max_by(F.struct("k", "template", "x", "y", "confidence"), F.when(F.col("confidence") > threshold, rank))


def first_or_best(matches: DataFrame, threshold: float, early: float) -> DataFrame:
    """One match for each frame that has any over the threshold (strict): the first that reaches `early`, else the best."""
    won = matches.filter(F.col("confidence") > threshold).groupBy(*FRAME).agg(_winner(threshold, early).alias("_w"))
    return won.select(*FRAME, "_w.*")


def sticky_matches(frames: DataFrame, matches: DataFrame, threshold: float, early: float) -> DataFrame:
    """Per frame (session, seq, ts): x, y, confidence, template, detected. The template that matched last is tried alone first; only
    where it has no match all are. A frame without a match has zeros, and nothing is tried first after it.

    What follows a frame in which no template or only one matches does not depend on what came before, so sessions are cut
    there. A frame has at most one row for each template.
    """
    won = matches.filter(F.col("confidence") > threshold).groupBy(*FRAME, "template").agg(_winner(threshold, early).alias("_w"))
    rows = won.select(*FRAME, "_w.*")
    all_ = rows.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"), _winner(threshold, early)["k"].alias("any"), F.min("template").alias("only"))
    timed = frames.select("session", "seq", "ts").join(all_, FRAME, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = ordered("ts", "seq")
    timed = timed.withColumn("last", F.when(F.lag("n").over(w) == 1, F.lag("only").over(w)))
    timed = islands(timed, F.lag("n").over(w) <= 1, ["ts", "seq"])
    zero = F.lit(0.0)
    clear = timed.filter("n = 0").select("session", "seq", "ts", zero.alias("x"), zero.alias("y"), zero.alias("confidence"), F.lit("").alias("template"), F.lit(False).alias("detected"))
    tried = timed.filter("n > 0").join(rows, FRAME).select("session", "island", "ts", "seq", "k", "any", "last", "template", "x", "y", "confidence")

    def step(g: dict[str, np.ndarray]) -> list[tuple]:
        out, last = [], g["last"][0]
        at = np.flatnonzero(np.r_[True, g["seq"][1:] != g["seq"][:-1]]).tolist()
        for i, j in zip(at, [*at[1:], len(g["seq"])]):
            pick = next((r for r in range(i, j) if g["template"][r] == last), None)
            if pick is None:
                pick = next(r for r in range(i, j) if g["k"][r] == g["any"][r])
            last = g["template"][pick]
            out.append((g["session"][pick], g["seq"][pick], g["ts"][pick], g["x"][pick], g["y"][pick], g["confidence"][pick], last, True))
        return out

    found = fold(tried, ["session", "island"], ["ts", "seq", "k"], step, "session long, seq long, ts double, x double, y double, confidence double, template string, detected boolean")
    return found.unionByName(clear)


def resolved_candidates(
    frames: DataFrame,
    candidates: DataFrame,
    flows: DataFrame,
    scale: float = 1.0,
    cell: float = 5.0,
    cluster_gap: float = 5000.0,
    visits: int = 3,
    width: float = 10_000.0,
) -> DataFrame:
    """One detection for each frame (session, seq, ts) from its candidates (session, seq, k, x, y, confidence, template).

    No candidate is no detection, a single one is it. Of several the best score counts: confidence, nearness to the place
    between the detection before and the next single candidate, less for a move along a flow (session, seq, start, end,
    magnitude, uniformity, direction; the first that covers the frame) and for places that are visited over and over.
    Places are in whole pixels of the frame, `scale` times those of the candidates; halves go to the even one.

    The scan's state is the last detection. A single candidate is one whatever came before, so sessions are cut there; the
    places on either side come along as columns.
    """
    keyed = candidates.withColumns({"cx": F.bround(F.col("x") / cell, 0), "cy": F.bround(F.col("y") / cell, 0)})
    timed = keyed.join(frames.select("session", "seq", "ts"), FRAME)
    often = position_clusters(timed.withColumn("detected", F.lit(True)), cell, cluster_gap).select("session", "cx", "cy", "clusters")
    single = F.struct("k", "x", "y", "confidence", "template")
    held = candidates.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"), F.min_by(single, "k").alias("c"))
    line = frames.select("session", "seq", "ts").join(held, FRAME, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    place = F.when(F.col("n") == 1, F.struct("ts", F.rint(F.col("c.x") * scale).alias("x"), F.rint(F.col("c.y") * scale).alias("y")))
    w = ordered("ts", "seq")
    back = W.partitionBy("session").orderBy(F.desc("ts"), F.desc("seq"))
    line = line.withColumn("_place", place)
    line = line.withColumns({"_b": F.last("_place", ignorenulls=True).over(w), "_a": F.last("_place", ignorenulls=True).over(back)})
    line = islands(line, F.col("n") == 1, ["ts", "seq"])
    sides = {f"{s}{c}": F.col(f"_{s}.{n}") for s in "ba" for c, n in (("t", "ts"), ("x", "x"), ("y", "y"))}
    open_ = line.filter("n > 1").withColumns(sides).select("session", "island", "seq", "ts", *sides)
    covered = interval_join(open_.select("session", "seq", F.col("ts").alias("start"), F.col("ts").alias("end")), flows, width, strict=False)
    flow = covered.groupBy("session", F.col("l.seq").alias("seq")).agg(F.min_by("r", F.struct("r.start", "r.seq")).alias("f"))
    flow = flow.select("session", "seq", F.col("f.magnitude").alias("fm"), F.col("f.uniformity").alias("fu"), F.col("f.direction").alias("fd"))
    rows = open_.join(flow, FRAME, "left").join(keyed, FRAME).join(often, ["session", "cx", "cy"], "left")
    rows = rows.select("session", "island", "ts", "seq", "k", "x", "y", "confidence", "template", "clusters", *sides, "fm", "fu", "fd")

    def score(g: dict[str, np.ndarray], r: int, expected: tuple | None, before: tuple | None) -> float:
        value, x, y = g["confidence"][r], g["x"][r], g["y"][r]
        if expected is not None:
            away = sqrt((x - expected[0]) ** 2 + (y - expected[1]) ** 2)
            value += 0.03 if away < 20 else 0.03 * (1.0 - (away - 20.0) / 80.0) if away < 100 else -0.02
        if before is not None and g["fm"][r] >= 3.0 and g["fu"][r] >= 0.6:
            dx, dy = x * scale - before[1], y * scale - before[2]
            size = sqrt(dx * dx + dy * dy)
            if size > 1.0:
                ux, uy = DIRECTIONS.get(g["fd"][r], (0.0, 0.0))
                along = dx / size * ux + dy / size * uy
                value -= 0.03 * max(0.0, along) * (min(g["fm"][r] / 3.0, 1.0) * g["fu"][r])
        if g["clusters"][r] > visits:
            value -= 0.02 * min((g["clusters"][r] - visits) / 5.0, 1.0)
        return value

    def step(g: dict[str, np.ndarray]) -> list[tuple]:
        has = lambda v: v is not None and v == v
        before = (g["bt"][0], g["bx"][0], g["by"][0]) if has(g["bt"][0]) else None
        after = (g["at"][0], g["ax"][0], g["ay"][0]) if has(g["at"][0]) else None
        out = []
        at = np.flatnonzero(np.r_[True, g["seq"][1:] != g["seq"][:-1]]).tolist()
        for i, j in zip(at, [*at[1:], len(g["seq"])]):
            t, expected = g["ts"][i], None
            if before and after:
                if after[0] > before[0]:
                    part = (t - before[0]) / (after[0] - before[0])
                    expected = tuple((before[d] + (after[d] - before[d]) * part) / scale for d in (1, 2))
            elif before or after:
                expected = tuple(v / scale for v in (before or after)[1:])
            pick = max(range(i, j), key=lambda r: (score(g, r, expected, before), -r))
            before = (t, float(np.rint(g["x"][pick] * scale)), float(np.rint(g["y"][pick] * scale)))
            out.append((g["session"][pick], g["seq"][pick], t, before[1], before[2], g["confidence"][pick], g["template"][pick], True))
        return out

    chosen = fold(rows, ["session", "island"], ["ts", "seq", "k"], step, "session long, seq long, ts double, x double, y double, confidence double, template string, detected boolean")
    one = F.col("n") == 1
    clear = line.filter("n <= 1").select(
        "session", "seq", "ts",
        *(F.when(one, F.col(f"_place.{c}")).otherwise(0.0).alias(c) for c in "xy"),
        F.when(one, F.col("c.confidence")).otherwise(0.0).alias("confidence"),
        F.when(one, F.col("c.template")).otherwise("").alias("template"),
        one.alias("detected"),
    )
    return chosen.unionByName(clear)

"""Where and when a moment is looked at, how many moments there may be, and where a point of the viewer lies in a video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import ordered

#: How long before and after a change its frames are, and the categories that are seen before and after.
BESIDE_MS = 250.0
PAIRED = ("interaction", "pre_scene_change")


def representative_time(category: Column, start: Column, end: Column) -> Column:
    """The time of a moment's one frame: shortly after a scene change has settled, at the start of a continuous change, else in the
    middle."""
    return F.when(category == "scene_change", end + BESIDE_MS).when(category == "continuous", start).otherwise((start + end) / 2.0)


def frame_times(category: Column, start: Column, end: Column, frames: Column, has_change: Column) -> Column:
    """The times of a moment's frames as an array. A change is seen shortly before (from 0 on) and after it, with evenly spaced
    frames between where there are more than two; anything else evenly from start to end, or once in its middle. frames of 0
    or less: two for a change, one for anything else."""
    paired = category.isin(*PAIRED) & F.coalesce(has_change, F.lit(False))
    n = F.when(F.coalesce(frames, F.lit(0)) > 0, frames).when(paired, 2).otherwise(1)
    spread = lambda a, b: F.when(b >= a, F.transform(F.sequence(a, F.greatest(a, b)), lambda k: start + (end - start) * k / (n - 1))).otherwise(F.array().cast("array<double>"))
    before, after = F.array(F.greatest(F.lit(0.0), start - BESIDE_MS)), F.array(end + BESIDE_MS)
    ends = F.when(n <= 2, F.concat(before, after)).otherwise(F.concat(before, spread(F.lit(1), n - 2), after))
    middle = F.array((start + end) / 2.0)
    return F.when(paired, ends).when((n <= 1) | (end <= start), middle).otherwise(spread(F.lit(0), n - 1))


def density_cap(moments: DataFrame, minutes: Column, per_minute: float) -> DataFrame:
    """The most important moments of each session, then the earliest: minutes * per_minute of them in whole, one at least. A rate of
    0 or less keeps all."""
    if per_minute <= 0:
        return moments
    most = F.greatest(F.lit(1), F.floor(minutes * per_minute))
    place = F.row_number().over(ordered("priority", "start", "seq"))
    return moments.withColumns({"_n": place, "_most": most}).filter(F.col("_n") <= F.col("_most")).drop("_n", "_most")


def beside_rows(df: DataFrame, order: list[str], before: dict[str, str], after: dict[str, str] | None = None) -> DataFrame:
    """df with values of the row before (new name -> column) and of the row after in each session's order; null at the ends."""
    w = ordered(*order)
    return df.withColumns({n: F.lag(c).over(w) for n, c in before.items()} | {n: F.lead(c).over(w) for n, c in (after or {}).items()})


def estimated_tokens(segments: DataFrame, fps: float, per_frame: int = 263) -> DataFrame:
    """(session, tokens): whole tokens of each segment (start, end) at a frame rate, added up."""
    each = F.floor((F.col("end") - F.col("start")) / 1000.0 * fps * per_frame).cast("long")
    return segments.groupBy("session").agg(F.sum(each).alias("tokens"))


def half_up(x: Column) -> Column:
    """To the nearest whole number, halves up: what the viewer rounds by."""
    return F.floor(x + 0.5)


def native_point(x: Column, y: Column, left: Column, top: Column, width: Column, height: Column, native_w: int, native_h: int) -> Column:
    """struct(x, y): a point on a player's element in pixels of the video, which stands in the element's middle with its own shape;
    points beside it are moved onto its edge. Null without a video or an element."""
    scale = F.least(width / native_w, height / native_h)  # the video fills the element one way

    def side(at: Column, begin: Column, size: Column, native: int) -> Column:
        edge = begin + (size - native * scale) / 2
        return half_up(F.greatest(F.lit(0.0), F.least(F.lit(float(native)), (at - edge) / scale)))

    sound = (F.lit(native_w) > 0) & (F.lit(native_h) > 0) & (width > 0) & (height > 0)
    return F.when(sound, F.struct(side(x, left, width, native_w).alias("x"), side(y, top, height, native_h).alias("y")))


def drag_box(a: Column, b: Column, least: int = 5) -> Column:
    """struct(x, y, w, h) between two points (structs x, y); null where it is under `least` pixels wide or high."""
    w, h = F.abs(a["x"] - b["x"]), F.abs(a["y"] - b["y"])
    box = F.struct(F.least(a["x"], b["x"]).alias("x"), F.least(a["y"], b["y"]).alias("y"), w.alias("w"), h.alias("h"))
    return F.when((w >= least) & (h >= least), box)


def stored_ms(video_ms: Column, offset: Column) -> Column:
    """A time of the video on the stored clock, in whole milliseconds."""
    return half_up(video_ms + offset)


def video_ms(stored: Column, offset: Column) -> Column:
    return stored - offset

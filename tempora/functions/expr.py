"""Column expressions of the timeline operators; all stay inside Spark's own code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Triage

#: Bins of 45 degrees from east on, with the y axis pointing down turned up.
COMPASS = ("E", "NE", "N", "NW", "W", "SW", "S", "SE")
#: The order in which ties of a direction count are settled.
TIE_ORDER = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def session_ms(ts: str = "ts") -> Column:
    """A timestamp as DOUBLE milliseconds since the epoch."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1000.0)


def tier(magnitude: Column, idle: float, low: float, medium: float) -> Column:
    return (
        F.when(magnitude < idle, "idle").when(magnitude < low, "low").when(magnitude < medium, "medium").otherwise("high")
    )


def tier_fps(name: Column) -> Column:
    out = F.lit(4.0)
    for k, v in Triage().fps.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out


def rounded(x: Column, digits: int) -> Column:
    """A double at so many digits as the oracle's round() has it: x times a power of ten, as a double, to the nearest whole number,
    halves away from zero. F.round goes by the shortest decimal of x, which at a half is another number now and then."""
    power = F.lit(10.0**digits)
    return F.round(x * power) / power


def valid() -> Column:
    """Detected, or filled in from neighbours that were."""
    return F.col("detected") | (F.col("confidence") > 0)


def compass(radians: Column) -> Column:
    angle = F.pmod(F.degrees(radians), F.lit(360.0))
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.floor((angle + 22.5) / 45.0) % 8 + 1).cast("int"))


def compass_rank(direction: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIE_ORDER)), direction)


def effective_end(start: Column, end: Column) -> Column:
    """The end, or the start where the end is missing or 0."""
    return F.coalesce(F.nullif(end, F.lit(0.0)), start)


def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    high = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    both = wide * high
    union = aw * ah + bw * bh - both
    return F.when(union > 0, both / union).otherwise(0.0)


def box_iou(a: Column, b: Column) -> Column:
    return iou(a["x"], a["y"], a["w"], a["h"], b["x"], b["y"], b["w"], b["h"])


def point_line(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point from the line through a and b."""
    long = F.hypot(bx - ax, by - ay)
    return F.when(long > 0, F.abs((bx - ax) * (ay - py) - (ax - px) * (by - ay)) / long).otherwise(F.hypot(px - ax, py - ay))


def turning_angle(dx1, dy1, dx2, dy2) -> Column:
    """Degrees between two steps; null where one is half a pixel or shorter."""
    a, b = F.sqrt(dx1 * dx1 + dy1 * dy1), F.sqrt(dx2 * dx2 + dy2 * dy2)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (dx1 * dx2 + dy1 * dy2) / (a * b)))
    return F.when((a > 0.5) & (b > 0.5), F.degrees(F.acos(cos)))


def image_tokens(width: Column, height: Column, per_tile: int = 258) -> Column:
    return (F.ceil(width / 768.0) * F.ceil(height / 768.0) * per_tile).cast("long")


def roi_side(need: Column, size: int, padding: int, frame: Column) -> Column:
    return F.least(F.greatest(F.lit(size), need + 2 * padding), frame)


def moment_tokens(category: Column, bw: Column, bh: Column, width: Column, height: Column, size: int = 256, padding: int = 64) -> Column:
    """Cost of one picture of a moment: whole frame or region of interest; bw and bh are null without a changed box."""
    whole = category.isin("scene_change", "scroll", "continuous", "baseline") | ((category == "pre_scene_change") & bw.isNull())
    side = F.lit(size + 2 * padding)
    roi = image_tokens(
        F.coalesce(roi_side(bw, size, padding, width), F.least(side, width)),
        F.coalesce(roi_side(bh, size, padding, height), F.least(side, height)),
    )
    return F.when(whole, image_tokens(width, height)).otherwise(roi)


def base_frames(category: Column, bw: Column) -> Column:
    return F.when((category == "pre_scene_change") | ((category == "interaction") & bw.isNotNull()), 2).otherwise(1)


def ideal_frames(category: Column, bw: Column, duration: Column, sample_ms: float, most: int) -> Column:
    base = base_frames(category, bw)
    if sample_ms <= 0:
        return base
    steps = duration / F.lit(float(sample_ms))
    many = F.when(base == 2, 2 + F.greatest(F.lit(0), F.floor(steps) - 1)).otherwise(F.greatest(F.lit(1), F.ceil(steps)))
    if most > 0:
        many = F.least(many, F.lit(most))
    return F.when(duration <= 0, base).otherwise(F.greatest(base, many)).cast("int")


def region_around(x: Column, y: Column, width: int, height: int, size: int) -> Column:
    """(rx, ry, rw, rh) of a square of `size` around a place (whole pixels), moved inside the frame; around its middle where
    the place is null. A frame smaller than the square is taken whole from its corner."""

    def side(at: Column, frame: int) -> Column:
        begin = F.when(at.isNull(), F.lit(max(0, frame // 2 - size // 2))).otherwise(F.greatest(F.lit(0), F.least(at.cast("int") - size // 2, F.lit(frame - size))))
        return begin.cast("int")

    rx, ry = side(x, width), side(y, height)
    rw = F.when(x.isNull(), F.lit(min(size, width))).otherwise(F.least(F.lit(size), F.lit(width) - rx))
    rh = F.when(y.isNull(), F.lit(min(size, height))).otherwise(F.least(F.lit(size), F.lit(height) - ry))
    return F.struct(rx.alias("rx"), ry.alias("ry"), rw.alias("rw"), rh.alias("rh"))


def budget_fps(fps: Column, duration_ms: Column, budget: Column, per_frame: int = 1548) -> Column:
    """The frame rate under a token budget, 0.5 at least."""
    frames = F.floor(fps * duration_ms / 1000.0).cast("long")
    fits = F.floor(budget / F.lit(float(per_frame))).cast("long")
    return F.when(frames * per_frame <= budget, fps).otherwise(F.greatest(F.lit(0.5), fits / (duration_ms / 1000.0)))


def clock(ms: Column) -> Column:
    """m:ss.s"""
    seconds = ms / 1000.0
    minutes = F.floor(seconds / 60.0)
    return F.concat(minutes.cast("string"), F.lit(":"), F.lpad(F.format_string("%.1f", seconds - minutes * 60.0), 4, "0"))


def one_line(kind: Column, start: Column, text: Column, width: int = 80) -> Column:
    cut = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)
    return F.concat(F.lit("["), clock(start), F.lit("] "), kind, F.lit(": "), cut)


def position_ms(text: Column) -> Column:
    """Milliseconds of `123`, `1500ms`, `1.5s` or `mm:ss.f`; null for anything else."""
    number = "([0-9]+(?:\\.[0-9]+)?)"
    get = lambda pattern, i=1: F.regexp_extract(text, pattern, i).cast("double")
    return (
        F.when(text.rlike(f"^{number}ms$"), get(f"^{number}ms$"))
        .when(text.rlike(f"^{number}s$"), get(f"^{number}s$") * 1000.0)
        .when(text.rlike(f"^([0-9]+):{number}$"), get(f"^([0-9]+):{number}$", 1) * 60000.0 + get(f"^([0-9]+):{number}$", 2) * 1000.0)
        .when(text.rlike(f"^{number}$"), get(f"^{number}$"))
    )


def filled(template: Column, values: dict[str, Column]) -> Column:
    """`{name}` replaced by its value; names without one stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def typed_override(text: Column) -> Column:
    """The kind of value that an override's text has."""
    return (
        F.when(text.isNull() | (text == ""), "ignored")
        .when(F.lower(text).isin("true", "false"), "boolean")
        .when(text.rlike("^[+-]?[0-9]+$"), "integer")
        .when(text.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"), "float")
        .otherwise("string")
    )


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8)

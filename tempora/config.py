"""Default thresholds of the timeline operators. Results depend on them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Triage:
    sample_fps: float = 5.0
    window_ms: float = 3000.0
    step_ms: float = 1000.0
    min_segment_ms: float = 5000.0
    idle: float = 0.005
    low: float = 0.02
    medium: float = 0.08
    fps: dict = field(default_factory=lambda: {"idle": 0.5, "low": 2.0, "medium": 4.0, "high": 10.0})


@dataclass(frozen=True)
class Merge:
    tolerance_ms: float = 2000.0
    similarity: float = 0.7
    overlap_close_ms: float = 3000.0
    overlap_similarity: float = 0.3


@dataclass(frozen=True)
class Evaluation:
    tolerance_ms: float = 2000.0
    min_score: float = 0.5
    two_pass_ms: float = 5000.0
    min_f1: float = 0.3
    min_recall: float = 0.2
    min_precision: float = 0.15
    slope: float = 0.02
    decline: float = 0.1
    min_sessions: int = 2


@dataclass(frozen=True)
class Trajectory:
    displacement_px: float = 30.0
    padding_ms: float = 500.0
    max_gap_ms: float = 500.0
    smooth_window: int = 3
    smooth_px: float = 50.0
    static_ms: float = 3000.0
    static_px: float = 1.0
    lookup_ms: float = 200.0


@dataclass(frozen=True)
class Behaviour:
    hover_ms: tuple = (300.0, 2000.0)
    hover_px: float = 15.0
    dwell_ms: float = 2000.0
    dwell_px: float = 20.0
    hesitation_ms: tuple = (500.0, 2000.0)
    hesitation_px: float = 10.0
    stop_ms: float = 300.0
    stop_px: float = 15.0
    thrash_ms: float = 1000.0
    thrash_turns: int = 4
    thrash_speed: float = 500.0
    thrash_degrees: float = 90.0
    click_ms: float = 200.0
    click_px: float = 5.0
    follow_ms: float = 1000.0


@dataclass(frozen=True)
class Change:
    fps: float = 4.0
    scene_area: float = 0.3
    continuous_ms: float = 3000.0
    flow_step_ms: float = 500.0
    flow_uniformity: float = 0.6
    flow_magnitude: float = 3.0


@dataclass(frozen=True)
class Moments:
    tokens_per_minute: float = 50_000.0
    merge_gap_ms: float = 500.0
    baseline_gap_ms: float = 5000.0
    roi_size: int = 256
    roi_padding: int = 64
    per_minute: float = 0.0
    sample_ms: float = 0.0
    frame_dedup_ms: float = 200.0
    batch_gap_ms: float = 5000.0
    batch_frames: int = 32


@dataclass(frozen=True)
class Frames:
    scan_gap_ms: float = 3000.0
    change: float = 0.03
    baseline_gap_ms: float = 5000.0
    dedup_ms: float = 200.0
    lookup_ms: float = 200.0
    roi_size: int = 256
    roi_padding: int = 64


#: Lower is more important.
MOMENT_PRIORITY = {
    "scene_change": 0,
    "interaction": 1,
    "pre_scene_change": 1,
    "scroll": 2,
    "continuous": 2,
    "cursor_stop": 3,
    "cursor_only": 4,
    "baseline": 5,
}

#: The types an event may have; another becomes the last.
EVENT_TYPES = (
    "click", "hover", "navigate", "input_text", "select",
    "dwell", "cursor_thrash", "scroll", "drag", "hesitate", "change_ui_state",
)


def _flag(text: str) -> bool:
    return {"true": True, "false": False}[text.lower()]


def typed(text: str):
    """A setting's value from its text: the first of boolean, integer and float that reads it, else the text."""
    for read in (_flag, int, float):
        with suppress(KeyError, ValueError):
            return read(text)
    return text


def overrides(items: list[str]) -> dict:
    """`a.b=value` items as one layer for resolve(); items without a name or a value count for nothing, of equal paths the last
    one counts."""
    cut = (item.split("=", 1) for item in items if "=" in item)
    found: dict[tuple, object] = {}
    for path, value in ((p.strip(), v.strip()) for p, v in cut):
        if path and value:
            _put(found, tuple(path.split(".")), typed(value))
    return _tree(found)


def leaves(layer: dict, above: tuple = ()) -> Iterator[tuple[tuple, object]]:
    """(path, value) of what a layer sets; an empty dictionary is a value of its own."""
    for key, value in layer.items():
        if isinstance(value, dict) and value:
            yield from leaves(value, (*above, key))
        else:
            yield (*above, key), value


def _put(found: dict[tuple, object], path: tuple, value: object) -> None:
    """Give a path its value. Whatever stood on the way to it or below it goes; an empty dictionary changes nothing where there is
    one with settings already."""
    below = [p for p in found if len(p) > len(path) and p[: len(path)] == path]
    if value == {} and below:
        return
    for p in [*below, *(path[:n] for n in range(1, len(path) + 1))]:
        found.pop(p, None)
    found[path] = value


def _tree(found: dict[tuple, object]) -> dict:
    out: dict = {}
    for path, value in found.items():
        at = out
        for key in path[:-1]:
            at = at.setdefault(key, {})
        at[path[-1]] = value
    return out


def resolve(*layers: dict | None) -> dict:
    """Layers from the weakest to the strongest: of each path the last value counts. A value and a dictionary replace each other
    whole; an empty dictionary changes nothing where there is one already."""
    found: dict[tuple, object] = {}
    for layer in layers:
        for path, value in leaves(layer or {}):
            _put(found, path, value)
    return _tree(found)

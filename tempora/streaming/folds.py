"""Order-dependent operators over streams, with the rows that the batch operators give.

A session's rows wait in its state until the watermark has passed them, as an earlier row may still come; then they are final, and
a step walks over them, sends what no later row can change and keeps the rest. Rows later than the watermark are dropped. A
session without a row for `idle_ms` has ended: what it keeps is sent, its state goes, and a later row begins it anew. The state
holds what the watermark has not passed and the open group, never a whole session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import within_reach

#: What a row brings along and a session keeps of it; `sent` says that it is only kept for those after it.
ROW = {"seq": "long", "ts": "double", "x": "double", "y": "double", "confidence": "double", "detected": "boolean"}
KINDS = {"long": np.int64, "double": np.float64, "boolean": bool}

#: step(rows, how many are final, whether the session has ended) -> (rows sent, where what is kept begins).
Step = Callable[[dict[str, np.ndarray], int, bool], tuple[list[tuple], int]]


def walked(rows: DataFrame, step: Step, schema: str, late: str, idle_ms: float) -> DataFrame:
    """rows (session, seq, ts in ms, x, y, confidence, detected) of a stream through a step; output has the session first."""
    names = [*ROW, "sent"]
    kept = ", ".join(f"{c} array<{ROW.get(c, 'boolean')}>" for c in names)
    out = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [pd.DataFrame(dict(zip(names, state.get)))] if state.exists else []
        parts += [b.assign(sent=False)[names] for b in batches if len(b)]
        if not parts:
            return
        all_ = pd.concat(parts, ignore_index=True).sort_values(["ts", "seq"], kind="stable")
        held = {c: all_[c].to_numpy(KINDS[ROW.get(c, "boolean")]) for c in names}
        t, mark = held["ts"], state.getCurrentWatermarkMs()
        final = int(np.searchsorted(t, mark, side="right"))
        over = final == len(t) and t[-1] + idle_ms <= mark
        made, at = step(held, final, over)
        if over or at >= len(t):
            if state.exists:
                state.remove()
        else:
            state.update(tuple(held[c][at:].tolist() for c in names))
            wake = t[final] if final < len(t) else t[-1] + idle_ms
            state.setTimeoutTimestamp(int(max(wake, mark)) + 1)
        if made:
            yield pd.DataFrame([(key[0], *r) for r in made], columns=out)

    timed = rows.select("session", *ROW).withColumn("_at", F.timestamp_micros((F.col("ts") * 1000).cast("long"))).withWatermark("_at", late)
    return timed.groupBy("session").applyInPandasWithState(run, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)


def stationary(rows: DataFrame, radius: float, late: str, idle_ms: float) -> DataFrame:
    """Runs of two rows or more within the radius of their first: (session, start, end, x, y, n). A run is sent when a row ends it."""

    def step(g: dict[str, np.ndarray], final: int, over: bool) -> tuple[list[tuple], int]:
        t, x, y, out, i = g["ts"][:final], g["x"][:final], g["y"][:final], [], 0
        while i < final:
            j = within_reach(x, y, i, radius)
            if j == final - 1 and not over:
                break  # it may go on
            if j > i:
                out.append((t[i], t[j], x[i], y[i], j - i + 1))
            i = j + 1
        return out, i

    return walked(rows, step, "session long, start double, end double, x double, y double, n long", late, idle_ms)


SAME = "session long, seq long, ts double, x double, y double, confidence double, detected boolean"


def interpolated(rows: DataFrame, max_gap: float, late: str, idle_ms: float) -> DataFrame:
    """Undetected rows between two detections at most `max_gap` apart on the line between them, with half the lesser confidence.
    A row waits for the next detection as long as that can be near enough; idle_ms should be more than max_gap."""

    def step(g: dict[str, np.ndarray], final: int, over: bool) -> tuple[list[tuple], int]:
        t, x, y, c, seen = (g[k].copy() for k in ("ts", "x", "y", "confidence", "detected"))
        at = np.flatnonzero(seen[:final])
        for a, b in zip(at, at[1:]):
            if 0 < t[b] - t[a] <= max_gap:
                m = np.arange(a + 1, b)
                part = (t[m] - t[a]) / (t[b] - t[a])
                x[m], y[m], c[m] = x[a] + (x[b] - x[a]) * part, y[a] + (y[b] - y[a]) * part, min(c[a], c[b]) / 2
        last = at[-1] if len(at) else -1
        # What follows the last detection is settled once none that can still come is near enough to it.
        settled = over or last < 0 or (final > last + 1 and t[final - 1] - t[last] > max_gap)
        end = final if settled else last + 1
        out = [(g["seq"][i], t[i], x[i], y[i], c[i], bool(seen[i])) for i in range(end) if not g["sent"][i]]
        g["sent"][:end] = True
        return out, end if settled else max(last, 0)

    return walked(rows, step, SAME, late, idle_ms)


def smoothed(rows: DataFrame, window: int, limit: float, late: str, idle_ms: float) -> DataFrame:
    """Moving average in place, as the batch operator has it: neighbours to the left are smoothed already, those to the right are
    not. A row is sent once window // 2 rows after it are final; the first and last ones of a session stay as they are."""
    half = window // 2

    def step(g: dict[str, np.ndarray], final: int, over: bool) -> tuple[list[tuple], int]:
        x, y, n = g["x"], g["y"], final
        ok = g["detected"] | (g["confidence"] > 0)
        out = []
        i = int(g["sent"].sum())
        while i < n and (i + half < n or over):
            if half <= i < n - half and ok[i]:
                a = abs(x[i] - x[i - 1]) + abs(x[i + 1] - x[i])
                b = abs(y[i] - y[i - 1]) + abs(y[i + 1] - y[i])
                if np.sqrt(a * a + b * b) <= limit:
                    use = [k for k in range(i - half, i + half + 1) if k == i or ok[k]]
                    x[i], y[i] = (sum(v[k] for k in use) / len(use) for v in (x, y))
            out.append((g["seq"][i], g["ts"][i], x[i], y[i], g["confidence"][i], bool(g["detected"][i])))
            g["sent"][i] = True
            i += 1
        return out, max(0, i - half)

    return walked(rows, step, SAME, late, idle_ms)

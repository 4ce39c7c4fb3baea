"""Interfaces to what lies outside Spark: a model that answers requests, and pixel kernels over decoded frames."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Answer(NamedTuple):
    text: str
    input_tokens: int
    output_tokens: int


def ask(provider: Callable[[str], Answer], prompt: str, tries: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Answer:
    """One request, tried again after 2 and 4 seconds."""
    for n in range(tries):
        try:
            return provider(prompt)
        except Exception:
            if n == tries - 1:
                raise
            sleep(wait * 2**n)
    raise ValueError("tries must be positive")


def ask_all(requests: DataFrame, provider: Callable[[str], Answer]) -> DataFrame:
    """(request_id, prompt) -> (request_id, text, input_tokens, output_tokens, error). A request that fails is a row with an
    error and does not stop the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, prompt in zip(b["request_id"], b["prompt"]):
                try:
                    rows.append((key, *ask(provider, prompt), None))
                except Exception as e:
                    rows.append((key, None, 0, 0, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["request_id", "text", "input_tokens", "output_tokens", "error"])

    return requests.select("request_id", "prompt").mapInPandas(run, "request_id string, text string, input_tokens long, output_tokens long, error string")


def frame_difference(a: np.ndarray, b: np.ndarray, above: int = 25) -> tuple[float, tuple[int, int, int, int] | None]:
    """Mean absolute difference of two grey frames over 255, and the box (x, y, w, h) of what changed by more than `above`."""
    d = np.abs(a.astype(np.int16) - b.astype(np.int16))
    y, x = np.nonzero(d > above)
    box = (int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1) if len(x) else None
    return float(d.mean() / 255), box


def runs_of(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of set pixels, row by row."""
    edge = np.diff(np.pad(on, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def changed_regions(a: np.ndarray, b: np.ndarray, above: int = 25, least: int = 1000) -> list[tuple[int, int, int, int, int]]:
    """8-connected changed regions of at least `least` pixels: (x, y, w, h, pixels), by rows. Runs of pixels are joined with the runs
    that they touch in the row above, so the work goes with the number of runs, whatever shape a region has."""
    row, first, last = runs_of(np.abs(a.astype(np.int16) - b.astype(np.int16)) > above)
    above_of = list(range(len(row)))

    def root(i: int) -> int:
        while above_of[i] != i:
            above_of[i] = i = above_of[above_of[i]]
        return i

    begin = np.searchsorted(row, np.arange(a.shape[0] + 1)).tolist()
    for y in range(1, a.shape[0]):
        up, own, end = begin[y - 1], begin[y], begin[y + 1]
        if up == own or own == end:
            continue
        low = up + np.searchsorted(last[up:own], first[own:end] - 1, side="left")
        high = up + np.searchsorted(first[up:own], last[own:end] + 1, side="right")
        for i, j, z in zip(range(own, end), low.tolist(), high.tolist()):
            for k in range(j, z):
                above_of[root(i)] = root(k)
    if not len(row):
        return []
    label = np.array([root(i) for i in range(len(row))], np.int64)
    order = np.argsort(label, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(label[order]) != 0])
    row, first, last = row[order], first[order], last[order]
    x, y = np.minimum.reduceat(first, at), np.minimum.reduceat(row, at)
    w, h = np.maximum.reduceat(last, at) - x + 1, np.maximum.reduceat(row, at) - y + 1
    n = np.add.reduceat(last - first + 1, at)
    found = np.stack([x, y, w, h, n], axis=1)[n >= least]
    return sorted(map(tuple, found.tolist()), key=lambda r: (r[1], r[0]))

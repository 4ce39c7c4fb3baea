"""Text similarity: Ratcliff-Obershelp by Arrow batches, and a Levenshtein ratio that SQL engines share."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Most pairs of equal characters that ratio() holds at a time (some 150 MB); texts with more are compared without them, slowly.
SEEDS = 4_000_000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _seeds(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(i, j, run): places of equal characters, in order, of those that a match may start from, and how many such pairs in a row end
    there. As in difflib, of 200 characters or more none starts a match that is over a hundredth of the second text."""
    order = np.argsort(y, kind="stable")
    chars, first, count = np.unique(y[order], return_index=True, return_counts=True)
    if len(y) >= 200:
        rare = count <= len(y) // 100 + 1
        chars, first, count = chars[rare], first[rare], count[rare]
    none = np.zeros(0, np.int64)
    if not len(chars) or not len(x):
        return none, none, none
    at = np.minimum(np.searchsorted(chars, x), len(chars) - 1)
    place = np.flatnonzero(chars[at] == x)
    n = count[at[place]]
    if n.sum() > SEEDS:
        return None
    i = np.repeat(place, n)
    j = order[np.repeat(first[at[place]] - np.cumsum(n) + n, n) + np.arange(len(i))]
    along = (j - i + len(x)) * (len(x) + 1) + i  # diagonal by diagonal
    by = np.argsort(along)
    new = np.r_[True, np.diff(along[by]) != 1][: len(i)]
    start = np.flatnonzero(new)
    run = np.empty(len(i), np.int64)
    run[by] = np.arange(len(i)) - start[np.cumsum(new) - 1] + 1
    return i, j, run


def _matched(a: str, b: str, seeds: tuple[np.ndarray, np.ndarray, np.ndarray]) -> int:
    """Characters in the matching blocks that difflib finds: the longest run first (the earliest of those), made longer by any equal
    characters beside it, then the same to the left and to the right of it."""
    total, todo = 0, [(0, len(a), 0, len(b), *seeds)]
    while todo:
        alo, ahi, blo, bhi, i, j, run = todo.pop()
        x, y, size = alo, blo, 0
        if len(i):
            long = np.minimum(np.minimum(run, i - alo + 1), j - blo + 1)
            best = int(long.argmax())
            size = int(long[best])
            x, y = int(i[best]) - size + 1, int(j[best]) - size + 1
        while x > alo and y > blo and a[x - 1] == b[y - 1]:
            x, y, size = x - 1, y - 1, size + 1
        while x + size < ahi and y + size < bhi and a[x + size] == b[y + size]:
            size += 1
        if not size:
            continue
        total += size
        if alo < x and blo < y:
            end = int(np.searchsorted(i, x))
            here = j[:end] < y
            todo.append((alo, x, blo, y, i[:end][here], j[:end][here], run[:end][here]))
        if x + size < ahi and y + size < bhi:
            end = int(np.searchsorted(i, x + size))
            here = j[end:] >= y + size
            todo.append((x + size, ahi, y + size, bhi, i[end:][here], j[end:][here], run[end:][here]))
    return total


def ratio(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp on lower-cased text, the value that difflib gives; the order of the arguments matters. Null counts as empty."""
    a, b = (a or "").lower(), (b or "").lower()
    if a == b:  # its first longest run meets itself, and all beside it is equal
        return 1.0
    seeds = _seeds(_codes(a), _codes(b))
    if seeds is None:
        return SequenceMatcher(None, a, b).ratio()
    return 2.0 * _matched(a, b, seeds) / (len(a) + len(b))


def possible(a: str | None, b: str | None, least: float) -> bool:
    """Whether bounds by length and by letters, which are never less than ratio(), reach `least`."""
    a, b = (a or "").lower(), (b or "").lower()
    if not a and not b:
        return 1.0 >= least
    if 2.0 * min(len(a), len(b)) / (len(a) + len(b)) < least:
        return False
    (x, n), (y, m) = (np.unique(_codes(t), return_counts=True) for t in (a, b))
    _, p, q = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return 2.0 * int(np.minimum(n[p], m[q]).sum()) / (len(a) + len(b)) >= least


def similar(a: str | None, b: str | None, least: float) -> bool:
    """Whether ratio() is at least `least`; its bounds come first, and equal texts are at once."""
    if (a or "").lower() == (b or "").lower():
        return least <= 1.0
    return possible(a, b, least) and ratio(a, b) >= least


def obershelp(a: Column, b: Column, least: Column | None = None) -> Column:
    """ratio() of each pair; where `least` is given and bounds by length and letters show that a pair is below it, -1. A pair of
    texts that comes again in a batch is looked up."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y, z in batches:
            known: dict[tuple[str | None, str | None], float] = {}
            out = []
            for p, q, low in zip(x, y, z):
                p, q = p or "", q or ""
                if (p, q) not in known:
                    if low > 0 and not possible(p, q, low):
                        out.append(-1.0)
                        continue
                    known[p, q] = ratio(p, q)
                out.append(known[p, q])
            yield pd.Series(out, dtype="float64")

    return run(a, b, F.lit(0.0) if least is None else least)


def edit_ratio(a: Column, b: Column, least: Column | None = None) -> Column:
    """1 - edit distance / longer length, 1 for two empty texts; on the UTF-8 bytes of lower-cased text, which is what SQL engines
    share. `least` is there for scored_pairs() and changes nothing."""
    a, b = (F.decode(F.encode(F.lower(F.coalesce(t, F.lit(""))), "UTF-8"), "ISO-8859-1") for t in (a, b))  # a character for each byte
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)

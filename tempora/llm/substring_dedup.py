"""Repeated passages: remove every byte that a window of `width` bytes covers which also starts earlier.

Every window has an anchor, a gram chosen by the window's bytes alone. Windows whose gram stands once in the corpus end
there. Where it stands more often, runs of windows with equal content are settled at once; of the unlike rest the suffixes
from the anchors on are sorted, and intervals of equal suffixes are extended backwards up to the bound (see expand()).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_BYTES, U64, discard, mix, powers, slices, stored, table, utf8

#: Bytes of the grams of which each window's least is its anchor.
GRAM = 24
#: Runs of one gram that are compared in one row; the windows of more than that are dealt by their own hashes.
MANY = 64
_BITS = U64(23)


def anchors(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """For rows of bytes: (row, first start, number of starts, gram hash, content hash, anchor's place from the first start)
    for every run of windows that share one anchor, the rightmost least gram of a window.

    Anchors depend on a window's bytes alone, so equal windows have equal grams at equal places. The content hash covers
    all bytes of the run's windows and where the anchor is in them.
    """
    assert len(raw) < 1 << int(_BITS), "places in a slice have 23 bits"
    w = width - GRAM + 1
    n = len(raw) - width + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64, np.int64))
    gram = raw.astype(U64) + U64(1)
    base, have = 0x100000001B3, 1
    parts = {1: gram}
    while 2 * have <= GRAM:
        gram = parts[have]
        parts[2 * have] = gram[: len(gram) - have] * U64(pow(base, have, 2**64)) + gram[have:]
        have *= 2
    gram, size = parts[have], have
    for more in sorted(parts, reverse=True):
        if size + more <= GRAM:
            m = len(raw) - (size + more) + 1
            gram = gram[:m] * U64(pow(base, more, 2**64)) + parts[more][size : size + m]
            size += more
    del parts
    key = mix(gram)
    at = np.arange(len(key), dtype=U64)
    least = (key >> _BITS << _BITS) | ((U64(1) << _BITS) - U64(1) - at)
    have = 1
    while 2 * have <= w:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    least = np.minimum(least[:n], least[w - have : w - have + n])
    place = ((U64(1) << _BITS) - U64(1) - (least & ((U64(1) << _BITS) - U64(1)))).astype(np.int64)
    size = np.diff(off)
    starts = np.maximum(size - width + 1, 0)
    row = np.repeat(np.arange(len(size)), starts)
    s = np.repeat(off[:-1] - np.r_[0, np.cumsum(starts)][:-1], starts) + np.arange(starts.sum())
    if not len(s):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64, np.int64))
    t = place[s]
    first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (row[1:] != row[:-1])])
    runs = np.diff(np.r_[first, len(s)])
    lo, t, row = s[first], t[first], row[first]
    up, down = powers(len(raw) + 1)
    total = np.r_[U64(0), np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], dtype=U64)]
    end = lo + runs + width - 1
    content = mix((total[end] - total[lo]) * down[lo] + mix((end - lo).astype(U64) * U64(1009) + (t - lo).astype(U64)))
    return row, lo - off[row], runs, mix(key[t] + U64(7)), content, t - lo


def window_hashes(raw: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash for the windows at `start`."""
    up, down = powers(len(raw) + 1)
    out = []
    for add in (1, 0xC2B2AE3D27D4EB4F):
        total = np.r_[U64(0), np.cumsum(mix(raw.astype(U64) + U64(add)) * up[: len(raw)], dtype=U64)]
        out.append(mix((total[start + width] - total[start]) * down[start]))
    return out[0], out[1]


def segments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets, first byte's place in its text); texts over CHUNK_BYTES come in parts that overlap by width - 1."""
    for whole in batches:
        for b in slices(whole, "text"):
            raw, off = utf8(b.column("text"))
            long = np.diff(off) > CHUNK_BYTES
            for i in np.flatnonzero(long):
                text = raw[off[i] : off[i + 1]]
                for at in range(0, len(text) - width + 1, CHUNK_BYTES):
                    part = text[at : at + CHUNK_BYTES + width - 1]
                    yield b.column("id").slice(i, 1), part, np.array([0, len(part)]), np.array([at])
            if long.any():
                b = b.filter(pa.array(~long))
                raw, off = utf8(b.column("text"))
            if b.num_rows:
                yield b.column("id"), raw, off, np.zeros(len(off) - 1, np.int64)


def gram_counts(docs: DataFrame, width: int) -> DataFrame:
    """(gram, n) of the anchors, combined within tasks."""

    def run(batches):
        for _, raw, off, _ in segments(batches, width):
            gram, n = np.unique(anchors(raw, off, width)[3].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int32))], names=["gram", "n"])

    return docs.select("text").withColumn("id", F.lit(0)).mapInArrow(run, "gram long, n int").groupBy("gram").agg(F.sum("n").alias("n"))


def anchor_rows(docs: DataFrame, width: int) -> DataFrame:
    """(gram, content, id, start, run, at) of the anchors."""

    def run(batches):
        for ids, raw, off, begin in segments(batches, width):
            row, lo, n, gram, content, at = anchors(raw, off, width)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(gram.view(np.int64)),
                    pa.array(content.view(np.int64)),
                    ids.take(pa.array(row)),
                    pa.array((lo + begin[row])),
                    pa.array(n.astype(np.int32)),
                    pa.array(at.astype(np.int32)),
                ],
                names=["gram", "content", "id", "start", "run", "at"],
            )

    fields = T._parse_datatype_string("gram long, content long").fields
    return docs.mapInArrow(run, T.StructType([*fields, docs.schema["id"], *T._parse_datatype_string("start long, run int, at int").fields]))


def _open_windows(marked: DataFrame, width: int) -> DataFrame:
    """The runs in `open` (start, run, at, gram, many) as rows (kind, k1, k2, id, start, run, at, bytes).

    ONE_RUN: k1 the gram, with the bytes of the run's windows. ONE_WINDOW: k1 and k2 the window's own 128 bits. AGAIN: a
    window that the task has met at an earlier place already.
    """

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                raw, off = utf8(b.column("text"))
                marks = b.column("open")
                flat = marks.flatten()
                per = np.asarray(pc.list_value_length(marks), dtype=np.int64)
                doc = np.repeat(np.arange(len(per)), per)
                lo, n, at, gram = (np.asarray(flat.field(c), dtype=np.int64) for c in ("start", "run", "at", "gram"))
                many = np.asarray(flat.field("many"), dtype=bool)
                ok = lo + n + width - 1 <= np.diff(off)[doc]  # false only where one id has several texts
                ids, few = b.column("id"), np.flatnonzero(ok & ~many)
                begin = (lo + off[doc])[few]
                data = [raw[i:j].tobytes() for i, j in zip(begin.tolist(), (begin + n[few] + width - 1).tolist())]
                yield _windows(ONE_RUN, gram[few], np.zeros(len(few), np.int64), ids.take(pa.array(doc[few])), lo[few], n[few], at[few], data)
                hot = np.flatnonzero(ok & many)
                if not len(hot):
                    continue
                to = np.r_[0, np.cumsum(n[hot])]
                start = np.repeat(lo[hot] - to[:-1], n[hot]) + np.arange(to[-1])
                row = np.repeat(doc[hot], n[hot])
                w1, w2 = window_hashes(raw, start + off[row], width)
                order = np.lexsort((start, ids.to_numpy()[row], w2, w1))
                new = np.r_[True, (w1[order[1:]] != w1[order[:-1]]) | (w2[order[1:]] != w2[order[:-1]])]
                for kind, which in ((ONE_WINDOW, order[new]), (AGAIN, order[~new])):
                    one, none = np.ones(len(which), np.int64), np.zeros(len(which), np.int64)
                    keys = w1[which].view(np.int64), w2[which].view(np.int64)
                    yield _windows(kind, *keys, ids.take(pa.array(row[which])), start[which], one, none, [None] * len(which))

    return marked.mapInArrow(run, "kind int, k1 long, k2 long, id long, start long, run int, at int, bytes binary")


ONE_RUN, ONE_WINDOW, AGAIN = 0, 1, 2


def _windows(kind: int, k1, k2, ids: pa.Array, start, run, at, data: list) -> pa.RecordBatch:
    short = [pa.array(x.astype(np.int32)) for x in (run, at)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(k1), kind, np.int32)), pa.array(k1), pa.array(k2), ids, pa.array(start), *short, pa.array(data, pa.binary())],
        names=["kind", "k1", "k2", "id", "start", "run", "at", "bytes"],
    )


def expand(group: np.ndarray, ids: np.ndarray, start: np.ndarray, run: np.ndarray, at: np.ndarray, data: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, window start) of the windows that a run of the same group holds earlier.

    All runs of a group share the gram at their anchors. The suffixes from the anchors on are sorted, with the common
    prefix of neighbours. Then the intervals of equal suffixes are extended backwards breadth-first, a byte a level, by the
    byte before the string that each row holds so far: at level n the string has n bytes before the anchor, and rows whose
    suffixes share width - n bytes and whose last n bytes before the anchor are equal hold the same window. Levels stop where
    no window lies further left. Bytes are compared themselves.
    """
    size = np.array([len(d) for d in data], np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8)
    begin = np.r_[0, np.cumsum(size)][:-1] + at
    most = width - GRAM
    right_size, left_size = np.minimum(size - at, width), np.minimum(at, most)
    column = np.arange(width)
    right = np.where(column < right_size[:, None], flat[np.minimum(begin[:, None] + column, len(flat) - 1)], 0).astype(np.uint8)
    words = np.zeros((len(size), -(-width // 8) * 8), np.uint8)
    words[:, :width] = right
    keys = words.view(">u8").astype(U64)
    order = np.lexsort((right_size, *keys.T[::-1], group))
    r, r_size = right[order], right_size[order]
    same = r[1:] == r[:-1]
    common = np.where(same.all(1), width, same.argmin(1))
    common = np.minimum(common, np.minimum(r_size[1:], r_size[:-1]))
    common[group[order][1:] != group[order][:-1]] = -1
    column = np.arange(1, most + 1)
    left = np.where(column <= left_size[:, None], flat[np.maximum(begin[:, None] - column, 0)], 0)[order].astype(np.int64)
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort((start[order] + at[order], ids[order]))] = np.arange(len(order))
    by_place = np.argsort(rank)
    anchor, last = at[order], run[order]
    before = np.zeros(len(order), np.int64)
    rows, starts = [], []
    for n in range(most + 1):
        if n:
            before = np.unique(before * 256 + left[:, n - 1], return_inverse=True)[1]
        suffix = np.r_[0, np.cumsum(common < width - n)]
        here = by_place[((anchor - n >= 0) & (anchor - n < last))[by_place]]
        if not len(here):
            continue
        key = suffix[here] * (before.max() + 1) + before[here]
        first = np.zeros(len(here), bool)
        first[np.unique(key, return_index=True)[1]] = True
        gone = here[~first]
        rows.append(order[gone])
        starts.append((start[order] + anchor - n)[gone])
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(starts)) if rows else (none, none)


def _compared(groups: DataFrame, width: int) -> DataFrame:
    """(id, start, run) of the windows that another run of their gram holds earlier; a row's `runs` has MANY at most."""

    def run(batches):
        for whole in batches:
            for b in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                flat = b.column("runs").flatten()
                if not len(flat):
                    continue
                group = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(b.column("runs")), dtype=np.int64))
                ids, lo, n, at = (np.asarray(flat.field(c), dtype=np.int64) for c in ("id", "start", "run", "at"))
                row, start = expand(group, ids, lo, n, at, flat.field("bytes").to_pylist(), width)
                who = ids[row]
                order = np.lexsort((start, who))
                who, start = who[order], start[order]
                first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (start[1:] > start[:-1] + 1)]) if len(who) else np.zeros(0, np.int64)
                end = np.r_[first[1:], len(who)] - 1 if len(first) else first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who[first]), pa.array(start[first]), pa.array((start[end] - start[first] + 1).astype(np.int32))], names=["id", "start", "run"]
                )

    return groups.mapInArrow(run, "id long, start long, run int")


def _cut(marked: DataFrame, width: int, id_col: str, with_text: bool) -> DataFrame:
    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                raw, off = utf8(b.column("text"))
                n_removed, n_spans, sha, kept = [], [], [], []
                marks = b.column("gone")
                per = np.r_[0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(marks), 0), dtype=np.int64))]
                flat = marks.flatten()
                start, run_ = (np.asarray(flat.field(c), dtype=np.int64) for c in ("start", "run"))
                for i in range(b.num_rows):
                    text = raw[off[i] : off[i + 1]]
                    if per[i + 1] > per[i]:
                        lo = start[per[i] : per[i + 1]]
                        hi = lo + run_[per[i] : per[i + 1]] + width - 1
                        step = np.zeros(len(text) + 1, np.int64)
                        np.add.at(step, np.minimum(lo, len(text)), 1)
                        np.add.at(step, np.minimum(hi, len(text)), -1)
                        out = np.cumsum(step[:-1]) > 0
                        n_removed.append(int(out.sum()))
                        n_spans.append(int((out & ~np.r_[False, out[:-1]]).sum()))
                        text = text[~out]
                    else:
                        n_removed.append(0)
                        n_spans.append(0)
                    data = text.tobytes()
                    sha.append(hashlib.sha256(data).hexdigest())
                    kept.append(data)
                columns = [b.column("id"), pa.array(np.diff(off)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())]
                names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    columns.append(pa.array(kept, pa.binary()))
                    names.append("kept_bytes")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string").fields
    if with_text:
        fields.append(T.StructField("kept_bytes", T.BinaryType()))
    return marked.mapInArrow(run, T.StructType([T.StructField(id_col, marked.schema["id"].dataType), *fields]))


def drop_repeats(
    docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes, which may cut through a character).

    A byte goes when a string of `width` bytes that covers it also starts earlier: in a document with a smaller id, or in
    the same one further left. Null text counts as empty; texts shorter than `width` stay whole. Rows that repeat an id are
    one document and give the same result each; rows with a null id stay whole and count for nothing. Extra columns are
    ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = rows.filter("id IS NOT NULL")
    repeated = stored(gram_counts(known, width).filter("n > 1").select("gram"))
    found = stored(anchor_rows(known, width).join(repeated, "gram"))
    discard(repeated)
    firsts = stored(found.groupBy("gram", "content").agg(F.min(F.struct("id", "start", "run", "at")).alias("f")))
    later = stored(found.join(firsts, ["gram", "content"]).filter("id <> f.id OR start <> f.start").select("id", "start", "run"))
    discard(found)
    # Runs with an equal gram and unequal content may share some windows: those of the first of each content are compared.
    several = stored(firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", (F.col("n") > MANY).alias("many")))
    open_runs = stored(
        firsts.join(several, "gram").groupBy("f.id").agg(F.collect_list(F.struct("f.start", "f.run", "f.at", "gram", "many")).alias("open"))
    )
    discard(firsts)
    windows = stored(_open_windows(known.join(open_runs, "id"), width))
    few = windows.filter(F.col("kind") == ONE_RUN).groupBy("k1").agg(F.collect_list(F.struct("id", "start", "run", "at", "bytes")).alias("runs"))
    each = windows.filter(F.col("kind") == ONE_WINDOW).select("k1", "k2", "id", "start")
    first = stored(each.groupBy("k1", "k2").agg(F.min(F.struct("id", "start")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    one = F.lit(1).alias("run")
    met = each.join(first, ["k1", "k2"]).filter("id <> f.id OR start <> f.start").select("id", "start", one)
    again = windows.filter(F.col("kind") == AGAIN).select("id", "start", one)
    gone = later.union(_compared(few.select("runs"), width)).union(met).union(again).groupBy("id").agg(F.collect_list(F.struct("start", "run")).alias("gone"))
    gone = stored(gone)
    discard(windows)
    return _cut(rows.join(gone, "id", "left"), width, id_col, with_text)


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"))

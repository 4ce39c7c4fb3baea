"""Best-fit packing: documents above a third of the capacity are matched at most two to a bin, smaller ones best-fit the gaps.

Lengths are whole numbers up to the capacity, so the packing is worked out on the histogram of lengths (at most
`capacity` counts, whatever the input) as runs of equal bins, and every piece finds its place from its rank within its length.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored, table
from .tokens import Encoder, tokenizer_path


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, pieces, pieces per bin, first bin, offset) that place counts[length] pieces of each length.

    Piece j of a run goes to bin first + j // per_bin at offset + (j % per_bin) * length.
    """
    left = {s: n for s, n in counts.items() if n}
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of bins (first, how many)
    mask = 0  # bit g is set where gaps[g] has ranges

    def free(first: int, n: int, room: int) -> None:
        nonlocal mask
        if n and room:
            gaps.setdefault(room, []).append((first, n))
            mask |= 1 << room

    big = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for a in big:  # the largest with the largest partner that fits
        while left[a]:
            b = next((s for s in big if s <= capacity - a and left[s] >= (2 if s == a else 1)), None)
            if b is None:
                n = left[a]
                runs.append((a, n, 1, bins, 0))
                free(bins, n, capacity - a)
                left[a] = 0
            elif b == a:
                n = left[a] // 2
                runs.append((a, 2 * n, 2, bins, 0))
                free(bins, n, capacity - 2 * a)
                left[a] -= 2 * n
            else:
                n = min(left[a], left[b])
                runs += [(a, n, 1, bins, 0), (b, n, 1, bins, a)]
                free(bins, n, capacity - a - b)
                left[a] -= n
                left[b] -= n
            bins += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        c = left[s]
        while c:
            fits = mask >> s
            if fits:
                room = s + (fits & -fits).bit_length() - 1
                first, n = gaps[room].pop()
                if not gaps[room]:
                    mask &= ~(1 << room)
            else:
                per = capacity // s
                room, first, n = capacity, bins, -(-c // per)
                bins += n
            per = room // s
            full = min(n, c // per)
            if full:
                runs.append((s, full * per, per, first, capacity - room))
                free(first, full, room - per * s)
                c -= full * per
            if full < n and c and c < per:
                runs.append((s, c, c, first + full, capacity - room))
                free(first + full, 1, room - c * s)
                free(first + full + 1, n - full - 1, room)
                c = 0
            elif full < n:
                free(first + full, n - full, room)
    return runs


def ids_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


PIECES = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("_task", T.IntegerType()),
        T.StructField("_rank", T.LongType()),
    ]
)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece; _rank numbers the pieces of one length within the task that made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(tokenizer, ids_bytes, lower=True, strip=True)
        tail = np.array([end_id], dtype="<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        width = 4 * capacity
        for whole in batches:
            for b in slices(whole, "text"):
                row, piece, length, crc = [], [], [], []
                for i, parts in enumerate(enc.batch([x or "" for x in b.column("text").to_pylist()])):
                    ids = b"".join(parts) + tail
                    for j, at in enumerate(range(0, len(ids), width)):
                        cut = ids[at : at + width]
                        row.append(i)
                        piece.append(j)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                size = np.array(length, np.int64)
                order = np.argsort(size, kind="stable")
                ordered = size[order]
                head = np.r_[True, ordered[1:] != ordered[:-1]]
                at = np.flatnonzero(head)
                rank = np.empty(len(size), np.int64)
                rank[order] = np.arange(len(size)) - np.repeat(at, np.diff(np.r_[at, len(size)])) + seen[ordered]
                seen += np.bincount(size, minlength=capacity + 1)
                number = np.array(piece, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id").take(pa.array(row, pa.int64())),
                        pa.array(number.astype(np.int32)),
                        pa.array(number * capacity),
                        pa.array(size),
                        pa.array(np.array(crc, np.int64)),
                        pa.array(np.full(len(size), task, np.int32)),
                        pa.array(rank),
                    ],
                    names=["id", *PIECES.names],
                )

    narrow = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return narrow.mapInArrow(run, T.StructType([narrow.schema["id"], *PIECES.fields]))


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty and packs as the closing id alone; documents longer than the capacity are cut into pieces of
    it, and none else is. Repeated rows are packed one by one; null ids stay null; extra columns are ignored.
    """
    made = stored(pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    by_task = stored(made.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n")))
    # At most `capacity` rows reach the driver.
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = sorted(plan(counts, capacity))
    of = {n: np.array([r[i] for r in runs], np.int64) for i, n in enumerate(("length", "n", "per", "bin", "offset"))}
    total = np.cumsum(of["n"]) - of["n"]  # pieces before the run, in order of length
    lengths, first_run = np.unique(of["length"], return_index=True)
    base = dict(zip(lengths.tolist(), total[first_run].tolist()))
    before = np.zeros(capacity + 1, np.int64)
    for k, v in base.items():
        before[k] = v

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length = b.column("length").to_numpy()
            rank = before[length] + b.column("_rank").to_numpy()
            i = np.searchsorted(total, rank, side="right") - 1
            j = rank - total[i]
            sequence, offset = of["bin"][i] + j // of["per"][i], of["offset"][i] + j % of["per"][i] * length
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    w = W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    ahead = by_task.withColumn("_ahead", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    ranked = made.join(ahead, ["_task", "length"]).withColumn("_rank", F.col("_rank") + F.col("_ahead"))
    schema = T.StructType(
        [
            T.StructField(id_col, made.schema["id"].dataType),
            *PIECES.fields[:4],
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    return ranked.select("id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(place, schema)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))

"""Minimum bin slack: each window takes the multiset of remaining lengths that fills it closest to capacity.

Which sums can be reached is a bitset (bit v: some multiset adds up to v), shifted by each length as often as it is left; going
back through the shifts gives the counts. Lengths are whole numbers up to the capacity, so windows are worked out on the
histogram of lengths, a pattern for as many windows at once as its lengths last, and every document finds its place from its
rank within its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored, table, utf8, worker_cache
from .packing import ids_bytes
from .tokens import PLAIN, Encoder, tokenizer_path

#: Pieces whose ids a worker keeps: about 200 bytes each.
KEPT_PIECES = 1_000_000


def closest(left: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """(sum, counts by length) of the multiset of `left` that comes closest to `room` from below. Where a length fits at all,
    the longest that fits is in it; of equal sums the one with longer lengths is found first."""
    lengths = sorted((s for s, n in left.items() if n and s <= room), reverse=True)
    if not lengths:
        return 0, {}
    mask, start = (1 << room + 1) - 1, lengths[0]
    reach = 1 << start
    steps: list[tuple[int, int, int]] = []  # length, copies, what was reachable before
    for s in lengths:
        n, chunk = min(left[s] - (s == start), (room - start) // s), 1
        while n > 0 and not reach >> room & 1:
            k = min(chunk, n)
            steps.append((s, k, reach))
            reach |= reach << s * k & mask
            n, chunk = n - k, 2 * chunk
        if reach >> room & 1:
            break
    best = at = reach.bit_length() - 1
    used = {start: 1}
    for s, k, before in reversed(steps):
        if not before >> at & 1:
            used[s] = used.get(s, 0) + k
            at -= s * k
    return best, used


#: length, rank of the first item, items, items in a window, first window, offset; tokens cut off (0: none), rank of the first rest.
Run = tuple[int, int, int, int, int, int, int, int]


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs that place counts[length] items of each length, so that each window holds `capacity`, or in the end a power of two.

    Where no multiset fills a window, an item of another length is cut: its head fills the slack, and its rest is an item
    like others. What is left for less than a window goes into windows of falling powers of two.
    """
    left = {s: n for s, n in counts.items() if n}
    made, placed = dict(left), dict.fromkeys(left, 0)
    total, window = sum(s * n for s, n in left.items()), 0
    runs: list[Run] = []

    def take(s: int, n: int, per: int, offset: int, cut: int = 0) -> None:
        runs.append((s, placed[s], n, per, window, offset, cut, made.get(s - cut, 0) if cut else 0))
        placed[s] += n
        left[s] -= n
        if not left[s]:
            del left[s]
        if cut:
            rest = s - cut
            left[rest], made[rest] = left.get(rest, 0) + n, made.get(rest, 0) + n
            placed.setdefault(rest, 0)

    while total:
        size = capacity if total >= capacity else 1 << total.bit_length() - 1
        best, used = closest(left, size)
        need = dict(used)
        if best < size:  # whatever is left besides is longer than the slack, or it would be in
            donor = max(s for s, n in left.items() if n > used.get(s, 0))
            need[donor] = need.get(donor, 0) + 1
        n = min(left[s] // k for s, k in need.items()) if size == capacity else 1
        n = min(n, total // size)
        offset = 0
        for s, k in sorted(used.items(), reverse=True):
            take(s, n * k, k, offset)
            offset += s * k
        if best < size:
            take(donor, n, 1, offset, size - best)
        window += n
        total -= n * size
    return runs


class Places:
    """Where items of a plan go, looked up by length and rank for whole arrays."""

    def __init__(self, runs: list[Run]):
        rows = np.array(sorted(runs), np.int64).reshape(-1, 8)
        self.length, first, self.n, self.per, self.window, self.offset, self.cut, self.rest = rows.T
        self.total = np.cumsum(self.n) - self.n  # items before the run, in order of length and rank
        lengths, at = np.unique(self.length, return_index=True)
        self.before = np.zeros(int(lengths.max(initial=0)) + 1, np.int64)
        self.before[lengths] = self.total[at]

    def of(self, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(item, tokens of it before, tokens, window, offset, is cut) for each piece, heads first."""
        item, start = np.arange(len(length)), np.zeros(len(length), np.int64)
        was = np.zeros(len(length), bool)
        while len(item):
            j = self.before[length] + rank
            i = np.searchsorted(self.total, j, side="right") - 1
            j -= self.total[i]
            cut = self.cut[i]
            more = cut > 0
            size = np.where(more, cut, length)
            yield item, start, size, self.window[i] + j // self.per[i], self.offset[i] + j % self.per[i] * length, was | more
            item, start, length, rank = item[more], (start + size)[more], (length - size)[more], (self.rest[i] + j)[more]
            was = np.ones(len(item), bool)


def _classes(raw: np.ndarray) -> np.ndarray:
    """Of each byte of plain text (as tokens.PLAIN has it): 0 white space, 1 part of a letter, 2 part of another character."""
    kind = np.full(256, 2, np.uint8)
    kind[list(b" \n\t\r")] = 0
    kind[65:91] = kind[97:123] = 1
    out = kind[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)  # Latin-1 letters, but for the signs of multiplication and division
    two = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    out[two] = out[two + 1] = 1
    return out


def _lower(raw: np.ndarray) -> np.ndarray:
    """The bytes of plain text with ASCII and Latin-1 capitals as small letters."""
    upper = (raw >= 65) & (raw <= 90)
    upper[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    return raw + (upper * np.uint8(32))


def _known(enc: Encoder, pieces: list[str]) -> list[bytes]:
    """The ids of pieces that stand alone; those that the worker has not met are encoded."""
    kept = worker_cache("plain pieces").setdefault(id(enc.tokenizer), {})
    if len(kept) > KEPT_PIECES:
        kept.clear()
    new = [p for p in pieces if p not in kept]
    for i in range(0, len(new), 20_000):
        part = new[i : i + 20_000]
        for p, e in zip(part, enc.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
            kept[p] = enc.value(e.ids)
    return list(map(kept.__getitem__, pieces))


def encoded(enc: Encoder, column: pa.Array) -> list[bytes]:
    """What enc.batch() gives for each text, joined: the pieces of plain texts are found and put together for all rows at once, and
    only distinct ones are looked up. Other texts, and those over a chunk, go through enc.batch()."""
    texts = [x or "" for x in column.to_pylist()]
    plain = np.array([len(x) <= enc.chunk and "'" not in x and not PLAIN.search(x) for x in texts], bool)
    raw, off = utf8(column.filter(pa.array(plain)))
    first = np.zeros(len(raw) + 1, bool)
    first[off] = True
    kind = _classes(raw)
    same = np.r_[False, kind[1:] == kind[:-1]] & ~first[:-1]
    start = np.flatnonzero((kind > 0) & ~same)
    held = np.ascontiguousarray(_lower(raw)[kind > 0])
    to = np.r_[np.cumsum(kind > 0)[start] - 1, len(held)].astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(to), pa.py_buffer(held)]).dictionary_encode()
    ids = _known(enc, pieces.dictionary.to_pylist())
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    begin, flat = np.cumsum(size) - size, np.frombuffer(b"".join(ids), "<u4")
    code = pieces.indices.to_numpy()
    n = size[code]
    end = np.cumsum(n)
    made = flat[np.arange(end[-1] if len(end) else 0) + np.repeat(begin[code] - (end - n), n)].tobytes()
    cut = 4 * np.r_[0, end][np.searchsorted(start, off)]
    whole = iter([made[a:z] for a, z in zip(cut.tolist(), cut[1:].tolist())])
    rest = iter(enc.batch([x for x, p in zip(texts, plain.tolist()) if not p]))
    return [next(whole) if p else b"".join(next(rest)) for p in plain.tolist()]


def items(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per item: a document's full windows and what is left of it, with `ids` (unsigned 16 or 32 bits) of the latter.

    _task and _row name an item; _rank numbers the items of one length within the task that made them.
    """
    own = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("_task", T.IntegerType()), ("_row", T.LongType()), ("_rank", T.LongType()), ("ids", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(tokenizer, ids_bytes, lower=True, strip=True)
        kind = np.dtype("<u2" if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        tail, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
        seen, done, task = np.zeros(capacity + 1, np.int64), 0, TaskContext.get().partitionId()
        for whole in batches:
            for b in slices(whole, "text"):
                row, start, tokens, total, crc, rest = [], [], [], [], [], []
                for i, found in enumerate(encoded(enc, b.column("text"))):
                    ids = found + tail
                    for at in range(0, len(ids), width):
                        piece = ids[at : at + width]
                        row.append(i)
                        start.append(at // 4)
                        tokens.append(len(piece) // 4)
                        total.append(len(ids) // 4)
                        crc.append(zlib.crc32(piece))
                        rest.append(piece if len(piece) < width else None)
                size = np.array(tokens, np.int64)
                held = np.frombuffer(b"".join(r for r in rest if r), "<u4").astype(kind).tobytes()
                to = np.cumsum(np.where(size < capacity, size, 0)) * kind.itemsize
                kept = [held[z - n * kind.itemsize : z] if r else None for r, n, z in zip(rest, tokens, to.tolist())]
                order = np.argsort(size, kind="stable")
                ordered = size[order]
                at = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
                rank = np.empty(len(size), np.int64)
                rank[order] = np.arange(len(size)) - np.repeat(at, np.diff(np.r_[at, len(size)])) + seen[ordered]
                seen += np.bincount(size, minlength=capacity + 1)
                columns = [pa.array(np.array(v, np.int64)) for v in (start, tokens, crc, total)]
                columns += [pa.array(np.full(len(size), task, np.int32)), pa.array(done + np.arange(len(size))), pa.array(rank), pa.array(kept, pa.binary())]
                done += len(size)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row, pa.int64())), *columns], names=["id", *(n for n, _ in own)])

    narrow = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return narrow.mapInArrow(run, T.StructType([narrow.schema["id"], *(T.StructField(n, t) for n, t in own)]))


def pack_windows(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Sequences hold `capacity` tokens, but for the
    last few, which hold powers of two; so none is padded.

    A document is its ids and `end_id`. Documents over the capacity give full windows first; lengths that are left fill
    windows whole, and only where no multiset of them fills one, a document is cut there. Null text counts as empty and
    packs as the closing id alone. Repeated rows are packed one by one; null ids stay null; an empty table gives no row;
    extra columns are ignored.
    """
    made = stored(items(docs, tokenizer, capacity, end_id, id_col, text_col))
    by_task = stored(made.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n")))
    # At most `capacity` rows reach the driver, and the plan has a few runs for each.
    runs = plan({r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}, capacity)
    places = Places(runs)
    own = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            for item, start, size, window, offset, cut in places.of(length, rank):
                at = pa.array(item)
                had = {c: b.column(c).take(at) for c in ("id", "start", "ids_crc32", "doc_tokens", "_task", "_row")}
                yield pa.RecordBatch.from_arrays(
                    [had["id"], *map(pa.array, (had["start"].to_numpy() + start, size)), had["ids_crc32"], had["doc_tokens"], *map(pa.array, (window, offset)), had["_task"], had["_row"], pa.array(start), pa.array(cut)],
                    names=[id_col, *own, "_task", "_row", "_from", "_cut"],
                )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("ids", "_from", "length", "_item")))
            crc = [zlib.crc32(np.frombuffer(ids, f"<u{len(ids) // n}")[a : a + size].astype("<u4").tobytes()) for ids, a, size, n in rows]
            yield b.set_column(b.schema.get_field_index("ids_crc32"), "ids_crc32", pa.array(crc, pa.int64())).select([id_col, *own])

    ahead = by_task.withColumn("_ahead", F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = made.drop("ids").join(ahead.drop("_n"), ["_task", "length"]).withColumn("_rank", F.col("_rank") + F.col("_ahead"))
    schema = T.StructType([T.StructField(id_col, made.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in own)])
    wide = T.StructType([*schema.fields, T.StructField("_task", T.IntegerType()), T.StructField("_row", T.LongType()), T.StructField("_from", T.LongType()), T.StructField("_cut", T.BooleanType())])
    placed = stored(ranked.mapInArrow(place, wide))
    whole = placed.filter("NOT _cut").select(id_col, *own)
    lengths = sorted({r[0] for r in runs if r[6]})  # only items of these lengths can be cut
    if not lengths:
        return whole
    texts = made.filter(F.col("length").isin(lengths)).select("_task", "_row", F.col("length").alias("_item"), "ids")
    cut = placed.filter("_cut").join(texts, ["_task", "_row"]).mapInArrow(counted, schema)
    return whole.unionByName(cut)


def op11_minimum_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_windows(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))

"""What several corpus operators share: shared-folder tables, Arrow text access, 64-bit hashing."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one numpy pass takes at a time inside a task; bounds a Python worker's memory.
CHUNK_BYTES = 2 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a session in one process (tests) gets a
    temporary folder; on a cluster that is an error, as executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tempora-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tempora-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete every table that stored() wrote in this application, once no result that reads them is needed any more."""
    _delete(spark, {_home(spark)})


def _delete(spark: SparkSession, folders: set[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{_home(spark)}/tempora-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the shuffle files of this plan have no reader once the table is written
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by stored() that no later step reads."""
    _delete(df.sparkSession, {f for f in (name.rsplit("/", 1)[0] for name in df.inputFiles()) if "/tempora-" in f})


#: A key with more than this share of all rows is hot, so there are at most HOT_KEYS of them.
HOT_KEYS = 10_000


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, how: str = "left") -> DataFrame:
    """left joined (inner, left or left_semi) to right, which has a row per key and in column n how many rows of left have it.

    right's rows for hot keys, those with more than a HOT_KEYS-th of all that it counts, are broadcast, HOT_KEYS of them at
    most; where the other keys need a shuffle, the rows of hot ones are spread over it by their hash, which changes no result.
    right should be a stored table.
    """
    seen = right.agg(F.sum(n).alias("total"), F.max(n).alias("most")).first()
    values = [] if how == "left_semi" else [c for c in right.columns if c not in (*keys, n)]
    columns = [*keys, *(c for c in left.columns if c not in keys)]
    if seen["most"] is None or seen["most"] * HOT_KEYS <= seen["total"]:
        return left.join(right.select(*keys, *values), keys, how).select(*columns, *values)
    side = right.select(*keys, n, F.struct(F.lit(1).alias("_has"), *values).alias("_right"))
    is_hot = F.col(n) * HOT_KEYS > seen["total"]
    hot = F.broadcast(side.filter(is_hot).select(*keys, F.col("_right").alias("_hot")))
    rest = side.filter(~is_hot).select(*keys, F.lit(0).cast("long").alias("_salt"), F.col("_right").alias("_cold"))
    salt = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*left.columns), F.lit(HOT_KEYS)))
    both = left.join(hot, keys, "left").withColumn("_salt", salt.cast("long")).join(rest, [*keys, "_salt"], "left")
    both = both.withColumn("_right", F.coalesce("_hot", "_cold"))
    if how != "left":
        both = both.filter("_right IS NOT NULL")
    return both.select(*columns, *(F.col("_right")[c].alias(c) for c in values))


def walk(df: DataFrame, by: list[str], step: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """step(rows, first row of each group) over whole groups of the bigint columns `by`, many small ones at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for c in by:
                v = b.column(c).to_numpy()
                new[1:] |= v[1:] != v[:-1]
                new[0] |= not held or held[-1].column(c)[-1].as_py() != v[0]
            first = np.flatnonzero(new)
            if held and len(first):
                # The last group met may go on, so what is complete ends where the batch's last group begins.
                whole = pa.concat_batches([*held, b.slice(0, first[-1])])
                yield from step(whole, starts(whole))
                held = [b.slice(first[-1])]
            elif len(first) > 1:
                yield from step(b.slice(0, first[-1]), first[:-1])
                held = [b.slice(first[-1])]
            else:
                held.append(b)
        if held:
            whole = pa.concat_batches(held)
            yield from step(whole, starts(whole))

    def starts(b: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(b.num_rows, bool)
        new[:1] = True
        for c in by:
            v = b.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    return df.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, across tasks."""
    home = sys.modules.setdefault("_tempora_worker", types.ModuleType("_tempora_worker"))
    return home.__dict__.setdefault(name, {})


def drop_caches() -> None:
    """Let go of what other operators kept in this Python worker, and of Arrow's unused memory."""
    for kept in list(vars(sys.modules.get("_tempora_worker", types.ModuleType("none"))).values()):
        if isinstance(kept, dict):
            kept.clear()
    pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that no part holds more than `limit` bytes of `column`; a row over it is a part of its own."""
    if not batch.num_rows:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    cut, held = [0], 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > limit:
            cut.append(i)
            held = 0
        held += n
    cut.append(batch.num_rows)
    for a, b in zip(cut, cut[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, null as empty, as one uint8 array and the row offsets."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    off = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); bijective."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), dtype=U64)
    have, step = 1, base
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * U64(step)
        step = step * step % 2**64
        have += take
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, kept in the worker and grown on demand."""
    kept = worker_cache("powers")
    if len(kept.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        kept["up"], kept["down"] = _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
    return kept["up"], kept["down"]


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z as a-z; split at space and 9..13) and the word count per row."""
    rows = len(off) - 1
    if not len(raw):
        return np.zeros(0, U64), np.zeros(rows, np.int64)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = np.zeros(len(raw) + 1, bool)
    first[off] = True
    inside = ~space
    start = np.flatnonzero(inside & (np.r_[True, space[:-1]] | first[:-1]))
    end = np.flatnonzero(inside & (np.r_[space[1:], True] | first[1:])) + 1
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((low.astype(U64) + U64(1)) * up[: len(raw)], out=total[1:])
    value = mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))
    count = np.diff(np.searchsorted(start, off))
    return value, count


def word_array(raw: np.ndarray, off: np.ndarray, low: bool, breaks: bytes = b"") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the rows as a string array, the word count per row, and where in raw each word starts.

    Words are split at space and 9..13, or, where `breaks` are given, at space, 9 and those bytes; `low` turns A-Z to a-z.
    """
    gap = np.zeros(256, bool)
    gap[[32, 9, *(breaks or range(9, 14))]] = True
    first = np.zeros(len(raw) + 1, bool)
    first[off] = True
    space = gap[raw]
    start = np.flatnonzero(~space & (np.r_[True, space[:-1]] | first[:-1]))
    end = np.flatnonzero(~space & (np.r_[space[1:], True] | first[1:])) + 1
    held = raw[~space]
    if low:
        held = np.where((held >= 65) & (held <= 90), held + 32, held).astype(np.uint8)
    to = np.r_[0, np.cumsum(end - start)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(held))])
    return words, np.diff(np.searchsorted(start, off)), start


def shingles_of(words: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row, sorted by row and value, and their number per row.

    With 1..k-1 words the whole sequence is the one shingle; without words the set is empty.
    """
    rows = len(count)
    at = np.r_[0, np.cumsum(count)]
    long = count >= k
    n = np.where(long, count - k + 1, (count > 0).astype(np.int64))
    if not n.sum():
        return np.zeros(0, U64), np.zeros(rows, np.int64)
    row = np.repeat(np.arange(rows), n)
    begin = np.repeat(at[:-1], n) + (np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)][:-1], n))
    width = np.minimum(count[row], k)
    value = np.zeros(len(row), U64)
    for j in range(k):
        use = width > j
        value[use] = mix(value[use] * U64(_BASE) + words[begin[use] + j] + U64(j + 1))
    value = mix(value + width.astype(U64))
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])]
    return value[keep], np.bincount(row[keep], minlength=rows)


def add_by_row(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sum modulo 2**64 of consecutive runs of `count` values; 0 for empty runs."""
    total = np.r_[U64(0), np.cumsum(value, dtype=U64)]
    at = np.r_[0, np.cumsum(count)]
    return total[at[1:]] - total[at[:-1]]


def free_name(taken: list[str], name: str) -> str:
    """`name`, with as many underscores after it as it takes to differ from all of `taken` (upper and lower case alike)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_sums(df: DataFrame, group: list[str], order: str, value: str, bits: int = 12) -> DataFrame:
    """(group, _part, _sum): sums of `value` by group and leading bits of `order`, for prefix_sums()."""
    return stored(df.groupBy(*group, F.shiftright(F.col(order), 60 - bits).alias("_part")).agg(F.sum(value).alias("_sum")))


def prefix_sums(df: DataFrame, sums: DataFrame, group: list[str], order: str, tie: str, value: str, out: str, bits: int = 12) -> DataFrame:
    """Exclusive running sum of `value` by (group, order, tie), for a bigint `order` spread evenly over 0..2**60-1.

    Rows are dealt by (group, leading bits of order), so a hot group spreads over up to 2**bits parts; the sums of the parts,
    from part_sums(), are prefix-summed per group (at most 2**bits rows each) and joined back.
    """
    part = df.withColumn("_part", F.shiftright(F.col(order), 60 - bits))
    running = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = stored(sums.select(*group, "_part", F.coalesce(F.sum("_sum").over(running), F.lit(0)).alias("_before")))
    inside = W.partitionBy(*group, "_part").orderBy(order, tie).rowsBetween(W.unboundedPreceding, -1)
    return (
        part.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(before, [*group, "_part"])
        .withColumn(out, F.col("_before") + F.col("_in"))
        .drop("_part", "_in", "_before")
    )

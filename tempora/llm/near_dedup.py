"""Near-duplicate documents by SetSketch registers: banded, estimated jointly by likelihood, then verified on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, add_by_row, discard, mix, shingles_of, skew_join, slices, stored, table, utf8, words_of
from .components import components

#: Registers (a power of two), registers in a band, base of the exponential spacing, offset that makes registers unsigned.
REGISTERS, BAND, BASE, OFFSET = 128, 4, 1.001, 8192
#: At similarity 0.8 a band of 4 agrees with probability 0.41, so 32 bands miss a pair with probability 5e-8.
#: At similarity 0.8 a register is equal with probability 0.8 or so; 64 or fewer of 128 are with probability 1e-13.
LEAST_EQUAL = REGISTERS // 2
#: A pair is dropped before verification only where the threshold is this many nats less likely than the estimate.
NATS = 16.0


def sketch(value: np.ndarray, count: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers [row, register] of the distinct hashes of each row (rows without any get zeros).

    An element's m values are exponentials truncated to m successive intervals, dealt to the registers by a permutation
    of its own; a register keeps the least value. Rows drop out once the next interval starts above all their registers.
    """
    rows = len(count)
    least = np.full(rows * m, np.inf)
    row = np.repeat(np.arange(rows), count)
    base, seed = row * m, mix(value + U64(0x632BE59BD9B4E019))
    step, place = ((seed >> U64(9)) | U64(1)).astype(np.int64) & (m - 1), (seed >> U64(40)).astype(np.int64) & (m - 1)
    v = value
    for j in range(m):
        u = ((mix(v + U64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53
        x = -np.log1p(-j / m) - np.log1p(-u / (m - j))
        np.minimum.at(least, base + ((place + j * step) & (m - 1)), x)
        if j + 1 < m:
            more = least.reshape(rows, m).max(1) > -np.log1p(-(j + 1) / m)
            keep = more[row]
            if not keep.all():
                row, base, v, step, place = row[keep], base[keep], v[keep], step[keep], place[keep]
            if not len(row):
                break
    with np.errstate(divide="ignore", invalid="ignore"):
        k = np.floor(1 - np.log(least) / np.log(BASE)) + OFFSET
    k[~np.isfinite(k)] = 0
    return np.clip(k, 0, 65535).astype(np.uint16).reshape(rows, m)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Joint maximum-likelihood estimate of the similarity from which registers are greater, less and equal, and whether
    `percent` may still be reached. The sizes of the sets are known."""
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - up - down
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    j = np.linspace(0, 1, steps + 1)[None, :] * top

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def nats(j):
        more, less = p(u - v * j), p(v - u * j)
        return up * np.log(more + 1e-12) + down * np.log(less + 1e-12) + same * np.log(np.maximum(1 - more - less, 0) + 1e-12)

    value = nats(j)
    best = value.argmax(1)
    estimate = np.take_along_axis(j, best[:, None], 1)[:, 0]
    goal = np.minimum(percent / 100, top)
    possible = top[:, 0] >= percent / 100 - 1e-12
    return estimate, possible & ((estimate >= percent / 100) | (nats(goal)[:, 0] >= value.max(1) - NATS))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, h1, h2, regs, bands): size, 128-bit digest, registers and band keys of each document's set of shingles."""
    bands = REGISTERS // BAND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                value, n = shingles_of(*words_of(*utf8(b.column("text"))), k)
                regs = sketch(value, n)
                key = np.zeros((len(n), bands), U64)
                for i in range(BAND):
                    key = mix(key * U64(0x100000001B3) + regs[:, i::BAND] + U64(1))
                key = mix(key + np.arange(1, bands + 1, dtype=U64))
                one = np.arange(len(n) + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id"),
                        pa.array(n.astype(np.int64)),
                        pa.array(add_by_row(mix(value), n).view(np.int64)),
                        pa.array(add_by_row(mix(value ^ U64(0xA5A5A5A55A5A5A5A)), n).view(np.int64)),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(one * bands), pa.array(key.view(np.int64).ravel())),
                    ],
                    names=["id", "n", "h1", "h2", "regs", "bands"],
                )

    schema = T.StructType([docs.schema["id"], *T._parse_datatype_string("n long, h1 long, h2 long, regs binary, bands array<long>").fields])
    return docs.mapInArrow(run, schema)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, members): the sorted shingle hashes of each document as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                value, n = shingles_of(*words_of(*utf8(b.column("text"))), k)
                at = np.r_[0, np.cumsum(n)]
                sets = [value[x:y].tobytes() for x, y in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.binary())], names=["id", "members"])

    return docs.mapInArrow(run, T.StructType([docs.schema["id"], T.StructField("members", T.BinaryType())]))


def _scored(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the likelihood of their registers leaves, with the estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                b = whole.slice(i, 2000)
                x, y = (np.stack([np.frombuffer(r, np.uint16) for r in b.column(c).to_pylist()]) for c in ("regs_a", "regs_b"))
                estimate, keep = likely(x, y, b.column("n_a").to_numpy().astype(float), b.column("n_b").to_numpy().astype(float), percent)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(estimate)], names=["a", "b", "estimate"]).filter(pa.array(keep))

    side = [reps.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"regs_{s}")) for s in "ab"]
    kind = reps.schema["rep"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("estimate", T.DoubleType())])
    return pairs.select("a", "b").join(side[0], "a").join(side[1], "b").mapInArrow(run, schema)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough: 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = (np.frombuffer(s.as_buffer(), U64) for s in (x, y))
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType
    return (
        pairs.select("a", "b")
        .join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
        .mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))
    )


def matched(a: list[bytes], b: list[bytes], percent: int) -> np.ndarray:
    """Which sets of a are similar enough to which of b, exactly: sizes of the intersections are products of 0/1 matrices,
    taken over slices of the hashes that both blocks hold."""
    x, y = ([np.frombuffer(s, U64) for s in side] for side in (a, b))
    n_x, n_y = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    both = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)), assume_unique=True)
    count = np.zeros((len(x), len(y)), np.float32)

    def coordinates(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(both, flat)
        ok = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == flat)
        order = np.argsort(at[ok], kind="stable")
        return row[ok][order], at[ok][order]

    if len(both):
        (rx, cx), (ry, cy) = coordinates(x), coordinates(y)
        for lo in range(0, len(both), 4096):
            part = []
            for r, c, n in ((rx, cx, len(x)), (ry, cy, len(y))):
                i, j = np.searchsorted(c, [lo, lo + 4096])
                m = np.zeros((n, 4096), np.float32)
                m[r[i:j], c[i:j] - lo] = 1
                part.append(m)
            count += part[0] @ part[1].T
    return (count > 0) & (100 * count.astype(np.int64) >= percent * (n_x[:, None] + n_y[None, :] - count.astype(np.int64)))


def _blocks(members: DataFrame, block: int = 512) -> DataFrame:
    """Rows of `members` (rep, size, minor, ...) as pairs of blocks (p, q, asks): every minor member asks, every member is
    asked. Blocks are of bounded size however many members a group has, and no pair of members becomes a row."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / block)).cast("int")
    rows = members.withColumn("_parts", parts).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    ask = rows.filter("minor").select(*members.columns, F.col("_own").alias("p"), every.alias("q"), F.lit(True).alias("asks"))
    told = rows.select(*members.columns, every.alias("p"), F.col("_own").alias("q"), F.lit(False).alias("asks"))
    return ask.unionByName(told).drop("size", "minor")


def _inside(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members (cluster, rep, label, size, minor, members) of a cluster with unlike labels, decided on
    full sets; one to each other label is enough for the components."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g[g["asks"]], g[~g["asks"]]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        hit = matched(x["members"].tolist(), y["members"].tolist(), percent)
        hit &= x["label"].to_numpy()[:, None] != y["label"].to_numpy()[None, :]
        i, j = np.nonzero(hit)
        found = pd.DataFrame({"a": x["rep"].to_numpy()[i], "b": y["rep"].to_numpy()[j], "to": y["label"].to_numpy()[j]})
        return found.drop_duplicates(["a", "to"])[["a", "b"]]

    return _blocks(members).groupBy("cluster", "p", "q").applyInPandas(run, "a long, b long")


def _bridges(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket's members (key, rep, cluster, n, regs, size, minor) in unlike clusters that the registers
    leave possible, one to each other cluster, which is enough to join the clusters. The most alike member whose size
    allows a link is tried first, and where it is not possible all others are."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g[g["asks"]], g[~g["asks"]]
        none = pd.DataFrame({"a": [], "b": []}, dtype="int64")
        if not len(x) or not len(y):
            return none
        rx, ry = (np.stack([np.frombuffer(r, np.uint16) for r in s["regs"]]) for s in (x, y))
        n_x, n_y = x["n"].to_numpy(float), y["n"].to_numpy(float)
        code, where = np.unique(np.r_[x["cluster"].to_numpy(), y["cluster"].to_numpy()], return_inverse=True)
        of_x, of_y = where[: len(x)], where[len(x) :]
        some = []
        for i in range(len(x)):
            same = (ry == rx[i]).sum(1)
            fit = 100 * np.minimum(n_x[i], n_y) >= percent * np.maximum(n_x[i], n_y)
            j = np.flatnonzero(fit & (same > LEAST_EQUAL) & (of_y != of_x[i]))
            some.append((np.full(len(j), i), j, same[j]))
        i, j, same = (np.concatenate(c) for c in zip(*some))
        order = np.lexsort((j, -same, of_y[j], i))
        i, j = i[order], j[order]
        group = i * len(code) + of_y[j]
        best = np.r_[True, group[1:] != group[:-1]][: len(i)]
        found = []
        for turn in (np.flatnonzero(best), np.flatnonzero(~best)):
            if found:
                turn = turn[~np.isin(group[turn], group[found[0]])]
            hit = [np.zeros(0, np.int64)]
            for at in (turn[k : k + 2000] for k in range(0, len(turn), 2000)):
                for steps in (10, 200):  # most fall at the coarse estimate already
                    at = at[likely(rx[i[at]], ry[j[at]], n_x[i[at]], n_y[j[at]], percent, steps)[1]] if len(at) else at
                hit.append(at)
            hit = np.concatenate(hit)
            found.append(hit[np.unique(group[hit], return_index=True)[1]])
        kept = np.concatenate(found)
        return pd.DataFrame({"a": x["rep"].to_numpy()[i[kept]], "b": y["rep"].to_numpy()[j[kept]]})

    return _blocks(members).groupBy("key", "p", "q").applyInPandas(run, "a long, b long")


def _majority(rows: DataFrame, by: str, part: str) -> DataFrame:
    """(by, size, main) of the groups of `by` in which several `part` meet; main is the commonest."""
    kinds = rows.groupBy(by, part).agg(F.count(F.lit(1)).alias("size"))
    found = kinds.groupBy(by).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("_parts"), F.max_by(part, F.struct("size", part)).alias("main"))
    return stored(found.filter("_parts > 1").drop("_parts"))


def _clusters(pairs: DataFrame) -> DataFrame:
    return components(pairs).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))


def _labels(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("rep"), F.col("component").alias("label"))


def near_components(
    docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id that can be reached by links, itself included), kept.

    A document's set holds its distinct k-word shingles (A-Z as a-z, words split at white space); with fewer words the
    whole sequence is one shingle; null and empty texts and those without words have an empty set and no link. Rows with
    equal sets are one class, named by its least id. Within a bucket of equal band keys, members are first paired with the bucket's least and
    greatest. Pairs that the registers leave possible span clusters; where a bucket's members are in several clusters,
    they are compared in blocks on registers, which joins clusters. Each member's likeliest pair is verified, and where a
    cluster is not yet one component its rest is compared in blocks on full sets, so no size of bucket loses a link. Ids are
    integers; rows with a null id are returned with a null component and kept true. Rows that repeat an id are one document
    with several sets: it is linked where any of them is, whatever the order of the rows, and all its rows have its component,
    each with its own n_shingles. `percent` is 80 at least: for less, bands and registers would miss pairs.
    """
    if not 80 <= percent <= 100:
        raise ValueError("bands and registers are laid out for similarities of 0.8 or more")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = stored(signatures(rows, k))
    reps = stored(
        sig.filter("n > 0 AND id IS NOT NULL")
        .groupBy("h1", "h2")
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("size"))
    )
    again = stored(sig.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"))
    repeated = not again.isEmpty()
    entries = reps.select(F.explode("bands").alias("key"), "rep")
    entries = entries.distinct() if repeated else entries
    ends = stored(entries.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least < most"))
    buckets = stored(entries.join(ends, "key"))

    def star(end: str) -> DataFrame:
        return buckets.filter(f"rep <> {end}").select(F.least("rep", end).alias("a"), F.greatest("rep", end).alias("b"))

    scored = stored(_scored(star("least").unionByName(star("most")).distinct(), reps, percent))
    pairs = scored.select("a", "b")
    clusters = _clusters(pairs)
    placed = stored(buckets.select("key", "rep").join(clusters, "rep", "left").select("key", "rep", F.coalesce("cluster", "rep").alias("cluster")))
    mixed = _majority(placed, "key", "cluster")
    strays = placed.join(mixed, "key").join(reps.select("rep", "n", "regs"), "rep").withColumn("minor", F.col("cluster") != F.col("main"))
    bridges = stored(_bridges(strays.drop("main"), percent).distinct())
    if not bridges.isEmpty():
        pairs = pairs.unionByName(bridges)
        clusters = _clusters(pairs)
    clusters = stored(clusters)
    wanted = clusters.select(F.col("rep").alias("id"))
    texts = rows.join(wanted, "id", "left_semi")
    sets = stored(full_sets(texts.distinct() if repeated else texts, k).filter(F.length("members") > 0))
    ended = scored.select(F.explode(F.array("a", "b")).alias("rep"), "a", "b", "estimate")
    first = ended.groupBy("rep").agg(F.max(F.struct("estimate", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    links = _verified(first, sets, percent)
    if repeated:  # the classes of one document's sets belong together
        own = stored(sig.select("id", "h1", "h2").distinct().join(again, "id", "left_semi").join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select("id", "rep").distinct())
        links = links.unionByName(own.join(own.groupBy("id").agg(F.min("rep").alias("b")), "id").select(F.col("rep").alias("a"), "b"))
        links = links.unionByName(own.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    links = stored(links)
    labels = _labels(links)
    known = stored(clusters.join(labels, "rep", "left").select("cluster", "rep", F.coalesce("label", "rep").alias("label")))
    mixed = _majority(known, "cluster", "label")
    rest = known.join(mixed, "cluster").join(sets.withColumnRenamed("id", "rep"), "rep").withColumn("minor", F.col("label") != F.col("main"))
    inside = stored(_inside(rest.drop("main"), percent))
    if not inside.isEmpty():
        labels = _labels(links.unionByName(inside))
    classes = stored(reps.join(labels, "rep", "left").select("h1", "h2", "size", F.coalesce("label", "rep").alias("component")))
    for old in (buckets, placed, ends, sets):
        discard(old)
    out = skew_join(sig.select("id", "n", "h1", "h2"), classes, ["h1", "h2"], "size")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    if repeated:
        whole = stored(labels.withColumnRenamed("rep", "id").join(again, "id", "left_semi"))
        out = out.join(whole, "id", "left")
        component = F.coalesce("label", component)
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), component).alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the least of its component; rows with a null id stay."""
    gone = near_components(docs, k, percent, id_col, text_col).filter("NOT kept").select(F.col(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op2_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), k=2)


OP2_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN rare USING (g) JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(reach) AS component_id, doc_id = min(reach) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

"""Near-duplicate vectors by collision counting: pairs whose projections fall into each other's windows often enough are verified.

Which pairs are counted at all is decided by windows too: cells of several projections make a key, and vectors that share one
of many keys are sorted along a further projection and looked at within the query's window. Keys grow longer with the number of
vectors, so that the pairs to count grow nearly in proportion to it, and more numerous, so that recall stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, mix, skew_join, stored, table, walk
from .components import components, stars

#: Projections whose windows are counted, unlike vectors that a key's bucket holds on average, vectors in a compared block.
PROJECTIONS, BUCKET, BLOCK = 48, 64, 1024
#: Width of a key's cells, in distances at the threshold.
CELL = 4.0
#: A link at the threshold itself is missed with at most these probabilities by counting and by the keys, less above it.
MISS, MISS_KEYS = 1e-6, 1e-6
#: Projections are kept in steps of 1/16, from -8 on, for counting.
STEP = 1 / 16


def calibrate(cosine: float, m: int = PROJECTIONS, miss: float = MISS) -> tuple[float, int]:
    """(half width of a window, least collisions) for projections on standard normal directions of unit vectors.

    Two unit vectors at distance d collide in a window of half width w with probability erf(w / (d sqrt 2)). Of all widths
    the one is taken whose count, at the wanted recall, tells unrelated vectors (at distance sqrt 2) apart best.
    """
    d = sqrt(2 - 2 * cosine)
    best = (2.0, 0.0, 0)
    for w in np.arange(0.5, 4, 0.05) * max(d, 1e-6):
        p, q = erf(w / d / sqrt(2)), erf(w / 2)
        tail, least = 0.0, 0
        for c in range(m + 1):
            tail += comb(m, c) * p**c * (1 - p) ** (m - c)
            if tail > miss:
                least = c
                break
        false = sum(comb(m, c) * q**c * (1 - q) ** (m - c) for c in range(least, m + 1))
        best = min(best, (false, float(w), least))
    return best[1], best[2]


def key_plan(n: int, cosine: float, window: float) -> tuple[int, int, float]:
    """(cells in a key, number of keys, width of a cell) for n vectors of one label and windows of half width `window`.

    Vectors at distance t share a cell of width w, placed at random, with probability 1 - 2 P(N < -w/t) - 2 (1 - exp(-(w/t)^2 / 2)) /
    (sqrt(2 pi) w/t). Unrelated vectors are to share a key with BUCKET others, and linked ones one of all keys, in whose window
    they lie too: the projections that keys are sorted along differ from key to key, so these chances multiply.
    """
    d = max(sqrt(2 - 2 * cosine), 1e-6)
    width = CELL * d

    def same(t: float) -> float:
        r = width / t
        return erf(r / sqrt(2)) - 2 * (1 - exp(-r * r / 2)) / (sqrt(2 * pi) * r)

    cells = max(0, ceil(log(max(n, 1) / BUCKET) / -log(same(sqrt(2)))))
    found = same(d) ** cells * erf(window / d / sqrt(2))
    return cells, 1 if not cells else ceil(log(MISS_KEYS) / log(1 - found)), width


def directions(dim: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, m))


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(lists.flatten(), dtype=float).reshape(-1, dim)


def entries(classes: DataFrame, cells: int, keys: int, width: float) -> DataFrame:
    """(key, lab, rep, line): a row for each key of each class (lab, rep, dim, unit), with its projections for counting, turned
    so that the one which the key is sorted along comes first: another one for each key, as far as there are enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 2000) for k in range(0, whole.num_rows, 2000)):
                dims = b.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    part = b.filter(pa.array(dims == dim))
                    n, unit = part.num_rows, matrix(part.column("unit"), dim)
                    lab = part.column("lab").to_numpy().view(U64)
                    key = mix(lab[:, None] + np.arange(1, keys + 1, dtype=U64))
                    if cells:
                        shift = np.random.default_rng([11, dim]).random(cells * keys)
                        cell = np.floor(unit @ directions(dim, cells * keys, 7) / width + shift).astype(np.int64).view(U64).reshape(n, keys, cells)
                        for k in range(cells):
                            key = mix(key * U64(0x100000001B3) + cell[:, :, k])
                    line = np.clip(np.rint((unit @ directions(dim, PROJECTIONS, 5) + 8) / STEP), 0, 255).astype(np.uint8)
                    row = pa.array(np.repeat(np.arange(n), keys))
                    turned = line[:, (np.arange(keys)[:, None] + np.arange(PROJECTIONS)) % PROJECTIONS]
                    lines = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PROJECTIONS), n * keys, [None, pa.py_buffer(np.ascontiguousarray(turned))])
                    columns = [pa.array(key.view(np.int64).ravel()), *(c.take(row) for c in (part.column("lab"), part.column("rep"))), lines.cast(pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "lab", "rep", "line"])

    return classes.select("lab", "rep", "dim", "unit").mapInArrow(run, "key long, lab long, rep long, line binary")


def in_blocks(members: DataFrame, by: list[str], block: int) -> DataFrame:
    """members with own, p and q: groups of more than `block` rows are cut into blocks by the hash of rep, and come as pairs
    p <= q of blocks, in which every two members meet once; own is a member's block."""
    sizes = stored(members.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block))
    one = members.withColumns({c: F.lit(0) for c in ("own", "p", "q")})
    if sizes.isEmpty():
        return one
    rows = skew_join(members, sizes.withColumn("_parts", F.ceil(F.col("_n") / block).cast("int")), by, "_n")
    parts = F.coalesce("_parts", F.lit(1))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("_with", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.withColumns({"p": F.least("own", "_with"), "q": F.greatest("own", "_with")}).drop("_with", "_parts")


def collisions(rows: DataFrame, width: float, least: int, windowed: bool = True) -> DataFrame:
    """Pairs (a, b) of a key's entries that collide in at least `least` windows, as stars: what they connect, without a row for
    each pair. `windowed`: only pairs within the window on the first projection are counted; otherwise all of a key's."""
    reach = ceil(width / STEP) + 1
    beside = reach if windowed else 4095

    def step(b: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, b.num_rows]))
        line = np.frombuffer(b"".join(b.column("line").to_pylist()), np.uint8).reshape(-1, PROJECTIONS)
        order = np.lexsort((line[:, 0], group))
        group, line = group[order], line[order].astype(np.int16)
        lab, own = b.column("lab").to_numpy()[order], b.column("own").to_numpy()[order]
        cross = b.column("p").to_numpy()[order] != b.column("q").to_numpy()[order]
        place = group * 4096 + line[:, 0]
        partners = np.searchsorted(place, np.minimum(place + beside, group * 4096 + 4095), side="right") - np.arange(len(place)) - 1
        to = np.cumsum(partners)
        a, z = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = 0
        while at < len(place):
            end = max(at + 1, int(np.searchsorted(to, (to[at - 1] if at else 0) + 500_000, side="right")))
            n = partners[at:end]
            i = np.repeat(np.arange(at, end), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            ok = (lab[i] == lab[j]) & (~cross[i] | (own[i] != own[j]))
            i, j = i[ok], j[ok]
            hit = (np.abs(line[i] - line[j]) <= reach).sum(1) >= least
            a.append(i[hit])
            z.append(j[hit])
            at = end
        label = stars(np.concatenate(a), np.concatenate(z), len(place))
        some = np.flatnonzero(label != np.arange(len(label)))
        rep = b.column("rep").take(pa.array(order))
        yield pa.RecordBatch.from_arrays([rep.take(pa.array(some)), rep.take(pa.array(label[some]))], names=["a", "b"])

    return walk(in_blocks(rows, ["key"], 2 * BLOCK), ["key", "p", "q"], step, "a long, b long")


def verified(members: DataFrame, cosine: float) -> DataFrame:
    """Links between members (cluster, lab, rep, h1, h2, dim, copies, unit) of a cluster, by their vectors: rows of a member's
    number of links (lab, h1, h2, n) and of stars (a, b) that connect what is linked."""

    def step(b: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = np.diff(np.r_[first, b.num_rows])
        own, copies, dims = b.column("own").to_numpy(), b.column("copies").to_numpy(), b.column("dim").to_numpy()
        cross = b.column("p").to_numpy() != b.column("q").to_numpy()
        offset = np.r_[0, np.cumsum(dims)]
        flat = np.asarray(b.column("unit").flatten(), dtype=float)
        some: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at, n in zip(first[size > 32].tolist(), size[size > 32].tolist()):
            unit = flat[offset[at] : offset[at + n]].reshape(n, -1)
            i, j = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
            some.append((at + i, at + j))
        for dim in np.unique(dims[first[size <= 32]]).tolist():
            mine = (size <= 32) & (dims[first] == dim)
            rank = np.arange(b.num_rows) - np.repeat(first, size)
            rows = np.flatnonzero(np.repeat(mine, size))
            n = (np.repeat(size, size) - rank - 1)[rows]
            i = np.repeat(rows, n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            for k in range(0, len(i), 100_000):
                x, y = (flat[offset[v[k : k + 100_000]][:, None] + np.arange(dim)] for v in (i, j))
                ok = np.einsum("ij,ij->i", x, y) >= cosine
                some.append((i[k : k + 100_000][ok], j[k : k + 100_000][ok]))
        i, j = (np.concatenate(c) for c in zip(*some))
        ok = ~cross[i] | (own[i] != own[j])
        i, j = i[ok], j[ok]
        links = np.bincount(i, weights=copies[j], minlength=b.num_rows) + np.bincount(j, weights=copies[i], minlength=b.num_rows)
        label = stars(i, j, b.num_rows)
        has, tree = pa.array(np.flatnonzero(links)), np.flatnonzero(label != np.arange(b.num_rows))
        none = pa.nulls(len(tree), pa.int64())
        rep = b.column("rep")
        counted = [*(b.column(c).take(has) for c in ("lab", "h1", "h2")), pa.array(links[has].astype(np.int64)), pa.nulls(len(has), pa.int64()), pa.nulls(len(has), pa.int64())]
        names = ["lab", "h1", "h2", "n", "a", "b"]
        yield pa.RecordBatch.from_arrays(counted, names=names)
        yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(tree), pa.int32()), none, rep.take(pa.array(tree)), rep.take(pa.array(label[tree]))], names=names)

    rows = in_blocks(members, ["lab", "cluster"], BLOCK)
    return walk(rows, ["lab", "cluster", "p", "q"], step, "lab long, h1 long, h2 int, n long, a long, b long")


def near_vectors(
    vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Per row: id, n_links (other rows with the same non-null label and cosine >= `cosine`), component_id, kept.

    Null vectors, empty and zero vectors, those with null or non-finite components and those without a label link with
    nothing; vectors of different dimension do not link. Equal vectors of a label are compared once, as a class with a
    multiplicity. Ids are integers; rows that repeat an id are rows of their own in n_links and share a component, the least
    id that any of their vectors reaches. Extra columns are ignored.

    Pairs that share a key and collide in enough windows make clusters; within a cluster all vectors are compared, in blocks.
    So a dense group costs no row for a pair, and no size of key or cluster loses one.
    """
    width, least = calibrate(cosine)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    limit = F.lit(float("inf"))
    valid = (
        F.col("label").isNotNull()
        & F.col("id").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: F.coalesce((F.abs(x) < limit) & ~F.isnan(x), F.lit(False)))
        & F.exists("v", lambda x: F.coalesce(x != 0, F.lit(False)))
    )
    rows = rows.withColumn("lab", F.when(F.coalesce(valid, F.lit(False)), F.xxhash64("label", F.size("v"))))
    keyed = stored(rows.withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")}))
    classes = keyed.filter("lab IS NOT NULL").groupBy("lab", "v").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("h1").alias("h1"), F.first("h2").alias("h2")
    )
    big = F.array_max(F.transform("v", F.abs))
    scaled = F.transform("v", lambda x: x / F.col("big"))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda t, x: t + x * x))
    classes = stored(
        classes.withColumn("big", big).withColumn("s", scaled).withColumn("norm", norm)
        .select("lab", "rep", "copies", "h1", "h2", F.size("v").alias("dim"), F.transform("s", lambda x: x / F.col("norm")).alias("unit"))
    )
    most = classes.groupBy("lab").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    keys = key_plan(most, cosine, width)
    # A label that fits one key is counted whole: with one key there is no second window to find what the first misses.
    near = stored(collisions(entries(classes, *keys), width, least, keys[0] > 0).distinct())
    clusters = components(near).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    found = stored(verified(classes.join(clusters, "rep"), cosine))
    links = found.filter("a IS NOT NULL").select("a", "b")
    again = stored(keyed.filter("lab IS NOT NULL").groupBy("id").agg(F.count_distinct("lab", "h1", "h2").alias("n")).filter("n > 1").select("id"))
    if not again.isEmpty():
        reps = keyed.join(again, "id", "left_semi").join(classes.select("lab", "h1", "h2", "rep"), ["lab", "h1", "h2"]).select("id", "rep")
        links = links.union(reps.join(reps.groupBy("id").agg(F.min("rep").alias("b")), "id").select(F.col("rep").alias("a"), "b"))
    counts = found.filter("a IS NULL").groupBy("lab", "h1", "h2").agg(F.sum("n").alias("n"))
    joined = components(links).select(F.col("node").alias("rep"), "component")
    known = stored(
        classes.select("lab", "h1", "h2", "rep", "copies").join(counts, ["lab", "h1", "h2"], "left").join(joined, "rep", "left")
        .select("lab", "h1", "h2", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    )
    out = skew_join(keyed.select("id", "lab", "h1", "h2"), known, ["lab", "h1", "h2"], "copies")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP4_SQL = r"""
WITH RECURSIVE
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b USING (label)
      WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(vec_id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = r.vec_id) AS n_links, min(reach) AS component_id, vec_id = min(reach) AS kept
FROM r GROUP BY vec_id
"""

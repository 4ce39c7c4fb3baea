"""Filter interaction audit: what each filter removes, alone and after any others, from a packed bitmap index.

Every task packs its rows' failures and labels into bitsets, one for each filter, label and part. For each set of filters the
rows that pass all of it are an AND-NOT of bitsets and their number a popcount; only these numbers are added up over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, skew_join, slices, stored, table, utf8, word_array

#: Orders of n filters are n! and sets 2**n: beyond this many filters the audit of all orders has no use.
MOST_FILTERS = 8
#: Parts whose sums a task holds before it sends them on.
HELD_PARTS = 10_000


def bitmaps(rows: DataFrame, filters: list[str], labels: list[str], part: str) -> DataFrame:
    """The index: (part, n, a binary column for each filter and label), a row for each part in each batch of a task.

    `filters` are boolean columns that are true where a row fails, `labels` boolean columns that are counted. Null counts as
    false, a null part as the empty string. Bit i, from the highest on, belongs to the i-th of the n rows.
    """
    names = [*filters, *labels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            code = b.column(0).dictionary_encode()
            of = code.indices.to_numpy()
            order, size = np.argsort(of, kind="stable"), np.bincount(of)
            wide = (size + 7) // 8
            to = np.cumsum(wide)
            place = np.arange(len(of)) + np.repeat(8 * (to - wide) - (np.cumsum(size) - size), size)
            bits = np.zeros(8 * to[-1], bool)
            columns = []
            for i in range(len(names)):
                bits[place] = b.column(i + 1).to_numpy(zero_copy_only=False)[order]
                packed = np.packbits(bits).tobytes()
                columns.append(pa.array([packed[z - w : z] for w, z in zip(wide.tolist(), to.tolist())], pa.binary()))
            yield pa.RecordBatch.from_arrays([code.dictionary, pa.array(size.astype(np.int64)), *columns], names=["part", "n", *names])

    flags = [F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(f"_{i}") for i, c in enumerate(names)]
    narrow = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"), *flags)
    return narrow.mapInArrow(run, ", ".join(["part string", "n long", *(f"`{c}` binary" for c in names)]))


def subset_counts(index: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """(part, subset, kept, a long for each label): rows that pass every filter of the subset (bit i: filters[i]), and of
    them those with each label. A task sends at most one row for each part and subset that it met."""
    sets = 1 << len(filters)
    names = ["kept", *labels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            total = np.concatenate([np.zeros((0, len(names)), np.int64), *held.values()])
            parts = pa.array(list(held), pa.string()).take(pa.array(np.repeat(np.arange(len(held)), sets)))
            which = pa.array(np.tile(np.arange(sets, dtype=np.int32), len(held)))
            held.clear()
            return pa.RecordBatch.from_arrays([parts, which, *(pa.array(np.ascontiguousarray(c)) for c in total.T)], names=["part", "subset", *names])

        for b in batches:
            if not b.num_rows:
                continue
            n = b.column("n").to_numpy()
            wide = (n + 7) // 8
            to = np.cumsum(wide)
            valid = np.full(to[-1], 0xFF, np.uint8)
            valid[to - 1] = (0xFF << (8 * wide - n)) & 0xFF
            bits = {c: np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8) for c in (*filters, *labels)}
            code = b.column("part").dictionary_encode()
            of, parts = code.indices.to_numpy(), code.dictionary.to_pylist()
            counts = np.zeros((len(parts), sets, len(names)), np.int64)
            fails = [np.zeros(to[-1], np.uint8)]
            for s in range(sets):
                if s:
                    low = s & -s
                    fails.append(fails[s ^ low] | bits[filters[low.bit_length() - 1]])
                alive = valid & ~fails[s]
                for j, rows in enumerate((alive, *(alive & bits[c] for c in labels))):
                    np.add.at(counts[:, s, j], of, np.add.reduceat(np.bitwise_count(rows).astype(np.int64), to - wide))
            for i, p in enumerate(parts):
                held[p] = held[p] + counts[i] if p in held else counts[i]
            if len(held) >= HELD_PARTS:
                yield sent()
        if held:
            yield sent()

    made = index.mapInArrow(run, "part string, subset int, " + ", ".join(f"`{c}` long" for c in names))
    return made.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in names))


def interactions(counts: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """What a filter does to the rows that a set of others has left: per part, `before` (the set) and `filter` (its place) the
    longs kept, removed, redundant, unique_fails, <label>_lost and shapley, from subset_counts().

    shapley adds up what the filter removes over all orders of all filters, whatever its step in them.
    """
    k = len(filters)
    every = (1 << k) - 1
    cells = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "kept", *labels))).alias("_at"))  # 2**k of them

    def at(subset: Column, name: str) -> Column:
        return F.element_at("_at", subset + 1)[name]

    steps = F.array(*(F.struct(F.lit(s).alias("before"), F.lit(i).alias("filter"), F.lit(1 << i).alias("_bit")) for s in range(every + 1) for i in range(k) if not s >> i & 1))
    rows = cells.select("part", "_at", F.explode(steps).alias("_cell")).select("part", "_at", "_cell.*")
    own, after = F.col("_bit"), F.col("before").bitwiseOR(F.col("_bit"))
    removed = at(F.col("before"), "kept") - at(after, "kept")
    weight = F.array(*(F.lit(factorial(i) * factorial(k - 1 - i)).cast("long") for i in range(k)))
    gain = F.aggregate(
        F.sequence(F.lit(0), F.lit(every)),
        F.lit(0).cast("long"),
        lambda total, s: total
        + F.when(
            s.bitwiseAND(own) == 0,
            F.element_at(weight, F.bit_count(s) + 1) * (at(s, "kept") - at(s.bitwiseOR(own), "kept")),
        ).otherwise(F.lit(0).cast("long")),
    )
    return rows.select(
        "part",
        "before",
        "filter",
        at(after, "kept").alias("kept"),
        removed.alias("removed"),
        (at(F.lit(0), "kept") - at(own, "kept") - removed).alias("redundant"),
        (at(F.lit(every) - own, "kept") - at(F.lit(every), "kept")).alias("unique_fails"),
        *((at(F.col("before"), c) - at(after, c)).alias(f"{c}_lost") for c in labels),
        gain.alias("shapley"),
    )


def audit(rows: DataFrame, filters: list[str], labels: list[str], part: str) -> DataFrame:
    """Per part, filter_order and step (from 1 on): longs kept (after the step), removed (by it), redundant (rows that fail
    its filter and were removed before), unique_fails (rows that fail its filter only), <label>_lost (labelled rows that it
    removed) and shapley (rows its filter removes, added up over all orders).

    `filters` name boolean columns that are true where a row fails (null: passes), `labels` boolean columns; a filter's name
    in filter_order is its column's name, joined without a sign between. Parts are the values of `part`, null as the empty
    string; every part has every order and step, zeros included; an empty table has none. Other columns are ignored.
    """
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    found = stored(interactions(subset_counts(bitmaps(rows, filters, labels, part), filters, labels), filters, labels))
    steps = [
        ("".join(filters[i] for i in order), step + 1, sum(1 << i for i in order[:step]), order[step])
        for order in permutations(range(len(filters)))
        for step in range(len(filters))
    ]  # k * k! rows, whatever the input
    steps = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, filter int")
    lost = [f"{c}_lost" for c in labels]
    return found.join(F.broadcast(steps), ["before", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley"
    )


def text_failures(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """The columns `keep` with booleans A to D for whole texts (null: empty). Words are maximal `[^\\x20\\x09-\\x0D]+`.

    A: under 200 words. B: 100 * distinct words < 50 * words. C: 100 * `[A-Z]` > 3 * code points. D: any of `#$%&*|`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "_text"):
                n = b.num_rows
                words, distinct, upper, points, odd = (np.zeros(n, np.int64) for _ in range(5))
                raw, off = utf8(b.column("_text"))
                kinds = []
                for z, to in spaced(raw, off):  # one part, but for a single text that is over the limit
                    word, count, _ = word_array(z, to, low=False)
                    code = word.dictionary_encode()
                    row = np.repeat(np.arange(n), count)
                    pair = np.unique(row * (len(code.dictionary) + 1) + code.indices.to_numpy())
                    distinct += np.bincount(pair // (len(code.dictionary) + 1), minlength=n)
                    if n == 1 and len(raw) > CHUNK_BYTES:
                        kinds.append(code.dictionary)
                    words += count
                    for total, hit in ((upper, (z >= 65) & (z <= 90)), (points, (z & 0xC0) != 0x80), (odd, ODD[z])):
                        total += np.diff(np.r_[0, np.cumsum(hit)][to])
                if kinds:
                    distinct[:] = len(pa.chunked_array(kinds).unique())
                fails = (words < 200, 100 * distinct < 50 * words, 100 * upper > 3 * points, odd > 0)
                own = [b.column(i) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, fails)], names=[*b.schema.names[:-1], *"ABCD"])

    narrow = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = narrow.drop("_text").schema
    for c in "ABCD":
        schema = schema.add(c, "boolean")
    return narrow.mapInArrow(run, schema)


ODD = np.zeros(256, bool)
ODD[list(b"#$%&*|")] = True


def spaced(raw: np.ndarray, off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, row offsets) as they are, or a single text over `limit` bytes in parts that begin at white space."""
    if len(off) != 2 or len(raw) <= limit:
        yield raw, off
        return
    at = 0
    while at < len(raw):
        end = min(len(raw), at + limit)
        while end < len(raw):  # on to the next white space
            near = raw[end : end + limit]
            found = np.flatnonzero((near == 32) | ((near >= 9) & (near <= 13)))
            end = end + int(found[0]) if len(found) else min(len(raw), end + limit)
            if len(found):
                break
        yield raw[at:end], np.array([0, end - at])
        at = end


def document_failures(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """(part, A to E, good, toxic), a row for each row of docs. E: the text is that of a row with a smaller id (null text:
    empty). good and toxic: quality and toxic are 1 in any row of `labels` with the id.

    A null id is neither smaller nor greater than another and has no labels; rows that share an id are judged one by one and
    are no copies of each other. Texts are equal when their length and SHA-256 are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = [F.col(id_col).alias("_id"), F.col(part_col).cast("string").alias("part"), F.octet_length(text).alias("_size"), F.sha2(text, 256).alias("_full")]
    facts = stored(text_failures(docs, text_col, keep))
    same = facts.groupBy("_size", "_full").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_least"))
    marked = skew_join(facts, stored(same.filter("_n > 1")), ["_size", "_full"], "_n")
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    return marked.join(known, "_id", "left").select(
        "part", *"ABCD", F.coalesce(F.col("_id") > F.col("_least"), F.lit(False)).alias("E"), "good", "toxic"
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(rows, list("ABCDE"), ["good", "toxic"], "part")


OP13_SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part,
             (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
             + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS fails FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
o(name, step, before, own) AS (
  SELECT '', 0, 0, 0
  UNION ALL
  SELECT name || chr((65 + i)::INT), step + 1, before + own, 1 << i::INT
  FROM o, range(5) x(i) WHERE step < 5 AND (before + own) & (1 << i::INT) = 0),
s AS (SELECT p.name AS filter_order, o.step, o.before, o.own FROM o p JOIN o ON p.step = 5 AND o.step > 0 AND starts_with(p.name, o.name)),
r AS (SELECT part, filter_order, step, own,
             sum(n) FILTER (WHERE fails & (before | own) = 0) AS kept, sum(n) FILTER (WHERE fails & before = 0 AND fails & own <> 0) AS removed,
             sum(n) FILTER (WHERE fails & before <> 0 AND fails & own <> 0) AS redundant, sum(n) FILTER (WHERE fails = own) AS unique_fails,
             sum(good) FILTER (WHERE fails & before = 0 AND fails & own <> 0) AS good_lost,
             sum(toxic) FILTER (WHERE fails & before = 0 AND fails & own <> 0) AS toxic_lost
      FROM m, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""

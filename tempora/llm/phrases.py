"""Phrase mining: all n-grams of up to max_n words as counted rows, scored at their weakest cut, the best of each language.

The rows of one length after another are dealt out by phrase and added up; what occurs often enough is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import skew_join, slices, stored, table, utf8, word_array

#: Characters that end a piece; no phrase goes over them.
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Bytes of text whose equal n-grams a task adds up before it sends them.
SLICE_BYTES = 8 << 20
#: Parts in which a language's candidates are ranked before the best of each part are ranked together.
RANK_PARTS = 16
SPACE, NOTHING = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())


def _windows(raw: np.ndarray, off: np.ndarray, max_n: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, row offsets, words to skip): the rows as they are, or one text over `limit` in windows that begin at a gap.

    Each window takes along the last max_n - 1 words of the one before it, which are not counted again.
    """
    if len(off) != 2 or len(raw) <= limit:
        yield raw, off, 0
        return
    gap = np.zeros(256, bool)
    gap[[32, 9, *BREAKS]] = True
    at, skip = 0, 0
    while at < len(raw):
        end = min(len(raw), at + limit)
        while end < len(raw) and not gap[raw[end]]:
            found = np.flatnonzero(gap[raw[end : end + limit]])
            end = end + int(found[0]) if len(found) else min(len(raw), end + limit)
        part, to = raw[at:end], np.array([0, end - at])
        start = word_array(part, to, False, BREAKS)[2]
        if end == len(raw) or len(start) - skip > max_n:
            yield part, to, skip
            if end == len(raw):
                return
            skip = max_n - 1
            at += int(start[-skip]) if skip else end - at
        else:  # so long words that the next window would not get on
            limit *= 2


def ngram_counts(docs: DataFrame, orders: list[int], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(phrase, n): occurrences of each phrase of so many words in each language, as rows whose phrase ends in a tab and the
    language; with order 1, a row with no words before the tab has the language's words. No word holds a tab.

    Equal n-grams of a slice of text are one row, so the shuffle gets at most a row for each of them and slice. They are sent
    in order, which the shuffle's compression makes use of.
    """
    max_n = max(orders)
    ends = np.zeros(256, bool)
    ends[list(BREAKS)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for whole in batches:
            for b in slices(whole, "text", SLICE_BYTES):
                code = b.column("lang").dictionary_encode()
                tail = pc.binary_join_element_wise(pa.array([""] * len(code.dictionary), pa.string()), code.dictionary, "\t").cast(pa.large_string())
                of_row = code.indices.to_numpy().astype(np.int64)
                for raw, off, skip in _windows(*utf8(b.column("text")), max_n, SLICE_BYTES):
                    words, count, start = word_array(raw, off, True, BREAKS)
                    if not len(words):
                        continue
                    row = np.repeat(np.arange(len(count)), count)
                    piece = np.cumsum(ends[raw])[start]
                    joined = np.r_[(row[1:] == row[:-1]) & (piece[1:] == piece[:-1]), False]  # to the word that follows
                    spelt = words.dictionary_encode()
                    order = pc.sort_indices(spelt.dictionary).to_numpy()
                    rank, base = np.empty(len(order), np.int64), len(order)
                    rank[order] = np.arange(base)
                    key, first = np.unique(of_row[row] * base + rank[spelt.indices.to_numpy()], return_inverse=True)
                    phrase = own = spelt.dictionary.take(pa.array(order[key % base]))
                    lang = key // base
                    if 1 in orders:
                        total = np.bincount(of_row[row[skip:]], minlength=len(tail))
                        yield tail, total
                        yield _named(own, tail, lang), np.bincount(first[skip:], minlength=len(own))
                    at, gram = np.arange(len(first)), first
                    for n in range(2, max_n + 1):
                        on = joined[at + n - 2]
                        at, gram = at[on], gram[on]
                        gram = gram * len(own) + first[at + n - 1]
                        if n < max_n:
                            key, gram = np.unique(gram, return_inverse=True)
                            n_of = np.bincount(gram[at + n - 1 >= skip], minlength=len(key))
                        else:
                            key, n_of = np.unique(gram[at + n - 1 >= skip], return_counts=True)
                        before = key // len(own)
                        phrase, lang = pc.binary_join_element_wise(phrase.take(pa.array(before)), own.take(pa.array(key % len(own))), SPACE), lang[before]
                        if n in orders:
                            yield _named(phrase, tail, lang), n_of

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for phrase, n in run(batches):
            some = np.flatnonzero(n)
            for k in range(0, len(some), 50_000):
                part = some[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([phrase.take(pa.array(part)).cast(pa.string()), pa.array(n[part].astype(np.int64))], names=["phrase", "n"])

    narrow = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Dealt by phrase first: the rows of a slice differ, so a table of them before the shuffle would only hold them once more.
    return narrow.mapInArrow(rows, "phrase string, n long").repartition("phrase").groupBy("phrase").agg(F.sum("n").alias("n"))


def _named(phrase: pa.Array, tail: pa.Array, lang: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(phrase, tail.take(pa.array(lang)), NOTHING)


def phrases(
    docs: DataFrame, max_n: int = 3, least: int = 10, inside_percent: int = 50, best: int = 2000, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Per language the `best` phrases of 2 to max_n words: lang, rank (from 1), phrase, a, l, r, n, score.

    a, l, r count the phrase and the parts of its weakest cut, n all words of the language. Candidates have a >= least; score
    is floor(1000000 * a * a / (l * r)) at the cut where it is least (then the earliest). A candidate inside a phrase of one
    word more that has 100 * f >= inside_percent * a is dropped; as counts only fall with length, that covers all longer
    phrases too. Order: score and a falling, phrase rising by bytes. All arithmetic is in whole decimals of 38 digits; beyond
    them (a over 10**15) Spark raises an error instead of rounding.

    A null language is `und`; null and empty texts have no words; repeated rows count each time; an empty table gives no
    row. Other columns are ignored.
    """
    kept = None
    for orders in ([1, 2], *([n] for n in range(3, max_n + 1))):  # one shuffle after another, so that disks hold one at a time
        counts = ngram_counts(docs, orders, text_col, lang_col)
        frequent = stored(counts.filter((F.col("n") >= least) | F.startswith("phrase", F.lit("\t"))))
        kept = frequent if kept is None else kept.union(frequent)
    named = kept.select(
        F.expr("substring(phrase, length(substring_index(phrase, '\t', 1)) + 2)").alias("lang"), F.substring_index("phrase", "\t", 1).alias("phrase"), "n"
    )
    totals = named.filter("phrase = ''").select("lang", "n")
    known = named.filter("phrase <> ''")
    words = F.split("phrase", " ")
    candidates = known.select("lang", "phrase", F.col("n").alias("a"), words.alias("_words")).filter(F.size("_words") > 1)
    cuts = candidates.withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_words") - 1))).select(
        "lang",
        "phrase",
        "a",
        "_k",
        F.array_join(F.slice("_words", F.lit(1), F.col("_k")), " ").alias("_first"),
        F.array_join(F.slice("_words", F.col("_k") + 1, F.size("_words")), " ").alias("_rest"),
    )
    cuts = stored(cuts)
    for part, name in (("_first", "l"), ("_rest", "r")):  # a common first or last word stands in many candidates
        wanted = cuts.groupBy("lang", part).agg(F.count(F.lit(1)).alias("_n"))
        side = stored(wanted.join(known.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part]))
        cuts = skew_join(cuts, side, ["lang", part], "_n")
    up = " * ".join(f"CAST({x} AS DECIMAL(38,0))" for x in (1000000, "a", "a"))
    score = F.expr(f"({up}) div (CAST(l AS DECIMAL(38,0)) * CAST(r AS DECIMAL(38,0)))")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "_k", "a", "l", "r")).alias("_cut")
    )
    size = F.size("_words")
    inner = F.explode(F.array(F.lit(1), F.lit(2))).alias("_from")  # without its last word, without its first
    longer = (
        candidates.filter(size > 2)
        .select("lang", "a", "_words", inner)
        .groupBy("lang", F.array_join(F.slice("_words", F.col("_from"), size - 1), " ").alias("phrase"))
        .agg(F.max("a").alias("_over"))
    )
    left = weakest.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(F.col("_over") * 100 < F.lit(inside_percent) * F.col("_cut.a"), F.lit(True)))
    rows = left.select("lang", "phrase", "_cut.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = rows.withColumn("_part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= best)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k AS size, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, size, phrase, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
u AS (
  SELECT lang, size, phrase, a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (
  SELECT u.lang, u.phrase, u.a, k, l.n AS l, r.n AS r, (1000000::HUGEINT * u.a * u.a // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM u
  JOIN f l ON l.lang = u.lang AND l.phrase = u.head
  JOIN f r ON r.lang = u.lang AND r.phrase = u.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS phrase, a AS longer FROM c WHERE size = 3),
k AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.longer >= 50 * b.a)),
t AS (SELECT lang, sum(n) AS n FROM f WHERE size = 1 GROUP BY lang),
o AS (SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n::BIGINT AS n, score FROM k JOIN t USING (lang))
SELECT * FROM o WHERE rank <= 2000
"""

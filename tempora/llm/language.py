"""Language ID: expectation-maximisation infers each document's language proportions from n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_caches, free_name, slices, stored, table, utf8

#: Hash buckets of the byte 3-grams; with the number of languages this bounds the model (and what the driver reads).
BUCKETS = 1 << 16
#: Consecutive words that share one hidden language.
SEGMENT_WORDS = 4
#: EM ends when no share moves by more than SETTLED in a round, at ROUNDS at the latest.
ROUNDS, SETTLED = 50, 1e-3
SMOOTHING = 0.5
#: Bytes of text scored at a time; each byte takes a number for every language.
TEXT_BYTES = 1 << 18


def grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """3-gram buckets of every row's lower-cased bytes with a space before and after it, their count per row, the padded
    bytes, and the padded row offsets."""
    rows = len(off) - 1
    to = off + 2 * np.arange(rows + 1)
    pad = np.full(to[-1], 32, np.uint8)
    pad[np.arange(len(raw)) + 2 * np.repeat(np.arange(rows), np.diff(off)) + 1] = raw
    pad[(pad >= 65) & (pad <= 90)] += 32
    second = np.r_[False, pad[:-1] == 0xC3]
    pad[second & (pad >= 0x80) & (pad <= 0x9E) & (pad != 0x97)] += 32
    pad[(pad >= 9) & (pad <= 13)] = 32
    wide = pad.astype(np.uint32)
    key = np.zeros(len(pad), np.uint32)
    key[:-2] = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    bucket = ((key * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    return bucket, np.diff(to) - 2, pad, to


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, bucket, n) over all rows with text and language; each task sends a row per language and bucket it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for b in slices(whole, "text", TEXT_BYTES):
                raw, off = utf8(b.column("text"))
                bucket, n, _, to = grams(raw, off)
                row = np.repeat(np.arange(len(n)), np.diff(to))
                real = np.ones(len(bucket), bool)
                real[to[1:] - 1] = real[to[1:] - 2] = False
                code = b.column("lang").dictionary_encode()
                of = np.asarray(code.indices)[row]
                for i, lang in enumerate(code.dictionary.to_pylist()):
                    have = np.bincount(bucket[real & (of == i)], minlength=BUCKETS)
                    total[lang] = total.get(lang, 0) + have
        for lang, have in total.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(have[at])], names=["lang", "bucket", "n"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).dropna()
    return rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 256) -> tuple[list[str], np.ndarray]:
    """The learned languages in order and log probabilities [bucket, language]. At most `most` languages may be labelled."""
    counts = stored(gram_counts(docs, text_col, lang_col))
    langs = sorted(r[0] for r in counts.select("lang").distinct().limit(most + 1).collect())
    if len(langs) > most:
        raise ValueError(f"more than {most} languages are labelled")
    found = counts.toPandas()  # at most BUCKETS rows a language
    have = np.full((BUCKETS, max(1, len(langs))), SMOOTHING)
    have[found["bucket"].to_numpy(), np.searchsorted(np.array(langs, dtype=object), found["lang"].to_numpy())] += found["n"].to_numpy()
    return langs, np.log(have / have.sum(0)).astype(np.float32)


def mixture(like: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """For segments' log likelihoods [segment, language] and their (sorted) document numbers: the chosen language and its share.

    EM gives each document's proportions over all languages; nested sets of its strongest languages are then refitted, one
    language more at a time while the likelihood, less half a logarithm of the segments for each language, rises.
    """
    n, langs = like.shape
    top = like.max(1, keepdims=True)
    ratio = np.exp(like - top)
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    own = doc[at]
    size = np.diff(np.r_[at, n])

    def em(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share, moving = allowed / allowed.sum(1, keepdims=True), np.ones(len(at), bool)
        for _ in range(ROUNDS):
            part = ratio * np.repeat(share, size, axis=0)
            part /= np.maximum(part.sum(1, keepdims=True), 1e-300)
            new = np.add.reduceat(part, at, axis=0) / size[:, None]
            moved = np.abs(new - share).max(1) > SETTLED
            share = np.where(moving[:, None], new, share)  # each document stops by itself, whatever others it came with
            moving &= moved
            if not moving.any():
                break
        value = np.log(np.maximum((ratio * np.repeat(share, size, axis=0)).sum(1), 1e-300)) + top[:, 0]
        return share, np.add.reduceat(value, at)

    full, _ = em(np.ones((len(at), langs)))
    order = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    best, score = full, np.full(len(at), -np.inf)
    going = np.ones(len(at), bool)
    for k in range(1, langs + 1):
        share, value = em((order < k).astype(float))
        value = value - k * (1 + 0.5 * np.log(size))
        going &= value > score
        if not going.any():
            break
        best, score = np.where(going[:, None], share, best), np.where(going, value, score)
    which, part = np.full(docs, -1), np.zeros(docs)
    which[own] = best.argmax(1)
    part[own] = best.max(1)
    return which, part


def predict(
    docs: DataFrame, langs: list[str], model: np.ndarray, text_col: str, keep: list[str], lang_as: str = "lang_pred", score_as: str = "score"
) -> DataFrame:
    """docs' columns `keep` with the predicted language and its score, in columns of the given names, which are not in `keep`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for whole in batches:
            for b in slices(whole, whole.schema.names[at], TEXT_BYTES):
                text = b.column(at)
                raw, off = utf8(text)
                rows = len(off) - 1
                ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
                seen = np.r_[0, np.cumsum(ascii_letter)]
                letters = seen[off[1:]] > seen[off[:-1]]
                for i in np.flatnonzero(~letters).tolist():
                    letters[i] = any(map(str.isalpha, text[i].as_py() or ""))
                which, part = np.full(rows, -1), np.zeros(rows)
                if langs and letters.any():
                    bucket, n, pad, to = grams(raw, off)
                    row = np.repeat(np.arange(rows), np.diff(to))
                    real = letters[row]
                    real[to[1:] - 1] = real[to[1:] - 2] = False
                    start = (pad == 32) & np.r_[pad[1:] != 32, False]  # the space before a word
                    word = np.cumsum(start)
                    word -= np.r_[0, word][to[:-1]][row]
                    segment = row.astype(np.int64) * (len(pad) + 1) + np.maximum(word - 1, 0) // SEGMENT_WORDS
                    bucket, segment, row = bucket[real], segment[real], row[real]
                    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
                    like = np.add.reduceat(sent.value[bucket], first, axis=0).astype(float)
                    which, part = mixture(like, row[first], rows)
                names = np.array([*langs, "und"], dtype=object)[which]
                own = [b.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(part)], names=[*keep, lang_as, score_as])

    # A text that is kept anyway is sent once; another goes along under a name of its own, whatever the others are called.
    at = keep.index(text_col) if text_col in keep else len(keep)
    narrow = docs.select(*map(F.col, keep), *([] if at < len(keep) else [F.col(text_col).alias(free_name(keep, "_text"))]))
    schema = T.StructType([*narrow.schema.fields[: len(keep)], T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType())])
    return narrow.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score (the predicted language's share of the mixture).

    The model is learned from the rows that are not held out and have text and a language. `und` with score 0: null text,
    text without a letter, or nothing to learn from. A null id is held out; repeated rows are judged one by one; extra
    columns are ignored.
    """
    langs, model = fit(docs.filter(~held_out(id_col)), text_col, lang_col)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col))
    return predict(rows, langs, model, text_col, [id_col, "held_out"])


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))

"""Corpus cleaning as one job: language ID, exact dedup, near dedup, mixing, packing.

Each stage works on all rows that the one before it kept; run() writes what a stage returns as Parquet in the shared folder
and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import exact_dedup, language, mixing, near_dedup, packing, tokens
from tempora.llm.common import free_name, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognisable language; lang is the recognised one. Null texts and texts without a letter go.

    Repeated rows and rows without an id are judged one by one; an empty table, and one without a labelled language to learn
    from, give none. Columns of any other name go along.
    """
    langs, model = language.fit(docs.filter(~language.held_out()))
    lang, score = (free_name(docs.columns, c) for c in ("lang_pred", "score"))
    found = language.predict(docs, langs, model, "text", docs.columns, lang, score)
    return found.filter(F.col(lang) != "und").select(*(F.col(lang).alias(c) if c == "lang" else c for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) one row: the longest, then the one with the smallest id. That holds for repeated rows
    and rows without an id too; null counts as empty. Columns of any name go along."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles. Empty texts link with nothing,
    rows without an id all stay, rows that share an id are one document. Columns of any name go along."""
    return near_dedup.near_dedup(docs, k=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as there are, small sources raised until one is repeated 1.25 times; a repeated document is a row again.

    A null source is a source of its own; texts without a word are not taken. Columns of any name go along.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return mixing.temperature_mix(rows, max_repeat=1.25, id_col="row.doc_id", text_col="row.text", source_col="row.source").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 2048 tokens; null texts are their closing token. Other columns are left out."""
    return packing.pack(docs, tokens.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixed),
    ("packing", packed),
]

#: EM, near-duplicate search and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs

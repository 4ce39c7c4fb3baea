"""Connected components of a link table: links of a task are contracted in it, then alternating large-star and small-star rounds
join what the tasks found; no part of it meets on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: With more links than this, least neighbours are written before they are joined: Spark splits a skewed side only where
#: both sides come straight from a shuffle.
WRITTEN_LINKS = 200_000
#: Links that one task contracts at a time: 16 bytes each.
LINKS_A_TASK = 100_000


def stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For links i-j between n things: the least one that each can reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """The links (u, v) of bigint nodes as stars around the least node that each reaches within its part of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if held:
            u, v = (np.concatenate(c) for c in zip(*held))
            node, place = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = stars(place[: len(u)], place[len(u) :], len(node))
            some = np.flatnonzero(root != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]])], names=["u", "v"])

    return edges.coalesce(parts).mapInArrow(run, "u long, v long")


def _stars(edges: DataFrame) -> bool:
    """Whether every child has one parent that is nobody's child."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    return ends.groupBy("node").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).filter("c + p > 1").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; nodes are bigint, component is the smallest node that can be reached.

    Each task first contracts up to LINKS_A_TASK links, which is all of it where there are no more. Beyond that, least
    neighbours are combined before the shuffle, so that a node with very many links is a plain skewed join, and rounds grow with
    the logarithm of the longest path over contracted parts; links that form stars already need none.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    first = stored(links.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    n = first.count()
    parts = ceil(n / LINKS_A_TASK)
    edges = stored(_contracted(first, parts)) if n else first
    kept = stored if n > WRITTEN_LINKS else lambda df: df
    while parts > 1 and not _stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        parent = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(parent, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = stored(moved.union(parent.select("u", F.col("m").alias("v"))).distinct())
        discard(edges)
        discard(large)
        edges = small
    if n:
        discard(first)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

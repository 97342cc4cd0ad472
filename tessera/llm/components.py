"""Connected components of an edge table, without bringing links or labels to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Edges in a stored part; a task holds about so many at a time.
PART_ROWS = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges' components as stars: every node but the smallest of its component, and that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(a):
        high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        open_ = high != low
        a, b = a[open_], b[open_]
        np.minimum.at(label, high[open_], low[open_])
        while (label[label] != label).any():
            label = label[label]
    hung = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[hung], nodes[label[hung]]


def _contracted(links: DataFrame, part_rows: int) -> DataFrame:
    """Stars in place of the edges that a task reads, for at most ``part_rows`` edges at a time; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def stars() -> tuple[np.ndarray, np.ndarray]:
            return forest(*(np.concatenate([x[i] for x in held]) for i in range(2)))

        def batch_of(edges: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in edges], ["a", "b"])

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("a", "b")))
            n += batch.num_rows
            if n > part_rows:
                held = [stars()]
                n = len(held[0][0])
                if 2 * n > part_rows:
                    yield batch_of(held[0])
                    held, n = [], 0
        if held:
            yield batch_of(stars())

    return links.mapInArrow(run, "a bigint, b bigint")


def connected_components(edges: DataFrame, max_rounds: int = 60, part_rows: int = PART_ROWS) -> DataFrame:
    """node, label (the smallest node that can be reached) for every node of ``edges`` (a, b: long).

    First, tasks replace the edges that they read by stars, as long as that halves them; edges that fit
    in one part are done by this. Then two rewritings of the edge set alternate: each node hands its larger neighbours, then its
    smaller ones, to the smallest node it knows. Both keep components; the edge set ends as stars
    around the smallest nodes, after rounds in the order of the logarithm of the longest path.
    Nodes with very many neighbours meet in joins only, whose large partitions Spark splits.
    """
    a, b = F.col("a"), F.col("b")
    links = common.cut(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    n, parts = links.count(), 0
    while parts != 1:
        parts, old, before = max(1, -(-n // part_rows)), links, n
        links = common.cut(_contracted(links.coalesce(parts), part_rows), "links")
        common.discard(old)
        n = links.count()
        if 2 * n > before:
            break
    if parts != 1:
        links = _settled(links, max_rounds, part_rows)
    return links.select(a.alias("node"), b.alias("label")).unionByName(links.select(b.alias("node"), b.alias("label")).distinct())


def _settled(links: DataFrame, max_rounds: int, part_rows: int) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    before = (links.count(), None)
    for _ in range(max_rounds):
        both = links.unionByName(links.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b)
        # every edge now points down, from a to b < a; they are as many as the links, and made distinct below
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        # the edge set does not grow: its stored parts are as many as its last size asks for
        old, links = links, common.cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct().coalesce(8 + before[0] // part_rows), "links")
        common.discard(old)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return links
        before = state
    raise RuntimeError("components did not settle")

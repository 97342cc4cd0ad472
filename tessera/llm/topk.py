"""Exact top-k inner-product search by distributed histogram selection.

Queries are taken in blocks of bounded size. Every candidate is scored against a block, and the
scores are counted in a histogram for each query, summed over all tasks; the bin that holds a
query's k-th score becomes the next, finer range, until only a few scores lie at or above its lower
edge or the bin is a single value. A last pass keeps the scores at or above the edge, at most k of
each task, ranks them by score, then smaller id, and stores the block's rows. No task sees more than its
own candidates and a block, and what meets is a histogram or k rows a task. A round reads all candidates
for a whole block, so the scans are as many as the blocks, times the few rounds of a block.

Components become floor(scale * x) and scores are integers: products are exact in doubles below
2^53, and above in Python integers (clipped to 64 bits).

Defined results: vectors that are null, or hold null or non-finite values, and rows without an id
take no part; a query meets candidates of its own length only, never rows of its own id; a query id
on several rows is answered once, for its smallest vector; repeated candidates count each; fewer
candidates than k give fewer rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SCALE = 1024.0
BINS = 512
#: Bytes of a block of queries, as it is broadcast, and queries in it at most.
BLOCK_BYTES, BLOCK = 16_000_000, 8192
#: Queries of a block that are scored at once.
LANES = 1024
#: The selection ends when so many times k scores remain.
SLACK = 4
#: Candidates that are scored at once.
TILE = 1024


def usable(vector: str, key: str) -> Column:
    """True for rows that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


def _quantise(column: pa.Array, scale: float) -> list[np.ndarray]:
    """Integer components, as doubles, of each vector of a list column without nulls."""
    flat = np.floor(scale * column.values.to_numpy(zero_copy_only=False).astype(np.float64))
    ends = column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _scores(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Exact integer inner products (queries x tile)."""
    if np.abs(queries).max(initial=0) * np.abs(tile).max(initial=0) * queries.shape[1] < 2**53:
        return (queries @ tile.T).astype(np.int64)
    whole = np.array([[int(x) for x in q] for q in queries], object) @ np.array([[int(x) for x in c] for c in tile], object).T
    return np.clip(whole, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def _tiles(batches: Iterator[pa.RecordBatch], dim: int, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        vectors = _quantise(pa.concat_arrays([batch.column(1)]), scale)
        fit = [i for i, v in enumerate(vectors) if len(v) == dim]
        for at in range(0, len(fit), TILE):
            pick = fit[at : at + TILE]
            yield ids[pick], np.stack([vectors[i] for i in pick])


def _block_top(candidates: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, scale: float) -> DataFrame:
    spark, (n, dim) = candidates.sparkSession, queries.shape
    most = candidates.where(F.size("vec") == dim).select(F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * scale), 2)).alias("n")).agg(F.max("n")).first()[0]
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bound = [min(2**63 - 1, int(np.ceil(np.sqrt(float((q * q).sum()) * float(most)) * (1 + 1e-9))) + 1) for q in queries]
    low = [-b for b in bound]
    shift = [max(0, (2 * b).bit_length() - BINS.bit_length() + 1) for b in bound]
    width = [BINS] * n  # bins that cover the range; fewer than BINS where a bin of the round before was narrower than that
    above = np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    while open_.any():
        state = spark.sparkContext.broadcast((ids, queries, np.array(low, np.int64), np.array(shift, np.uint64), np.array(width, np.uint64), np.flatnonzero(open_)))

        def count(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            ids, queries, low, shift, width, todo = state.value
            own, lo, sh, most = queries[todo], low[todo][:, None], shift[todo][:, None], width[todo][:, None]
            total = np.zeros(len(todo) * BINS, np.int64)
            for vec_ids, tile in _tiles(batches, queries.shape[1], scale):
                for a in range(0, len(todo), LANES):
                    part = slice(a, a + LANES)
                    score = _scores(own[part], tile)
                    place = (score.view(np.uint64) - lo[part].view(np.uint64)) >> sh[part]  # the distance may take all 64 bits
                    inside = (score >= lo[part]) & (place < most[part]) & (vec_ids[None, :] != ids[todo[part]][:, None])
                    counts = total[a * BINS : (a + LANES) * BINS]
                    counts += np.bincount((place.astype(np.int64) + np.arange(len(score))[:, None] * BINS)[inside], minlength=len(counts))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(todo[some // BINS].astype(np.int32)), pa.array((some % BINS).astype(np.int32)), pa.array(total[some])], ["q", "bin", "n"])

        bins = candidates.select("vec_id", "vec").mapInArrow(count, "q int, bin int, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("q").orderBy(F.desc("bin"))
        reached = bins.withColumn("upto", F.sum("n").over(down.rowsBetween(W.unboundedPreceding, 0)))
        need = spark.createDataFrame([(int(q), int(k - above[q])) for q in np.flatnonzero(open_)], "q int, need long")
        # the first bin from the top with enough scores, or the lowest of all
        first = reached.join(F.broadcast(need), "q").groupBy("q").agg(F.max(F.when(F.col("upto") >= F.col("need"), F.struct("bin", "n", "upto"))).alias("hit"))
        found = {r["q"]: r["hit"] for r in first.collect()}  # a row for each query of the block
        state.destroy()
        for q in np.flatnonzero(open_).tolist():
            hit = found.get(q)
            if hit is None:  # fewer than k candidates: all of them
                open_[q] = False
                continue
            low[q] += hit["bin"] << shift[q]
            if shift[q] == 0 or above[q] + hit["upto"] <= SLACK * k:
                open_[q] = False
            else:
                above[q] += hit["upto"] - hit["n"]
                finer = max(0, shift[q] - BINS.bit_length() + 1)
                width[q], shift[q] = 1 << (shift[q] - finer), finer
    state = spark.sparkContext.broadcast((ids, queries, np.array(low, np.int64)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, low = state.value
        best: dict[int, list[tuple[int, int]]] = {}
        for vec_ids, tile in _tiles(batches, queries.shape[1], scale):
            for a in range(0, len(queries), LANES):
                part = slice(a, a + LANES)
                score = _scores(queries[part], tile)
                at, col = np.nonzero((score >= low[part, None]) & (vec_ids[None, :] != ids[part, None]))
                for q in np.unique(at).tolist():
                    own = col[at == q]
                    mine = best.setdefault(a + q, [])
                    mine += [(-int(s), int(v)) for s, v in zip(score[q, own], vec_ids[own], strict=True)]
                    mine.sort()
                    del mine[k:]
        rows = [(int(ids[q]), v, -s) for q, mine in best.items() for s, v in mine]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], ["query_id", "vec_id", "score"])

    kept = candidates.select("vec_id", "vec").mapInArrow(keep, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = common.cut(kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top")
    state.destroy()
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row that ``is_query`` holds for."""
    rows = vectors.where(usable(vector, key))
    candidates = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vec"))
    queries = rows.where(is_query).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vec")).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    out, ids, block, dim = None, [], [], None

    def flush() -> None:
        nonlocal out, ids, block
        if block:
            part = _block_top(candidates, np.array(ids, np.int64), np.stack(block), k, scale)
            out = part if out is None else out.unionByName(part)
            ids, block = [], []

    # a block at a time comes to the driver, as it is to be broadcast
    for row in queries.orderBy(F.size("vec"), "vec_id").toLocalIterator(prefetchPartitions=False):
        vec = np.floor(scale * np.array(row["vec"], np.float64))
        if dim != len(vec) or len(block) >= min(BLOCK, max(1, BLOCK_BYTES // (8 * len(vec)))):
            flush()
        dim = len(vec)
        ids.append(row["vec_id"])
        block.append(vec)
    flush()
    return out if out is not None else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

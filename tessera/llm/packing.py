"""Packing token sequences by bounded-space online best-fit.

Documents longer than a sequence are cut into full pieces and a rest. Pieces arrive one by one; a
fixed number of bins is open, kept by free space with a bitset that has a bit for each free space
some open bin has. A piece goes to the fullest bin that still holds it, found by one shift and
lowest-bit step; if none does, a bin is opened, and when all are open the fullest closes first.

Tokenising and packing are two passes: the first turns texts into piece rows of a few dozen bytes,
the second deals those rows into shards of bounded size (a hash of the piece and its stored row, so
neither a hot source nor repeated rows meet in one shard) and packs each shard in the order of that
hash. The packer is online: it never looks ahead. Who feeds it may choose the order, and here pieces
arrive in windows whose longest come first, so short ones fill what the long ones leave. A shard
loses at most its open bins.

Defined results: a null or empty text is one piece, the end token alone; a very long text is cut into
full pieces and a rest; repeated rows, also of null or repeated ids, are packed once each under the id
they have; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .piece_table import forget, piece_table

SEQUENCE = 2048
OPEN_BINS = 512
#: Pieces arrive in windows of so many times the open bins, the longest of a window first.
WINDOW = 2
#: Pieces that a shard has on average: bounds a packing task and the share of half-empty bins.
SHARD_PIECES = 60_000
END_TOKEN = 0

PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


class BestFit:
    """Bounded-space best-fit: at most ``n_open`` bins are open, the fullest closes first."""

    def __init__(self, capacity: int = SEQUENCE, n_open: int = OPEN_BINS):
        self.capacity, self.n_open = capacity, n_open
        self.bits = 0  # bit f is set while some open bin has f free
        self.by_free: dict[int, list[int]] = {}
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_id = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        return bin_id

    def _put(self, free: int, bin_id: int) -> None:
        bins = self.by_free.setdefault(free, [])
        if not bins:
            self.bits |= 1 << free
        bins.append(bin_id)

    def place(self, length: int) -> tuple[int, int]:
        """The bin for a piece and the piece's offset there."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} does not fit {self.capacity}")
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.capacity, self.made
            self.made += 1
            if free > length and self.open == self.n_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            self.open += 1
        left = free - length
        if left:
            self._put(left, bin_id)
        else:
            self.open -= 1
        return bin_id, self.capacity - free


def pieces(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", size: int = SEQUENCE) -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32 of its little-endian 32-bit ids."""
    source = docs.select(F.col(key), F.col(text).alias("__text"))
    schema = f"`{key}` {source.schema[0].dataType.simpleString()}, {PIECES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("packing", forget)
        known = piece_table(path)
        for batch in batches:
            for first, texts in common.steps(batch, "__text"):
                ids, counts = known.encode(texts, END_TOKEN)
                data, ends = memoryview(ids.astype("<u4", copy=False)).cast("B"), np.cumsum(counts)
                parts = -(-counts // size)
                where = np.repeat(np.arange(len(texts)), parts)
                piece = np.arange(len(where)) - np.repeat(np.cumsum(parts) - parts, parts)
                start, length = piece * size, np.minimum(size, counts[where] - piece * size)
                at = ((ends - counts)[where] + start).tolist()
                crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at, length.tolist(), strict=True)]
                own = batch.column(0).take(pa.array(where + first))
                yield pa.RecordBatch.from_arrays([own, pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]], [key, "piece", "start", "length", "ids_crc32"])

    return common.small_batches(source).mapInArrow(common.trimmed(run), schema)


def pack(rows: DataFrame, key: str = "doc_id", size: int = SEQUENCE, n_open: int = OPEN_BINS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to piece rows; ``rows`` is counted once to set the number of shards."""
    rows = common.cut(rows, "pieces")
    n = max(1, -(-rows.count() // shard_pieces))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", sequence_id bigint, offset bigint"
    order = F.xxhash64(key, "piece", "ids_crc32", F.monotonically_increasing_id())  # of a stored row, so a repeated task gives the same

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        packer, base = BestFit(size, n_open), int(shard["__shard"].iloc[0]) << 40
        placed = [packer.place(x) for x in shard["length"].tolist()]
        shard = shard.drop(columns=["__shard", "__order"])
        shard["sequence_id"] = [base + b for b, _ in placed]
        shard["offset"] = [o for _, o in placed]
        return shard

    def ordered(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["__order", "piece", "ids_crc32"], kind="stable")
        window = np.arange(len(shard)) // (WINDOW * n_open)
        return run(shard.iloc[np.lexsort((-shard["length"].to_numpy(), window))])

    dealt = rows.withColumn("__order", order).withColumn("__shard", F.pmod(F.col("__order"), F.lit(n)))
    return dealt.groupBy("__shard").applyInPandas(ordered, schema)


def pack_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    return pack(pieces(docs, path, text, key), key)

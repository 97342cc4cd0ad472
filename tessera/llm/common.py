"""Shared helpers of the training-data operators: tables, work files, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; ``bytes.split()`` splits at exactly these.
SPACES = " \t\n\r\x0b\x0c"
#: Rows of one vectorised step hold about so many bytes of text.
STEP_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a temporary folder serves a session on one machine; a cluster is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(work_dir, "local", None) or f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        work_dir.local = folder
    return folder.rstrip("/")


#: Paths that the running operator has written; None outside of one that tidies up.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


#: With this set, a query's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    Nothing reads the shuffle files behind it any more, so they go with the write.
    """
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if (written := _written.get()) is not None:
        written.append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with _shuffles_cleaned(df.sparkSession):
        writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of work files, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(stored: DataFrame, *parts: str) -> None:
    """Deletes what ``cut`` has written, or folders of it, once all that reads it is itself stored."""
    for part in parts or ("",):
        delete(stored.sparkSession, f"{stored.stored_at}/{part}")


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """Inside, ``cut`` lists the paths that it writes."""
    own: list[str] = []
    token = _written.set(own)
    try:
        yield own
    finally:
        _written.reset(token)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is stored and whose work tables are deleted before it returns."""

    @wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        out, spark = None, SparkSession.getActiveSession()
        with scratch() as own:
            try:
                out = cut(operator(*args, **kwargs), operator.__name__)
            finally:
                for path in own:
                    if out is None or path != out.stored_at:
                        delete(spark, path)
        if (outer := _written.get()) is not None:
            outer.append(out.stored_at)
        return out

    return run


#: Rows of a few numbers each that may be broadcast.
BROADCAST_ROWS = 400_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Marks a stored table of a few numeric columns for broadcast if its counted rows are few; else it is shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Session settings that suit short rows, with Spark's default, and what they become for long texts: rows of
#: an Arrow batch, which the JVM and the worker hold at once, and of a batch of the Parquet reader.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.parquet.columnarReaderBatchSize": ("4096", "256")}


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds batches of rows as ``BATCHES`` says, where the session has Spark's defaults."""
    conf = df.sparkSession.conf
    for name, (default, size) in BATCHES.items():
        if conf.get(name) == default:
            conf.set(name, size)
    return df


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that no model learns from: crc32 of the id's decimal text divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[tuple[int, list[bytes | None]]]:
    """Slices of a string column as (first row, raw UTF-8 of each row), of about ``limit`` bytes."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    first, rows, held = 0, [], 0
    for i, value in enumerate(col):
        raw = value.as_py()
        rows.append(raw)
        held += len(raw or b"") + 64
        if held >= limit:
            yield first, rows
            first, rows, held = i + 1, [], 0
    if rows:
        yield first, rows


_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True
#: Words of more bytes are hashed one by one, by xxhash.
LONG_WORD = 64
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def lanes(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from every byte of ``buffer`` on, as unaligned little-endian words of one copy."""
    return np.ndarray(len(buffer) + 1, "<u8", np.concatenate([buffer, np.zeros(8, np.uint8)]), 0, (1,))


def lane(view: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Bytes ``k`` to ``k`` + 7 of each run, zero beyond its end; ``view`` as ``lanes`` gives it."""
    return view[starts + k] & _MASKS[np.minimum(sizes - k, 8)]


def cut_runs(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and size of every run of bytes without ASCII white space."""
    solid = np.zeros(len(buffer) + 2, np.int8)
    solid[1:-1] = ~_SPACE[buffer]
    change = np.diff(solid)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    return starts, ends, ends - starts


def cut_words(buffer: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and 64-bit hash of every run of bytes without ASCII white space.

    A hash starts from the length and takes in eight bytes at a time through a bijective mixer, so words
    of up to eight bytes and one length never share one; no Python object is made for a word of usual length.
    """
    (starts, ends, sizes), view = cut_runs(buffer), lanes(buffer)
    value = mix(sizes.astype(np.uint64), seed)
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        value[i] = xxhash.xxh3_64_intdigest(buffer[starts[i] : ends[i]].tobytes(), seed + 1)
    at = np.flatnonzero(sizes <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        at = at[sizes[at] > k]
        value[at] = mix(value[at] ^ lane(view, starts[at], sizes[at], k), seed)
    return starts, ends, value


def _trim() -> None:
    """Gives freed memory back to the system: a worker outlives its tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that returns its memory when it is done."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        _trim()

    return whole


_claimed: list[str] = []
_releases: dict[str, Callable[[], None]] = {}


def claim(name: str, release: Callable[[], None] | None = None) -> None:
    """A worker serves one operator after the other and keeps the caches of the last one only.

    ``release`` frees what the operator remembers; it is called when another one claims the worker.
    """
    if _claimed != [name]:
        for free in _releases.values():
            free()
        _releases.clear()
        _claimed[:] = [name]
        _trim()
    if release:
        _releases[name] = release


def word_arrays(texts: list[bytes | None], fold_case: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and the number of words of each text.

    Words are runs of anything but ASCII white space; ``fold_case`` lower-cases A-Z only. Another
    ``seed`` gives hashes that start from the bytes anew.
    """
    raw = b" ".join(t or b"" for t in texts)
    if fold_case:
        raw = raw.lower()
    starts, _, hashes = cut_words(np.frombuffer(raw, np.uint8), seed)
    bounds = np.cumsum([len(t or b"") + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, bounds), prepend=0)


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


MULTIPLIERS = _multipliers(64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``width`` words, by its first word; windows may cross texts (mask those)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += words[k : k + n] * MULTIPLIERS[k]
    return mix(total, seed)


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)


def whole_windows(counts: np.ndarray, width: int) -> np.ndarray:
    """Mask over all window starts of the concatenated words: true where the window stays in its text."""
    n = int(counts.sum()) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    ends = np.repeat(np.cumsum(counts), counts)
    return np.arange(n) + width <= ends[:n]


def covered(hits: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """Mask over words: true where a window that starts at one of ``hits`` covers the word."""
    change = np.bincount(hits, minlength=n_words + 1) - np.bincount(hits + width, minlength=n_words + 1)
    return np.cumsum(change)[:n_words] > 0


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one per word) for each text."""
    sums = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]

"""Exact substring dedup by fixed-block anchors.

A word goes if a window of 35 words that covers it has the same words as a window that starts
anywhere else. Any two such windows hold, at the same place, a block of 18 words that starts at a
multiple of 18 in one of the two texts. So:

1. *Index.* The non-overlapping 18-word blocks of every text form a table, dealt by block hash.
2. *Probe.* Every rolling 18-word window is looked up there; it is a hit if some block (for a window
   that is itself a block: another block) has its hash. Windows of 35 words without a hit inside
   cannot be repeated and go no further.
3. *Extend.* The 35-word windows around the hits are hashed and counted exactly, over all texts;
   runs of repeated windows are the maximal exact repeats, and their words go.

Index and probes travel together: texts are handled in chunks of a few MB, and a chunk sends each of
its distinct 18-word hashes once to one of many buckets, as four bytes and two bits that say whether
it is a block there, once or more; two bits come back. Cut to the bucket and four bytes, unlike
blocks may be taken for one, which only costs a count in step 3. The windows of step 3 go the same
way with 64 bits and 32 more of an independent hash that starts from the words' bytes anew. A passage
that a third of all texts share is thus one hash per chunk. The number of buckets follows the size of
the corpus, and so does a chunk's size where buckets would get more hashes than a task should hold.
Every step is stored on its own, so the shuffle files and work tables of the one before can go.

Defined results: a null text has no words and stays null; texts under 35 words lose nothing; very long
texts are one chunk of their own; repeated rows are copies like any other and lose their long
passages; ids are not looked at, so null and repeated ones change nothing; other columns pass
through, but for ``n_words`` and ``n_removed``, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 35
#: Bytes of text in a chunk, at least and at most.
CHUNK_BYTES, MAX_CHUNK_BYTES = 2_500_000, 32_000_000
#: Hashes of a bucket, and of a chunk in one bucket, that are aimed at.
BUCKET_WORDS, SHARE_WORDS = 4_000_000, 48
_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
_ROWS = "kind string, chunk bigint, bucket int, data binary, more binary"


def _positions(counts: np.ndarray) -> np.ndarray:
    """Place of each word in its own text."""
    return np.arange(int(counts.sum())) - np.repeat(common.starts_of(counts), counts)


def plan(size: int, least: int) -> tuple[int, int]:
    """Buckets and bytes of a chunk for a corpus of ``size`` bytes, of six to a word."""
    buckets = max(least, -(-size // (6 * BUCKET_WORDS)))
    chunk = min(max(CHUNK_BYTES, 6 * SHARE_WORDS * buckets), MAX_CHUNK_BYTES)
    return max(least, min(buckets, chunk // (6 * SHARE_WORDS))), chunk


def _chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Rows of about ``limit`` bytes of text, and their texts."""
    held, texts, size = [], [], 0
    for batch in batches:
        for first, rows in common.steps(batch, text, limit):
            held.append(batch.slice(first, len(rows)))
            texts += rows
            size += sum(len(t or b"") + 64 for t in rows)
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], texts
                held, texts, size = [], [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], texts


def _probes(hashes: np.ndarray, counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows of ``block`` words, whether each is a block, the sorted distinct hashes, and each window's place among these."""
    places = np.flatnonzero(common.whole_windows(counts, block))
    rolled = common.rolling(hashes, block)[places] if len(places) else np.zeros(0, np.uint64)
    distinct, inverse = np.unique(rolled, return_inverse=True)
    return places, _positions(counts)[places] % block == 0, distinct, inverse


def _dealt(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ends of the buckets' shares of sorted hashes."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets), side="right")


def _candidates(places: np.ndarray, hit: np.ndarray, counts: np.ndarray, window: int, block: int) -> np.ndarray:
    """Mask over words: windows that start there hold a hit, so they may be repeated."""
    whole, n = common.whole_windows(counts, window), int(counts.sum())
    mask = np.zeros(n, bool)
    mask[: len(whole)] = whole
    change, places = np.zeros(n + 1, np.int64), places[hit]
    first = np.repeat(common.starts_of(counts), counts)[places]
    np.add.at(change, np.maximum(places - (window - block), first), 1)
    np.add.at(change, places + 1, -1)
    return mask & (np.cumsum(change[:-1]) > 0)


def _rows(rows: list[tuple[str, int, int, bytes, bytes]]) -> pa.Table:
    kind, chunk, bucket, data, more = zip(*rows, strict=True) if rows else ((), (), (), (), ())
    return pa.table({"kind": pa.array(kind, pa.string()), "chunk": pa.array(chunk, pa.int64()), "bucket": pa.array(bucket, pa.int32()), "data": pa.array(data, pa.binary()), "more": pa.array(more, pa.binary())})


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _look_up(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket of the block table: for each hash of each chunk, whether one block, and whether two, have it."""
    keys = [np.frombuffer(x, np.uint32) for x in rows["data"]]
    blocks = np.concatenate([_bits(x, 2 * len(k)).reshape(2, -1).sum(axis=0) for x, k in zip(rows["more"], keys, strict=True)])
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    found = np.bincount(inverse, weights=blocks)[inverse]
    parts = np.split(found, np.cumsum([len(k) for k in keys])[:-1])
    return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "data": [np.packbits(np.concatenate([p >= 1, p >= 2])).tobytes() for p in parts], "more": b""})


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket of windows: for each of a chunk's, whether it occurs again, there or anywhere."""
    keys = [np.frombuffer(x, np.uint64) for x in rows["data"]]
    key = np.concatenate(keys)
    check = np.concatenate([np.frombuffer(x, np.uint32, len(k)) for x, k in zip(rows["more"], keys, strict=True)])
    again = np.concatenate([_bits(x[4 * len(k) :], len(k)) for x, k in zip(rows["more"], keys, strict=True)])
    order, first = _equal(key, check)
    group = np.cumsum(first) - 1
    repeated = (np.bincount(group) > 1) | (np.bincount(group, weights=again[order]) > 0)
    out = np.empty(len(key), bool)
    out[order] = repeated[group]
    parts = np.split(out, np.cumsum([len(k) for k in keys])[:-1])
    return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "data": [np.packbits(p).tobytes() for p in parts], "more": b""})


def _equal(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (key, check), and a mask over it of the first of each run of equal ones."""
    order = np.lexsort((check, key))
    k, c = key[order], check[order]
    return order, np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])


def _answers(rows: list[dict], n: int, width: int) -> np.ndarray:
    """The bits that came back for a chunk, in the order of its hashes; ``width`` for each."""
    out, at = np.zeros((width, n), bool), 0
    for r in sorted((r for r in rows if r["bucket"] >= 0), key=lambda r: r["bucket"]):
        own = r["size"]
        out[:, at : at + own] = _bits(r["data"], width * own).reshape(width, own)
        at += own
    return out


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_all().combine_chunks().to_batches(max_chunksize=None)[0]


def _result(batch: pa.RecordBatch, text: str, gone: np.ndarray | None, counts: np.ndarray, digests: bool) -> pa.RecordBatch:
    """The rows with their removed words; ``gone`` is a mask over all words, None for nothing."""
    at = batch.schema.get_field_index(text)
    column, n_removed = batch.column(at).cast(pa.binary()), np.zeros(len(counts), np.int64)
    if gone is not None:
        n_removed = common.per_text(gone.astype(np.int64), counts)
    starts, out = common.starts_of(counts), []
    for i, value in enumerate(column):
        raw = value.as_py()
        own = gone[starts[i] : starts[i] + counts[i]] if n_removed[i] else None
        if digests:
            words = (raw or b"").split()
            kept = words if own is None else [w for w, g in zip(words, own.tolist(), strict=True) if not g]
            out.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        elif own is None:
            out.append(raw)
        else:
            flags = iter(own.tolist())
            out.append(_WORD.sub(lambda m, f=flags: b"" if next(f) else m[0], raw))
    values = pa.array(out, pa.string() if digests else pa.binary()).cast(pa.string())
    columns, names = list(batch.columns), list(batch.schema.names)
    columns[at] = values
    return pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(n_removed, pa.int64())], [*names, "n_words", "n_removed"])


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, digests: bool = False, buckets: int | None = None, chunk_bytes: int | None = None) -> DataFrame:
    """All rows and columns, with repeated passages cut out of ``text``, and n_words, n_removed.

    The white space after a kept word stays. With ``digests`` the text column holds the SHA-256 of
    the kept words joined by one blank instead. Columns named n_words or n_removed are replaced.
    ``buckets`` and ``chunk_bytes`` follow the size of the corpus unless they are given.
    """
    spark, block = docs.sparkSession, (window + 1) // 2
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_words", "n_removed") and c != text])
    kept = ", ".join(f"`{f.name}` {'string' if f.name == text else f.dataType.simpleString()}" for f in docs.schema.fields)
    schema = kept + ", n_words bigint, n_removed bigint"
    planned = plan(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_buckets, limit = buckets or planned[0], chunk_bytes or planned[1]
    columns, reply = ["chunk", "bucket", "data", "more"], "chunk bigint, bucket int, data binary, more binary"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("substring")
        chunk = TaskContext.get().partitionId() << 32
        for own, texts in _chunks(batches, text, limit):
            chunk += 1
            hashes, counts = common.word_arrays(texts)
            long = counts >= window
            rows: list[tuple[str, int, int, bytes, bytes]] = []
            if not long.all():
                plain = np.flatnonzero(~long)
                rows.append(("done", chunk, -1, _pack(_result(own.take(pa.array(plain)), text, None, counts[plain], digests)), b""))
            if long.any():
                rows.append(("text", chunk, -1, _pack(own.take(pa.array(np.flatnonzero(long)))), b""))
            yield from _rows(rows).combine_chunks().to_batches()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("substring")
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = _unpack(data.as_py())
                _, aligned, distinct, inverse = _probes(*common.word_arrays(own.column(own.schema.get_field_index(text)).cast(pa.binary()).to_pylist()), block)
                blocks = np.bincount(inverse[aligned], minlength=len(distinct))
                low, a, rows = distinct.astype(np.uint32), 0, []
                for b, e in enumerate(_dealt(distinct, n_buckets).tolist()):
                    if e > a:
                        rows.append(("probe", chunk, b, low[a:e].tobytes(), np.packbits(np.concatenate([blocks[a:e] > 0, blocks[a:e] > 1])).tobytes()))
                    a = e
                yield from _rows(rows).select(columns).combine_chunks().to_batches()

    def extend(group: pa.Table) -> pa.Table:
        common.claim("substring")
        given = group.to_pylist()
        chunk = given[0]["chunk"]
        own = _unpack(next(r["data"] for r in given if r["bucket"] < 0))
        texts = own.column(own.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
        hashes, counts = common.word_arrays(texts)
        places, aligned, distinct, inverse = _probes(hashes, counts, block)
        sizes = np.diff(_dealt(distinct, n_buckets), prepend=0)
        for r in given:
            r["size"] = int(sizes[r["bucket"]]) if r["bucket"] >= 0 else 0
        once, twice = _answers(given, len(distinct), 2)
        mask = _candidates(places, np.where(aligned, twice[inverse], once[inverse]), counts, window, block)
        touched = common.per_text(mask.astype(np.int64), counts) > 0
        rows: list[tuple[str, int, int, bytes, bytes]] = []
        if not touched.all():
            plain = np.flatnonzero(~touched)
            rows.append(("done", chunk, -1, _pack(_result(own.take(pa.array(plain)), text, None, counts[plain], digests)), b""))
        if touched.any():
            inside = np.repeat(touched, counts)
            mask, hashes = mask[inside], hashes[inside]
            others, _ = common.word_arrays([t for t, x in zip(texts, touched.tolist(), strict=True) if x], seed=1)
            at = np.flatnonzero(mask)
            key, check = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
            for k in range(window):
                key += hashes[at + k] * common.MULTIPLIERS[k]
                check += others[at + k] * common.MULTIPLIERS[k]
            key, check = common.mix(key), (common.mix(check) >> np.uint64(32)).astype(np.uint32)
            order, first = _equal(key, check)
            rank = np.empty(len(at), np.uint32)
            rank[order] = np.cumsum(first) - 1
            seen = np.bincount(rank)
            key, check, a = key[order][first], check[order][first], 0
            ends = _dealt(key, n_buckets)
            for b, e in enumerate(ends.tolist()):
                if e > a:
                    rows.append(("keys", chunk, b, key[a:e].tobytes(), check[a:e].tobytes() + np.packbits(seen[a:e] > 1).tobytes()))
                a = e
            layout = pa.RecordBatch.from_arrays([pa.array([np.packbits(mask).tobytes()]), pa.array([rank.tobytes()]), pa.array([np.diff(ends, prepend=0).astype(np.uint32).tobytes()])], ["mask", "rank", "sizes"])
            rows.append(("layout", chunk, -1, _pack(own.take(pa.array(np.flatnonzero(touched)))), _pack(layout)))
        return _rows(rows)

    def finish(group: pa.Table) -> pa.Table:
        given = group.to_pylist()
        layout = next(r for r in given if r["bucket"] < 0)
        own, found = _unpack(layout["data"]), _unpack(layout["more"])
        sizes = np.frombuffer(found["sizes"][0].as_py(), np.uint32)
        for r in given:
            r["size"] = int(sizes[r["bucket"]]) if r["bucket"] >= 0 else 0
        repeated = _answers(given, int(sizes.sum()), 1)[0]
        column = own.column(own.schema.get_field_index(text)).cast(pa.binary())
        counts = np.array([len((v.as_py() or b"").split()) for v in column], np.int64)
        n = int(counts.sum())
        places = np.flatnonzero(_bits(found["mask"][0].as_py(), n))
        hits = places[repeated[np.frombuffer(found["rank"][0].as_py(), np.uint32)]]
        return pa.Table.from_batches([_result(own, text, common.covered(hits, window, n), counts, digests)])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield _unpack(data.as_py())

    first = common.cut(common.small_batches(docs).mapInArrow(common.trimmed(scan), _ROWS), "chunks", "kind")
    chunks = first.where("kind = 'text'").select(*columns)
    looked_up = common.cut(chunks.select("chunk", "data").mapInArrow(common.trimmed(probe), reply).groupBy("bucket").applyInPandas(_look_up, reply), "hits")
    second = common.cut(chunks.unionByName(looked_up).groupBy("chunk").applyInArrow(extend, _ROWS), "windows", "kind")
    common.discard(first, "kind=text")
    common.discard(looked_up)
    counted = second.where("kind = 'keys'").select(*columns).groupBy("bucket").applyInPandas(_count, reply)
    rest = second.where("kind = 'layout'").select(*columns).unionByName(counted).groupBy("chunk").applyInArrow(finish, schema)
    return reduce(DataFrame.unionByName, [rest, *[t.where("kind = 'done'").select("data").mapInArrow(plain, schema) for t in (first, second)]])

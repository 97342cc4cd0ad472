"""Structured Streaming forms: the delivered-card ledger, the journal, and idempotent ingestion."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed as V
from ..functions import text as X
from ..operators import daily, relational
from ..plans.store import Store
from ..plans.work import stored


def fresh_cards(offers: DataFrame, cap: int = V.DELIVERED_CAP) -> DataFrame:
    """offers: session, id, ord. The offers that their session has not had yet; a session remembers ``cap`` ids and then no more.

    Its state is a session's id list, bounded by the cap.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known: list[int] = list(state.get[0]) if state.exists else []
        seen, out = set(known), []
        for batch in batches:
            for row in batch.sort_values("ord").itertuples():
                if row.id not in seen:
                    out.append((key[0], row.id))
                    if len(known) < cap:
                        known.append(row.id)
                        seen.add(row.id)
        state.update((known,))
        yield pd.DataFrame(out, columns=["session", "id"])

    return offers.groupBy("session").applyInPandasWithState(step, "session string, id bigint", "ids array<bigint>", "append", GroupStateTimeout.NoTimeout)


def _start(stream: DataFrame, store: Store, apply: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str, available_now: bool) -> StreamingQuery:
    """Publishes what ``apply`` makes of each micro-batch, with the batch's number: one that is delivered again is left out."""
    name = hashlib.sha1(checkpoint.rstrip("/").encode()).hexdigest()

    def once(batch: DataFrame, number: int) -> None:
        if number > store.batches().get(name, -1) and (tables := apply(batch)):
            store.publish(batch=(name, number), **tables)

    writer = stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def journal(entries: DataFrame, store: Store, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """entries: day, project_key, ord, label, text. Each micro-batch is appended to its days; late entries are welcome and revive an archived day."""

    def apply(batch: DataFrame) -> dict[str, DataFrame]:
        return {} if batch.isEmpty() else {"memories": daily.append(store.read()["memories"], batch, F.current_timestamp())}

    return _start(entries, store, apply, checkpoint, available_now)


def ingest(items: DataFrame, store: Store, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """items: the item schema with ``hash``. Inserts items whose hash the ledger does not know, and records them.

    The ledger is unbounded, so this is an anti-join with the stored table and not a stream's own dedup.
    Blank texts and texts over the cap are refused: they are left out and not recorded.
    """

    def apply(batch: DataFrame) -> dict[str, DataFrame]:
        tables = store.read()
        body = X.strip(F.col("text"))
        sound = batch.withColumn("text", body).where((F.col("text") != "") & (F.length("text") <= V.BODY_CAP))
        fresh = relational.new_hashes(sound.dropDuplicates(["hash"]), tables["ledger"])
        if fresh.isEmpty():
            return {}
        now = F.current_timestamp()
        rows = fresh.select("hash", "text", F.coalesce("title", F.lit("")).alias("title"), F.lit("import").alias("source"), "tags", "ord")
        rows = stored(relational.with_ids(tables["memories"], rows), "fresh")
        entries = rows.select("hash", F.col("id").alias("memory_id"), now.alias("imported_at"), "ord")
        return {"memories": relational.insert(tables["memories"], rows, now), "ledger": relational.record_imports(tables["ledger"], entries)}

    return _start(items, store, apply, checkpoint, available_now)


def daily_counts(entries: DataFrame, watermark: str = "30 days") -> DataFrame:
    """Entries of each day and project, updated as they come; days older than the watermark are forgotten."""
    return entries.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"), "project_key").agg(F.count("*").alias("n"))

"""From items to memories: hashes, the ledger, layers, candidates and the report of a run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import scalar as S
from ..functions import text as X
from ..plans.work import stored
from . import daily, distill, merge, relational


@dataclass(frozen=True)
class Request:
    platform: str | None = None
    scope: str = "global"
    project_key: str | None = None
    project_path: str | None = None
    tags: tuple[str, ...] = ()
    max_chars: int = V.BODY_CAP
    max_items: int | None = V.IMPORT_ITEMS
    dry_run: bool = False


def considered(items: DataFrame, request: Request) -> DataFrame:
    """The first ``max_items`` by ``ord`` (None: all), with hash, layer and the day of a journal item. Equal hashes count once, the first."""
    first = items if request.max_items is None else items.orderBy("ord").limit(request.max_items)
    rows = first.withColumn("hash", X.item_hash(F.lit(request.platform), F.col("item_id"), F.col("text")))
    keep = rows.groupBy("hash").agg(F.min("ord").alias("ord")).withColumn("fresh", F.lit(True))
    rows = rows.join(keep, ["hash", "ord"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    layer = F.when(F.col("scope").isNull() | (F.col("scope") == "identity"), F.lit(request.scope)).otherwise(F.col("scope"))
    day = F.when(S.is_day_key(F.coalesce("title", F.lit(""))), F.col("title")).otherwise(F.substring(F.coalesce("at", F.lit("")), 1, 10))
    return rows.withColumn("layer", layer).withColumn("day", day)


def candidates_for(rows: DataFrame) -> DataFrame:
    """Utterances are mined, entries are taken whole: ord, pos, text, kind, explicit, vouched."""
    mined = distill.extract_candidates(rows.where("kind = 'utterance'"), "text", ("ord",)).select("ord", "pos", "text", "kind", "explicit", "vouched")
    whole = rows.where("kind <> 'utterance'").select("ord", F.lit(0).alias("pos"), X.strip(F.col("text")).alias("text"), distill.classify(F.col("text")).alias("kind"), F.lit(True).alias("explicit"), F.lit(True).alias("vouched"))
    return mined.unionByName(whole.where("text <> ''"))


def run(items: DataFrame, memories: DataFrame, ledger: DataFrame, now: Column, request: Request | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(next memories, next ledger, one row of counters). Candidates are folded in one after the other, layer by layer."""
    request = request or Request()
    rows = stored(considered(items, request), "items")
    known = relational.known_hashes(rows.where("fresh"), ledger).select("hash").distinct().withColumn("known", F.lit(True))
    rows = rows.join(known, "hash", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    live = rows.where("fresh AND NOT known")
    sized = live.where(F.length("text") <= request.max_chars)
    journal = sized.where("layer = 'daily'").withColumn("logged", S.is_day_key(F.col("day")))
    has_project = request.project_key is not None
    made = distill.judge(candidates_for(sized.where("layer <> 'daily'")), has_project)
    carry = sized.select("ord", "hash", F.col("layer"), F.coalesce("title", F.lit("")).alias("title"), F.concat(F.array(*[F.lit(t) for t in request.tags]).cast("array<string>"), F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"))
    # an item has at most MESSAGE_CANDIDATES candidates, wherever in it they stand
    rank = F.row_number().over(W.partitionBy("ord").orderBy("pos"))
    judged = stored(made.drop("scope").join(carry, "ord").withColumn("cand_id", F.col("ord") * V.MESSAGE_CANDIDATES + rank), "judged")
    accepted = judged.where("accepted").select("cand_id", "hash", "kind", "title", "text", F.col("layer").alias("scope"), F.when(F.col("layer") == "project", F.lit(request.project_key)).alias("project_key"), "tags", "importance", F.lit("import").alias("source"), F.lit(request.platform).alias("source_platform"), F.lit(request.project_path).alias("project_path"))
    folded = stored(merge.sequential(accepted, memories), "folded")
    decided = judged.select("cand_id", "hash", "accepted").join(folded, "cand_id", "left").withColumn("decision", F.coalesce("decision", F.lit("rejected")))
    counters = [F.count_if(F.col("decision") == d).alias(n) for n, d in (("written", "new"), ("merged", "merge"), ("updated", "update"), ("ignored", "ignore"), ("rejected", "rejected"))]
    report = decided.agg(*counters)
    scanned, logged = items.agg(F.count("*").alias("scanned")), journal.agg(F.count_if("logged").alias("logged"))
    flags = rows.agg(F.count("*").alias("considered"), F.count_if(F.col("fresh") & F.col("known")).alias("known"), F.count_if(F.col("fresh") & ~F.col("known") & (F.length("text") > request.max_chars)).alias("oversized"))
    report = scanned.join(F.broadcast(flags)).join(F.broadcast(logged)).join(F.broadcast(report)).withColumn("truncated", F.col("scanned") > F.col("considered"))
    if request.dry_run:
        return memories, ledger, report
    entries = journal.where("logged").select("day", F.lit(request.project_key).alias("project_key"), "ord", F.lit(None).cast("string").alias("label"), "text")
    after = daily.append(memories, entries, now)
    after, made = apply_fold(after, accepted, folded, now)
    after = stored(after, "memories")
    placed = accepted.select("cand_id", "hash").join(folded.where("decision <> 'rejected'"), "cand_id")
    # the row that the candidate made, the one made by an earlier candidate, or the stored one
    maker = F.when(F.col("decision").isin("new", "update"), F.col("cand_id")).when(F.col("target") < 0, -F.col("target"))
    made = made.select(F.col("cand_id").alias("maker"), "id")
    named = placed.withColumn("maker", maker).join(made, "maker", "left").select("hash", F.coalesce("id", "target").alias("memory_id"), F.col("cand_id").alias("ord"))
    days = daily.days(after).where(F.col("project_key").eqNullSafe(F.lit(request.project_key))).groupBy("date").agg(F.max("id").alias("memory_id"))
    logged_rows = journal.where("logged").join(days, F.col("day") == F.col("date")).select("hash", "memory_id", "ord")
    entries = named.unionByName(logged_rows).withColumn("imported_at", now)
    return after, relational.record_imports(ledger, entries), report


def apply_fold(memories: DataFrame, accepted: DataFrame, folded: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Applies a sequential fold: targets that were themselves made in the fold are resolved to the row that started them.

    Gives the next memories, and the id of the row that each candidate made.
    """
    accepted = accepted.withColumn("scope", merge.written_scope(F.col("scope")))
    rows = stored(accepted.join(folded, "cand_id"), "placed")  # of known size, as in apply_plan
    made = rows.where("decision IN ('new', 'update')").select("cand_id", "text", "title", "tags", "scope", "project_key", "importance", "source", "source_platform", "project_path", "target", "decision")
    into = rows.where("decision = 'merge' AND target < 0").groupBy((-F.col("target")).alias("cand_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("cand_id").alias("c"), "text"))).alias("__in"))
    gone = rows.where("decision = 'update' AND target < 0").select((-F.col("target")).alias("cand_id")).distinct().withColumn("__old", F.lit(True))
    body = F.aggregate("__in", F.col("text"), lambda acc, x: X.merged_body(acc, x["text"]))
    fresh = made.join(into, "cand_id", "left").join(gone, "cand_id", "left").withColumn("text", F.when(F.col("__in").isNotNull(), body).otherwise(F.col("text")))
    fresh = fresh.withColumn("status", F.when(F.col("__old"), "outdated").otherwise("active")).withColumn("ord", F.col("cand_id"))
    plans = rows.where("target > 0 AND decision IN ('merge', 'update')").select("cand_id", "decision", "target", "text", "tags")
    merges = plans.where("decision = 'merge'").select("cand_id", "text", "tags", F.col("target"), "decision")
    retire = plans.where("decision = 'update'").select("target").distinct().select(F.col("target").alias("id"), F.lit("outdated").alias("status"))
    kept = merge.apply_plan(memories, merges.drop("decision", "target"), merges.select("cand_id", "decision", "target"), now)
    fresh = stored(relational.with_ids(memories, fresh.drop("__in", "__old", "target", "decision")), "fresh")
    return relational.insert(relational.update(kept, retire, now), fresh.drop("cand_id"), now), fresh.select("cand_id", "id")


def distill_messages(messages: DataFrame, memories: DataFrame, now: Column, project_key: str | None = None, scope: str | None = None, seed: DataFrame | None = None, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(next memories, one row of counters) for a session's user messages (ord, message).

    The candidates of ``seed`` (pos, text, kind, vouched) come first, then those of the messages, oldest
    first; each goes through the gate, then through the merge against what the ones before left. A
    ``scope`` given by the caller wins over the guessed layer, but for a project that has no key.
    """
    batch = messages.select(F.lit(1).alias("batch"), "ord", "message")
    mined = distill.extract_from_messages(batch, "batch", "ord").select("ord", "pos", "text", "kind", "vouched")
    if seed is not None:
        mined = seed.select(F.lit(None).cast(mined.schema["ord"].dataType).alias("ord"), "pos", "text", "kind", "vouched").unionByName(mined)
    judged = distill.judge(mined, project_key is not None)
    numbered = stored(judged.withColumn("cand_id", F.row_number().over(W.orderBy("ord", "pos")).cast("long")), "judged")  # at most a batch's candidates
    wanted = F.col("scope") if scope is None else F.lit("global" if scope == "project" and project_key is None else scope)
    accepted = numbered.where("accepted").select(
        "cand_id", "kind", F.lit("").alias("title"), "text", merge.written_scope(wanted).alias("scope"), F.when(wanted.isin("project", "daily"), F.lit(project_key)).alias("project_key"),
        F.array().cast("array<string>").alias("tags"), "importance", F.lit("auto").alias("source"), F.lit(None).cast("string").alias("source_platform"), F.lit(None).cast("string").alias("project_path"),
    )
    folded = stored(merge.sequential(accepted, memories), "folded")
    outcomes = numbered.select("cand_id").join(folded, "cand_id", "left").select(F.coalesce("decision", F.lit("rejected")).alias("decision"))
    after = memories if dry_run else apply_fold(memories, accepted, folded, now)[0]
    return after, distill.report(outcomes)


def samples(rows: DataFrame, limit: int = V.IMPORT_SAMPLES) -> DataFrame:
    return rows.orderBy("ord").limit(limit).withColumn("text", X.headline(F.col("text"), 120))

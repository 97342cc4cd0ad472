"""Filtered lists, counts, groups, paging, eviction and the write side of a memory table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import scalar as S
from ..functions import text as X
from ..plans.work import number_rows
from .model import MEMORY_COLUMNS, Query, order

# -- reads --------------------------------------------------------------------------------------


def list_memories(memories: DataFrame, query: Query) -> DataFrame:
    """Filter, order, page. An offset without a limit is ignored."""
    rows = memories.where(query.condition()).orderBy(*order(query.order_by))
    if query.limit is None:
        return rows
    return (rows.offset(query.offset) if query.offset else rows).limit(query.limit)


def with_tag(memories: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """Membership in the tag table, as a semi-join."""
    return memories.join(tags.where(F.col("tag") == tag).select(F.col("memory_id").alias("id")), "id", "left_semi")


def attach_tags(memories: DataFrame, tags: DataFrame) -> DataFrame:
    """``tags`` in their order from the tag table; the column's own where the table has none."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "tag"))), lambda t: t["tag"])
    own = tags.groupBy(F.col("memory_id").alias("id")).agg(ordered.alias("__tags"))
    return memories.join(own, "id", "left").withColumn("tags", F.coalesce("__tags", "tags")).drop("__tags")


def get_many(memories: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The rows of ``ids`` in the caller's order, with ``pos``; unknown ids are dropped."""
    wanted = memories.sparkSession.createDataFrame([(i, p) for p, i in enumerate(ids)], "id bigint, pos int")
    return memories.join(F.broadcast(wanted), "id").orderBy("pos")


def count(memories: DataFrame, query: Query) -> DataFrame:
    return memories.where(query.condition()).agg(F.count("*").alias("n"))


def projects(memories: DataFrame) -> DataFrame:
    """Keys by number of rows; the key breaks ties."""
    found = memories.where(F.col("project_key").isNotNull()).groupBy("project_key").agg(F.max("project_path").alias("project_path"), F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "project_key")


def all_tags(memories: DataFrame) -> DataFrame:
    return memories.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def overview(memories: DataFrame) -> DataFrame:
    """Counts by scope and status (zero-filled), by source (those met) and in all, in one pass: kind, name, n."""
    sets = memories.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("name")) for k, v in (("scope", F.col("scope")), ("status", F.col("status")), ("source", F.col("source")), ("total", F.lit("all")))])).alias("g")).select("g.*")
    counts = sets.groupBy("kind", "name").agg(F.count("*").alias("n"))
    fixed = [("scope", s) for s in V.SCOPES] + [("status", s) for s in V.STATUSES] + [("total", "all")]
    zero = memories.sparkSession.createDataFrame(fixed, "kind string, name string").withColumn("n", F.lit(0).cast("long"))
    return counts.unionByName(zero).groupBy("kind", "name").agg(F.max("n").alias("n"))


def visible(memories: DataFrame, project_key: str | None, query: Query | None = None, limit: int = V.VISIBLE_LIMIT) -> DataFrame:
    """Global rows without a key, then own rows: the key-less daily layer, or a project's and its days; ``side`` and ``ord`` keep the order."""
    query = query or Query()
    base = memories.where(Query(status=query.status, source=query.source, pinned=query.pinned, tag=query.tag).condition())
    sides = [(0, (F.col("scope") == "global") & F.col("project_key").isNull())]
    own = (F.col("scope") == "daily") & F.col("project_key").isNull() if project_key is None else F.col("scope").isin("project", "daily") & (F.col("project_key") == project_key)
    sides.append((1, own))
    parts = []
    for side, condition in sides:
        rows = base.where(condition).orderBy(*order(query.order_by)).limit(limit)
        parts.append(rows.withColumn("side", F.lit(side)).withColumn("ord", F.row_number().over(W.partitionBy("side").orderBy(*order(query.order_by)))))
    return parts[0].unionByName(parts[1])


def retrievable(project_key: str | None) -> Column:
    """Active rows outside the keyed scopes, or of exactly this key (which may be none)."""
    return (F.col("status") == "active") & (~F.col("scope").isin("project", "daily") | F.col("project_key").eqNullSafe(F.lit(project_key)))


def in_scopes(scopes: Sequence[str], project_key: str | None) -> Column:
    """The filter after a search: scopes, and the exact key for keyed scopes."""
    out = F.col("scope").isin(*scopes) if scopes else F.lit(True)
    return out & (~F.col("scope").isin("project", "daily") | F.col("project_key").eqNullSafe(F.lit(project_key)))


def list_scopes(scopes: Sequence[str], project_key: str | None) -> Column:
    """A listing by named scopes: no project layer without a key; the key binds keyed scopes only."""
    kept = [s for s in scopes if s != "project" or project_key is not None]
    return in_scopes(kept, project_key) if kept else F.lit(False)


def panel_filter(scope: str | None = None, status: str | None = None, tag: str | None = None, project: str | None = None, global_only: bool = False) -> Query:
    return Query(
        scope=(scope,) if scope else (), status=(status,) if status else (), tag=tag,
        project_key=project, by_project=global_only or project is not None,
    )


def panel_input(requests: DataFrame) -> DataFrame:
    """Clamps of panel input for a table of requests (limit, offset, importance, entries, tags, title, scope); null keeps a default. ``valid``: the scope is null or known."""
    return requests.select(
        *[c for c in requests.columns if c not in ("limit", "offset", "importance", "entries", "tags", "title")],
        S.clamp(F.coalesce("limit", F.lit(30)), 1, 200).alias("limit"), S.clamp(F.coalesce("offset", F.lit(0)), 0, 1_000_000).alias("offset"), S.clamp(F.col("importance"), 0, 5).alias("importance"),
        S.clamp(F.coalesce("entries", F.lit(200)), 1, 200).alias("entries"), F.slice(F.transform("tags", lambda t: F.substring(t, 1, 40)), 1, 32).alias("tags"), F.substring("title", 1, 200).alias("title"),
        (F.col("scope").isNull() | F.col("scope").isin(*V.SCOPES)).alias("valid"),
    )


def panel_view(memories: DataFrame, limit: int = V.PANEL_TEXT_CHARS) -> DataFrame:
    return memories.withColumn("text_truncated", F.length("text") > limit).withColumn("text", F.substring("text", 1, limit))


def eviction_candidates(memories: DataFrame, keep: int) -> DataFrame:
    """Unpinned active rows past the ``keep`` most recent, most recent first."""
    ranked = [F.coalesce("last_used_at", "created_at").desc(), F.desc("created_at"), F.desc("importance"), F.asc("id")]
    rows = memories.where(~F.col("pinned") & (F.col("status") == "active")).orderBy(*ranked)
    return rows.offset(keep) if keep else rows


def forget_outcome(project_key: str | None) -> Column:
    """For a left join of wanted ids with the table (``status`` null: unknown)."""
    other = F.col("scope").isin("project", "daily") & F.col("project_key").isNotNull() & ~F.col("project_key").eqNullSafe(F.lit(project_key))
    return (
        F.when(F.col("status").isNull(), "unknown").when(F.col("scope") == "identity", "identity").when(other, "other-project")
        .when(F.col("status") == "archived", "already-archived").otherwise("archived")
    )


# -- writes: each gives the next snapshot -------------------------------------------------------


def checked_text(text: Column, limit: int = V.BODY_CAP) -> Column:
    body = X.strip(text)
    return F.when(body == "", F.raise_error(F.lit("a memory needs text"))).when(F.length(body) > limit, F.raise_error(F.lit("the text is too long"))).otherwise(body)


def with_ids(memories: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with the next ids, in the order of its ``ord``."""
    top = memories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    numbered = number_rows(new, "ord" if "ord" in new.columns else "text").join(F.broadcast(top))
    return numbered.withColumn("id", F.col("__top") + F.col("__n")).drop("__top", "__n")


def insert(memories: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Appends rows (any subset of the columns; text required), defaults filled in; rows without an ``id`` column get the next ids."""
    defaults = {
        "title": F.lit(""), "scope": F.lit("global"), "source": F.lit("auto"), "pinned": F.lit(False), "importance": F.lit(0), "status": F.lit("active"),
        "tags": F.array().cast("array<string>"), "created_at": now, "updated_at": now,
    }
    types = dict(memories.dtypes)
    numbered = new if "id" in new.columns else with_ids(memories, new)
    columns = []
    for name in MEMORY_COLUMNS:
        given = F.col(name) if name in numbered.columns else F.lit(None)
        value = F.coalesce(given, defaults[name]) if name in defaults else given
        if name == "text":
            value = checked_text(given)
        elif name == "title":
            value = X.strip(value)
        elif name == "tags":
            value = X.normalize_tags(value)
        columns.append(value.cast(types[name]).alias(name))
    return memories.select(*MEMORY_COLUMNS).unionByName(numbered.select(*columns))


def update(memories: DataFrame, patches: DataFrame, now: Column, moved: str | None = None) -> DataFrame:
    """Applies patches (id and any columns, null: keep); ``updated_at`` moves only where something changes, which a column named ``moved`` can tell."""
    named = [c for c in patches.columns if c != "id"]
    joined = memories.join(patches.select("id", *[F.col(c).alias(f"__{c}") for c in named], F.lit(True).alias("__hit")), "id", "left")
    changed = F.lit(False)
    for c in named:
        changed = changed | (F.col(f"__{c}").isNotNull() & ~F.col(f"__{c}").eqNullSafe(F.col(c)))
    columns = {c: F.coalesce(f"__{c}", c) if c in named else F.col(c) for c in MEMORY_COLUMNS} | {"updated_at": F.when(changed, now).otherwise(F.col("updated_at"))}
    return joined.select(*[columns[c].alias(c) for c in MEMORY_COLUMNS], *([changed.alias(moved)] if moved else []))


def touch(memories: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    hit = memories.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    return hit.withColumn("last_used_at", F.when(F.col("__hit"), at).otherwise(F.col("last_used_at"))).select(*MEMORY_COLUMNS)


def remove(memories: DataFrame, tags: DataFrame, ledger: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deletes rows; their tags go, and ledger entries lose their pointer."""
    gone = ids.select("id").distinct()
    kept_tags = tags.join(gone.select(F.col("id").alias("memory_id")), "memory_id", "left_anti")
    marked = ledger.join(gone.select(F.col("id").alias("memory_id"), F.lit(True).alias("__gone")), "memory_id", "left")
    freed = marked.select("hash", F.when(F.col("__gone").isNull(), F.col("memory_id")).alias("memory_id"), "imported_at")
    return memories.join(gone, "id", "left_anti"), kept_tags, freed


def record_imports(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """Insert or replace by hash; of entries with one hash the last by ``ord`` stays."""
    last = entries.groupBy("hash").agg(F.max_by(F.struct("memory_id", "imported_at"), "ord").alias("e")).select("hash", "e.*")
    return ledger.join(last.select("hash"), "hash", "left_anti").unionByName(last)


def known_hashes(items: DataFrame, ledger: DataFrame) -> DataFrame:
    return items.join(ledger.where(F.col("memory_id").isNotNull()).select("hash"), "hash", "left_semi")


def new_hashes(items: DataFrame, ledger: DataFrame) -> DataFrame:
    return items.join(ledger.where(F.col("memory_id").isNotNull()).select("hash"), "hash", "left_anti")

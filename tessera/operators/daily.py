"""The daily journal: one row per day and project, appended to, listed, purged, exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import scalar as S
from ..functions import text as X
from ..plans.work import stored
from .model import MEMORY_COLUMNS
from .relational import insert

_LIVE = ("active", "pending", "archived")


def render_entry(label: Column, text: Column) -> Column:
    body, mark = X.strip(text), X.strip(F.coalesce(label, F.lit("")))
    return F.when(mark == "", F.concat(F.lit("- "), body)).otherwise(F.concat(F.lit("- ["), mark, F.lit("] "), body))


def parse_entries(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), X.strip), lambda x: x != "")


def days(memories: DataFrame) -> DataFrame:
    rows = memories.where(F.col("scope") == "daily").where(F.col("status").isin(*_LIVE))
    return rows.withColumn("date", S.date_of(F.col("title"), F.col("created_at")))


def rendered_days(entries: DataFrame) -> DataFrame:
    """entries: day, project_key, ord, label, text. One body per day and key, in the order of ``ord``; entries without a day or text go."""
    lines = entries.withColumn("line", render_entry(F.col("label"), F.col("text"))).where(S.is_day_key(F.col("day")) & ~F.col("line").rlike(r"^- ?\z"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "line")))
    return lines.groupBy("day", "project_key").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("body"), F.count("*").alias("n_entries"))


def append(memories: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """The next snapshot: a day's row gets the new lines at its end (and is active again), or is made."""
    fresh = rendered_days(entries).withColumnRenamed("day", "__day").withColumnRenamed("project_key", "__key")
    found = days(memories).groupBy("date", "project_key").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))
    target = fresh.join(found, (F.col("__day") == F.col("date")) & F.col("__key").eqNullSafe(F.col("project_key")), "left")
    target = stored(target.select("__day", "__key", "body", "id"), "days")  # of known size: a few days meet the memories where they lie
    more = target.where("id IS NOT NULL").select("id", "body")
    joined = memories.join(more, "id", "left")
    hit = F.col("body").isNotNull()
    merged = F.array_join(F.concat(parse_entries(F.col("text")), F.array("body")), "\n\n")
    changed = {
        "text": F.when(hit, merged).otherwise(F.col("text")),
        "status": F.when(hit & (F.col("status") == "archived"), "active").otherwise(F.col("status")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    kept = joined.select(*[changed.get(c, F.col(c)).alias(c) for c in MEMORY_COLUMNS])
    made = target.where("id IS NULL").select(
        F.col("__day").alias("title"), F.col("body").alias("text"), F.lit("daily").alias("scope"), F.col("__key").alias("project_key"),
        F.array(F.lit("daily")).alias("tags"), F.lit("auto").alias("source"), F.lit(V.DAILY_IMPORTANCE).alias("importance"),
        F.concat(F.col("__day"), F.coalesce("__key", F.lit(""))).alias("ord"),
    )
    return insert(kept, made, now)


def read(memories: DataFrame, date: str, project_key: str | None = None) -> DataFrame:
    rows = days(memories).where((F.col("date") == date) & F.col("project_key").eqNullSafe(F.lit(project_key)))
    return rows.withColumn("entries", parse_entries(F.col("text"))).orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def list_days(memories: DataFrame, project_key: str | None = None, any_project: bool = False, limit: int = V.DAILY_LIMIT) -> DataFrame:
    """The newest ``limit`` rows, then by date: the limit comes first."""
    key = F.col("project_key").isNotNull() if any_project else F.col("project_key").eqNullSafe(F.lit(project_key))
    rows = days(memories).where(key).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return rows.withColumn("entries", parse_entries(F.col("text"))).orderBy(F.desc("date"), F.desc("created_at"), F.desc("id"))


def stale(memories: DataFrame, now: Column, days_kept: int = V.DAILY_RETENTION_DAYS, zone: str = "UTC") -> DataFrame:
    rows = days(memories).where(F.col("status") == "active")
    return rows.where(F.col("date") < S.retention_cutoff(now, days_kept, zone))


def purge(memories: DataFrame, now: Column, days_kept: int = V.DAILY_RETENTION_DAYS, zone: str = "UTC") -> DataFrame:
    """Archives days past the retention, of all projects."""
    date = S.date_of(F.col("title"), F.col("created_at"))
    old = (F.col("scope") == "daily") & (F.col("status") == "active") & (date < S.retention_cutoff(now, days_kept, zone))
    return memories.withColumn("updated_at", F.when(old, now).otherwise(F.col("updated_at"))).withColumn("status", F.when(old, "archived").otherwise(F.col("status")))


def to_markdown(logs: DataFrame, heading: str = "Daily log") -> str:
    """A bounded listing as Markdown."""
    out = [f"# {heading}", ""]
    for row in logs.select("date", "text").toLocalIterator():
        out += [f"## {row['date']}", "", row["text"], ""]
    return "\n".join(out).rstrip() + "\n"

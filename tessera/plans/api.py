"""The facade: the five tools and the panel's methods over a snapshot store.

Each call plans on the published version and publishes the next; reads give DataFrames.
"""

from __future__ import annotations

import hashlib
import os
import subprocess
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import scalar as S
from ..functions import text as X
from ..operators import assemble, daily, distill, importing, merge, relational, retrieval
from ..operators.model import Query, order
from ..sources import archives, files
from .store import Store, validate_panel
from .work import stored


class MemoryError_(Exception):
    """A refused call; ``code`` is one of invalid, not-found, forbidden, unavailable."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Session:
    """Who asks: a project key, or none where the place is not trusted."""

    project_key: str | None = None
    project_path: str | None = None
    sub_id: str | None = None


def key_for(namespace: str, path: str) -> str:
    return hashlib.sha1(f"{namespace}\0{path.lower()}".encode()).hexdigest()[:16]


_MARKS = (".git", "package.json", "pyproject.toml", "Cargo.toml", "go.mod")


def resolve_identity(cwd: str, markers: tuple[str, ...] = _MARKS) -> Session:
    """The repository's key (shared by its worktrees), else that of the nearest marked folder, else none."""
    def git(*args: str) -> str | None:
        try:
            done = subprocess.run(["git", "-C", cwd, "rev-parse", *args], capture_output=True, text=True, timeout=2, check=False)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return done.stdout.strip() or None if done.returncode == 0 else None

    top = git("--show-toplevel")
    if top:
        common = git("--path-format=absolute", "--git-common-dir") or top
        return Session(key_for("git", common), top, os.path.basename(top) if not common.startswith(top) else None)
    folder = os.path.abspath(cwd)
    while True:
        if any(os.path.exists(os.path.join(folder, m)) for m in markers):
            return Session(key_for("path", folder), folder)
        if os.path.dirname(folder) == folder:
            return Session()
        folder = os.path.dirname(folder)


class Memory:
    def __init__(self, store: Store, now: datetime | None = None):
        self.store, self.spark, self._now = store, store.spark, now

    def now(self) -> Column:
        at = self._now or datetime.now(timezone.utc).replace(tzinfo=None)
        return F.lit(at.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")

    def memories(self) -> DataFrame:
        return self.store.read()["memories"]

    # -- tools -----------------------------------------------------------------------------------

    def remember(self, session: Session, text: str, scope: str | None = None, title: str = "", tags: tuple[str, ...] = (), pinned: bool = False, importance: int | None = None, source: str = "dialogue") -> dict:
        """Classifies, gates and merges one statement: decision, reason and the id it ended in."""
        if scope == "project" and session.project_key is None:
            raise MemoryError_("invalid", "there is no project here")
        rows = self.spark.createDataFrame([(1, text)], "cand_id bigint, text string")
        rows = rows.withColumn("kind", distill.classify(F.col("text"))).withColumn("vouched", F.lit(True))
        judged = distill.judge(rows, session.project_key is not None).first()
        if not judged["accepted"]:
            return {"decision": "rejected", "reason": judged["reason"], "id": None}
        layer = scope or judged["scope"]
        layer = "global" if layer == "identity" else layer
        weight = judged["importance"] if importance is None else importance
        key = session.project_key if layer in ("project", "daily") else None
        cand = self.spark.createDataFrame(
            [(1, judged["kind"], title, text.strip(), layer, key, session.project_path, session.sub_id, list(tags), source, pinned, weight)],
            "cand_id bigint, kind string, title string, text string, scope string, project_key string, project_path string, sub_id string, tags array<string>, source string, pinned boolean, importance int",
        )
        before = self.memories()
        folded = stored(merge.sequential(cand, before), "folded")
        after, made = importing.apply_fold(before, _full(cand), folded, self.now())
        self.store.publish(memories=after)
        row, own = folded.first(), made.first()
        target = own["id"] if own else row["target"]
        return {"decision": row["decision"], "reason": None, "id": target}

    def forget(self, session: Session, memory_id: int) -> str:
        wanted = self.spark.createDataFrame([(memory_id,)], "id bigint")
        m = self.memories()
        outcome = wanted.join(m, "id", "left").select(relational.forget_outcome(session.project_key).alias("o")).first()["o"]
        if outcome == "archived":
            patch = wanted.withColumn("status", F.lit("archived"))
            self.store.publish(memories=relational.update(m, patch, self.now()))
        return outcome

    def search(self, session: Session, query: str = "", scopes: tuple[str, ...] = (), limit: int = 10) -> DataFrame:
        limit = min(max(limit, 1), 50)
        m = self.memories()
        if query.strip():
            return retrieval.search(m, query, scopes, session.project_key, limit, self._now)
        if scopes:
            rows = m.where(relational.list_scopes(scopes, session.project_key) & (F.col("status") == "active"))
            return rows.orderBy(*order("used")).limit(limit)
        return relational.visible(m, session.project_key, Query(status=("active",), order_by="used")).orderBy("side", "ord").limit(limit)

    def log(self, session: Session, entries: list[tuple[str | None, str]], date: str | None = None, zone: str = "UTC") -> int:
        """Appends (label, text) entries to a day."""
        rows = self.spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(entries)], "ord bigint, label string, text string")
        day = F.lit(date) if date else S.day_key(self.now(), zone)
        rows = rows.withColumn("day", day).withColumn("project_key", F.lit(session.project_key))
        return self.store.publish(memories=daily.append(self.memories(), rows, self.now()))

    def import_path(self, session: Session, path: str, scope: str | None = None, tags: tuple[str, ...] = (), dry_run: bool = False, limit: int = V.IMPORT_ITEMS) -> dict:
        """Detects, scans and folds in what lies at a path; the report's counters, with ``ok`` and ``source``."""
        kind, items = archives.scan(self.spark, path, files.Limits(max_items=min(limit, 2000)))
        if items is None:
            return {"ok": False, "source": None, "scanned": 0}
        tables = self.store.read()
        request = importing.Request(archives.PLATFORM.get(kind), scope or "global", session.project_key, session.project_path, tags, max_items=min(limit, 2000), dry_run=dry_run)
        after, ledger, report = importing.run(items, tables["memories"], tables["ledger"], self.now(), request)
        counters = report.first().asDict()
        if not dry_run:
            self.store.publish(memories=after, ledger=ledger)
        return {"ok": counters["scanned"] > 0, "source": kind, **counters}

    def recall(self, session: Session, query: str, limit: int = V.CARD_RECALL) -> DataFrame:
        return retrieval.recall(self.memories(), query[-V.STEP_QUERY_CHARS :], session.project_key, limit, self._now)

    def context(self, session: Session, query: str = "") -> str:
        cards = self.recall(session, query) if query.strip() else None
        row = assemble.turn_context(self.memories(), session.project_key, cards).first()
        return row["text"] if row else ""

    # -- panel -----------------------------------------------------------------------------------

    def overview(self) -> dict:
        out: dict = {}
        for row in relational.overview(self.memories()).collect():
            out.setdefault(row["kind"], {})[row["name"]] = row["n"]
        return out

    def list(self, filters: Query | None = None, limit: int = 30, offset: int = 0, order_by: str = "used") -> tuple[DataFrame, int]:
        checked = validate_panel({"limit": limit, "offset": offset})
        base = filters or Query()
        page = Query(**{**base.__dict__, "limit": checked["limit"], "offset": checked["offset"], "order_by": order_by})
        m = self.memories()
        return relational.panel_view(relational.list_memories(m, page)), relational.count(m, base).first()["n"]

    def get(self, memory_id: int) -> dict:
        row = relational.get_many(self.memories(), [memory_id]).first()
        if row is None:
            raise MemoryError_("not-found", f"no memory #{memory_id}")
        return row.asDict()

    def update(self, memory_id: int, **fields) -> dict:
        allowed = {"title", "text", "scope", "tags", "pinned", "importance", "status", "project_key", "project_path"}
        if unknown := set(fields) - allowed:
            raise MemoryError_("invalid", f"unknown fields {sorted(unknown)}")
        current = self.get(memory_id)
        if fields.get("status") is not None and fields["status"] not in V.STATUSES:
            raise MemoryError_("invalid", "unknown status")
        fields = {k: v for k, v in validate_panel(fields).items() if k in fields}
        if "text" in fields:
            fields["text"] = fields["text"].strip()
            if not 0 < len(fields["text"]) <= V.BODY_CAP:
                raise MemoryError_("invalid", "a memory needs text of at most 8000 characters")
        if fields.get("scope") == "project" and not (fields.get("project_key") or current["project_key"]):
            raise MemoryError_("invalid", "a project memory needs a project")
        m = self.memories()
        row = F.col("id") == memory_id
        columns = {k: F.when(row, F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<string>")).otherwise(F.col(k)) for k, v in fields.items()}
        if fields.get("scope") in ("global", "identity"):  # leaving a project also leaves its key
            columns["project_key"] = F.when(row, F.lit(None).cast("string")).otherwise(F.col("project_key"))
        columns["updated_at"] = F.when(row, self.now()).otherwise(F.col("updated_at"))
        self.store.publish(memories=m.withColumns(columns))
        return self.get(memory_id)

    def daily(self, session: Session, limit: int = V.DAILY_LIMIT) -> DataFrame:
        return daily.list_days(self.memories(), session.project_key, limit=limit)

    def purge_daily(self, days_kept: int = V.DAILY_RETENTION_DAYS, zone: str = "UTC") -> int:
        m = self.memories()
        n = daily.stale(m, self.now(), days_kept, zone).count()
        if n:
            self.store.publish(memories=daily.purge(m, self.now(), days_kept, zone))
        return n

    def export(self, scopes: tuple[str, ...] = V.SCOPES, include_archived: bool = False, project_key: str | None = None, heading: str = "# 记忆导出") -> str:
        from ..sources.export import export_markdown

        return export_markdown(self.memories(), scopes, include_archived, project_key, heading, self._now)


def _full(cand: DataFrame) -> DataFrame:
    return cand.withColumn("source_platform", F.lit(None).cast("string"))


def short(text: Column, limit: int = 120) -> Column:
    return X.clip(text, limit)

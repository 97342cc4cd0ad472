"""Schemas of the stored tables and of the one shape that every source emits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MEMORIES = (
    "id bigint, title string, text string, scope string, project_key string, project_path string, sub_id string, tags array<string>, source string, "
    "source_platform string, pinned boolean, importance int, last_used_at timestamp, created_at timestamp, updated_at timestamp, status string"
)
TAGS = "memory_id bigint, tag string, position int"
LEDGER = "hash string, memory_id bigint, imported_at timestamp"
ITEMS = "text string, uri string, item_id string, title string, tags array<string>, scope string, at string, kind string, ord bigint"
SCHEMA_VERSION = 1
MEMORY_COLUMNS = tuple(part.strip().split(" ")[0] for part in MEMORIES.replace("array<string>", "array").split(","))


@dataclass(frozen=True)
class Query:
    """Filters of a memory list; empty tuples and None mean no filter, ``project_key`` "" stands for the key-less layer."""

    scope: tuple[str, ...] = ()
    status: tuple[str, ...] = ()
    source: tuple[str, ...] = ()
    source_platform: tuple[str, ...] = ()
    project_key: str | None = None
    by_project: bool = False  # compare project_key null-safely
    any_project: bool = False  # any key at all; wins over project_key
    pinned: bool | None = None
    tag: str | None = None
    order_by: str = "created"
    limit: int | None = None
    offset: int = 0

    def condition(self) -> Column:
        """The conjunction of all filters but ``tag`` membership in a separate table."""
        out = F.lit(True)
        for column in ("scope", "status", "source", "source_platform"):
            if values := getattr(self, column):
                out = out & F.col(column).isin(*values)
        if self.any_project:
            out = out & F.col("project_key").isNotNull()
        elif self.by_project:
            out = out & F.col("project_key").eqNullSafe(F.lit(self.project_key))
        if self.pinned is not None:
            out = out & (F.col("pinned") == F.lit(self.pinned))
        if self.tag is not None:
            out = out & F.array_contains("tags", self.tag)
        return out


def order(name: str) -> list[Column]:
    used = F.coalesce("last_used_at", "created_at")
    return {
        "created": [F.desc("created_at"), F.desc("id")],
        "used": [used.desc(), F.desc("id")],
        "importance": [F.desc("importance"), F.desc("created_at"), F.desc("id")],
    }[name]

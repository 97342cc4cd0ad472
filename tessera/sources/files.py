"""Reading of files into rows, listings, and the dispatch to a reader by content."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as V


@dataclass(frozen=True)
class Limits:
    max_items: int = V.IMPORT_ITEMS
    max_files: int = V.IMPORT_FILES
    max_bytes: int = V.IMPORT_BYTES


def whole_files(spark: SparkSession, paths: str | list[str], limits: Limits | None = None, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """path, name, text (its first ``max_bytes``), truncated, modified, ord: newest first, then by path."""
    limits = limits or Limits()
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    rows = reader.load(paths)
    plain = F.regexp_replace("path", "^file:/+", "/")
    named = rows.select(
        plain.alias("path"), F.element_at(F.split(plain, "/"), -1).alias("name"), F.decode(F.substring("content", 1, limits.max_bytes), "UTF-8").alias("text"),
        (F.col("length") > limits.max_bytes).alias("truncated"), F.col("modificationTime").alias("modified"),
    )
    chosen = named.select("path", "modified").orderBy(F.desc("modified"), "path").limit(limits.max_files)
    from pyspark.sql import Window as W

    ranked = chosen.withColumn("ord", (F.row_number().over(W.orderBy(F.desc("modified"), "path")) - 1).cast("long"))  # at most max_files rows
    return named.join(F.broadcast(ranked.select("path", "ord")), "path")


def sniff_conversations(head: str) -> str | None:
    if re.search(r'"mapping"\s*:', head):
        return "chatgpt"
    return "claude-web" if re.search(r'"chat_messages"\s*:|"messages"\s*:\s*\[', head) else None


def looks_like_claude_memories(head: str) -> bool:
    return re.search(r'"(?:conversations_memory|project_memories|memory_files)"\s*:', head) is not None


def _head(path: str) -> str:
    with open(path, "rb") as f:
        return f.read(V.SNIFF_BYTES).decode("utf-8", "replace")


def _named(folder: str, suffix: str) -> list[str]:
    if not os.path.isdir(folder):
        return []
    found = [os.path.join(folder, n) for n in os.listdir(folder) if n.lower().endswith(suffix) and os.path.isfile(os.path.join(folder, n))]
    return sorted(found, key=lambda p: (-os.path.getmtime(p), p))


def list_files(folder: str, suffix: str) -> list[str]:
    """Newest first, then by path."""
    return _named(folder, suffix)


def _json_kind(head: str) -> str | None:
    return sniff_conversations(head) or ("claude-memories" if looks_like_claude_memories(head) else None)


def _folder_kind(path: str) -> str | None:
    entries = os.listdir(path)
    folders = {e for e in entries if os.path.isdir(os.path.join(path, e))}
    parts = [p.lower() for p in re.split(r"[\\/]+", path.rstrip("/\\")) if p]
    own, parent = ([*parts[::-1], "", ""])[:2]
    if folders & set(V.STORE_MARKERS) or own in V.STORE_MARKERS or (own == "memory" and parent in V.STORE_MARKERS) or "MEMORY.md" in entries:
        return "workbuddy"
    projects = os.path.join(path, "projects")
    nested = os.path.isdir(projects) and any(os.path.isdir(m := os.path.join(projects, p, "memory")) and os.listdir(m) for p in os.listdir(projects))
    if "memory" in folders or nested:
        return "zcode"
    if _named(path, ".jsonl") or any(_named(os.path.join(path, d), ".jsonl") for d in folders):
        return "claude-code"
    for file in _named(path, ".json"):
        if kind := _json_kind(_head(file)):
            return kind
    return "generic" if _named(path, ".md") else None


def detect(path: str) -> str | None:
    """The reader for a path, from its layout or the first bytes of its content; None if none fits.

    Looks at the driver's file system, as the path is what a user names.
    """
    path = os.path.expanduser(path)
    if os.path.isdir(path):
        return _folder_kind(path)
    if not os.path.isfile(path):
        return None
    name, head = os.path.basename(path).lower(), _head(path)
    if name.endswith(".zip"):
        return "zip"
    if name.endswith(".jsonl"):
        return "claude-code" if '"sessionId"' in head or '"isMeta"' in head else "generic"
    if re.search(r"(?:^|_)memory\.md\Z", name):
        return "workbuddy"
    if name.endswith((".md", ".markdown", ".txt")):
        return "generic"
    if name.endswith(".json"):
        return _json_kind(head) or ("generic" if '"memories"' in head or '"items"' in head or re.match(r"\s*\[", head) else None)
    return None

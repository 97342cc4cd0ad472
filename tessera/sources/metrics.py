"""What a reader left out: one row of counters for a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import json_exports as J

_JSON = ("chatgpt", "claude-web")


def _considered(kind: str, files: DataFrame) -> DataFrame:
    """One row for everything a reader looked at: turns, lines or files, and elements of a wrong shape."""
    if kind in _JSON:
        schema = J._CHATGPT if kind == "chatgpt" else J._CLAUDE
        turns = J.chatgpt_turns(files) if kind == "chatgpt" else J.claude_web_turns(files)
        shaped = F.coalesce(F.element_at(F.split(F.trim("element"), ""), 1) == "{", F.lit(False))
        wrong = J.elements(files).where(~shaped | F.from_json("element", schema).isNull())
        return turns.select("path").unionByName(wrong.select("path"))
    if kind == "claude-code":
        return J._lines(files).select("path")
    return files.select("path")


def scan_metrics(kind: str, files: DataFrame, items: DataFrame) -> DataFrame:
    """files, items, skipped, truncated. Readers that cut a file into several entries skip files only."""
    looked, made = _considered(kind, files).agg(F.count("*").alias("looked")), items.agg(F.count("*").alias("items"))
    cut = F.max("truncated") if "truncated" in files.columns else F.lit(False)
    opened = files.agg(F.count("*").alias("files"), F.coalesce(cut, F.lit(False)).alias("truncated"))
    row = opened.join(F.broadcast(made)).join(F.broadcast(looked))
    return row.select("files", "items", F.greatest(F.col("looked") - F.col("items"), F.lit(0)).alias("skipped"), "truncated")


def describe(report: dict) -> str:
    """A run's counters as a short text."""
    parts = [f"{report.get(n, 0)} {n}" for n in ("written", "merged", "updated", "ignored", "rejected", "logged", "known", "oversized") if report.get(n)]
    head = f"{report.get('considered', 0)} of {report.get('scanned', 0)} items considered"
    return f"{head}: {', '.join(parts) if parts else 'nothing to do'}" + (" (truncated)" if report.get("truncated") else "")

"""Markdown export of a memory table. Rows come to the driver, at most 5000 of a layer, as the document is one string."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..operators.model import order


def _entry(row) -> list[str]:
    meta = [
        f"状态 {row['status']}", f"重要度 {row['importance']}", "已固定" if row["pinned"] else "", f"项目 {row['project_key']}" if row["project_key"] is not None else "",
        f"标签 {', '.join(row['tags'])}" if row["tags"] else "", f"来源 {row['source']}" + (f"/{row['source_platform']}" if row["source_platform"] else ""), f"更新 {row['updated']}",
    ]
    return [f"### {row['title']}", "", "- " + " · ".join(m for m in meta if m), "", row["text"].strip(), "", "---", ""]


def export_markdown(memories: DataFrame, scopes: tuple[str, ...] = V.SCOPES, include_archived: bool = False, project_key: str | None = None, heading: str = "# 记忆导出", now: datetime | None = None) -> str:
    """A document with a section for each layer, in order; projects in the order in which they first appear."""
    body: list[str] = []
    total = 0
    for scope in scopes:
        rows = memories.where(F.col("scope") == scope)
        if not include_archived and scope != "identity":
            rows = rows.where(F.col("status").isin("active", "pending"))
        if scope == "project" and project_key is not None:
            rows = rows.where(F.col("project_key") == project_key)
        shown = rows.orderBy(*order("created" if scope == "daily" else "importance")).limit(V.EXPORT_LIMIT).withColumn("updated", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSS")).collect()
        total += len(shown)
        if not shown:
            continue
        body += [f"## {V.SCOPE_TITLES[scope]}", ""]
        groups: dict[str | None, list] = {}
        for row in shown:
            groups.setdefault(row["project_key"] if scope == "project" else None, []).append(row)
        for key, group in groups.items():
            if scope == "project":
                body += [f"### 项目 {key if key is not None else V.UNNAMED_PROJECT}", ""]
            for row in group:
                body += _entry(row)
    at = (now or datetime.now()).strftime("%Y-%m-%d %H:%M")
    head = [heading, "", f"- 导出时间：{at}", f"- 条目：{total}", f"- 层级：{' / '.join(scopes)}", f"- 状态：{'全部' if include_archived else 'active / pending'}", ""]
    return "\n".join(head + body).rstrip() + "\n"

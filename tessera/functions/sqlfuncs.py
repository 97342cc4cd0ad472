"""The scalar functions under SQL names, for ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import fixed as V


def register(spark: SparkSession) -> tuple[str, ...]:
    """Creates temporary functions, which Catalyst inlines: mem_collapse, mem_item_hash, mem_recency, mem_relevance, mem_is_day, mem_bigrams, mem_jaccard, mem_score."""
    bodies = {
        "mem_collapse": ("t STRING", "STRING", r"regexp_replace(regexp_replace(t, '(?U)\\s+', ' '), '^ | $', '')"),
        "mem_item_hash": ("platform STRING, item_id STRING, t STRING", "STRING", "substring(sha2(concat(coalesce(platform, 'file'), char(0), coalesce(nullif(item_id, ''), mem_collapse(t))), 256), 1, 32)"),
        "mem_recency": ("at TIMESTAMP, now TIMESTAMP", "DOUBLE", f"coalesce(CASE WHEN at IS NOT NULL THEN pow(2D, -greatest((unix_micros(now) - unix_micros(at)) / 86400e6, 0D) / {V.HALF_LIFE_DAYS}) END, 0D)"),
        "mem_relevance": ("r DOUBLE", "DOUBLE", "CASE WHEN r IS NULL OR isnan(r) THEN 0D ELSE 1 / (1 + exp(r)) END"),
        "mem_is_day": ("t STRING", "BOOLEAN", r"coalesce(t RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}\\z', false)"),
        "mem_bigrams": ("n STRING", "ARRAY<STRING>", "CASE WHEN length(n) = 0 THEN array() WHEN length(n) = 1 THEN array(n) ELSE array_distinct(transform(sequence(1, length(n) - 1), i -> substring(n, i, 2))) END"),
        "mem_jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(a) + size(b) = 0 THEN 1D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END"),
        "mem_score": ("relevance DOUBLE, recency DOUBLE, importance INT", "DOUBLE", f"{V.WEIGHTS[0]} * relevance + {V.WEIGHTS[1]} * recency + {V.WEIGHTS[2]} * least(1D, greatest(0, importance) / 10)"),
    }
    for name, (args, kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return tuple(bodies)

"""Dates, scores and small arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V

DAY_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def is_day_key(value: Column) -> Column:
    return F.coalesce(value.rlike(DAY_PATTERN), F.lit(False))


def day_key(at: Column, zone: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd")


def date_of(title: Column, created_at: Column) -> Column:
    return F.when(is_day_key(title), title).otherwise(F.coalesce(F.date_format(created_at, "yyyy-MM-dd"), F.lit("unknown")))


def retention_cutoff(now: Column, days: int = V.DAILY_RETENTION_DAYS, zone: str = "UTC") -> Column:
    return day_key(now - F.make_dt_interval(days=F.lit(days)), zone)


def recency(at: Column, now: Column) -> Column:
    """Halves every half-life; 0 without a time, 1 in the future."""
    age = (F.unix_micros(now) - F.unix_micros(at)) / F.lit(86400e6)
    return F.when(at.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(2.0), -F.greatest(age, F.lit(0.0)) / V.HALF_LIFE_DAYS))


def iso_of_seconds(seconds: Column) -> Column:
    """ISO time of plausible epoch seconds, else null."""
    stamp = F.date_format(F.timestamp_millis((seconds * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when((seconds > 0) & (seconds < 1e11), stamp)


def relevance_of_rank(rank: Column) -> Column:
    finite = rank.isNotNull() & ~F.isnan(rank) & (F.abs(rank) != float("inf"))
    return F.when(finite, 1 / (1 + F.exp(rank))).otherwise(F.lit(0.0))


def importance_part(importance: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0), importance) / 10)


def boosted(relevance: Column) -> Column:
    return F.least(F.lit(1.0), relevance * V.AGREEMENT_BOOST)


def final_score(relevance: Column, recent: Column, importance: Column, weights: tuple[float, float, float] = V.WEIGHTS) -> Column:
    return weights[0] * relevance + weights[1] * recent + weights[2] * importance_part(importance)


def clamp(value: Column, low: int, high: int) -> Column:
    """Bounded in the value's own type, then made an int: a value past an int's range is clamped like any other."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)).cast("int"))


def used_at(last_used: Column, created: Column) -> Column:
    return F.coalesce(last_used, created)

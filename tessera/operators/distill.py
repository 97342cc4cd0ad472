"""Rule-based extraction: clauses, cues, the gate, scope and importance, all as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import patterns as P
from ..functions import text as X


def _cue(clause: Column, cue: P.CuePattern) -> Column:
    """struct (kind, text, marker) of one pattern, null where it does not match or leaves no body."""
    pattern = P.java(cue.pattern, cue.fold_case)
    whole = F.regexp_extract(clause, pattern, 0)
    if cue.group == 0:
        body, marker = X.clean(whole), X.strip(whole)
    else:
        tail = F.regexp_extract(clause, pattern, cue.group)
        body, marker = X.clean(tail), X.clean(F.substring(whole, F.lit(1), F.length(whole) - F.length(tail)))
    made = F.struct(F.lit(cue.kind).alias("kind"), body.alias("text"), marker.alias("marker"))
    return F.when(X.matches(clause, (cue.pattern, cue.fold_case)), F.when(body != "", made))


def extract_candidates(messages: DataFrame, message: str = "message", by: tuple[str, ...] = ("msg_id",), limit: int = V.MESSAGE_CANDIDATES) -> DataFrame:
    """Candidates of each message: ``by``, pos, text, kind, marker, explicit, vouched.

    Attachments and fenced code are cut, pasted lists give nothing; of each clause the first cue
    counts; a correction's lead-in takes the next clause; equal texts count once, the first
    ``limit`` stay.
    """
    body = X.strip_fenced(X.strip_attachment(F.col(message)))
    rows = messages.select(*by, body.alias("__body")).where(~X.looks_like_paste(F.col("__body"))).withColumn("__clauses", X.split_sentences(F.col("__body")))
    clauses = rows.select(*by, "__clauses", F.posexplode("__clauses").alias("pos", "__clause"))
    clauses = clauses.select(*by, "pos", "__clause", F.get("__clauses", F.col("pos") + 1).alias("__next"))
    # evaluated once a clause: the explode keeps later references from repeating the patterns
    found = F.transform(F.array("__clause"), lambda x: F.coalesce(*[_cue(x, cue) for cue in P.CUES]))
    cued = clauses.select(*by, "pos", "__clause", "__next", F.explode(found).alias("c")).where("c IS NOT NULL")
    lead = (F.col("c.kind") == "correction") & F.col("c.text").rlike(P.java(V.CORRECTION_LEAD_IN)) & F.col("__next").isNotNull()
    text = X.strip(F.when(lead, F.concat(F.col("c.text"), F.lit("："), F.col("__next"))).otherwise(F.col("c.text")))
    explicit = X.matches(text, *P.EXPLICIT) | X.matches(F.col("__clause"), *P.EXPLICIT)
    made = cued.select(*by, "pos", text.alias("text"), F.col("c.kind").alias("kind"), F.col("c.marker").alias("marker"), explicit.alias("explicit"), F.lit(False).alias("vouched"))
    return _first_of_equal(made.where("text <> ''"), list(by), ["pos"], limit)


def _first_of_equal(rows: DataFrame, group: list[str], order: list[str], limit: int) -> DataFrame:
    first = F.row_number().over(W.partitionBy(*group, F.lower("text")).orderBy(*order))
    kept = rows.withColumn("__first", first).where("__first = 1")
    return kept.withColumn("__rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("__rank") <= limit).drop("__first", "__rank")


def extract_from_messages(messages: DataFrame, batch: str, order: str, message: str = "message", limit: int = V.BATCH_CANDIDATES) -> DataFrame:
    """Candidates of the messages of each ``batch`` in ``order``; equal texts count once in a batch."""
    made = extract_candidates(messages, message, (batch, order), limit)
    return _first_of_equal(made, [batch], [order, "pos"], limit)


def classify(text: Column) -> Column:
    """The kind of a text taken whole: that of the first cue found anywhere, else a fact."""
    trimmed = X.strip(text)
    first = lambda cues: F.coalesce(*[F.when(X.matches(trimmed, (c.pattern, c.fold_case)), F.lit(c.kind)) for c in cues], F.lit("fact"))
    # every Chinese pattern holds a Han character, so texts without one need the others only
    return F.when(trimmed.rlike(r"\p{IsHan}"), first(P.CUES)).otherwise(first([c for c in P.CUES if c.fold_case]))


def reject_reason(text: Column, has_project: Column, vouched: Column) -> Column:
    """Why the gate refuses a text, null if it does not; the first reason in order."""
    body = X.strip(text)
    mined = ~vouched
    return (
        F.when(body == "", "empty")
        .when(X.matches(body, *P.SESSION_RECALL), "session-recall")
        .when(X.matches(body, *P.VAGUE), "vague")
        .when(mined & (F.length(body) < V.MIN_CHARS), "too-short")
        .when(mined & (F.length(body) > V.MAX_CHARS), "too-long")
        .when(mined & X.matches(body, *P.QUESTIONS), "question")
        .when(mined & X.matches(body, *P.HEDGES), "hedged")
        .when(has_project & X.matches(body, *P.SESSION_SCOPED), "session-scoped")
    )


def _lookup(kind: Column, table: dict) -> Column:
    return reduce(lambda acc, kv: acc.when(kind == kv[0], F.lit(kv[1])), list(table.items())[1:], F.when(kind == next(iter(table)), F.lit(next(iter(table.values())))))


def base_scope(kind: Column) -> Column:
    return _lookup(kind, V.BASE_SCOPE)


def decide_scope(kind: Column, text: Column, has_project: Column) -> Column:
    return (
        F.when((kind == "identity") | X.matches(text, (V.IDENTITY_MARKERS, True)), "identity")
        .when(~has_project, "global")
        .when(X.matches(text, (V.GLOBAL_MARKERS, True)), "global")
        .when(X.matches(text, (V.PROJECT_MARKERS, True)), "project")
        .when(X.matches(text, (V.TECHNOLOGY_MARKERS, True)), "project")
        .otherwise(base_scope(kind))
    )


def importance(kind: Column, text: Column) -> Column:
    one = lambda c: F.when(c, 1).otherwise(0)
    bonus = (
        one(X.matches(text, (V.IMPORTANCE_EXPLICIT, True)))
        + one((kind == "prohibition") & X.matches(text, (V.IMPORTANCE_REPLACEMENT, True)))
        + one(X.matches(text, (V.IMPORTANCE_RULE, True)))
        + one(X.matches(text, (V.IMPORTANCE_REASON, True)))
        + one(X.matches(text, (V.IMPORTANCE_ACTIONABLE, False)))
    )
    return F.least(F.lit(10), F.greatest(F.lit(0), _lookup(kind, V.BASE_IMPORTANCE) + bonus)).cast("int")


def judge(candidates: DataFrame, has_project: Column | bool) -> DataFrame:
    """Adds accepted, reason, importance (0 if refused) and scope (the kind's own if refused)."""
    has = F.lit(has_project) if isinstance(has_project, bool) else has_project
    rows = F.array(F.struct(F.col("kind").alias("kind"), F.col("text").alias("text"), F.col("vouched").alias("vouched"), has.alias("has")))
    gated = F.transform(rows, lambda r: F.struct(r["kind"].alias("kind"), r["text"].alias("text"), r["has"].alias("has"), reject_reason(r["text"], r["has"], r["vouched"]).alias("reason")))

    def verdict(r: Column) -> Column:
        accepted = r["reason"].isNull()
        return F.struct(
            r["reason"].alias("reason"), accepted.alias("accepted"), F.when(accepted, importance(r["kind"], X.strip(r["text"]))).otherwise(0).alias("importance"),
            F.when(accepted, decide_scope(r["kind"], r["text"], r["has"])).otherwise(base_scope(r["kind"])).alias("scope"),
        )

    return candidates.select("*", F.explode(F.transform(gated, verdict)).alias("__v")).select("*", "__v.*").drop("__v")


def report(outcomes: DataFrame) -> DataFrame:
    """One row: how many outcomes of each decision."""
    names = {"written": "new", "merged": "merge", "updated": "update", "ignored": "ignore", "rejected": "rejected"}
    return outcomes.agg(*[F.count_if(F.col("decision") == d).alias(n) for n, d in names.items()])


def describe_report(counts: DataFrame) -> DataFrame:
    parts = [F.concat(F.col(n).cast("string"), F.lit(f" {n}")) for n in ("written", "merged", "updated", "ignored", "rejected")]
    return counts.select(F.concat_ws(", ", *parts).alias("summary"))

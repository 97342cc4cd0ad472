"""Rendering of memories as text blocks, and their fitting into a character budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as X
from .relational import visible


def scope_label(scope: Column) -> Column:
    return F.coalesce(*[F.when(scope == k, F.lit(v)) for k, v in V.SCOPE_LABEL.items()])


def index_line() -> Column:
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(" #"), F.array_join(F.slice("tags", 1, 3), " #"))).otherwise("")
    pin = F.when(F.col("pinned"), "★").otherwise("")
    return F.concat(F.lit("- "), pin, F.lit("["), scope_label(F.col("scope")), F.lit("] "), X.title_of(F.col("title"), F.col("text")), tags, F.lit(" · #"), F.col("id").cast("string"))


def card_entry(limit: int | None = None) -> Column:
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(" ("), F.array_join(F.slice("tags", 1, 4), ", "), F.lit(")"))).otherwise("")
    body = X.strip(F.col("text"))
    body = X.clamp_chars(body, limit) if limit else body
    return F.concat(F.lit("### ["), scope_label(F.col("scope")), F.lit("] "), X.title_of(F.col("title"), F.col("text")), tags, F.lit(" — #"), F.col("id").cast("string"), F.lit("\n"), body)


def constraint_line() -> Column:
    return F.concat(F.lit(V.CONSTRAINT_PREFIX), X.strip(F.col("text")))


def _header(template: str, n: Column) -> Column:
    head, tail = template.split("%d")
    return F.concat(F.lit(head), n.cast("string"), F.lit(tail))


def rendered(rows: DataFrame, line: Column, header: str, order: str, gap: str = "\n", by: Sequence[str] = ()) -> DataFrame:
    """One text per group: a header with the number of entries, then the lines by ``order``; '' of none. For bounded listings."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    body = F.array_join(F.transform(ordered, lambda x: x["l"]), gap)
    text = F.when(F.count("*") == 0, F.lit("")).otherwise(F.concat(_header(header, F.count("*")), F.lit(gap), body))
    return rows.groupBy(*by).agg(text.alias("text"), F.count("*").alias("n"))


def render_index(rows: DataFrame, order: str, by: Sequence[str] = ()) -> DataFrame:
    return rendered(rows, index_line(), V.INDEX_HEADER, order, by=by)


def render_cards(rows: DataFrame, order: str, by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    return rendered(rows, card_entry(limit), V.CARD_HEADER, order, "\n\n", by)


def render_constraints(rows: DataFrame, order: str, by: Sequence[str] = ()) -> DataFrame:
    return rendered(rows, constraint_line(), V.CONSTRAINT_HEADER, order, by=by)


def fit_index(rows: DataFrame, order: str, budget: int = V.INDEX_BUDGET, by: Sequence[str] = ()) -> DataFrame:
    """The index, or as many of its first lines as the budget takes with the header of the whole; the count is of the kept lines.

    A prefix sum over the lines: their order is total, and cutting at the first line that does not fit
    is the same as keeping all whose running length fits.
    """
    keys = list(by)
    lined = rows.withColumn("__line", index_line())
    running = F.sum(F.length("__line") + 1).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    total = F.count("*").over(W.partitionBy(*keys))
    head = F.length(_header(V.INDEX_HEADER, total))
    kept = lined.withColumn("__used", running + head).where(F.col("__used") <= budget)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__line").alias("l"), F.col("id").alias("i"))))
    text = F.concat(_header(V.INDEX_HEADER, F.count("*")), F.lit("\n"), F.array_join(F.transform(ordered, lambda x: x["l"]), "\n"))
    return kept.groupBy(*keys).agg(F.when(F.count("*") == 0, F.lit("")).otherwise(text).alias("text"), F.transform(ordered, lambda x: x["i"]).alias("ids"), F.count("*").alias("n"))


_OUTCOME = "array<struct<name: string, kept_chars: int, kept_text: string, dropped: boolean, truncated: boolean>>"


def apply_budget(sections: Column, budget: Column | int) -> Column:
    """Folds an array of struct(name, text, partial) into struct(remaining, outcomes).

    In order, a section is kept whole if it fits with its separator; else, if it is partial, cut to fit
    where that leaves more than a line; else dropped, and a later one may still fit.
    """
    budget = F.lit(budget) if isinstance(budget, int) else budget
    start = F.struct(budget.cast("int").alias("remaining"), F.lit(0).alias("kept"), F.array().cast(_OUTCOME).alias("outcomes"))

    def step(acc: Column, s: Column) -> Column:
        text = X.strip(s["text"])
        gap = F.when(acc["kept"] > 0, 2).otherwise(0)
        size = F.length(text)
        room = acc["remaining"] - gap
        cut = X.clamp_chars(text, room)
        empty, whole = text == "", (text != "") & (size <= room)
        partly = ~empty & ~whole & s["partial"] & (room > 0) & (cut != "") & cut.contains("\n")
        kept = F.when(whole, text).when(partly, cut).otherwise(F.lit(""))
        some = whole | partly
        outcome = F.struct(
            s["name"].alias("name"), F.length(kept).alias("kept_chars"), kept.alias("kept_text"), (~empty & ~some).alias("dropped"), partly.alias("truncated"),
        )
        return F.struct(
            F.when(some, room - F.length(kept)).otherwise(acc["remaining"]).cast("int").alias("remaining"),
            (acc["kept"] + F.when(some, 1).otherwise(0)).cast("int").alias("kept"),
            F.concat(acc["outcomes"], F.array(outcome)).cast(_OUTCOME).alias("outcomes"),
        )

    return F.aggregate(sections, start, step)


def budget_text(folded: Column) -> Column:
    return F.array_join(F.transform(F.filter(folded["outcomes"], lambda o: o["kept_chars"] > 0), lambda o: o["kept_text"]), "\n\n")


def describe_budget(folded: Column) -> Column:
    shown = F.transform(
        F.filter(folded["outcomes"], lambda o: (o["kept_chars"] > 0) | o["dropped"]),
        lambda o: F.when(o["dropped"], F.concat(o["name"], F.lit(": dropped"))).otherwise(
            F.concat(o["name"], F.lit(": "), o["kept_chars"].cast("string"), F.when(o["truncated"], " chars (truncated)").otherwise(" chars"))
        ),
    )
    return F.when(F.size(shown) == 0, "nothing injected").otherwise(F.array_join(shown, ", "))


def join_within_budget(sections: Column, budget: int) -> Column:
    """Sections in order, each clamped to what is left."""
    def step(acc: Column, s: Column) -> Column:
        text = X.strip(s)
        kept = F.when((text == "") | (acc["left"] <= 0), F.lit("")).otherwise(X.clamp_chars(text, acc["left"]))
        return F.struct((acc["left"] - F.length(kept)).alias("left"), F.when(kept == "", acc["parts"]).otherwise(F.concat(acc["parts"], F.array(kept))).alias("parts"))

    folded = F.aggregate(sections, F.struct(F.lit(budget).alias("left"), F.array().cast("array<string>").alias("parts")), step)
    return X.clamp_chars(X.join_sections(folded["parts"]), budget)


def ids_in_index(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^-\s.*·\s#([0-9]+)\s*$"), F.lit(1)), lambda x: x.cast("bigint"))


def ids_in_cards(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^###\s.*—\s#([0-9]+)\s*$"), F.lit(1)), lambda x: x.cast("bigint"))


def undelivered(cards: DataFrame, delivered: DataFrame) -> DataFrame:
    """Cards that the session has not been given."""
    return cards.join(delivered.select("session", "id"), ["session", "id"], "left_anti")


def deliver(delivered: DataFrame, given: DataFrame, cap: int = V.DELIVERED_CAP) -> DataFrame:
    """Adds given ids to each session's ledger, which stops growing at the cap. Both: session, id, ord."""
    first = delivered.unionByName(given).groupBy("session", "id").agg(F.min("ord").alias("ord"))
    return first.withColumn("__r", F.row_number().over(W.partitionBy("session").orderBy("ord", "id"))).where(F.col("__r") <= cap).drop("__r")


def turn_context(memories: DataFrame, project_key: str | None, cards: DataFrame | None = None, turn_budget: int = V.TURN_BUDGET, index_budget: int = V.INDEX_BUDGET, card_chars: int = V.BODY_CAP) -> DataFrame:
    """One row: text, outcomes and the ids whose bodies it holds: constraints, then the index of the rest, then cards."""
    from .model import Query

    place = F.col("side") * 1_000_000 + F.col("ord")
    pinned = visible(memories, project_key, Query(status=("active",), pinned=True, order_by="importance")).withColumn("__o", place)
    constraints = render_constraints(pinned, "__o").select(F.col("text").alias("constraints"))
    rows = visible(memories, project_key, Query(status=("active",), order_by="created")).withColumn("__o", place)
    index = fit_index(rows.join(pinned.select("id"), "id", "left_anti"), "__o", index_budget).select(F.col("text").alias("index"))
    card_text = render_cards(cards.withColumn("__o", F.col("pos")), "__o", limit=card_chars).select(F.col("text").alias("cards")) if cards is not None else None
    joined = constraints.join(F.broadcast(index))
    joined = joined.join(F.broadcast(card_text)) if card_text is not None else joined.withColumn("cards", F.lit(""))
    section = lambda name, partial: F.struct(F.lit(name).alias("name"), F.col(name).alias("text"), F.lit(partial).alias("partial"))
    folded = joined.withColumn("f", apply_budget(F.array(section("constraints", False), section("index", False), section("cards", True)), turn_budget))
    text = budget_text(F.col("f"))
    return folded.select(text.alias("text"), F.length(text).alias("used_chars"), F.col("f.outcomes").alias("outcomes"), describe_budget(F.col("f")).alias("summary"), F.array_distinct(F.concat(ids_in_cards(text), ids_in_index(text))).alias("ids"))

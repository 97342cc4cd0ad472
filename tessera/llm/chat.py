"""Chat formatting by a finite-state machine over roles, in DataFrame functions only.

A template names the marks around a turn, the escape character and which roles carry loss. Each
turn becomes a head segment, a body segment and a tail segment; the machine walks the roles in
turn order and says whether the order is allowed. Control strings inside texts are escaped, so
the formatted string can be parsed back to the exact turns.

Defined results: null roles and texts count as empty; turns that share a number are ordered by
role, then text; a null turn number comes first; repeated rows stay repeated turns; extra columns
are ignored. A conversation in a forbidden order is still formatted, with ``valid`` false.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn. ``head`` and ``tail`` must not contain ``escape``."""

    head: str = "### "
    after_role: str = ": "
    tail: str = " </turn>\n"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Role to the roles that may follow; "" is the start.
    follows: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("", ("system", "user")),
        ("system", ("user",)),
        ("user", ("assistant",)),
        ("assistant", ("user",)),
    )


DEFAULT = Template()


#: Letters that stand for the escape itself, and for the control characters, after an escape.
_CODES = "bhlc"


def _control(template: Template) -> tuple[str, ...]:
    """The escape, and the first visible character of each mark; escaped text holds none of the latter."""
    return tuple(dict.fromkeys([template.escape, template.head.strip()[0], template.tail.strip()[0], template.after_role.strip()[0]]))


def escaped(text: Column, template: Template = DEFAULT) -> Column:
    """Each control character becomes the escape and a letter, so no mark can occur in the result."""
    for code, mark in zip(_CODES, _control(template), strict=False):
        text = F.replace(text, F.lit(mark), F.lit(template.escape + code))
    return text


def unescaped(text: Column, template: Template = DEFAULT) -> Column:
    """The inverse of ``escaped``; the escape's own code goes last."""
    for code, mark in reversed(list(zip(_CODES, _control(template), strict=False))):
        text = F.replace(text, F.lit(template.escape + code), F.lit(mark))
    return text


def valid_order(roles: Column, template: Template = DEFAULT) -> Column:
    """Runs the machine: the state is the last role, or ``!`` after a forbidden step."""
    def step(state: Column, role: Column) -> Column:
        allowed = F.lit(False)
        for before, after in template.follows:
            allowed = allowed | ((state == before) & role.isin(*after))
        return F.when(allowed, role).otherwise(F.lit("!"))

    return F.aggregate(roles, F.lit(""), step, lambda state: state != "!")


def format_chats(turns: DataFrame, template: Template = DEFAULT, key: str = "conv_id") -> DataFrame:
    """One row per conversation: key, valid, segments (array of text, loss), the formatted string and its loss mask.

    ``loss_mask`` lists the character ranges (start from 1, length) of ``formatted`` that carry loss. As a
    conversation is one row, its turns meet in one task.
    """
    t = template
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select(F.col(key), F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    chats = rows.groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segments(x: Column) -> Column:
        loss = x["role"].isin(*t.loss_roles)
        return F.array(
            F.struct(F.concat(F.lit(t.head), escaped(x["role"], t), F.lit(t.after_role)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(x["text"], t).alias("text"), loss.alias("loss")),
            F.struct(F.lit(t.tail).alias("text"), F.lit(False).alias("loss")),
        )

    out = chats.select(key, valid_order(F.transform("turns", lambda x: x["role"]), t).alias("valid"), F.flatten(F.transform("turns", segments)).alias("segments"))
    out = out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    ends = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, length: INT>>)").alias("spans"))

    def extend(state: Column, s: Column) -> Column:
        n = F.length(s["text"])
        span = F.array(F.struct((state["at"] + 1).alias("start"), n.alias("length")))
        return F.struct((state["at"] + n).alias("at"), F.when(s["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return out.withColumn("loss_mask", F.aggregate("segments", ends, extend, lambda state: state["spans"]))


def read_back(chats: DataFrame, template: Template = DEFAULT, key: str = "conv_id") -> DataFrame:
    """Parses ``formatted`` and its loss mask back: key, valid, turns (array of role, text), loss_text.

    Escaped text holds no mark, so the literal tail ends a turn and the first end-of-role mark ends its role.
    """
    t = template
    pieces = F.split("formatted", "\\Q" + t.tail + "\\E", -1)

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(t.head) + 1), F.length(piece))
        role = F.substring_index(inner, t.after_role, 1)
        text = F.substring(inner, F.length(role) + len(t.after_role) + 1, F.length(inner))
        return F.struct(unescaped(role, t).alias("role"), unescaped(text, t).alias("text"))

    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)
    loss = F.array_join(F.transform("loss_mask", lambda m: unescaped(F.substring(F.col("formatted"), m["start"], m["length"]), t)), "")
    return chats.select(key, "valid", "formatted", turns.alias("turns"), loss.alias("loss_text"))

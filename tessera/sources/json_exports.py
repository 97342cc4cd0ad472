"""Conversation exports and transcripts in JSON, read with Spark's JSON functions.

Readers take rows of (path, ord, text) and give items; what a reader leaves out is counted by its
``skipped`` companion. Elements of a wrong shape are skipped, never raised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import scalar as S
from ..functions import text as X

_CHATGPT = (
    "conversation_id string, id string, title string, create_time string, mapping map<string, struct<message: struct<id: string, author: struct<role: string>, "
    "create_time: string, content: struct<parts: array<variant>>>>>"
)
_MESSAGE = "array<struct<uuid: string, id: string, sender: string, role: string, created_at: string, text: string, content: array<struct<text: string>>, attachments: array<struct<extracted_content: string>>>>"
_CLAUDE = f"uuid string, id string, name string, created_at string, chat_messages {_MESSAGE}, messages {_MESSAGE}"
_TURN = "type string, sessionId string, cwd string, timestamp string, isMeta boolean, message struct<role: string, content: variant>"
_GENERIC = ", ".join(f"{k} string" for k in dict.fromkeys((*V.TEXT_KEYS, *V.TITLE_KEYS, "id", "scope", "at", "createdAt"))) + ", tags array<variant>"


def elements(files: DataFrame) -> DataFrame:
    """path, ord, n, element (JSON text): the members of a file's array, or of the array under its first wrapper key, or the one object."""
    wrapped = [F.get_json_object("text", f"$.{k}") for k in (*V.WRAPPER_KEYS, "conversations")]
    is_array = lambda c: c.rlike(r"(?U)^\s*\[")
    listed = F.when(is_array(F.col("text")), F.col("text")).otherwise(F.coalesce(*[F.when(is_array(w), w) for w in wrapped], F.concat(F.lit("["), F.col("text"), F.lit("]"))))
    rows = files.withColumn("__all", F.from_json(listed, "array<string>"))
    return rows.select("path", "ord", F.posexplode("__all").alias("n", "element"))


def _ordered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``ord`` from the order of file, element and turn: packed into one long, so no global sort is needed."""
    ranked = rows.withColumn("__turn", F.row_number().over(W.partitionBy("path", "n").orderBy(*order)) - 1)
    return ranked.withColumn("ord", F.col("ord") * (1 << 40) + F.col("n") * (1 << 20) + F.col("__turn"))


def _items(rows: DataFrame, **columns: Column) -> DataFrame:
    empty = {"item_id": "string", "title": "string", "tags": "array<string>", "scope": "string", "at": "string"}
    return rows.select(*[(columns[c] if c in columns else F.lit(None).cast(empty[c])).alias(c) for c in ("text", "uri", "item_id", "title", "tags", "scope", "at", "kind")], "ord")


def _seconds(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when((number > 0) & (number < 1e11), number).otherwise(F.lit(-1.0))


def _given(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def chatgpt_turns(files: DataFrame) -> DataFrame:
    """Every user and assistant turn with text, in time order within its conversation."""
    rows = elements(files).withColumn("c", F.from_json("element", _CHATGPT)).where("c IS NOT NULL")
    title = X.strip(F.coalesce("c.title", F.lit("")))
    conv = F.coalesce(_given(F.col("c.conversation_id")), _given(F.col("c.id")), X.short_id(F.concat(title, F.lit("|"), F.coalesce("c.create_time", F.lit(""))), 16))
    nodes = rows.select("path", "ord", "n", title.alias("conv_title"), conv.alias("conv_id"), _seconds(F.col("c.create_time")).alias("conv_s"), F.posexplode(F.map_entries("c.mapping")).alias("node", "e"))
    m = F.col("e.value.message")
    strings = F.filter(F.coalesce(m["content"]["parts"], F.array().cast("array<variant>")), lambda p: F.schema_of_variant(p) == "STRING")
    parts = F.filter(F.transform(strings, lambda p: F.variant_get(p, "$", "string")), lambda p: X.strip(p) != "")
    turns = nodes.withColumn("text", X.strip(F.array_join(parts, "\n"))).withColumn("role", m["author"]["role"]).where("text <> '' AND role IN ('user', 'assistant')")
    own = _seconds(m["create_time"])
    turns = turns.withColumn("sort", F.when(own > 0, own).otherwise(F.col("conv_s"))).withColumn("turn_id", F.coalesce(_given(m["id"]), X.short_id(F.col("text"), 16)))
    return turns.drop("e")


def chatgpt(files: DataFrame) -> DataFrame:
    turns = _ordered(chatgpt_turns(files), "sort", "node").where("role = 'user'")
    label = F.when(F.col("conv_title") == "", F.col("conv_id")).otherwise(F.col("conv_title"))
    return _items(
        turns, text=F.col("text"), uri=F.concat("path", F.lit("#"), label), item_id=X.short_id(F.concat_ws("|", F.lit("chatgpt"), "conv_id", "turn_id"), 24),
        tags=F.array(F.lit("chatgpt")), at=S.iso_of_seconds(F.col("sort")), kind=F.lit("utterance"),
    )


def claude_web_turns(files: DataFrame) -> DataFrame:
    rows = elements(files).withColumn("c", F.from_json("element", _CLAUDE)).where("c IS NOT NULL")
    name = X.strip(F.coalesce("c.name", F.lit("")))
    conv = F.coalesce(_given(F.col("c.uuid")), _given(F.col("c.id")), X.short_id(F.concat(name, F.lit("|"), F.coalesce("c.created_at", F.lit(""))), 16))
    told = rows.select("path", "ord", "n", name.alias("name"), conv.alias("conv_id"), F.col("c.created_at").alias("conv_at"), F.posexplode(F.coalesce("c.chat_messages", "c.messages")).alias("node", "m"))
    blocks = F.filter(F.transform(F.coalesce("m.content", F.array().cast("array<struct<text:string>>")), lambda b: b["text"]), lambda t: t.isNotNull())
    said = F.coalesce(_given(X.strip(F.coalesce("m.text", F.lit("")))), X.strip(F.array_join(blocks, "\n")))
    held = F.filter(F.transform(F.coalesce("m.attachments", F.array().cast("array<struct<extracted_content:string>>")), lambda a: X.strip(a["extracted_content"])), lambda t: t.isNotNull() & (t != ""))
    blob = F.array_join(held, "\n\n")
    text = F.when(F.size(held) == 0, said).when(said == "", blob).otherwise(F.concat(said, F.lit("\n\n" + V.ATTACHMENT_MARKER + "\n"), blob))
    sender = F.coalesce("m.sender", "m.role")
    role = F.when(sender.isin("human", "user"), "user").when(sender == "assistant", "assistant")
    return told.withColumn("text", text).withColumn("role", role)


def _iso(value: Column) -> Column:
    number = value.try_cast("double")
    at = F.coalesce(F.when(number > 0, F.timestamp_millis(number.cast("long"))), F.try_to_timestamp(X.strip(value)))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def claude_web(files: DataFrame) -> DataFrame:
    turns = _ordered(claude_web_turns(files), "node").where("role = 'user' AND text <> ''")
    label = F.when(F.col("name") == "", F.col("conv_id")).otherwise(F.col("name"))
    own = F.coalesce(_given(F.col("m.uuid")), _given(F.col("m.id")), X.short_id(F.col("text"), 16))
    return _items(
        turns, text=F.col("text"), uri=F.concat("path", F.lit("#"), label), item_id=X.short_id(F.concat_ws("|", F.lit("claude-web"), "conv_id", own), 24),
        tags=F.array(F.lit("claude")), at=F.coalesce(_iso(F.col("m.created_at")), _iso(F.col("conv_at"))), kind=F.lit("utterance"),
    )


def _bold_sections(text: Column) -> Column:
    """array of struct(title, body) of the parts under lines that are one bold phrase."""
    cut = F.split(F.concat(F.lit("\n"), text), r"\n(?=[ \t]*\*\*[^\n]+?\*\*[ \t]*(?:\n|\z))")
    made = F.transform(F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0))), lambda part: F.struct(
        X.strip(F.regexp_extract(part, r"^[ \t]*\*\*([^\n]+?)\*\*[ \t]*(?:\n|\z)", 1)).alias("title"),
        X.strip(F.regexp_replace(part, r"^[ \t]*\*\*[^\n]+?\*\*[ \t]*(?:\n|\z)", "")).alias("body"),
    ))
    return F.filter(made, lambda s: s["body"] != "")


def claude_memories(files: DataFrame) -> DataFrame:
    """Three independent fields of a memories file: bold sections, project texts, memory files."""
    root = F.when(F.col("text").rlike(r"(?U)^\s*\["), F.get_json_object("text", "$[0]")).otherwise(F.col("text"))
    schema = "conversations_memory string, project_memories map<string,string>, memory_files array<struct<path:string,content:string>>"
    rows = files.withColumn("c", F.from_json(root, schema))
    path, tag = F.col("path"), lambda *t: F.array(*[F.lit(x) if isinstance(x, str) else x for x in t])
    told = rows.select("path", "ord", F.posexplode(_bold_sections(F.coalesce("c.conversations_memory", F.lit("")))).alias("n", "s"))
    sections = _items(
        told.withColumn("ord", F.col("ord") * (1 << 40) + F.col("n")), text=F.col("s.body"), uri=F.concat(path, F.lit("#conversations_memory/"), (F.col("n") + 1).cast("string")),
        item_id=F.concat(F.lit("claude-memory|conversations|"), F.col("s.title")), title=X.label_of(F.col("s.title"), F.col("s.body")), tags=tag("claude", "memory"), kind=F.lit("entry"),
    )
    kept = rows.select("path", "ord", F.posexplode(F.map_entries("c.project_memories")).alias("n", "e")).withColumn("body", X.strip(F.col("e.value"))).where("body <> ''")
    short = F.substring("e.key", 1, 8)
    projects = _items(
        kept.withColumn("ord", F.col("ord") * (1 << 40) + (1 << 20) + F.col("n")), text=F.col("body"), uri=F.concat(path, F.lit("#project/"), short), item_id=F.concat(F.lit("claude-memory|project|"), F.col("e.key")),
        title=X.label_of(F.concat(F.lit("Claude project memory · "), short), F.col("body")), tags=tag("claude", "memory", F.concat(F.lit("project:"), short)), kind=F.lit("entry"),
    )
    held = rows.select("path", "ord", F.posexplode("c.memory_files").alias("n", "f")).withColumn("body", X.strip(F.col("f.content"))).where("body <> ''").withColumn("raw", X.strip(F.coalesce("f.path", F.lit(""))))
    name = F.when(F.col("raw") == "", "(unnamed)").otherwise(F.element_at(F.split("raw", r"[\\/]+"), -1))
    notes = _items(
        held.withColumn("ord", F.col("ord") * (1 << 40) + (2 << 20) + F.col("n")), text=F.col("body"), uri=F.concat(path, F.lit("#file/"), F.coalesce(_given(F.col("raw")), F.lit("(unnamed)"))),
        item_id=F.concat(F.lit("claude-memory|file|"), F.col("raw")), title=X.label_of(F.concat(F.lit("Claude memory file · "), name), F.col("body")), tags=tag("claude", "memory", "memory-file"), kind=F.lit("entry"),
    )
    return sections.unionByName(projects).unionByName(notes)


def _lines(files: DataFrame) -> DataFrame:
    """path, ord, n, line: the lines that hold something, counted from 0.

    A file is one row, or several that hold whole lines of it each and count the lines before them in ``first``:
    then no task holds more of it than such a part.
    """
    first = F.col("first") if "first" in files.columns else F.lit(0)
    rows = files.select("path", "ord", first.alias("first"), F.posexplode(F.split("text", "\r?\n")).alias("n", "line")).withColumn("n", F.col("first") + F.col("n")).drop("first")
    return rows.withColumn("line", X.strip(F.col("line"))).where("line <> ''")


def transcript_turns(files: DataFrame) -> DataFrame:
    """Lines of transcripts: the session is the last one named in the file, the project the first directory."""
    kept = files.where(~F.array_contains(F.split("path", r"[\\/]+"), "subagents"))
    rows = _lines(kept).withColumn("t", F.from_json("line", _TURN)).withColumn("ok", F.try_parse_json("line").isNotNull() & F.col("line").startswith("{"))
    whole = W.partitionBy("path").orderBy("n").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    base = F.regexp_replace(F.element_at(F.split("path", r"[\\/]+"), -1), r"(?i)\.jsonl\z", "")
    rows = rows.withColumn("conv_id", F.coalesce(F.last(_given(F.col("t.sessionId")), ignorenulls=True).over(whole), base)).withColumn("project", F.first(_given(F.col("t.cwd")), ignorenulls=True).over(whole))
    content = F.col("t.message.content")
    string = F.when(F.schema_of_variant(content) == "STRING", X.strip(F.try_variant_get(content, "$", "string")))
    is_user = (F.col("t.type") == "user") & ~F.coalesce("t.isMeta", F.lit(False)) & (string != "")
    return rows.withColumn("text", F.when(F.col("ok") & is_user, string))


def transcripts(files: DataFrame) -> DataFrame:
    turns = transcript_turns(files).where("text IS NOT NULL").withColumn("ord", F.col("ord") * (1 << 40) + F.col("n"))
    tags = F.array_compact(F.array(F.lit("claude"), F.lit("claude-code"), F.col("project")))
    ident = F.concat_ws("|", F.lit("claude-code"), "conv_id", F.col("n").cast("string"), F.lit("user"), "text")
    return _items(turns, text=F.col("text"), uri=F.concat("path", F.lit("#"), "conv_id"), item_id=X.short_id(ident, 24), tags=tags, at=_given(X.strip(F.col("t.timestamp"))), kind=F.lit("utterance"))


def _generic_item(rows: DataFrame, uri: Column) -> DataFrame:
    rows = rows.withColumn("v", F.try_parse_json("element")).withColumn("o", F.from_json("element", _GENERIC))
    shape = F.schema_of_variant("v")
    plain = F.when(shape == "STRING", F.try_variant_get("v", "$", "string"))
    string_of = lambda k: F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")) == "STRING", F.col(f"o.{k}"))
    first = lambda keys: F.coalesce(*[F.when(X.strip(string_of(k)) != "", string_of(k)) for k in keys])
    text = X.normalise_body(F.coalesce(plain, first(V.TEXT_KEYS)))
    scope = F.when(F.col("o.scope").isin(*V.SCOPES), F.col("o.scope"))
    strings = F.filter("o.tags", lambda t: F.schema_of_variant(t) == "STRING")
    tags = F.transform(strings, lambda t: F.variant_get(t, "$", "string"))
    # exploded, as a filter would be pushed below the parsing and parse the element again for each key
    made = rows.withColumn("text", F.explode(F.filter(F.array(text), lambda t: t != "")))
    return _items(
        made, text=F.col("text"), uri=uri, title=X.strip(first(V.TITLE_KEYS)), tags=F.when(F.size(tags) > 0, tags), scope=scope, at=F.coalesce(string_of("at"), string_of("createdAt")),
        item_id=F.concat(F.lit("file|"), F.col("o.id")), kind=F.lit("entry"),
    )


def json_lines(files: DataFrame, export_marker: str = "export") -> DataFrame:
    """A line an item; a line that holds the export marker's key only names the format. Files may come in parts, as ``_lines`` has it."""
    rows = _lines(files).withColumnRenamed("line", "element")
    marked = F.get_json_object("element", f"$.{export_marker}").isNotNull() & F.col("element").startswith("{")
    rows = rows.where(~F.coalesce(marked, F.lit(False)))
    rows = rows.withColumn("uri", F.concat("path", F.lit(":"), (F.col("n") + 1).cast("string"))).withColumn("ord", F.col("ord") * (1 << 40) + F.col("n"))
    return _generic_item(rows, F.col("uri"))


def json_items(files: DataFrame) -> DataFrame:
    rows = elements(files).withColumn("ord", F.col("ord") * (1 << 40) + F.col("n"))
    return _generic_item(rows, F.col("path"))

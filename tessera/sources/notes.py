"""Markdown and text notes, and the stores that keep memories as Markdown files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as X


# -- plain Markdown and text ----------------------------------------------------------------------


def markdown_sections(files: DataFrame) -> DataFrame:
    """path, ord, section, title, body: by headings of level 1 to 3 if there are several, else by paragraphs."""
    lines = files.select("path", "ord", F.posexplode(F.split("text", "\r?\n")).alias("n", "line")).withColumn("head", F.col("line").rlike("^#{1,3} "))
    by_file = W.partitionBy("path")
    lines = lines.withColumn("heads", F.sum(F.col("head").cast("int")).over(by_file)).withColumn("section", F.sum(F.col("head").cast("int")).over(by_file.orderBy("n")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("n", "line")))), lambda x: x["line"]), "\n")
    title = F.coalesce(F.max(F.when(F.col("head"), X.strip(F.regexp_replace("line", r"(?U)^#{1,3}\s*", "")))), F.lit(""))
    cut = lines.where("heads > 1").groupBy("path", "ord", "section").agg(title.alias("title"), body.alias("body"))
    cut = cut.where((F.col("section") > 0) | (X.strip(F.col("body")) != ""))
    cut = cut.withColumn("section", F.row_number().over(W.partitionBy("path").orderBy("section")) - 1)
    single = lines.where("heads <= 1").select("path").distinct()
    paras = files.join(single, "path", "left_semi").select("path", "ord", F.posexplode(X.paragraphs(F.col("text"))).alias("section", "body"))
    return cut.unionByName(paras.withColumn("title", X.headline(F.col("body"))))


def markdown(files: DataFrame) -> DataFrame:
    rows = markdown_sections(files).withColumn("text", X.normalise_body(F.col("body"))).withColumn("many", F.count("*").over(W.partitionBy("path")) > 1).where("text <> ''")
    label = F.when(F.col("title") == "", (F.col("section") + 1).cast("string")).otherwise(F.col("title"))
    return rows.select(
        "text", F.when(F.col("many"), F.concat("path", F.lit("#"), label)).otherwise(F.col("path")).alias("uri"), F.concat_ws("|", F.lit("file"), "path", F.col("section").cast("string")).alias("item_id"),
        F.nullif("title", F.lit("")).alias("title"), F.array(F.lit("file")).alias("tags"), F.lit(None).cast("string").alias("scope"), F.lit(None).cast("string").alias("at"), F.lit("entry").alias("kind"),
        (F.col("ord") * (1 << 40) + F.col("section")).alias("ord"),
    )


# -- notes with a header block ---------------------------------------------------------------------


def _file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^\\/]*$", 0)


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.md$", "")


def _unquoted(value: Column) -> Column:
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    bare = F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when(value.rlike(r"(?s)^([\"']).*\1$") & (F.length(value) > 1), bare).otherwise(value)


def _fields(header: Column) -> Column:
    """The header's lines ``key: value`` as structs of place, nested (indented), key and value."""
    found = [F.regexp_extract_all(header, F.lit(V.NOTE_FIELD), F.lit(i)) for i in (1, 2, 3)]
    return F.transform(F.arrays_zip(*found), lambda x, i: F.struct(i.alias("at"), (x["0"] != "").alias("nested"), x["1"].alias("key"), _unquoted(X.strip(x["2"])).alias("value")))


def _value(fields: Column, key: str) -> Column:
    """The last value of a key; empty if there is none."""
    own = F.filter(fields, lambda f: f["key"] == key)
    return X.strip(F.coalesce(F.get(own, F.size(own) - 1)["value"], F.lit("")))


def project_notes(files: DataFrame) -> DataFrame:
    """The note files of project stores as items; generated files and notes without a body give none.

    Fields that are indented, or follow an empty ``metadata``, belong to it; a type given inline there counts too.
    """
    rows = files.withColumn("name", _file_name(F.col("path"))).where(~F.col("name").isin(*V.GENERATED_NOTES))
    rows = rows.withColumn("f", _fields(F.regexp_extract("text", V.NOTE_HEADER, 1))).withColumn("body", X.strip(F.regexp_replace("text", V.NOTE_HEADER, ""))).where("body <> ''")
    opened = F.coalesce(F.array_min(F.transform(F.filter("f", lambda f: ~f["nested"] & (f["key"] == "metadata") & (f["value"] == "")), lambda f: f["at"])), F.lit(1 << 30))
    rows = rows.withColumn("opened", opened)
    top = F.filter("f", lambda f: ~f["nested"] & (f["at"] <= F.col("opened")))
    under = F.filter("f", lambda f: f["nested"] | (f["at"] > F.col("opened")))
    inline = X.strip(F.regexp_extract(_value(top, "metadata"), V.NOTE_INLINE_TYPE, 1))
    first = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c])
    parts, n = F.split("path", r"[\\/]+"), F.size(F.split("path", r"[\\/]+"))
    placed = (n > 2) & F.get(parts, n - 2).isin("memory", "topics")
    bucket = F.when(placed, F.get(parts, n - 2)).otherwise(_stem(F.col("name")))
    label = F.when(placed, F.regexp_replace(F.get(parts, n - 3), V.NOTE_PROJECT, "$1")).otherwise("root")
    kind, stamp = first(_value(top, "type"), _value(under, "type"), _unquoted(inline)), first(_value(top, "updatedAt"), _value(top, "createdAt"))
    title = F.coalesce(first(_value(top, "name")), _stem(F.col("name")))
    return rows.select(
        F.col("body").alias("text"), F.concat("path", F.lit("#"), bucket).alias("uri"), F.concat_ws("|", F.lit("zcode"), label, title).alias("item_id"), title.alias("title"),
        F.array(F.lit("zcode"), label, F.when(kind.isin(*V.NOTE_TYPES), kind).otherwise("other")).alias("tags"), F.lit(None).cast("string").alias("scope"),
        F.when(stamp.rlike(r"^\d{4}-\d{2}-\d{2}T"), stamp).alias("at"), F.lit("entry").alias("kind"), (F.col("ord") * (1 << 40)).alias("ord"),
    )


# -- sectioned memory files ------------------------------------------------------------------------


def without_raw(text: Column) -> Column:
    """Without raw JSON blocks; from the line of a start mark that has no end, nothing is kept."""
    return F.regexp_replace(F.regexp_replace(text, V.RAW_BLOCK, ""), V.RAW_OPEN, "")


def fill_in(text: Column) -> Column:
    """Whether a text is a form's field that nobody has filled in."""
    bare = F.regexp_replace(F.regexp_replace(text, V.EMPHASIS, ""), V.EMPHASISED_HINT, "")
    rest = X.strip(F.regexp_replace(bare, V.FIELD_NAME, ""))
    return (rest == "") | rest.rlike(V.FILL_IN)


def _joined(line: Column, at: str = "n") -> Column:
    return X.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at), line.alias("line")))), lambda x: x["line"]), "\n"))


def memory_files(files: DataFrame) -> DataFrame:
    """Entries of a store's files; of entries with the same text the first by file order stays.

    Files named as sectioned are cut at headings and bold lines. In a section, the bullets of its
    outermost level are an entry each, with what follows them; lines before the first go with it; a
    section without bullets is one entry.
    """
    name = _file_name(F.col("path"))
    parts = F.split("path", r"[\\/]+")
    store = F.coalesce(*[F.when(F.array_contains(parts, m), F.lit(V.STORE_MARKERS[m])) for m in (".codebuddy", ".workbuddy")], F.lit("dsh"))
    rows = files.select("path", "ord", name.alias("name"), store.alias("store"), name.rlike(V.SECTIONED_NAME).alias("sectioned"), name.rlike(V.DAY_NAME).alias("day"), without_raw(F.regexp_replace("text", V.NOTE_HEADER, "")).alias("raw"))
    scaffold = lambda x: reduce(lambda a, p: a | x.rlike("(?i)" + p), V.SCAFFOLD_LINES, F.lit(False))
    kept = F.filter(F.split("raw", "\n"), lambda x: ~scaffold(x) & ~(F.col("sectioned") & x.rlike(V.RULE_LINE)))
    rows = rows.withColumn("body", X.strip(F.array_join(kept, "\n"))).where("body <> ''")
    headings = F.filter(F.transform(F.split("body", "\n"), lambda x: F.regexp_extract(X.strip(x), V.ANY_HEADING, 1)), lambda x: x != "")
    rows = rows.withColumn("fallback", F.coalesce(F.get(headings, F.lit(0)), _stem(F.col("name"))))
    about = ["path", "ord", "name", "store", "day", "fallback"]
    # sections: a running number of headings
    lines = rows.select(*about, "sectioned", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    head = F.coalesce(F.nullif(F.regexp_extract("line", V.SECTION_HEADING, 1), F.lit("")), F.nullif(F.regexp_extract(X.strip(F.col("line")), V.SECTION_BOLD, 1), F.lit("")))
    lines = lines.withColumn("head", F.when(F.col("sectioned"), head))
    lines = lines.withColumn("section", F.sum(F.col("head").isNotNull().cast("int")).over(W.partitionBy("path", "ord").orderBy("n")))
    sections = lines.groupBy(*about, "section").agg(F.max("head").alias("label"), _joined(F.when(F.col("head").isNull(), F.col("line"))).alias("body")).where("body <> ''")
    # entries: a running number of bullets of the outermost level
    lines = sections.select(*about, "section", "label", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    inside = W.partitionBy("path", "ord", "section")
    lines = lines.withColumn("indent", F.when(F.col("line").rlike(V.BULLET), F.length(F.regexp_extract("line", V.BULLET, 1)))).withColumn("outer", F.min("indent").over(inside))
    starts = F.coalesce(F.col("indent") == F.col("outer"), F.lit(False))
    lines = lines.withColumn("starts", starts).withColumn("entry", F.sum(starts.cast("int")).over(inside.orderBy("n"))).where("entry > 0 OR outer IS NULL OR trim(line) <> ''")
    said = F.when(F.col("starts"), F.regexp_extract("line", V.BULLET, 2)).otherwise(F.col("line"))
    entries = lines.groupBy(*about, "section", "label", F.greatest("entry", F.lit(1)).alias("entry")).agg(_joined(said).alias("text"), F.first("outer").alias("outer"))
    entries = entries.where((F.col("text") != "") & ~fill_in(F.col("text")))
    bulleted = F.when(F.col("label").isNotNull(), X.label_of(F.col("label"), F.col("text"))).otherwise(F.coalesce(F.nullif(X.first_line_of(F.col("text")), F.lit("")), F.col("fallback")))
    title = F.when(F.col("day"), _stem(F.col("name"))).when(F.col("outer").isNull(), F.coalesce("label", "fallback")).otherwise(bulleted)
    number = (F.row_number().over(W.partitionBy("path", "ord").orderBy("section", "entry")) - 1).cast("string")
    items = entries.withColumn("i", number).select(
        "text", F.concat("path", F.lit("#"), "i").alias("uri"), F.concat_ws("|", "store", "path", "i").alias("item_id"), title.alias("title"),
        F.when(F.col("day"), F.array("store", F.lit("daily-log"))).otherwise(F.array("store")).alias("tags"), F.lit(None).cast("string").alias("scope"), F.lit(None).cast("string").alias("at"),
        F.lit("entry").alias("kind"), (F.col("ord") * (1 << 40) + F.col("i").cast("long")).alias("ord"),
    )
    same = F.sha2(X.collapse(F.col("text")), 256)
    return items.withColumn("__r", F.row_number().over(W.partitionBy(same).orderBy("ord"))).where("__r = 1").drop("__r")


def plan_store(files: DataFrame) -> DataFrame:
    """The files of a folder that a store's import reads, with ``ord`` by precedence.

    First the stores of each generation: their ``MEMORY.md``, then what is in their ``memory`` folder. Then,
    as a fallback, folders that are a memory folder, by name or because a memory file lies in them: of the
    latter only memory files and day files, not the persona files beside them.
    """
    parts = F.split("path", r"[\\/]+")
    n, name = F.size(parts), _file_name(F.col("path"))
    folder, above = F.get(parts, n - 2), F.get(parts, n - 3)
    markers = list(V.STORE_MARKERS)
    generation = lambda c: F.coalesce(*[F.when(c == m, F.lit(i)) for i, m in enumerate(markers)], F.lit(len(markers)))
    memory = name.rlike(V.SECTIONED_NAME)
    rows = files.withColumn("__at", F.regexp_replace("path", r"[\\/][^\\/]*$", "")).withColumn("__memory", memory)
    holds = F.max("__memory").over(W.partitionBy("__at"))
    rank = (
        F.when(folder.isin(*markers) & (name == "MEMORY.md"), F.struct(generation(folder).alias("g"), F.lit(0).alias("r")))
        .when((folder == "memory") & above.isin(*markers), F.struct(generation(above).alias("g"), F.lit(1).alias("r")))
        .when((F.lower(folder) == "memory") | (holds & (memory | name.rlike(V.DAY_NAME))), F.struct(F.lit(len(markers)).alias("g"), F.lit(2).alias("r")))
    )
    ranked = rows.withColumn("__rank", rank).where("__rank IS NOT NULL")
    order = F.row_number().over(W.orderBy("__rank.g", "__rank.r", "ord", "path"))  # a row for each file of one store
    return ranked.withColumn("ord", (order - 1).cast("long")).drop("__at", "__memory", "__rank")


# -- rule files --------------------------------------------------------------------------------------


def load_rules(files: DataFrame, size_limit: int = V.RULE_FILE_BYTES) -> DataFrame:
    """One text of rule files (path, name, text, scope): project files first, then by name with numbers as numbers.

    Hidden, blank and oversized files are left out; labels are shown if there are several.
    """
    kept = files.where(~F.col("name").startswith(".") & (X.strip(F.col("text")) != "") & (F.octet_length("text") <= size_limit))
    key = F.struct(F.when(F.col("scope") == "project", 0).otherwise(1).alias("p"), X.natural_key(F.col("name")).alias("k"), "path", "name", X.strip(F.col("text")).alias("body"))
    ordered = F.array_sort(F.collect_list(key))
    many = F.size(ordered) > 1
    shown = F.transform(ordered, lambda r: F.when(many, F.concat(F.lit(V.RULE_HEADING), F.regexp_replace(r["name"], r"(?i)\.md\z", ""), F.lit("\n"), r["body"])).otherwise(r["body"]))
    return kept.agg(F.array_join(shown, "\n\n").alias("text"), F.count("*").alias("n"))

"""Text functions as Column expressions; only NFKC leaves the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import fixed as V
from . import patterns as P


def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


@lru_cache(1)
def _nfkc():
    return pandas_udf(_composed, "string")


def nfkc(text: Column) -> Column:
    """Compatibility form, in Arrow batches; Spark has no function for it."""
    return _nfkc()(text)


def strip(text: Column) -> Column:
    """Trims Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def matches(text: Column, *patterns: tuple[str, bool]) -> Column:
    """Whether any of (pattern, fold case) is found. The patterns are in lower case, so folding is lowering the text."""
    out = F.lit(False)
    for pattern, fold_case in patterns:
        out = out | (F.lower(text) if fold_case else text).rlike(P.java(pattern))
    return out


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


# -- comparison ---------------------------------------------------------------------------------


def normalize_for_compare(text: Column, compose: bool = True) -> Column:
    """Letters and digits only, lower case, in compatibility form (``compose`` false for texts known to be in it)."""
    return F.regexp_replace(F.lower(nfkc(text) if compose else text), r"[^\p{L}\p{N}\p{IsHan}]+", "")


def bigrams(normalized: Column) -> Column:
    """Distinct pairs of neighbouring characters; a single character stands for itself."""
    letters, n = F.split(normalized, ""), F.length(normalized)
    some = F.greatest(n - 1, F.lit(0))
    grams = F.array_distinct(F.zip_with(F.slice(letters, F.lit(1), some), F.slice(letters, F.lit(2), some), lambda x, y: F.concat(x, y)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(normalized)).otherwise(grams)


def jaccard(left: Column, right: Column) -> Column:
    """Of two gram arrays: 1 if both are empty, 0 if one is."""
    shared = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right) - shared
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / total)


def contained(needle: Column, hay: Column) -> Column:
    return F.when(F.size(needle) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(needle, hay)) / F.size(needle))


def similarity(a: Column, b: Column, compose: bool = True) -> Column:
    return jaccard(bigrams(normalize_for_compare(a, compose)), bigrams(normalize_for_compare(b, compose)))


def containment(a: Column, b: Column, compose: bool = True) -> Column:
    return contained(bigrams(normalize_for_compare(a, compose)), bigrams(normalize_for_compare(b, compose)))


def read_statement(text: Column, compose: bool = True) -> Column:
    """struct of negative, marker (the first negation in list order that occurs) and affirmative (all negations and white space gone)."""
    lowered = F.lower(nfkc(text) if compose else text)
    marker, rest = F.lit(None).cast("string"), lowered
    for word in V.NEGATIONS:
        marker = F.coalesce(marker, F.when(lowered.contains(word), F.lit(word)))
        rest = F.replace(rest, F.lit(word), F.lit(""))
    return F.struct(marker.isNotNull().alias("negative"), marker.alias("marker"), F.regexp_replace(rest, r"(?U)\s+", "").alias("affirmative"))


def content_terms(text: Column, compose: bool = True) -> Column:
    words = F.split(F.lower(nfkc(text) if compose else text), r"[^\p{L}\p{N}\p{IsHan}]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*V.NEGATIONS))


def contradict(left: Column, right: Column, compose: bool = True) -> Column:
    """Of two ``read_statement`` structs."""
    a, b = left["affirmative"], right["affirmative"]
    first = F.length(a) <= F.length(b)
    shorter, longer = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    overlap = containment(shorter, longer, compose) >= V.CONTRADICTION_OVERLAP
    return (left["negative"] != right["negative"]) & (F.length(shorter) > 0) & (longer.contains(shorter) | overlap)


def merged_body(old: Column, new: Column) -> Column:
    a, b = strip(old), strip(new)
    return F.when((a == "") | (a == b) | b.contains(a), b).when(a.contains(b), a).otherwise(F.concat(a, F.lit("\n"), b))


# -- statements ---------------------------------------------------------------------------------


def strip_fenced(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)```.*?```", " ")


def strip_code_spans(text: Column) -> Column:
    return F.regexp_replace(strip_fenced(text), "`[^`\n]*`", " ")


def strip_attachment(text: Column) -> Column:
    return F.substring_index(text, V.ATTACHMENT_MARKER, 1)


def looks_like_paste(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    marked = F.filter(lines, lambda x: x.rlike(r"^(?:[-*>#|]|[0-9]+[.)])"))
    return (F.size(lines) >= 4) & (F.size(marked) >= 0.3 * F.size(lines))


def split_sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, "(?U)" + V.CLAUSE_DELIMITER), lambda x: strip(F.regexp_replace(x, "(?U)" + V.LIST_MARKER, "")))
    return F.filter(parts, lambda x: x.rlike(r"[\p{L}\p{N}]") & ~x.rlike(r"^[0-9]+\z"))


def clean(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, P.java(V.CLEAN_HEAD), ""), P.java(V.CLEAN_TAIL), ""))


# -- bodies, titles, tags -----------------------------------------------------------------------


def normalise_body(text: Column) -> Column:
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1), lambda x: F.regexp_replace(x, r"[ \t]+\z", ""))
    kept = F.filter(lines, lambda x: ~x.rlike(r"(?U)^\s*(?:-{3,}|\*{3,}|_{3,})\s*\z"))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))


def first_of_lines(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def headline(text: Column, limit: int = 80) -> Column:
    first = F.regexp_replace(collapse(first_of_lines(text)), r"(?U)^[-*>#\s]+", "")
    return F.when(F.length(first) <= limit, first).otherwise(F.concat(F.substring(first, 1, limit - 1), F.lit("…")))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), normalise_body), lambda x: x != "")


def item_hash(platform: Column, item_id: Column, text: Column) -> Column:
    identity = F.coalesce(F.nullif(item_id, F.lit("")), collapse(text))
    return F.substring(F.sha2(F.concat(F.coalesce(platform, F.lit("file")), F.char(F.lit(0)), identity), 256), 1, 32)


def short_id(text: Column, length: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def key_for(namespace: Column, path: Column) -> Column:
    return F.substring(F.sha1(F.concat(namespace, F.char(F.lit(0)), F.lower(path))), 1, 16)


def first_line_of(body: Column) -> Column:
    """The first line that has content, without list marks, up to the end of its first sentence."""
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: strip(F.regexp_replace(x, r"(?U)^[-*>#\s]+", ""))), lambda x: x != "")
    return F.when(F.size(lines) == 0, F.lit("")).otherwise(strip(F.regexp_extract(F.get(lines, F.lit(0)), r"(?s)^[^。.!?！？]*", 0)))


def label_of(title: Column, body: Column) -> Column:
    short, summary = F.substring(title, 1, V.LABEL_TITLE_CHARS), first_line_of(body)
    merged = F.when(summary == "", short).otherwise(F.concat(short, F.lit(" · "), summary))
    return F.when(F.length(merged) <= V.LABEL_CHARS, merged).otherwise(F.concat(F.substring(merged, 1, V.LABEL_CHARS), F.lit("…")))


def derive_title(text: Column) -> Column:
    clause = F.regexp_extract(first_of_lines(text), "(?s)^[^。！？!?；;]*", 0)
    mark = P.java(V.LEADING_MARK)
    trimmed = strip(F.regexp_replace(clause, mark, ""))
    return F.when(trimmed == "", strip(F.regexp_replace(text, mark, ""))).otherwise(trimmed)


def short_title(title: Column, limit: int = V.TITLE_MAX_CHARS) -> Column:
    text = strip(title)
    head = F.substring(text, 1, limit)
    back = F.reverse(head)
    from_end = F.least(*[F.when(F.locate(c, back) > 0, F.locate(c, back)) for c in (" ", "，")])
    last = F.coalesce(F.lit(limit) - from_end, F.lit(-1))
    cut = F.when(last > limit / 2, F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, r"(?U)\s+\z", ""), F.lit(V.TITLE_ELLIPSIS)))


def title_of(title: Column, text: Column) -> Column:
    written = strip(title)
    return F.when(written == "", short_title(derive_title(text))).otherwise(written)


def clamp_chars(text: Column, limit: Column | int) -> Column:
    """Cuts to ``limit`` characters with the truncation marker, at a line end if one is past the middle."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    marker = V.TRUNCATION_MARKER
    room = limit - len(marker)
    head = F.substring(text, F.lit(1), F.greatest(room, F.lit(0)))
    at = F.locate("\n", F.reverse(head))
    last = F.when(at > 0, F.length(head) - at).otherwise(-1)
    cut = F.when(last > room / 2, F.substring(head, F.lit(1), last)).otherwise(head)
    long = F.when(room <= 0, F.substring(F.lit(marker), F.lit(1), limit)).otherwise(F.concat(F.regexp_replace(cut, r"(?U)\s+\z", ""), F.lit(marker)))
    return F.when(limit <= 0, F.lit("")).when(F.length(text) <= limit, text).otherwise(long)


def join_sections(sections: Column) -> Column:
    return F.array_join(F.filter(F.transform(sections, strip), lambda x: x != ""), "\n\n")


def normalize_tags(tags: Column) -> Column:
    cut = F.transform(tags, lambda t: F.substring(strip(t), 1, V.TAG_CHARS))
    return F.slice(F.array_distinct(F.filter(cut, lambda t: t.isNotNull() & (t != ""))), 1, V.TAG_CAP)


def clip(text: Column, limit: int) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))


def escape_like(text: Column) -> Column:
    return F.regexp_replace(text, "([!%_])", "!$1")


def natural_key(name: Column) -> Column:
    """Sorts digit runs as numbers."""
    runs = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(r, 20, "0")).otherwise(F.lower(r))), "")

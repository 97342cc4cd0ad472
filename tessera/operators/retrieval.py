"""Hybrid text retrieval: trigram-floor phrases by BM25, short fragments by substring, fused and re-ranked.

One form answers a batch of queries: queries are rows, their fragments are exploded once, and the
corpus is read once against all of them. Fragments of a batch are few and short; their table is
broadcast after its bytes are checked, and beyond the bound the corpus is joined through trigrams.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from datetime import datetime

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import scalar as S
from ..functions import text as X
from .relational import retrievable

_CJK = regex.compile(r"[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Hangul}]+")
_OUTER = regex.compile(r"^[\p{P}\p{S}\s]+|[\p{P}\p{S}\s]+$")
#: Fragments of a batch that may be broadcast.
BROADCAST_FRAGMENTS = 20_000


def _runs(query: str) -> list[tuple[str, bool]]:
    """Runs of word characters with whether they stand in quotes; neighbours of CJK letters alone are fused."""
    found: list[tuple[str, bool]] = []
    for i, part in enumerate(unicodedata.normalize("NFKC", query).split('"')):
        for run in regex.findall(r"[\p{L}\p{N}_]+", part):
            if found and _CJK.fullmatch(found[-1][0]) and _CJK.fullmatch(run):
                found[-1] = (found[-1][0] + run, found[-1][1] or i % 2 == 1)
            else:
                found.append((run, i % 2 == 1))
    return found


def tokenize(query: str) -> list[tuple[str, str, bool]]:
    """(text, kind, quoted) fragments: ``fts`` from three characters on, else ``like``."""
    out: list[tuple[str, str, bool]] = []
    seen: set[str] = set()
    for run, quoted in _runs(query):
        text = _OUTER.sub("", run)[: V.MAX_FRAGMENT_CHARS]
        if not text:
            continue
        cut = not quoted and _CJK.fullmatch(text) and len(text) > V.CJK_TERM_CHARS
        for part in [text[i : i + V.TRIGRAM_FLOOR] for i in range(len(text) - V.TRIGRAM_FLOOR + 1)] if cut else [text]:
            if part.lower() not in seen and len(out) < V.MAX_FRAGMENTS:
                seen.add(part.lower())
                out.append((part, "fts" if len(part) >= V.TRIGRAM_FLOOR else "like", quoted))
    return out


def fragments(spark: SparkSession, queries: Sequence[tuple[int, str]]) -> DataFrame:
    """query_id, pos, fragment (lower case), kind, quoted of a batch of queries."""
    rows = [(q, i, text.lower(), kind, quoted) for q, query in queries for i, (text, kind, quoted) in enumerate(tokenize(query))]
    return spark.createDataFrame(rows, "query_id int, pos int, fragment string, kind string, quoted boolean")


def occurrences(text: Column, phrase: Column) -> Column:
    """Start positions of the phrase, overlaps included: matches of a look-ahead are empty, so the next search starts one further."""
    return F.regexp_count(text, F.concat(F.lit(r"(?=\Q"), phrase, F.lit(r"\E)")))


def phrase_hits(corpus: DataFrame, parts: DataFrame) -> DataFrame:
    """id, L and each fragment found, with its occurrences in title and body.

    The fragments' distinct texts are matched, so a phrase that several queries share is looked for once.
    """
    phrases = parts.where("kind = 'fts'").select("fragment").distinct()
    low = corpus.select("id", F.lower("title").alias("t"), F.lower("text").alias("b"), (F.greatest(F.length("title") - 2, F.lit(0)) + F.greatest(F.length("text") - 2, F.lit(0))).alias("L"))
    if phrases.count() <= BROADCAST_FRAGMENTS:
        pairs = low.join(F.broadcast(phrases), F.col("t").contains(F.col("fragment")) | F.col("b").contains(F.col("fragment")))
    else:
        grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))
        both = F.concat(F.col("t"), F.lit("\n\n"), F.col("b"))
        posts = low.where(F.length(both) > 2).select("*", F.explode(grams(both)).alias("gram"))
        keyed = phrases.select("fragment", F.substring("fragment", 1, 3).alias("gram"))
        pairs = posts.join(keyed, "gram").where(F.col("t").contains(F.col("fragment")) | F.col("b").contains(F.col("fragment")))
    return pairs.select("id", "L", "fragment", (occurrences(F.col("t"), F.col("fragment")) + occurrences(F.col("b"), F.col("fragment"))).alias("tf"))


def bm25(corpus: DataFrame, parts: DataFrame) -> DataFrame:
    """query_id, id, rank (lower is better) and n_matched. Statistics cover all rows of ``corpus``, visible or not."""
    hits = phrase_hits(corpus, parts)
    total = corpus.agg(
        F.count("*").alias("total"),
        F.avg(F.greatest(F.length("title") - 2, F.lit(0)) + F.greatest(F.length("text") - 2, F.lit(0))).alias("avgdl"),
    )
    seen = hits.groupBy("fragment").agg(F.count("*").alias("n"))
    idf = F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weights = seen.join(F.broadcast(total)).select("fragment", "avgdl", F.when(idf <= 0, F.lit(V.IDF_FLOOR)).otherwise(idf).alias("idf"))
    k1, b = V.BM25_K1, V.BM25_B
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * ((1 - b) + b * F.col("L") / F.col("avgdl")))
    scored = hits.join(F.broadcast(weights), "fragment").select("id", "fragment", part.alias("part"))
    per_query = scored.join(F.broadcast(parts.where("kind = 'fts'").select("query_id", "fragment")), "fragment")
    return per_query.groupBy("query_id", "id").agg((-F.sum("part")).alias("rank"), F.count("*").alias("n_matched"))


def fts_search(corpus: DataFrame, parts: DataFrame, project_key: str | None, limit: int) -> DataFrame:
    """The ``limit`` best visible rows of each query; rows with all phrases if a visible one has, else with any."""
    wanted = parts.where("kind = 'fts'").groupBy("query_id").agg(F.count("*").alias("n_phrases"))
    shown = corpus.where(retrievable(project_key)).select("id")
    found = bm25(corpus, parts).join(shown, "id").join(F.broadcast(wanted), "query_id")
    # rows with all phrases come first, so a query's first ``limit`` rows tell whether it has one; only those are in a window's frame
    whole = F.col("n_matched") == F.col("n_phrases")
    ranked = found.withColumn("fts_pos", F.row_number().over(W.partitionBy("query_id").orderBy(whole.desc(), "rank", "id"))).where(F.col("fts_pos") <= limit)
    kept = ranked.withColumn("any_whole", F.max(whole).over(W.partitionBy("query_id"))).where(~F.col("any_whole") | whole)
    return kept.select("query_id", "id", "rank", "n_matched")


def like_search(corpus: DataFrame, parts: DataFrame, project_key: str | None, limit: int) -> DataFrame:
    """The most recently used visible rows that hold all short fragments of a query: query_id, id, matched."""
    short = parts.where("kind = 'like'").groupBy("query_id").agg(F.collect_list("fragment").alias("short"))
    rows = corpus.where(retrievable(project_key)).select("id", F.lower("title").alias("t"), F.lower("text").alias("b"), S.used_at(F.col("last_used_at"), F.col("created_at")).alias("used"))
    hit = F.forall("short", lambda f: F.col("t").contains(f) | F.col("b").contains(f))
    found = rows.join(F.broadcast(short), hit).withColumn("matched", F.size("short"))
    ranked = found.withColumn("p", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("matched"), F.desc("used"), "id")))
    return ranked.where(F.col("p") <= limit).select("query_id", "id", "matched")


def retrieve(
    corpus: DataFrame, queries: Sequence[tuple[int, str]], project_key: str | None = None, limit: int = V.RETRIEVE_LIMIT,
    now: datetime | None = None, weights: tuple[float, float, float] = V.WEIGHTS,
) -> DataFrame:
    """Hybrid search of a batch: query_id, pos, id, score, relevance, match (fts, like or both)."""
    spark = corpus.sparkSession
    parts = fragments(spark, queries)
    most = min(V.CANDIDATE_CAP, V.CANDIDATE_FACTOR * limit)
    fts, like = fts_search(corpus, parts, project_key, most), like_search(corpus, parts, project_key, most)
    fused = fts.join(like, ["query_id", "id"], "full")
    sizes = parts.groupBy("query_id").agg(F.count("*").alias("n_parts"))
    rows = fused.join(F.broadcast(sizes), "query_id").join(corpus.select("id", "importance", "last_used_at", "created_at"), "id")
    by_rank = S.relevance_of_rank(F.col("rank"))
    by_share = F.col("matched") / F.col("n_parts")
    both = F.col("rank").isNotNull() & F.col("matched").isNotNull()
    relevance = F.when(both, S.boosted(by_rank)).when(F.col("rank").isNotNull(), by_rank).otherwise(by_share)
    match = F.when(both, "both").when(F.col("rank").isNotNull(), "fts").otherwise("like")
    at = F.lit(now) if now else F.current_timestamp()
    used = S.used_at(F.col("last_used_at"), F.col("created_at"))
    scored = rows.select("query_id", "id", relevance.alias("relevance"), match.alias("match"), used.alias("used"), "importance")
    scored = scored.withColumn("score", S.final_score(F.col("relevance"), S.recency(F.col("used"), at), F.col("importance"), weights))
    ranked = scored.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("used"), "id")))
    return ranked.where(F.col("pos") <= limit).select("query_id", "pos", "id", "score", "relevance", "match")


def search(
    corpus: DataFrame, query: str, scopes: Sequence[str] = (), project_key: str | None = None, limit: int = V.RETRIEVE_LIMIT, now: datetime | None = None,
) -> DataFrame:
    """Retrieves twice the limit, filters by scope, cuts: the filter comes after the top-k."""
    from .relational import in_scopes

    found = retrieve(corpus, [(0, query)], project_key, 2 * limit, now).drop("query_id")
    return found.join(corpus, "id").where(in_scopes(scopes, project_key)).orderBy("pos").limit(limit)


def recall(corpus: DataFrame, query: str, project_key: str | None = None, limit: int = V.CARD_RECALL, now: datetime | None = None) -> DataFrame:
    if not query.strip():
        return corpus.limit(0)
    return retrieve(corpus, [(0, query)], project_key, limit, now).drop("query_id").join(corpus, "id").orderBy("pos")


def step_query(messages: Sequence[dict]) -> str:
    """The last text that a user wrote, its last characters."""
    for message in reversed(messages):
        if message.get("role") == "user" and (message.get("source") or {}).get("kind") == "user":
            content = message.get("content")
            if isinstance(content, list):
                content = "\n".join(p["text"] for p in content if isinstance(p, dict) and p.get("type") == "text" and isinstance(p.get("text"), str))
            text = content.strip() if isinstance(content, str) else ""
            if text:
                return text[-V.STEP_QUERY_CHARS :]
    return ""


def step_queries(turns: DataFrame) -> DataFrame:
    """session, query of all sessions at once: the last text that a user wrote (by ``ord``), its last characters. turns: session, ord, role, text."""
    said = turns.select("session", "ord", "role", X.strip(F.col("text")).alias("said")).where("role = 'user' AND said <> ''")
    return said.groupBy("session").agg(F.max_by("said", "ord").alias("said")).select("session", F.right("said", F.lit(V.STEP_QUERY_CHARS)).alias("query"))

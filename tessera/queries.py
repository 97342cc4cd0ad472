"""One registered query for each operator, over the views of ``views``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views
from .functions import fixed as V
from .functions import scalar as S
from .functions import text as X
from .operators import assemble, daily, distill, importing, merge, relational, retrieval
from .operators.model import Query
from .sources import export, json_exports, metrics, notes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_NOW = datetime(2024, 2, 1)


def _now() -> F.Column:
    return F.lit(views.NOW).cast("timestamp")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _listed(order: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pyspark.sql import Window as W

        from .operators.model import order as columns

        page = relational.list_memories(views.mem(spark, sf_dir), Query(scope=("global", "project"), status=("active",), order_by=order, limit=50, offset=10))
        return page.withColumn("pos", F.row_number().over(W.orderBy(*columns(order)))).select("pos", "id", "title", "importance")

    run.__name__ = f"mem_list_{order}"
    return query(run)


for _name in ("created", "used", "importance"):
    _listed(_name)


@query
def mem_filter_scope_status_tag(spark, sf_dir):
    m = views.mem(spark, sf_dir)
    tags = m.select(F.col("id").alias("memory_id"), F.explode("tags").alias("tag"))
    return relational.with_tag(m.where(Query(scope=("global",), status=("active", "pending"), pinned=True).condition()), tags, "fr").select("id", "title", "status")


@query
def mem_visible_for_key(spark, sf_dir):
    return relational.visible(views.mem(spark, sf_dir), "src3", Query(status=("active",))).select("side", "ord", "id")


@query
def mem_visible_null_key(spark, sf_dir):
    return relational.visible(views.mem(spark, sf_dir), None, Query(order_by="used"), limit=100).select("side", "ord", "id")


@query
def mem_count(spark, sf_dir):
    return relational.count(views.mem(spark, sf_dir), Query(by_project=True, project_key="src5", status=("active",)))


@query
def mem_projects(spark, sf_dir):
    return relational.projects(views.mem(spark, sf_dir))


@query
def mem_tags(spark, sf_dir):
    return relational.all_tags(views.mem(spark, sf_dir))


@query
def mem_attach_tags(spark, sf_dir):
    m = views.mem(spark, sf_dir)
    tags = m.select(F.col("id").alias("memory_id"), F.posexplode(F.array("source", F.element_at("tags", 1))).alias("position", "tag"))
    return relational.attach_tags(m, tags).select("id", F.array_join("tags", ",").alias("tags"))


@query
def mem_overview(spark, sf_dir):
    return relational.overview(views.mem(spark, sf_dir))


@query
def mem_eviction(spark, sf_dir):
    return relational.eviction_candidates(views.mem(spark, sf_dir), 100).select("id", "importance")


@query
def mem_get_many(spark, sf_dir):
    return relational.get_many(views.mem(spark, sf_dir), [7, 3, 999_999_999, 11, 42]).select("pos", "id", "title")


@query
def mem_forget(spark, sf_dir):
    wanted = spark.range(0, 60).withColumn("id", F.col("id") * 17)
    rows = wanted.join(views.mem(spark, sf_dir).select("id", "scope", "status", "project_key"), "id", "left")
    return rows.select("id", relational.forget_outcome("src3").alias("outcome"))


@query
def mem_update(spark, sf_dir):
    m = views.mem(spark, sf_dir)
    patches = m.where("id % 10 = 3").select("id", F.lit("archived").alias("status"), F.when(F.col("id") % 20 == 3, F.lit(9)).alias("importance"))
    return relational.update(m, patches, _now(), moved="moved").select("id", "status", "importance", "moved")


@query
def mem_touch(spark, sf_dir):
    m = views.mem(spark, sf_dir)
    return relational.touch(m, m.where("id % 13 = 0").select("id"), _now()).select("id", F.date_format("last_used_at", "yyyy-MM-dd HH:mm").alias("used"))


@query
def mem_insert(spark, sf_dir):
    m = views.mem(spark, sf_dir)
    fresh = views.candidates(spark, sf_dir).withColumnRenamed("cand_id", "ord")
    return relational.insert(m, fresh, _now()).where("created_at = timestamp'2024-02-01 00:00:00' AND source = 'auto' AND title = ''").select("id", "text", "scope", "status")


@query
def mem_remove(spark, sf_dir):
    m = views.mem(spark, sf_dir)
    tags = m.select(F.col("id").alias("memory_id"), F.posexplode("tags").alias("position", "tag"))
    ledger = m.select(F.sha1("text").alias("hash"), F.col("id").alias("memory_id"), F.col("created_at").alias("imported_at"))
    rows, kept, freed = relational.remove(m, tags, ledger, m.where("id % 3 = 0").select("id"))
    n = lambda df, what: df.agg(F.count("*").alias("n")).withColumn("what", F.lit(what))
    return n(rows, "memories").unionByName(n(kept, "tags")).unionByName(n(freed.where("memory_id IS NULL"), "freed"))


@query
def panel_view(spark, sf_dir):
    return relational.panel_view(views.mem(spark, sf_dir)).select("id", "text", "text_truncated")


@query
def norm_compare(spark, sf_dir):
    return views.mem(spark, sf_dir).select("id", X.normalize_for_compare(F.col("text")).alias("norm")).select("id", F.length("norm").alias("n"), F.sha2("norm", 256).alias("digest"))


@query
def bigram_profile(spark, sf_dir):
    grams = views.mem(spark, sf_dir).select("id", F.explode(X.bigrams(X.normalize_for_compare(F.col("text")))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("df"))


@query
def jaccard_pairs(spark, sf_dir):
    return views.pairs(spark).select("pair_id", F.round(X.similarity(F.col("a"), F.col("b")), 6).alias("sim"))


@query
def containment_pairs(spark, sf_dir):
    return views.pairs(spark).select("pair_id", F.round(X.containment(F.col("a"), F.col("b")), 6).alias("share"))


@query
def statement_polarity(spark, sf_dir):
    return views.mem(spark, sf_dir).select("id", X.read_statement(F.col("text")).alias("s")).select("id", "s.negative", "s.marker", F.length("s.affirmative").alias("n"))


@query
def contradict_pairs(spark, sf_dir):
    return views.pairs(spark).select("pair_id", X.contradict(X.read_statement(F.col("a")), X.read_statement(F.col("b"))).alias("clash"))


@query
def content_terms(spark, sf_dir):
    terms = views.mem(spark, sf_dir).select(F.explode(X.content_terms(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n"))


@query
def merge_similar(spark, sf_dir):
    pool = merge._prepared(views.mem(spark, sf_dir).where("status = 'active'"), "id", True)
    cands = merge._prepared(views.candidates(spark, sf_dir), "cand_id", True)
    return merge.similar_pairs(cands, pool).select("cand_id", "id", F.round("score", 6).alias("score"))


@query
def merge_plan_snapshot(spark, sf_dir):
    return merge.plan(views.candidates(spark, sf_dir), views.mem(spark, sf_dir)).select("cand_id", "decision", "target", "reason")


@query
def merge_widened(spark, sf_dir):
    """All candidates as corrections: one that is new in its layer retires the newest row of another that it contradicts."""
    cands = views.candidates(spark, sf_dir).withColumn("kind", F.lit("correction"))
    return merge.plan(cands, views.mem(spark, sf_dir)).select("cand_id", "decision", "target", "reason")


@query
def merge_apply_snapshot(spark, sf_dir):
    m, c = views.mem(spark, sf_dir), views.candidates(spark, sf_dir)
    out = merge.apply_plan(m, c, merge.plan(c, m), _now())
    return out.groupBy("scope", "status").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query
def merge_sequential(spark, sf_dir):
    return merge.sequential(views.candidates(spark, sf_dir), views.mem(spark, sf_dir))


@query
def fts_and(spark, sf_dir):
    parts = retrieval.fragments(spark, [(1, "tion the ing")])
    return retrieval.fts_search(views.mem(spark, sf_dir), parts, "src1", 40).select("id", F.round("rank", 6).alias("rank"), "n_matched")


@query
def fts_or_relax(spark, sf_dir):
    parts = retrieval.fragments(spark, [(1, "tionre qqqxz")])
    return retrieval.fts_search(views.mem(spark, sf_dir), parts, "src1", 40).select("id", F.round("rank", 6).alias("rank"), "n_matched")


@query
def bm25_rank(spark, sf_dir):
    parts = retrieval.fragments(spark, list(views.QUERIES))
    return retrieval.bm25(views.mem(spark, sf_dir), parts).select("query_id", "id", F.round("rank", 6).alias("rank"), "n_matched")


@query
def like_short(spark, sf_dir):
    parts = retrieval.fragments(spark, [(1, "zu en"), (2, "ou")])
    return retrieval.like_search(views.mem(spark, sf_dir), parts, "src2", 40)


@query
def hybrid_search(spark, sf_dir):
    found = retrieval.retrieve(views.mem(spark, sf_dir), list(views.QUERIES), "src1", 10, _NOW)
    return found.select("query_id", "pos", "id", F.round("score", 6).alias("score"), "match")


@query
def search_scope_postfilter(spark, sf_dir):
    found = retrieval.search(views.mem(spark, sf_dir), "tionre ethese ou", ("global",), "src1", 10, _NOW)
    return found.select("id", F.round("score", 6).alias("score"))


@query
def tokenize_queries(spark, sf_dir):
    return retrieval.fragments(spark, [(1, "项目 约定"), (2, "pnpm cache"), (3, "构建缓存应该怎么处理"), (4, 'say "exact phrase" _x_ ab'), *views.QUERIES])


@query
def split_sentences(spark, sf_dir):
    return views.statements(spark).select("msg_id", F.posexplode(X.split_sentences(F.col("message"))).alias("pos", "clause"))


@query
def split_sentences_corpus(spark, sf_dir):
    clauses = views.mem(spark, sf_dir).select("id", X.split_sentences(F.col("text")).alias("c"))
    return clauses.select("id", F.size("c").alias("n"), F.length(F.array_join("c", "")).alias("chars"))


@query
def extract_candidates(spark, sf_dir):
    return distill.extract_candidates(views.statements(spark))


@query
def classify_corpus(spark, sf_dir):
    return views.mem(spark, sf_dir).select(distill.classify(F.col("text")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query
def judge_gate(spark, sf_dir):
    judged = distill.judge(distill.extract_candidates(views.statements(spark)), True)
    return judged.select("msg_id", "pos", "kind", "accepted", "reason", "importance", "scope")


@query
def judge_corpus(spark, sf_dir):
    rows = views.mem(spark, sf_dir).select("id", "text", distill.classify(F.col("text")).alias("kind"), F.lit(False).alias("vouched"))
    return distill.judge(rows, True).groupBy("kind", "reason", "scope", "importance").agg(F.count("*").alias("n"))


@query
def distill_report(spark, sf_dir):
    m = views.mem(spark, sf_dir)
    judged = distill.judge(distill.extract_candidates(views.statements(spark)), True)
    cands = judged.where("accepted").select((F.col("msg_id") * 100 + F.col("pos")).cast("long").alias("cand_id"), "kind", F.lit("").alias("title"), "text", "scope", F.when(F.col("scope") == "project", F.lit("src1")).alias("project_key"))
    plans = merge.plan(cands, m).select("decision").unionByName(judged.where("NOT accepted").select(F.lit("rejected").alias("decision")))
    return distill.report(plans)


@query
def paste_filter(spark, sf_dir):
    return views.statements(spark).select("msg_id", X.looks_like_paste(F.col("message")).alias("paste")).unionByName(views.mem(spark, sf_dir).select(F.col("id").cast("int").alias("msg_id"), X.looks_like_paste(F.col("text")).alias("paste")))


@query
def strip_code(spark, sf_dir):
    return views.statements(spark).select("msg_id", X.strip_code_spans(F.col("message")).alias("plain"), X.strip_fenced(F.col("message")).alias("unfenced"))


@query
def normalise_bodies(spark, sf_dir):
    return views.mem(spark, sf_dir).select("id", F.sha2(X.normalise_body(F.col("text")), 256).alias("digest"), X.headline(F.col("text")).alias("headline"))


@query
def titles(spark, sf_dir):
    return views.mem(spark, sf_dir).select("id", X.short_title(X.derive_title(F.col("text"))).alias("title"), X.clip(F.col("text"), 60).alias("clip"))


@query
def item_hash(spark, sf_dir):
    u = views.utterances(spark, sf_dir)
    return u.select("ord", X.item_hash(F.lit("chatgpt"), F.when(F.col("ord") % 2 == 0, F.col("item_id")), F.col("text")).alias("hash"))


def _ledger(spark, sf_dir):
    u = views.utterances(spark, sf_dir).withColumn("hash", X.item_hash(F.lit(None).cast("string"), F.col("item_id"), F.col("text")))
    ledger = u.where("ord % 3 = 0").select("hash", F.when(F.col("ord") % 2 == 0, F.col("ord")).alias("memory_id"), _now().alias("imported_at"))
    return u, ledger


@query
def ledger_new(spark, sf_dir):
    return relational.new_hashes(*_ledger(spark, sf_dir)).select("ord", "hash")


@query
def ledger_known(spark, sf_dir):
    return relational.known_hashes(*_ledger(spark, sf_dir)).select("ord", "hash")


@query
def ledger_record(spark, sf_dir):
    u, ledger = _ledger(spark, sf_dir)
    entries = u.where("ord % 5 = 0").select("hash", F.col("ord").alias("memory_id"), _now().alias("imported_at"), "ord")
    return relational.record_imports(ledger, entries).select("hash", "memory_id")


@query
def import_metrics(spark, sf_dir):
    m = views.mem(spark, sf_dir)
    ledger = _ledger(spark, sf_dir)[1]
    return importing.run(views.utterances(spark, sf_dir), m, ledger, _now(), importing.Request(max_items=None, dry_run=True))[2]


@query
def import_entries(spark, sf_dir):
    m = views.mem(spark, sf_dir)
    items = views.statements(spark).select(F.col("message").alias("text"), F.lit("lit").alias("uri"), F.col("msg_id").cast("string").alias("item_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("scope"), F.lit(None).cast("string").alias("at"), F.lit("entry").alias("kind"), F.col("msg_id").cast("long").alias("ord"))
    after, ledger, report = importing.run(items, m, m.select(F.sha1("text").alias("hash"), F.col("id").alias("memory_id"), F.col("created_at").alias("imported_at")).limit(0), _now())
    sizes = after.agg(F.count("*").alias("n_memories")).join(ledger.agg(F.count("*").alias("n_ledger")))
    return report.join(sizes)


@query
def daily_append(spark, sf_dir):
    return daily.rendered_days(views.journal(spark, sf_dir)).select("day", "project_key", F.sha2("body", 256).alias("digest"), "n_entries")


@query
def daily_list(spark, sf_dir):
    return daily.list_days(views.mem(spark, sf_dir), "src6", limit=30).select("id", "date", F.size("entries").alias("n"))


@query
def daily_purge(spark, sf_dir):
    return daily.stale(views.mem(spark, sf_dir), _now(), 30).select("id", "date")


@query
def recency_scores(spark, sf_dir):
    return views.mem(spark, sf_dir).select("id", F.round(S.recency(S.used_at(F.col("last_used_at"), F.col("created_at")), _now()), 6).alias("recency"))


@query
def render_index(spark, sf_dir):
    rows = views.mem(spark, sf_dir).where("status = 'active' AND project_key IS NOT NULL")
    return assemble.render_index(rows, "id", ("project_key",))


@query
def render_cards(spark, sf_dir):
    rows = views.mem(spark, sf_dir).where("status = 'active' AND pinned AND project_key IS NOT NULL")
    return assemble.render_cards(rows, "id", ("project_key",)).select("project_key", "n", F.sha2("text", 256).alias("digest"))


@query
def fit_index(spark, sf_dir):
    rows = views.mem(spark, sf_dir).where("status = 'active' AND project_key IS NOT NULL")
    return assemble.fit_index(rows, "id", 900, ("project_key",)).select("project_key", "text", "n")


@query
def budget_fold(spark, sf_dir):
    rows = views.mem(spark, sf_dir).where("status = 'active'").withColumn("g", F.col("id") % 50)
    section = F.struct(F.col("id").alias("o"), F.col("title").alias("name"), F.col("text").alias("text"), F.col("pinned").alias("partial"))
    folded = rows.groupBy("g").agg(assemble.apply_budget(F.transform(F.array_sort(F.collect_list(section)), lambda s: F.struct(s["name"].alias("name"), s["text"].alias("text"), s["partial"].alias("partial"))), V.TURN_BUDGET).alias("f"))
    return folded.select("g", F.length(assemble.budget_text(F.col("f"))).alias("used"), assemble.describe_budget(F.col("f")).alias("summary"))


@query
def turn_context(spark, sf_dir):
    m = views.mem(spark, sf_dir)
    cards = retrieval.recall(m, "tionre ethese ou", "src1", 4, _NOW)
    return assemble.turn_context(m, "src1", cards).select("text", "used_chars", "summary")


@query
def delivered_cards(spark, sf_dir):
    m = views.mem(spark, sf_dir)
    given = m.where("id % 3 = 0").select(F.coalesce("project_key", F.lit("-")).alias("session"), "id", F.col("id").alias("ord"))
    ledger = assemble.deliver(given.limit(0), given, 20)
    cards = m.select(F.coalesce("project_key", F.lit("-")).alias("session"), "id")
    return assemble.undelivered(cards, ledger).groupBy("session").agg(F.count("*").alias("n"))


@query
def markdown_sections(spark, sf_dir):
    c = views.mem(spark, sf_dir).withColumn("g", F.col("id") % 25)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "title", "text"))), lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    files = c.groupBy("g").agg(texts.alias("text")).select(F.concat(F.lit("note"), F.col("g").cast("string")).alias("path"), F.col("g").alias("ord"), "text")
    return notes.markdown(files).select("uri", "title", F.length("text").alias("n"), F.sha2("text", 256).alias("digest"))


_CHATGPT = """[{"conversation_id":"c1","title":"Trip","create_time":100,"mapping":{"a":{"message":{"id":"m1","author":{"role":"user"},"create_time":30,"content":{"parts":["Book it for","","two weeks",{"x":1}]}}},"b":{"message":{"id":"m2","author":{"role":"assistant"},"create_time":20,"content":{"parts":["ok"]}}},"c":{"message":null},"d":{"message":{"id":"","author":{"role":"user"},"create_time":null,"content":{"parts":["later"]}}},"e":{"message":{"id":"m5","author":{"role":"user"},"create_time":10.5,"content":{"parts":["first"]}}}}}, 7]"""
_CLAUDE = """{"conversations":[{"uuid":"u1","name":"Plan","created_at":"2024-01-02T03:04:05Z","chat_messages":[{"uuid":"x1","sender":"human","created_at":"2024-01-02T03:05:00Z","text":" hello "},{"uuid":"x2","sender":"assistant","text":"hi"},{"uuid":"x3","sender":"human","text":"","content":[{"type":"text","text":"see file"}],"attachments":[{"extracted_content":"body text"}]}]}]}"""


@query
def chatgpt_flatten(spark, sf_dir):
    files = spark.createDataFrame([("conversations.json", 0, _CHATGPT)], "path string, ord long, text string")
    return json_exports.chatgpt(files).select("ord", "text", "uri", "item_id", "at")


@query
def claude_web_flatten(spark, sf_dir):
    files = spark.createDataFrame([("conversations.json", 0, _CLAUDE)], "path string, ord long, text string")
    return json_exports.claude_web(files).select("ord", "text", "uri", "item_id", "at")


@query
def jsonl_turns(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    line = F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("sessionId"), F.lit("/work/x").alias("cwd"), F.struct("role", F.col("text").alias("content")).alias("message")))
    files = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    files = files.select(F.concat(F.lit("p/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), F.col("conv_id").alias("ord"), "text")
    return json_exports.transcripts(files).select("uri", "text", "item_id", F.array_join("tags", ",").alias("tags"))


@query
def generic_json_lines(spark, sf_dir):
    from pyspark.sql import Window as W

    d = views.mem(spark, sf_dir)
    even = F.coalesce(F.col("id") % 2 == 0, F.lit(False))
    line = F.to_json(F.struct(F.when(even, F.col("text")).alias("note"), F.when(~even, F.col("text")).alias("body"), F.col("title").alias("name"), "scope", "id", "tags"))
    lines = d.select(F.concat(F.lit("x"), (F.col("id") % 20).cast("string"), F.lit(".jsonl")).alias("path"), (F.col("id") % 20).alias("ord"), line.alias("text"), "id")
    # Files grow with the table, so each comes in parts of a line. Lines are numbered only for who asks for uri or ord: else the window is left out of the plan.
    files = lines.withColumn("first", F.row_number().over(W.partitionBy("path").orderBy("id", "text")) - 1)
    return json_exports.json_lines(files).select("item_id", "title", "scope", F.array_join("tags", ",").alias("tags"), F.sha2("text", 256).alias("digest"))


@query
def scan_counters(spark, sf_dir):
    files = spark.createDataFrame([("conversations.json", 0, _CHATGPT)], "path string, ord long, text string")
    return metrics.scan_metrics("chatgpt", files, json_exports.chatgpt(files))


_NOTE = '---\nname: "Build rules"\nmetadata:\n  type: feedback\nupdatedAt: 2024-01-02T00:00:00Z\n---\nUse pnpm.\n'
_STORE = "# User Memory Profile\n> Last updated: now\n\n## Style\n- Prefers **short** answers\n  with examples\n- **Tone**: (optional)\n\n**Work**\nBuilds with vite.\n<!-- RAW_JSON_START {} RAW_JSON_END -->\n"


@query
def zcode_frontmatter(spark, sf_dir):
    files = spark.createDataFrame([("p/projects/shop-0123456789abcdef/memory/a.md", _NOTE, 0), ("p/projects/shop-0123456789abcdef/memory/MEMORY.md", "x", 1)], "path string, text string, ord long")
    return notes.project_notes(files)


@query
def workbuddy_items(spark, sf_dir):
    files = spark.createDataFrame([("w/.workbuddy/memory/x_memory.md", _STORE, 0), ("w/.workbuddy/memory/2024-01-02.md", "- did a thing\n- did another", 1)], "path string, text string, ord long")
    return notes.memory_files(files)


# -- filters, functions and documents over whole tables ------------------------------------------


@query
def mem_any_project(spark, sf_dir):
    return relational.list_memories(views.mem(spark, sf_dir), Query(status=("active",), project_key="src1", by_project=True, any_project=True)).select("id", "project_key")


@query
def panel_rows(spark, sf_dir):
    m = views.mem(spark, sf_dir)
    asked = {"layer": relational.panel_filter("global", "active", "fr", global_only=True), "project": relational.panel_filter(tag="en", project="src2")}
    layer, project = (m.where(q.condition()).select(F.lit(name).alias("ask"), "id", "scope") for name, q in asked.items())
    return layer.unionByName(project)


@query
def mem_listed_scopes(spark, sf_dir):
    m = views.mem(spark, sf_dir)
    asked = {"keyless": (("global", "project", "daily"), None), "keyed": (("project", "global"), "src4"), "none": (("project",), None)}
    keyless, keyed, none = (m.where(relational.list_scopes(*a)).select(F.lit(name).alias("ask"), "id", "scope") for name, a in asked.items())
    return keyless.unionByName(keyed).unionByName(none)


@query
def panel_clamps(spark, sf_dir):
    d = views.documents(spark, sf_dir)
    n = F.col("doc_id")
    asked = d.select(
        n.alias("id"), F.when(n % 5 > 0, n * 37 % 400 - 50).alias("limit"), ((n - 20) * 9973).alias("offset"), F.when(n % 4 > 0, n % 11 - 3).alias("importance"), F.when(n % 3 > 0, n % 300 - 10).alias("entries"),
        F.split("text", " ").alias("tags"), F.col("text").alias("title"), F.element_at(F.array(*[F.lit(s) for s in (*V.SCOPES, "other")]), (n % 5 + 1).cast("int")).alias("scope"),
    )
    return relational.panel_input(asked).select("id", "limit", "offset", "importance", "entries", F.size("tags").alias("n_tags"), F.array_join("tags", "|").alias("tags"), "title", "valid")


@query
def attachments_cut(spark, sf_dir):
    marked = F.concat("text", F.when(F.col("id") % 3 == 0, F.concat(F.lit(V.ATTACHMENT_MARKER + "\n"), "title", F.lit(V.ATTACHMENT_MARKER))).otherwise(""))
    return views.mem(spark, sf_dir).select("id", F.sha2(X.strip_attachment(marked), 256).alias("digest"))


@query
def project_keys(spark, sf_dir):
    return views.mem(spark, sf_dir).select("id", X.key_for(F.lit("git"), F.concat("project_path", F.lit("/Repo"), F.col("id").cast("string"))).alias("key"))


@query
def joined_sections(spark, sf_dir):
    parts = F.array(F.concat(F.lit(" "), "title", F.lit("\n")), F.when(F.col("id") % 2 == 0, F.col("text")).otherwise("  "), F.lit("end"))
    return views.mem(spark, sf_dir).select("id", F.sha2(X.join_sections(parts), 256).alias("digest"))


@query
def tag_lists(spark, sf_dir):
    return views.mem(spark, sf_dir).select("id", F.array_join(X.normalize_tags(F.slice(F.split("text", " "), 1, 30)), "|").alias("tags"))


@query
def like_escapes(spark, sf_dir):
    """Every escaped head of a text finds its own row by LIKE; one with its wildcards left open may find more."""
    head = F.concat(F.substring("text", 1, 60), F.lit("100%_!"))
    rows = views.mem(spark, sf_dir).select("id", head.alias("head"), X.escape_like(head).alias("pattern"))
    return rows.select("id", "pattern", F.expr("head LIKE pattern ESCAPE '!'").alias("own"), F.expr("concat(substring(head, 2), 'x') LIKE pattern ESCAPE '!'").alias("other"))


@query
def natural_order(spark, sf_dir):
    from pyspark.sql import Window as W

    names = views.mem(spark, sf_dir).select("id", "project_path", X.natural_key(F.concat(F.lit("Rule-"), F.col("id").cast("string"), F.lit("b.md"))).alias("k"))
    return names.select("id", "project_path", F.row_number().over(W.partitionBy("project_path").orderBy("k")).alias("pos"))


@query
def day_keys(spark, sf_dir):
    return views.mem(spark, sf_dir).select("id", S.day_key(F.col("created_at"), "Asia/Shanghai").alias("day"))


@query
def neighbour_pairs(spark, sf_dir):
    """Similarity, containment and contradiction of each text and the next one by id."""
    m = views.mem(spark, sf_dir).select("id", F.col("text").alias("a"))
    pairs = m.join(m.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    clash = X.contradict(X.read_statement(F.col("a")), X.read_statement(F.col("b")))
    return pairs.select("id", F.round(X.similarity(F.col("a"), F.col("b")), 6).alias("sim"), F.round(X.containment(F.col("a"), F.col("b")), 6).alias("share"), clash.alias("clash"))


@query
def extract_turns(spark, sf_dir):
    return distill.extract_candidates(views.spoken(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "message"))


@query
def extract_batches(spark, sf_dir):
    rows = views.spoken(spark, sf_dir).select("conv_id", "turn", "message")
    return distill.extract_from_messages(rows, "conv_id", "turn").select("conv_id", "turn", "pos", "text", "kind")


@query
def step_queries(spark, sf_dir):
    return retrieval.step_queries(views.spoken(spark, sf_dir).select(F.col("conv_id").alias("session"), F.col("turn").alias("ord"), "role", "text"))


@query
def distill_summary(spark, sf_dir):
    return distill.describe_report(distill_report(spark, sf_dir))


@query
def memory_file_items(spark, sf_dir):
    """A memories file for each document: a bold section, a project's text and a memory file."""
    number = F.col("id").cast("string")
    fields = F.struct(
        F.concat(F.lit("**Topic "), number, F.lit("**\n"), "title").alias("conversations_memory"), F.create_map(F.concat(F.lit("key-"), number), F.col("text")).alias("project_memories"),
        F.array(F.struct(F.concat(F.lit("notes/"), number, F.lit(".md")).alias("path"), F.col("text").alias("content"))).alias("memory_files"),
    )
    files = views.mem(spark, sf_dir).select(F.concat(F.lit("m"), number).alias("path"), F.col("id").alias("ord"), F.to_json(fields).alias("text"))
    return json_exports.claude_memories(files).select("uri", "item_id", "title", F.array_join("tags", ",").alias("tags"), F.sha2("text", 256).alias("digest"))


@query
def json_wrapped(spark, sf_dir):
    """A JSON file for each document, its one item under a wrapper key."""
    m = views.mem(spark, sf_dir)
    item = F.struct(F.col("text").alias("note"), F.col("title").alias("subject"), F.when(F.col("id") % 4 == 1, "elsewhere").otherwise(F.col("scope")).alias("scope"), "id", F.date_format("created_at", "yyyy-MM-dd").alias("createdAt"))
    files = m.select(F.concat(F.lit("x"), F.col("id").cast("string"), F.lit(".json")).alias("path"), F.col("id").alias("ord"), F.to_json(F.struct(F.array(item).alias("items"))).alias("text"))
    return json_exports.json_items(files).select("uri", "item_id", "title", "scope", "at", F.sha2("text", 256).alias("digest"))


@query
def export_document(spark, sf_dir):
    """The export, a document of at most ``EXPORT_LIMIT`` rows a layer."""
    text = export.export_markdown(views.mem(spark, sf_dir), now=_NOW)
    return spark.createDataFrame([(text,)], "text string").select(F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"))


@query
def daily_document(spark, sf_dir):
    text = daily.to_markdown(daily.list_days(views.mem(spark, sf_dir), "src6"))
    return spark.createDataFrame([(text,)], "text string").select(F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"))

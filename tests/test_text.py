import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.functions import sqlfuncs
from tessera.functions import text as X
from tessera.operators import distill
from tessera.operators.retrieval import step_query, tokenize


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("query, texts", [("项目 约定", ["项目约定"]), ("pnpm cache", ["pnpm", "cache"]), ("", []), ("a a A", ["a"]), ("OR * ' NEAR(", ["OR", "NEAR"])])
def test_tokenize(query, texts):
    assert [t for t, _, _ in tokenize(query)] == texts


def test_tokenize_windows_kinds_quotes():
    assert len(tokenize("构建缓存应该怎么处理")) == 8
    assert {t: k for t, k, _ in tokenize("缓存 ab")} == {"缓存": "like", "ab": "like"}
    assert [k for _, k, _ in tokenize("abc")] == ["fts"]
    assert tokenize('"构建缓存应该"') == [("构建缓存应该", "fts", True)]
    assert len(tokenize(" ".join(f"word{i}" for i in range(20)))) == 8
    assert tokenize("x" * 100)[0][0] == "x" * 64


def test_step_query():
    messages = [{"role": "user", "source": {"kind": "user"}, "content": "first"}, {"role": "user", "source": {"kind": "tool"}, "content": "no"}, {"role": "assistant", "content": "no"}]
    assert step_query(messages) == "first"
    assert step_query([{"role": "user", "source": {"kind": "user"}, "content": [{"type": "text", "text": "a" * 3000}, {"type": "image"}]}]) == "a" * 2000
    assert step_query([]) == ""


@pytest.mark.parametrize("a, b, low, high", [("Use PNPM!", "use pnpm", 1, 1), ("we use pnpm here", "we use pnpm", 0.5, 1), ("alpha beta", "zu xy", 0, 0.3), ("", "", 1, 1), ("a", "", 0, 0)])
def test_similarity(spark, a, b, low, high):
    assert low <= one(spark, X.similarity(F.col("a"), F.col("b")), a=a, b=b) <= high


def test_containment_of_short_in_long(spark):
    short, long = "cache policy must be stable", "the cache policy must be stable and it is documented for every team and every service that we run in production here"
    assert one(spark, X.containment(F.col("a"), F.col("b")), a=short, b=long) > 0.85
    assert one(spark, X.similarity(F.col("a"), F.col("b")), a=short, b=long) < 0.5


@pytest.mark.parametrize("a, b, clash", [("这个项目用 pnpm", "这个项目不要用 pnpm", True), ("这个项目用 pnpm", "这个项目用 pnpm", False), ("这个项目用 pnpm", "不要用 tab 缩进", False), ("", "no", False)])
def test_contradict(spark, a, b, clash):
    assert one(spark, X.contradict(X.read_statement(F.col("a")), X.read_statement(F.col("b"))), a=a, b=b) is clash


@pytest.mark.parametrize("text, n", [("第一句。第二句！第三句？", 3), ("one. two!\nthree?", 3), ("use tabs, never spaces", 2), ("- 12\n- x", 1), ("", 0)])
def test_split_sentences(spark, text, n):
    assert len(one(spark, X.split_sentences(F.col("t")), t=text)) == n


def test_nfkc_in_comparison(spark):
    assert one(spark, X.normalize_for_compare(F.col("t")), t="Ｕｓｅ ﬁve, 项目！") == "usefive项目"


def test_titles_and_clamps(spark):
    assert one(spark, X.title_of(F.col("t"), F.col("b")), t=" ", b="- Use pnpm. Always") == "Use pnpm. Always"
    assert one(spark, X.title_of(F.col("t"), F.col("b")), t="kept ", b="x") == "kept"
    long = one(spark, X.short_title(F.col("t")), t="word " * 30)
    assert long.endswith("…") and len(long) <= 49
    assert one(spark, X.clamp_chars(F.col("t"), 30), t="line one is here\nline two is longer than that") == "line one is here …[已截断]"
    assert one(spark, X.clamp_chars(F.col("t"), 5), t="short") == "short"
    assert one(spark, X.clamp_chars(F.col("t"), 0), t="short") == ""
    assert one(spark, X.normalize_tags(F.array(*[F.lit(t) for t in [" a ", "a", "", "b" * 60, *map(str, range(20))]])))[:2] == ["a", "b" * 48]


def test_merged_body(spark):
    body = lambda a, b: one(spark, X.merged_body(F.col("a"), F.col("b")), a=a, b=b)
    assert body("x", "x") == "x" and body("x", "x y") == "x y" and body("x y", "x") == "x y" and body("x", "z") == "x\nz" and body("", "z") == "z"


def test_recency_and_relevance(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    at = lambda t: S.recency(F.lit(t).cast("timestamp"), now)
    assert one(spark, at("2024-02-01 00:00:00")) == 1
    assert one(spark, at("2024-01-18 00:00:00")) == pytest.approx(0.5)
    assert one(spark, at("2025-01-01 00:00:00")) == 1
    assert one(spark, at(None)) == 0
    assert one(spark, S.relevance_of_rank(F.lit(None).cast("double"))) == 0
    assert one(spark, S.relevance_of_rank(F.lit(0.0))) == 0.5


@pytest.mark.parametrize(
    "text, reason",
    [
        ("", "empty"), ("你还记得吗", "session-recall"), ("照旧", "vague"), ("abc", "too-short"), ("x" * 501, "too-long"), ("use pnpm ok?", "question"), ("maybe use pnpm", "hedged"),
        ("fix this file now", "session-scoped"), ("this project builds with pnpm", None),
    ],
)
def test_gate(spark, text, reason):
    assert one(spark, distill.reject_reason(F.col("t"), F.lit(True), F.lit(False)), t=text) == reason


def test_gate_lets_vouched_text_pass(spark):
    assert one(spark, distill.reject_reason(F.col("t"), F.lit(True), F.lit(True)), t="maybe x") is None


@pytest.mark.parametrize("kind, text, project, scope", [("preference", "用 pnpm", True, "project"), ("preference", "我个人喜欢用 tabs", True, "global"), ("fact", "用 pnpm", False, "global"), ("fact", "my name is Lee", True, "identity")])
def test_scope(spark, kind, text, project, scope):
    assert one(spark, distill.decide_scope(F.col("k"), F.col("t"), F.lit(project)), k=kind, t=text) == scope


def test_importance_order(spark):
    of = lambda k: one(spark, distill.importance(F.col("k"), F.col("t")), k=k, t="plain words")
    assert of("correction") > of("prohibition") > of("preference")
    assert one(spark, distill.importance(F.col("k"), F.col("t")), k="correction", t="never, always because ./x remember that") == 10


def test_extraction_carries_a_correction_over(spark):
    rows = spark.createDataFrame([(1, "更正一下，数据库是 postgres"), (2, "a\n- b\n- c\n- d\n- never e"), (3, None)], "msg_id int, message string")
    found = distill.extract_candidates(rows).collect()
    assert [(r["msg_id"], r["kind"], r["text"]) for r in found] == [(1, "correction", "更正一下：数据库是 postgres")]


def test_extraction_over_messages_counts_equal_texts_once(spark):
    rows = spark.createDataFrame([(1, 1, "never use tabs"), (1, 2, "Never use TABS"), (2, 1, "never use tabs")], "b int, m int, message string")
    assert sorted((r["b"], r["m"]) for r in distill.extract_from_messages(rows, "b", "m").collect()) == [(1, 1), (2, 1)]


def test_sql_functions_agree(spark):
    sqlfuncs.register(spark)
    text = spark.sql("SELECT mem_collapse('  a \\n b ') AS c, mem_jaccard(mem_bigrams('abc'), mem_bigrams('abd')) AS j, mem_is_day('2024-01-02') AS d, mem_item_hash('x', '', 'a  b') AS h").first()
    assert (text["c"], round(text["j"], 3), text["d"]) == ("a b", 0.333, True)
    assert text["h"] == one(spark, X.item_hash(F.lit("x"), F.lit(""), F.lit("a  b")))

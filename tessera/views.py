"""The engine's tables as views over the test tables, and small literal inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"

#: Statements for the extraction operators: id, text.
STATEMENTS = (
    (1, "Please always use pnpm here. Never commit secrets, it breaks the audit"),
    (2, "我喜欢简洁的回答。以后都用中文回答，不要用英文"),
    (3, "Actually we use postgres because mysql is slow"),
    (4, "更正一下，数据库是 postgres"),
    (5, "maybe we should use redis? not sure"),
    (6, "这个项目用 pnpm 管理依赖。记住：部署前先跑测试"),
    (7, "I'm a backend engineer, call me Lee"),
    (8, "- one\n- two\n- three\nuse four spaces\n- five"),
    (9, "Use tabs ```never do this``` and avoid `eval`; for now don't touch this file"),
    (10, "let's go with vite.\nour team agreed, remember that the build runs in ./scripts/build.sh"),
    (11, "照旧。我之前说过用 yarn 的"),
    (12, "how do i always win"),
)
#: Pairs of statements for the comparison operators: id, a, b.
PAIRS = (
    (1, "这个项目用 pnpm", "这个项目不要用 pnpm"),
    (2, "Use PNPM!", "use pnpm"),
    (3, "We deploy with docker on fridays", "never deploy with docker on fridays"),
    (4, "项目使用缓存", "不要用 tab 缩进"),
    (5, "", ""),
    (6, "a", ""),
    (7, "the cache policy must be stable and documented for all teams", "cache policy stable"),
)
QUERIES = ((1, "whed thti zu"), (2, "tionre ethese ou"), (3, "ungver einheit st"), (4, "thenderqqx en"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as memories."""
    d = documents(spark, sf_dir)
    scope = F.when(F.col("doc_id") % 4 == 0, "project").when(F.col("doc_id") % 4 == 2, "daily").otherwise("global")
    status = F.when(F.col("doc_id") % 7 == 0, "archived").when(F.col("doc_id") % 7 == 1, "outdated").when(F.col("doc_id") % 7 == 2, "pending").otherwise("active")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    minutes = lambda n: start + F.make_dt_interval(mins=n)
    created = minutes(F.col("doc_id").cast("int"))
    return d.select(
        F.col("doc_id").alias("id"), F.concat("lang", F.lit(" "), "source").alias("title"), "text", scope.alias("scope"), F.when(scope.isin("project", "daily"), F.col("source")).alias("project_key"),
        F.concat(F.lit("/work/"), "source").alias("project_path"), F.lit(None).cast("string").alias("sub_id"), F.array("lang", "source").alias("tags"),
        F.when(F.col("doc_id") % 3 == 0, "import").otherwise("auto").alias("source"), F.lit(None).cast("string").alias("source_platform"), (F.col("doc_id") % 5 == 0).alias("pinned"),
        (F.col("doc_id") % 11).cast("int").alias("importance"), F.when(F.col("doc_id") % 3 != 0, minutes((F.col("doc_id") * 37 % 43200).cast("int"))).alias("last_used_at"),
        created.alias("created_at"), created.alias("updated_at"), status.alias("status"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` as merge candidates."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select(
        (F.col("item_id") + 1).alias("cand_id"), F.lit("").alias("title"), "text", F.when(F.col("item_id") % 2 == 0, "global").otherwise("project").alias("scope"),
        F.when(F.col("item_id") % 2 == 1, F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))).alias("project_key"), F.array(F.lit("bench")).alias("tags"),
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as journal entries."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("project_key"), F.col("event_id").alias("ord"),
        F.col("event_type").alias("label"), F.concat(F.lit("value "), F.round("value", 1).cast("string")).alias("text"),
    )


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of ``conversations`` as items."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    uri = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"))
    return c.select(
        "text", uri.alias("uri"), F.concat_ws("|", uri, F.col("turn").cast("string")).alias("item_id"), F.lit(None).cast("string").alias("title"), F.array(F.lit("chat")).alias("tags"),
        F.lit(None).cast("string").alias("scope"), F.lit(None).cast("string").alias("at"), F.lit("utterance").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
    )


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of ``conversations``, each message followed by one of the statements in turn, as the tables' own prose holds no cues."""
    said = F.array(*[F.lit(message) for _, message in STATEMENTS])
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text IS NOT NULL")
    return c.withColumn("message", F.concat("text", F.lit("\n"), F.get(said, ((F.col("conv_id") + F.col("turn")) % len(STATEMENTS)).cast("int"))))


def statements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STATEMENTS), "msg_id int, message string")


def pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PAIRS), "pair_id int, a string, b string")

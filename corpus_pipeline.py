"""A corpus pipeline over ``documents``: language, quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes
every stage's result as Parquet in the shared folder and reads it back as the next one's input, whereupon
the stage's work files and its own input are deleted.

Defined results, stage by stage: the language stage rejects null texts and texts without a letter; the
quality stage judges every text it gets; for near-duplicates every row is a document of its own,
whatever its id, and texts without a word are kept; the passage stage keeps rows whose words all go, with
an empty text; packing gives a piece to each row, also to an empty one. Repeated rows are near-duplicates
of each other. Very long texts are handled whole in every stage, extra columns are kept up to the last,
and an empty table goes through all stages.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import fm_quality, langid, near_dup, packing, substring
from tessera.llm.common import broadcast_if_small, cut, delete, scratch, table, work_dir
from tessera.llm.queries import VOCABULARY

#: The stages train models and confirm links on full sets, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None

#: Column that numbers the rows inside a stage.
ROW = "__row"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a letter whose predicted language scores at least ``langid.MIN_SCORE``."""
    found = langid.identify(docs, langid.fit(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= langid.MIN_SCORE)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier predicts as good."""
    model = fm_quality.fit(docs, table(spark, sf_dir, "labels"))
    return fm_quality.classify(docs, model).where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group: the smallest id, rows without an id last.

    Every row counts as a document of its own, also where ids are null or repeated.
    """
    rows = cut(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")  # stored, as the numbers must not change
    found = near_dup.near_duplicates(rows, key=ROW).select(ROW, "component_id")
    groups = cut(found.join(rows.select(ROW, "doc_id"), ROW), "groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    dropped = cut(groups.select(ROW).join(first, ROW, "left_anti"), "dropped")
    return rows.join(broadcast_if_small(dropped), ROW, "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words that windows of 35 repeated words cover; a document keeps its row even if no word is left."""
    out = substring.remove_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("op8_language", language),
    ("op1_quality", quality),
    ("op4_near_duplicates", near_duplicates),
    ("op10_repeated_passages", repeated_passages),
    ("op7_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
        with scratch() as written:
            stage(spark, docs, sf_dir).write.parquet(path)
        for old in [*written, *([before] if before else [])]:
            delete(spark, old)
        docs, before = spark.read.parquet(path), path
    return docs

"""The registered queries of the training-data operators: thin layers that derive the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fm_quality, langid, merkle, near_dup, packing, rules, substring, topk
from .common import held_out, table

VOCABULARY = "word_bpe_49k.json"


def op1_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = fm_quality.fit(docs, table(spark, sf_dir, "labels"))
    return fm_quality.classify(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits ``pages`` against a replica in which some records have a flipped byte, are cut short or are lost."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    flipped = F.concat(F.lit("~"), F.substring("html", 2, 2**31 - 1))
    body = F.when(F.col("page_id") % 211 == 7, flipped).when(F.col("page_id") % 1009 == 11, F.left("html", F.lit(10))).otherwise(F.col("html"))
    replica = pages.where("page_id IS NULL OR page_id % 2003 <> 13").withColumn("html", body)
    return merkle.audit(merkle.manifest(pages), merkle.manifest(replica)).withColumnRenamed("id", "page_id")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rules.ledger(table(spark, sf_dir, "documents"))
    base = F.col("fail_bits").bitwiseAND(F.lit(rules.mask(("base", 1)))) != 0
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits", base.alias("base_failed"), rules.passes().alias("kept"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_chats(turns.unionByName(planted)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs, digests=True).select("doc_id", "n_words", "n_removed", F.col("text").alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fm_quality": op1_fm_quality,
    "op2_exact_topk": op2_exact_topk,
    "op3_merkle_audit": op3_merkle_audit,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_rule_ledger": op5_rule_ledger,
    "op6_chat_format": op6_chat_format,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_gru_language": op8_gru_language,
    "op9_bpe_backtracking": op9_bpe_backtracking,
    "op10_substring_dedup": op10_substring_dedup,
}

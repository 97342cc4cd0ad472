"""Values and sizes that the small test tables do not reach."""

import time

from pyspark.sql import functions as F

from tests.compare import rows_of, rows_of_sql

from tessera import views
from tessera.operators import daily, importing, merge
from tessera.oracle import ORACLE_SQL
from tessera.queries import QUERIES
from tessera.sources import json_exports


def shifted(spark, folder, by):
    """The smallest documents under ids of a larger table."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    d.withColumn("doc_id", F.col("doc_id") + by).write.parquet(f"{folder}/documents.parquet")
    for name in ("benchmark", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def same_as_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    assert rows_of(QUERIES[name](spark, folder)) == rows_of_sql(con, ORACLE_SQL[name])


def test_panel_clamps_takes_offsets_past_an_int(spark, tmp_path):
    same_as_sql(spark, shifted(spark, tmp_path, 256_000), "panel_clamps")


def test_mem_update_moves_only_what_changes(spark, tmp_path):
    """The row of id 44640 was made, and last updated, at the time of the update."""
    same_as_sql(spark, shifted(spark, tmp_path, 44_600), "mem_update")


def timed(query, spark, folder, seconds):
    start = time.monotonic()
    rows = query(spark, folder).collect()
    assert time.monotonic() - start < seconds
    return rows


def test_merge_plan_is_one_pass_over_the_rows(spark):
    """Pairs of a candidate and a row of its layer took more than 260 seconds at this size."""
    assert len(timed(QUERIES["merge_plan_snapshot"], spark, "/root/testdata/sf0.1", 120)) == 200


def test_widened_and_applied_merges_compare_once(spark):
    """Each holds at least one plan as above; the applied one held three."""
    assert len(timed(QUERIES["merge_widened"], spark, "/root/testdata/sf0.1", 120)) == 200
    assert timed(QUERIES["merge_apply_snapshot"], spark, "/root/testdata/sf0.1", 120)


def test_generic_json_lines_holds_no_file_whole(spark, monkeypatch):
    """Before, each of its 20 files was one row, a twentieth of all texts, and failed by executor memory at 6 GB."""
    folder, given = "/root/testdata/sf0.01", []
    monkeypatch.setattr(json_exports, "json_lines", lambda files, read=json_exports.json_lines: given.append(files) or read(files))
    items = QUERIES["generic_json_lines"](spark, folder)
    longest = views.documents(spark, folder).agg(F.max(F.length(F.to_json(F.struct("text"))))).first()[0]
    assert given[0].agg(F.max(F.length("text"))).first()[0] < longest + 200
    assert not any(node in items._jdf.queryExecution().executedPlan().toString() for node in ("Aggregate", "Exchange", "Window"))


def test_generic_json_lines_keeps_rows_of_any_id(spark, tmp_path):
    """Before, odd ids below 0 and null ids gave lines without a text."""
    same_as_sql(spark, shifted(spark, tmp_path, F.when(F.col("doc_id") % 3 > 0, -1000)), "generic_json_lines")


def test_generic_json_lines_are_numbered_in_their_files(spark, monkeypatch):
    folder, given = "/root/testdata/sf0.001", []
    monkeypatch.setattr(json_exports, "json_lines", lambda files, read=json_exports.json_lines: given.append(files) or read(files))
    QUERIES["generic_json_lines"](spark, folder)
    rows = given[0].collect()
    whole = [(f"x{g}.jsonl", g, "\n".join(r["text"] for r in sorted((r for r in rows if r["ord"] == g), key=lambda r: r["id"]))) for g in range(20)]
    monkeypatch.undo()
    expected = json_exports.json_lines(spark.createDataFrame(whole, "path string, ord long, text string"))
    assert json_exports.json_lines(given[0]).orderBy("ord").collect() == expected.orderBy("ord").collect()


def shuffles_texts(frame):
    """Whether the plan deals the memories out and sorts them for a join."""
    return "SortMergeJoin" in frame._jdf.queryExecution().executedPlan().toString()


def test_applied_merges_leave_the_memories_where_they_lie(spark):
    """Before, the next snapshot shuffled and sorted every memory with its text to meet a few changes."""
    m, c = views.mem(spark, "/root/testdata/sf0.01"), views.candidates(spark, "/root/testdata/sf0.01")
    assert not shuffles_texts(merge.apply_plan(m, c, merge.plan(c, m), F.lit(views.NOW).cast("timestamp")))


def test_imports_leave_the_memories_where_they_lie(spark):
    m = views.mem(spark, "/root/testdata/sf0.01")
    now = F.lit(views.NOW).cast("timestamp")
    accepted = views.candidates(spark, "/root/testdata/sf0.01")
    more = [F.lit(None).cast("int").alias("importance"), F.lit("import").alias("source"), F.lit(None).cast("string").alias("source_platform"), F.lit(None).cast("string").alias("project_path")]
    accepted = accepted.select("*", *more)
    folded = spark.createDataFrame([(1, "new", None, 0.0), (2, "merge", 3, 0.9), (3, "update", 4, 0.9)], "cand_id bigint, decision string, target bigint, score double")
    after, made = importing.apply_fold(m, accepted, folded, now)
    assert not shuffles_texts(after)
    assert {r["id"]: r["status"] for r in after.where("id IN (3, 4)").collect()} == {3: m.where("id = 3").first()["status"], 4: "outdated"} and made.count() == 2
    entries = spark.createDataFrame([("2024-01-09", "src1", 1, None, "a line")], "day string, project_key string, ord bigint, label string, text string")
    assert not shuffles_texts(daily.append(m, entries, now))

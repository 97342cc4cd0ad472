from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import assemble, daily, importing, merge, relational
from tessera.operators.model import ITEMS, LEDGER, MEMORIES, MEMORY_COLUMNS, TAGS, Query
from tessera.plans.api import Memory, MemoryError_, Session, key_for, resolve_identity
from tessera.plans.store import Store, validate_panel
from tessera.plans.work import number_rows

def NOW():
    return F.lit("2024-06-15 12:00:00").cast("timestamp")


AT = datetime(2024, 6, 15, 12)


def memories(spark, *rows):
    """rows: dicts over defaults."""
    base = {"title": "", "scope": "global", "project_key": None, "project_path": None, "sub_id": None, "tags": [], "source": "auto", "source_platform": None, "pinned": False, "importance": 0,
            "last_used_at": None, "created_at": datetime(2024, 1, 1), "updated_at": datetime(2024, 1, 1), "status": "active"}
    full = [{**base, "id": i + 1, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c] for c in MEMORY_COLUMNS) for r in full], MEMORIES)


def candidates(spark, *rows):
    shown = [(i + 1, r.get("title", ""), r["text"], r.get("scope", "global"), r.get("project_key"), r.get("tags", [])) for i, r in enumerate(rows)]
    return spark.createDataFrame(shown, "cand_id bigint, title string, text string, scope string, project_key string, tags array<string>")


def test_empty_tables_give_empty_lists(spark):
    m = memories(spark)
    assert relational.list_memories(m, Query()).count() == 0
    assert relational.count(m, Query()).first()["n"] == 0
    assert {r["n"] for r in relational.overview(m).collect()} == {0}
    assert merge.plan(candidates(spark, {"text": "x"}), m).first()["decision"] == "new"
    assert assemble.turn_context(m, None).count() == 1


def test_null_key_is_a_layer(spark):
    m = memories(spark, {"text": "a", "project_key": None}, {"text": "b", "project_key": "k", "scope": "project"})
    pick = lambda q: [r["id"] for r in relational.list_memories(m, q).collect()]
    assert pick(Query(by_project=True)) == [1]
    assert pick(Query(by_project=True, project_key="k")) == [2]
    assert pick(Query(any_project=True, by_project=True)) == [2]
    assert pick(Query(scope=("project",), pinned=False)) == [2]
    assert sorted(pick(Query(limit=1, offset=1)) + pick(Query(limit=1))) == [1, 2]


def test_eviction_keeps_pinned_and_recent(spark):
    m = memories(spark, {"text": "p", "pinned": True}, {"text": "old", "last_used_at": datetime(2000, 1, 1)}, {"text": "new", "last_used_at": datetime(2024, 5, 1)})
    assert [r["id"] for r in relational.eviction_candidates(m, 0).collect()] == [3, 2]
    assert [r["id"] for r in relational.eviction_candidates(m, 1).collect()] == [2]


def test_insert_numbers_and_defaults(spark):
    new = spark.createDataFrame([(i, f" text {i} ", ["b", "a", "b"]) for i in range(50)], "ord bigint, text string, tags array<string>")
    out = relational.insert(memories(spark, {"text": "x"}), new, NOW()).where("id > 1").orderBy("id").collect()
    assert [r["id"] for r in out] == list(range(2, 52)) and [r["text"] for r in out] == [f"text {i}" for i in range(50)]
    assert (out[0]["scope"], out[0]["status"], out[0]["tags"], out[0]["pinned"]) == ("global", "active", ["b", "a"], False)
    with pytest.raises(Exception, match="needs text"):
        relational.insert(memories(spark), spark.createDataFrame([("  ",)], "text string"), NOW()).collect()


def test_number_rows_spans_parts(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 7 % 1000).alias("k"))
    assert [r["__n"] for r in number_rows(df, "k").orderBy("k").collect()] == list(range(1, 1001))


def test_remove_cascades(spark):
    m = memories(spark, {"text": "a"}, {"text": "b"})
    tags = spark.createDataFrame([(1, "t", 0), (2, "t", 0)], TAGS)
    ledger = spark.createDataFrame([("h1", 1, None), ("h2", 2, None)], LEDGER)
    left, kept, freed = relational.remove(m, tags, ledger, spark.createDataFrame([(1,)], "id bigint"))
    assert [r["id"] for r in left.collect()] == [2] and kept.count() == 1
    assert {r["hash"]: r["memory_id"] for r in freed.collect()} == {"h1": None, "h2": 2}


def test_record_imports_last_wins(spark):
    ledger = spark.createDataFrame([("h", 1, None)], LEDGER)
    entries = spark.createDataFrame([("h", 2, None, 1), ("h", 3, None, 2), ("g", None, None, 3)], LEDGER + ", ord bigint")
    assert {r["hash"]: r["memory_id"] for r in relational.record_imports(ledger, entries).collect()} == {"h": 3, "g": None}


@pytest.mark.parametrize(
    "stored, candidate, decision",
    [
        ("use pnpm here", "Use PNPM here!", "ignore"), ("we build with vite", "we build with vite and rollup", "merge"), ("我们用 pnpm 管理依赖", "我们不要用 pnpm 管理依赖", "update"),
        ("alpha beta", "zulu xy", "new"),
    ],
)
def test_merge_decisions_agree_in_both_modes(spark, stored, candidate, decision):
    m, c = memories(spark, {"text": stored}), candidates(spark, {"text": candidate})
    assert merge.plan(c, m).first()["decision"] == decision
    assert merge.sequential(c, m).first()["decision"] == decision


def test_other_project_does_not_compete(spark):
    m = memories(spark, {"text": "use pnpm here", "scope": "project", "project_key": "a"})
    c = candidates(spark, {"text": "use pnpm here", "scope": "project", "project_key": "b"})
    assert merge.plan(c, m).first()["decision"] == "new" and merge.sequential(c, m).first()["decision"] == "new"


def test_snapshot_merges_append_in_order(spark):
    m = memories(spark, {"text": "we build with vite here", "tags": ["x"]})
    c = candidates(spark, {"text": "we build with vite first", "tags": ["y"]}, {"text": "we build with vite first again", "tags": ["x", "z"]})
    out = merge.apply_plan(m, c, merge.plan(c, m), NOW()).collect()
    assert [(r["text"], r["tags"]) for r in out] == [("we build with vite here\nwe build with vite first\nwe build with vite first again", ["x", "y", "z"])]


def test_sequential_sees_earlier_candidates(spark):
    c = candidates(spark, {"text": "use tabs in go files"}, {"text": "use tabs in go files"}, {"text": "never use tabs in go files"})
    out = {r["cand_id"]: (r["decision"], r["target"]) for r in merge.sequential(c, memories(spark)).collect()}
    assert out == {1: ("new", None), 2: ("ignore", -1), 3: ("update", -1)}


def test_daily_append_revives_and_purges(spark):
    m = memories(spark, {"text": "- a", "scope": "daily", "title": "2024-06-01", "status": "archived"}, {"text": "- old", "scope": "daily", "title": "2024-01-01", "project_key": "k"})
    entries = spark.createDataFrame([("2024-06-01", None, 1, "fix", " b "), ("2024-06-02", "k", 2, None, "c"), ("nope", None, 3, None, "d"), ("2024-06-02", "k", 4, None, " ")], "day string, project_key string, ord int, label string, text string")
    out = daily.append(m, entries, NOW())
    assert sorted((r["title"], r["project_key"], r["text"], r["status"]) for r in out.where("title > '2024-05'").collect()) == [("2024-06-01", None, "- a\n\n- [fix] b", "active"), ("2024-06-02", "k", "- c", "active")]
    assert [r["date"] for r in daily.stale(out, NOW()).collect()] == ["2024-01-01"]
    assert {r["title"]: r["status"] for r in daily.purge(out, NOW()).collect()}["2024-01-01"] == "archived"
    assert daily.to_markdown(daily.list_days(out)) == "# Daily log\n\n## 2024-06-01\n\n- a\n\n- [fix] b\n"


def fold(spark, sections, budget):
    rows = spark.createDataFrame([(sections,)], "s array<struct<name: string, text: string, partial: boolean>>")
    row = rows.withColumn("f", assemble.apply_budget(F.col("s"), budget)).select(assemble.budget_text(F.col("f")).alias("t"), assemble.describe_budget(F.col("f")).alias("d")).first()
    return row["t"], row["d"]


def test_budget_keeps_order_and_skips(spark):
    assert fold(spark, [("a", "x" * 10, False), ("b", "y" * 100, False), ("c", "z", False)], 20) == ("x" * 10 + "\n\nz", "a: 10 chars, b: dropped, c: 1 chars")
    assert fold(spark, [("a", "x", False)], 0) == ("", "a: dropped")
    assert fold(spark, [], 10) == ("", "nothing injected")
    text, told = fold(spark, [("a", "first line\n" + "w " * 200, True)], 60)
    assert len(text) <= 60 and text.endswith("…[已截断]") and "truncated" in told


def test_fit_index_cuts_at_a_line_and_recounts(spark):
    m = memories(spark, *[{"text": f"entry number {i}"} for i in range(100)])
    row = assemble.fit_index(m, "id", 200).first()
    assert len(row["text"]) <= 200 and row["text"].startswith(f"[记忆索引 · {row['n']} 条]") and row["text"].count("\n") == row["n"]


def test_context_does_not_grow_with_the_store(spark):
    shown = [assemble.turn_context(memories(spark, *[{"text": f"entry {i:04d}", "created_at": datetime(2024, 1, 1, 0, 0, 0, 10_000 - i)} for i in range(n)]), None).first()["used_chars"] for n in (100, 400)]
    assert max(shown) <= 900


def test_delivered_cards_saturate(spark):
    given = spark.createDataFrame([("s", i, i) for i in range(10)], "session string, id bigint, ord bigint")
    ledger = assemble.deliver(given.limit(0), given, 4)
    assert ledger.count() == 4 and assemble.undelivered(given, ledger).count() == 6


def test_import_counters_and_ledger(spark):
    rows = [("use pnpm in this repo", "u", f"i{i}", None, ["t"], None, None, "entry", i) for i in range(2)]
    rows += [("x" * 9000, "u", "big", None, None, None, None, "entry", 2), ("did it", "u", "day", "2024-06-01", None, "daily", None, "entry", 3), ("no day", "u", "bad", None, None, "daily", None, "entry", 4)]
    items = spark.createDataFrame(rows, ITEMS)
    m, ledger = memories(spark, {"text": "unrelated words"}), spark.createDataFrame([], LEDGER)
    after, ledger, report = importing.run(items, m, ledger, NOW())
    counts = report.first().asDict()
    assert (counts["written"], counts["ignored"], counts["oversized"], counts["logged"], counts["known"]) == (1, 1, 1, 1, 0)
    assert after.count() == 3 and ledger.count() == 3
    again = importing.run(items, after, ledger, NOW())[2].first()
    assert (again["known"], again["written"]) == (3, 0)


def test_facade_round_trip(spark, tmp_path):
    api = Memory(Store(spark, f"file://{tmp_path}/store"), AT)
    me = Session("proj", "/work/proj")
    assert api.store.version() == 0 and api.store.migrate() == 1 and api.store.migrate() == 1
    first = api.remember(me, "this project always builds with vite", tags=("build",))
    assert first["decision"] == "new" and api.get(first["id"])["project_key"] == "proj"
    assert api.remember(me, "this project always builds with vite")["decision"] == "ignore"
    changed = api.remember(me, "this project never builds with vite")
    assert changed["decision"] == "update" and api.get(first["id"])["status"] == "outdated"
    assert api.remember(me, "照旧")["reason"] == "vague"
    with pytest.raises(MemoryError_):
        api.remember(Session(), "x y z w", scope="project")
    assert [r["id"] for r in api.search(me, "builds with vite").collect()] == [changed["id"]]
    assert api.search(Session(), "builds with vite").count() == 0
    assert api.search(me, scopes=("project",)).count() == 1 and api.search(me).count() == 1
    assert api.forget(Session("other"), changed["id"]) == "other-project"
    assert api.update(changed["id"], importance=99, title="Build")["importance"] == 5
    with pytest.raises(MemoryError_):
        api.update(changed["id"], nonsense=1)
    api.log(me, [("note", "shipped")], "2024-06-14")
    assert [r["date"] for r in api.daily(me).collect()] == ["2024-06-14"]
    assert "shipped" in api.export() and "## 项目记忆 Project" in api.export()
    assert "Build" in api.context(me, "vite")
    assert api.overview()["status"]["outdated"] == 1 and api.list(limit=1)[1] == 3
    assert api.forget(me, changed["id"]) == "archived" and api.forget(me, changed["id"]) == "already-archived" and api.forget(me, 99) == "unknown"
    assert api.store.has_active() and api.purge_daily(0) == 1


def test_panel_validation_and_identity(tmp_path):
    assert validate_panel({"limit": 100_000, "offset": -1, "importance": 9, "tags": ["x" * 50]}) == {"limit": 200, "offset": 0, "importance": 5, "tags": ["x" * 40]}
    with pytest.raises(ValueError):
        validate_panel({"scope": "none"})
    assert key_for("git", "/A/b") == key_for("git", "/a/B") != key_for("path", "/a/b")
    (tmp_path / "p" / "q").mkdir(parents=True)
    (tmp_path / "p" / "package.json").write_text("{}")
    assert resolve_identity(str(tmp_path / "p" / "q")).project_path == str(tmp_path / "p")


def test_candidates_far_into_a_message_stay_apart(spark):
    """Cues in clauses 16 and 17 of an item are two candidates, stored once each under their own ledger ids."""
    text = ". ".join([*[f"plain remark number {i}" for i in range(15)], "always use pnpm for installing packages", "never commit generated files to the repo"])
    items = spark.createDataFrame([(text, "u", "i1", None, ["t"], None, None, "utterance", 1)], ITEMS)
    after, ledger, report = importing.run(items, memories(spark, {"text": "unrelated words"}), spark.createDataFrame([], LEDGER), NOW())
    assert report.first()["written"] == 2 and after.count() == 3
    stored = {r["id"]: r["text"] for r in after.collect()}
    assert [r["memory_id"] in stored and r["memory_id"] > 1 for r in ledger.collect()] == [True]


def test_import_ledger_points_to_the_own_project(spark):
    """The same text in two projects: the ledger holds the row that this run made."""
    items = spark.createDataFrame([("use pnpm in this repo", "u", "i", None, None, "project", None, "entry", 1)], ITEMS)
    m = memories(spark, {"text": "use pnpm in this repo", "scope": "project", "project_key": "other", "id": 90})
    after, ledger, _ = importing.run(items, m, spark.createDataFrame([], LEDGER), NOW(), importing.Request(project_key="mine"))
    own = after.where("project_key = 'mine'").first()["id"]
    assert own != 90 and [r["memory_id"] for r in ledger.collect()] == [own]


@pytest.mark.parametrize("scope, key, target", [("global", None, 1), ("project", "k", 2), ("project", "z", None)])
def test_corrections_look_beyond_their_layer(spark, scope, key, target):
    """A correction that plans as new retires the newest row it contradicts; with a project key only rows of that key."""
    m = memories(spark, {"text": "deploys run with docker on fridays", "scope": "project", "project_key": "p"}, {"text": "deploys run with docker on fridays", "scope": "daily", "project_key": "k", "created_at": datetime(2023, 1, 1)})
    c = candidates(spark, {"text": "never deploys run with docker on fridays", "scope": scope, "project_key": key})
    for kind, want in (("correction", target), ("preference", None)):
        given = c.withColumn("kind", F.lit(kind))
        for rows in (merge.plan(given, m), merge.sequential(given, m)):
            row = rows.first()
            assert (row["decision"], row["target"]) == (("update", want) if want else ("new", None))


def test_identity_is_written_to_global(spark, tmp_path):
    m = memories(spark, {"text": "I'm a backend engineer"})
    c = candidates(spark, {"text": "I'm a backend engineer", "scope": "identity"}, {"text": "call me Lee from now on", "scope": "identity"})
    assert [r["decision"] for r in merge.plan(c, m).orderBy("cand_id").collect()] == ["ignore", "new"]
    assert [r["decision"] for r in merge.sequential(c, m).orderBy("cand_id").collect()] == ["ignore", "new"]
    assert {r["scope"] for r in merge.apply_plan(m, c, merge.plan(c, m), NOW()).collect()} == {"global"}
    api = Memory(Store(spark, f"file://{tmp_path}/store"), AT)
    first = api.remember(Session("p", "/w"), "I'm a backend engineer")
    again = api.remember(Session("p", "/w"), "I'm a backend engineer")
    assert first["decision"] == "new" and (again["decision"], again["id"]) == ("ignore", first["id"])
    assert api.memories().first()["scope"] == "global"


def test_distill_messages(spark):
    messages = spark.createDataFrame([(1, "we always use tabs in go files. how are you"), (2, "never use tabs in go files"), (3, "call me Lee, I'm a backend engineer")], "ord bigint, message string")
    after, report = importing.distill_messages(messages, memories(spark), NOW(), "k")
    counts = report.first().asDict()
    assert counts["written"] >= 2 and counts["updated"] == 1
    rows = after.collect()
    assert len(rows) == counts["written"] + counts["updated"] and {r["scope"] for r in rows} <= {"global", "project"}
    assert sum(r["status"] == "outdated" for r in rows) == 1
    assert importing.distill_messages(messages, memories(spark), NOW(), dry_run=True)[0].count() == 0
    assert importing.distill_messages(messages.limit(0), memories(spark), NOW())[1].first()["written"] == 0

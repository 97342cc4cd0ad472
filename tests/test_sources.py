import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import fixed as V
from tessera.plans.api import Memory, Session
from tessera.plans.store import Store
from tessera.queries import _CHATGPT, _CLAUDE, _NOTE, _STORE
from tessera.sources import archives, files, json_exports, metrics, notes
from tessera.streaming import incremental


def of(spark, text, path="f"):
    return spark.createDataFrame([(path, 0, text)], "path string, ord long, text string")


def test_chatgpt_turns_in_time_order(spark):
    items = json_exports.chatgpt(of(spark, _CHATGPT)).orderBy("ord").collect()
    assert [i["text"] for i in items] == ["first", "Book it for\ntwo weeks", "later"]
    assert items[0]["at"] == "1970-01-01T00:00:10.500Z" and items[0]["uri"] == "f#Trip"


def test_scan_metrics(spark):
    files = of(spark, _CHATGPT)
    row = metrics.scan_metrics("chatgpt", files, json_exports.chatgpt(files)).first()
    assert (row["files"], row["items"], row["skipped"]) == (1, 3, 2)  # an assistant's turn and an element that is a number
    assert metrics.describe({"scanned": 2, "considered": 1, "written": 1, "truncated": True}) == "1 of 2 items considered: 1 written (truncated)"


def test_claude_web_attachment(spark):
    items = json_exports.claude_web(of(spark, _CLAUDE)).orderBy("ord").collect()
    assert [i["text"] for i in items] == ["hello", f"see file\n\n{V.ATTACHMENT_MARKER}\nbody text"]


def test_claude_memories_three_fields(spark):
    text = json.dumps([{"conversations_memory": "intro\n**Work**\nuses vite. more\n**Empty**\n\n**Home**\nhas cats", "project_memories": {"0123456789": "body"}, "memory_files": [{"path": "/a/b.md", "content": " c "}, {"content": ""}]}])
    items = json_exports.claude_memories(of(spark, text)).orderBy("ord").collect()
    assert [(i["title"], i["text"]) for i in items] == [("Work · uses vite", "uses vite. more"), ("Home · has cats", "has cats"), ("Claude project memory · 01234567 · body", "body"), ("Claude memory file · b.md · c", "c")]


def test_transcripts_skip_meta_and_sidechains(spark):
    lines = [
        {"type": "user", "sessionId": "s1", "cwd": "/w", "message": {"content": " hi "}}, {"type": "user", "isMeta": True, "message": {"content": "meta"}},
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "yo"}]}}, {"type": "user", "message": {"content": [{"type": "tool_result"}]}},
    ]
    text = "\n".join([*map(json.dumps, lines), "not json"])
    items = json_exports.transcripts(of(spark, text, "p/x.jsonl").union(of(spark, text, "p/subagents/y.jsonl"))).collect()
    assert [(i["text"], i["uri"], i["tags"]) for i in items] == [("hi", "p/x.jsonl#s1", ["claude", "claude-code", "/w"])]


def test_generic_json(spark):
    lines = ['{"export": 1}', '{"content": " a  ", "subject": "S", "tags": ["x", 1], "scope": "daily", "id": 7}', '"plain"', "{}", "oops", '{"text": 5, "note": "n", "scope": "odd"}']
    items = json_exports.json_lines(of(spark, "\n".join(lines))).orderBy("ord").collect()
    assert [(i["text"], i["title"], i["tags"], i["scope"], i["item_id"]) for i in items] == [("a", "S", ["x"], "daily", "file|7"), ("plain", None, None, None, None), ("n", None, None, None, None)]
    wrapped = json_exports.json_items(of(spark, '{"items": [{"text": "a"}, {"body": "b"}], "x": 1}')).orderBy("ord").collect()
    assert [i["text"] for i in wrapped] == ["a", "b"]
    assert [i["text"] for i in json_exports.json_items(of(spark, '{"text": "one"}')).collect()] == ["one"]


def test_json_lines_in_parts_are_those_of_the_whole_file(spark):
    """Before, a file had to be one row; parts were numbered each from 1."""
    lines = ['{"export": 1}', '{"text": "a", "id": 1}', "", '"b"\r', '{"note": "c"}', "oops", "{}", '{"body": "d"}']
    whole = json_exports.json_lines(of(spark, "\n".join(lines))).orderBy("ord").collect()
    rows = [("f", 0, "\n".join(lines[i:j]) + end, i) for i, j, end in ((4, 8, ""), (0, 1, "\n"), (1, 4, ""))]
    parts = json_exports.json_lines(spark.createDataFrame(rows, "path string, ord long, text string, first long")).orderBy("ord").collect()
    assert parts == whole and [(i["text"], i["uri"]) for i in parts] == [("a", "f:2"), ("b", "f:4"), ("c", "f:5"), ("d", "f:8")]


def parsings(frame):
    """How often the plan has an element parsed as a variant."""
    return frame._jdf.queryExecution().optimizedPlan().toString().count("parseJson(")


def test_generic_items_parse_an_element_once(spark):
    """Before, the filter of empty texts was pushed below the parsing, and parsed the element again for each key."""
    for read, text in ((json_exports.json_lines, '{"text": "a"}\n{"text": " "}'), (json_exports.json_items, '[{"text": "a"}, {"text": null}]')):
        items = read(spark.createDataFrame([("f", 0, text)], "path string, ord long, text string"))
        assert parsings(items) == 1 and [i["text"] for i in items.collect()] == ["a"]


def test_markdown_by_headings_or_paragraphs(spark):
    by_head = notes.markdown(of(spark, "pre\n# A\none\n---\n## B\n\ntwo\n#### c\n")).orderBy("ord").collect()
    assert [(i["title"], i["text"], i["uri"]) for i in by_head] == [(None, "pre", "f#1"), ("A", "one", "f#A"), ("B", "two\n#### c", "f#B")]
    paras = notes.markdown(of(spark, "# only\n\nfirst\nline\n\n\n- second")).orderBy("ord").collect()
    assert [i["text"] for i in paras] == ["# only", "first\nline", "- second"]


def test_note_headers(spark):
    quoted = '---\nname: "say \\"hi\\""\ntype: project\nmetadata: {type: user}\nkey no colon\n---\nbody'
    rows = [("p/projects/shop-0123456789abcdef/memory/a.md", _NOTE), ("b.md", "---\ncreatedAt: 2024-01-02T00:00:00Z\n---\nx"), ("x/MEMORY.md", "x"), ("x/c.md", "---\nname: n\n---\n"), ("solo.md", "text"),
            ("q/topics/d.md", quoted), ("e.md", "---\r\nmetadata: {a: 1, type: reference}\r\n---\r\nbody\r\n")]
    files = spark.createDataFrame([(p, t, i) for i, (p, t) in enumerate(rows)], "path string, text string, ord long")
    items = {i["uri"].split("#")[0]: i for i in notes.project_notes(files).collect()}
    a = items.pop(rows[0][0])
    assert (a["title"], a["tags"], a["text"], a["at"]) == ("Build rules", ["zcode", "shop", "feedback"], "Use pnpm.", None)  # fields after metadata are its own
    assert items["b.md"]["at"] == "2024-01-02T00:00:00Z" and items["b.md"]["title"] == "b"
    assert items["solo.md"]["tags"] == ["zcode", "root", "other"] and "x/MEMORY.md" not in items and "x/c.md" not in items
    assert (items["q/topics/d.md"]["title"], items["q/topics/d.md"]["tags"]) == ('say "hi"', ["zcode", "q", "project"])
    assert items["e.md"]["tags"][2] == "reference" and items["e.md"]["text"] == "body"
    assert notes.project_notes(files.limit(0)).count() == 0


def test_store_plan(spark):
    paths = ["h/.codebuddy/memory/b_memory.md", "h/.workbuddy/SOUL.md", "h/.workbuddy/MEMORY.md", "h/.workbuddy/memory/2024-01-01.md", "h/.deepseek-harness/MEMORY.md", "h/notes/MEMORY.md", "h/notes/USER.md", "h/notes/2024-01-02.md", "h/other/x.md"]
    files = spark.createDataFrame([(p, "t", i) for i, p in enumerate(paths)], "path string, text string, ord long")
    got = [r["path"] for r in notes.plan_store(files).orderBy("ord").collect()]
    assert got == [paths[4], paths[2], paths[3], paths[0], paths[5], paths[7]]


def test_memory_files_sections_and_duplicates(spark):
    rows = spark.createDataFrame([("w/.workbuddy/memory/x_memory.md", _STORE, 0), ("w/.codebuddy/memory/y_memory.md", "## T\nBuilds  with vite.", 1), ("w/d/2024-01-02.md", "- did it", 2)], "path string, text string, ord long")
    items = notes.memory_files(rows).orderBy("ord").collect()
    assert [(i["title"], i["text"]) for i in items] == [("Style · Prefers **short** answers", "Prefers **short** answers\n  with examples"), ("Work", "Builds with vite."), ("2024-01-02", "did it")]
    said = spark.createDataFrame([("keep\nx RAW_JSON_START y",), ("**Tone**: (optional)",), ("Tone: calm",)], "t string")
    assert [tuple(r) for r in said.select(notes.without_raw(F.col("t")), notes.fill_in(F.col("t"))).collect()] == [("keep", False), ("**Tone**: (optional)", True), ("Tone: calm", False)]
    rows = spark.createDataFrame([("a_memory.md", "lead\n\n  - one\n    - deep\n  - two\n# S\n\nplain\n***\nrest\n## Empty\n", 0)], "path string, text string, ord long")
    assert [(i["title"], i["text"]) for i in notes.memory_files(rows).orderBy("ord").collect()] == [("lead", "lead\none\n    - deep"), ("two", "two"), ("S", "plain\nrest")]


def test_json_array_streams_over_block_ends():
    values = [{"a": 'x[]{}," \\'}, 12, "s", [1, [2]], None]
    for text in (json.dumps(values), json.dumps({"exported": {"items": [9]}, "conversations": values, "z": 1})):
        for block in (3, 7, 65_536):
            assert list(archives.json_array(io.StringIO(text), block=block)) == values
    assert list(archives.json_array(io.StringIO('[1, {"a": '))) == [1] and list(archives.json_array(io.StringIO("{}"))) == []


def test_detection(tmp_path):
    write = lambda name, text: ((p := tmp_path / name).parent.mkdir(parents=True, exist_ok=True), p.write_text(text), str(p))[2]
    assert files.detect(write("a/conversations.json", '[{"mapping": {}}]')) == "chatgpt"
    assert files.detect(write("b/c.json", '{"chat_messages": []}')) == "claude-web"
    assert files.detect(write("c/m.json", '{"memory_files": []}')) == "claude-memories"
    assert files.detect(write("d/t.jsonl", '{"sessionId": 1}')) == "claude-code" and files.detect(write("d2/t.jsonl", "{}")) == "generic"
    assert files.detect(write("e/x_memory.md", "x")) == "workbuddy" and files.detect(write("e2/n.txt", "x")) == "generic"
    assert files.detect(write("f/n.json", '{"items": []}')) == "generic" and files.detect(write("f/n.bin", "x")) is None
    write("g/.workbuddy/memory/a.md", "x"), write("h/projects/p/memory/a.md", "x"), write("i/p/t.jsonl", "{}"), write("j/n.md", "x")
    assert [files.detect(str(tmp_path / d)) for d in "aghij"] == ["chatgpt", "workbuddy", "zcode", "claude-code", "generic"]
    assert files.detect(str(tmp_path / "none")) is None


def test_zip_import_end_to_end(spark, tmp_path):
    path = tmp_path / "export.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("deep/conversations.json", json.dumps([{"title": "T", "mapping": {"a": {"message": {"id": "m", "author": {"role": "user"}, "content": {"parts": ["from now on always use four spaces"]}}}}}]))
        z.writestr("picture.png", "no")
    kind, items = archives.scan(spark, str(path))
    assert kind == "chatgpt" and items.count() == 1
    api = Memory(Store(spark, f"file://{tmp_path}/store"))
    assert api.import_path(Session("k"), str(path), dry_run=True)["written"] == 1 and api.store.version() == 0
    report = api.import_path(Session("k"), str(path), tags=("mine",))
    assert report["ok"] and report["written"] == 1 and api.import_path(Session("k"), str(path))["known"] == 1
    assert api.memories().first()["tags"] == ["mine", "chatgpt"]
    assert api.import_path(Session(), str(tmp_path / "missing"))["ok"] is False


def test_whole_files_and_rules(spark, tmp_path):
    for name, text in (("10-b.md", "ten"), ("9-a.md", "nine"), (".hidden.md", "no"), ("blank.md", " ")):
        (tmp_path / name).write_text(text)
    rows = files.whole_files(spark, str(tmp_path), files.Limits(max_bytes=3), "*.md")
    assert {r["name"]: (r["text"], r["truncated"]) for r in rows.collect()}["9-a.md"] == ("nin", True)
    scoped = files.whole_files(spark, str(tmp_path), glob="*.md").selectExpr("path", "name", "text", "'global' AS scope")
    assert notes.load_rules(scoped).first()["text"] == "### 规则：9-a\nnine\n\n### 规则：10-b\nten"


@pytest.fixture
def folder(tmp_path):
    return tmp_path


def test_streaming_cards_and_ingest(spark, folder):
    spark.createDataFrame([("s", 1, 1), ("s", 1, 2), ("s", 2, 3), ("t", 1, 4)], "session string, id bigint, ord bigint").write.parquet(f"{folder}/offers")
    offers = spark.readStream.schema("session string, id bigint, ord bigint").parquet(f"{folder}/offers")
    query = incremental.fresh_cards(offers).writeStream.format("memory").queryName("fresh").option("checkpointLocation", f"{folder}/c1").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["session"], r["id"]) for r in spark.table("fresh").collect()) == [("s", 1), ("s", 2), ("t", 1)]
    schema = "hash string, text string, title string, tags array<string>, ord bigint"
    spark.createDataFrame([("h1", "one thing", None, ["a"], 1), ("h1", "one thing", None, ["a"], 2), ("h2", "two", None, None, 3)], schema).write.parquet(f"{folder}/items")
    store = Store(spark, f"file://{folder}/store")
    for run in ("c2", "c3"):  # a second stream sees nothing new
        incremental.ingest(spark.readStream.schema(schema).parquet(f"{folder}/items"), store, f"{folder}/{run}").awaitTermination()
    tables = store.read()
    assert tables["memories"].count() == 2 and tables["ledger"].where("memory_id IS NOT NULL").count() == 2
    days = "day string, project_key string, ord bigint, label string, text string"
    spark.createDataFrame([("2024-01-01", None, 1, None, "x")], days).write.parquet(f"{folder}/days")
    incremental.journal(spark.readStream.schema(days).parquet(f"{folder}/days"), store, f"{folder}/c4").awaitTermination()
    assert store.read()["memories"].where("scope = 'daily'").first()["text"] == "- x"


def test_a_batch_that_comes_again_is_left_out(spark, folder):
    """The store remembers the last batch of a stream, so a batch published before its commit is not appended twice."""
    days = "day string, project_key string, ord bigint, label string, text string"
    spark.createDataFrame([("2024-01-01", None, 1, None, "x")], days).write.parquet(f"{folder}/days")
    store, stream = Store(spark, f"file://{folder}/store"), spark.readStream.schema(days).parquet(f"{folder}/days")
    incremental.journal(stream, store, f"{folder}/c").awaitTermination()
    for name in (folder / "c" / "commits").iterdir():  # as if the writer had died between publishing and committing
        name.unlink()
    incremental.journal(stream, store, f"{folder}/c").awaitTermination()
    assert [r["text"] for r in store.read()["memories"].collect()] == ["- x"] and store.version() == 1


def test_ingest_refuses_bad_rows_and_knows_trimmed_ones(spark, folder):
    schema = "hash string, text string, title string, tags array<string>, ord bigint"
    spark.createDataFrame([("h1", "  padded text \n", None, None, 1), ("h2", " ", None, None, 2), ("h3", "x" * (V.BODY_CAP + 1), None, None, 3), ("h4", "padded text", None, None, 4)], schema).write.parquet(f"{folder}/items")
    store = Store(spark, f"file://{folder}/store")
    for run in ("c1", "c2"):
        incremental.ingest(spark.readStream.schema(schema).parquet(f"{folder}/items"), store, f"{folder}/{run}").awaitTermination()
    tables = store.read()
    assert tables["memories"].count() == 2 and sorted(r["hash"] for r in tables["ledger"].collect()) == ["h1", "h4"]
    assert {r["memory_id"] for r in tables["ledger"].collect()} == {1, 2}


def test_damaged_archives_are_refused(spark, folder):
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("conversations.json", "[" + "1," * 5000 + "1]")
        z.writestr("b.jsonl", "{}")
    data = whole.getvalue()
    (folder / "cut.zip").write_bytes(data[: len(data) // 2])
    (folder / "hurt.zip").write_bytes(data[:60] + b"\0\1\2\3" + data[64:])
    assert archives.zip_entries(spark, f"{folder}/cut.zip").count() == 0 and archives.zip_entries(spark, f"{folder}/hurt.zip").count() == 0
    (folder / "whole.zip").write_bytes(data)
    assert sorted(r["name"] for r in archives.zip_entries(spark, f"{folder}/whole.zip").collect()) == ["b.jsonl", "conversations.json"]
    assert [r["name"] for r in archives.zip_entries(spark, f"{folder}/whole.zip", 100).collect()] == ["b.jsonl"]

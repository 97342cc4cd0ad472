"""The sequential fold and the pass under it, against a fold that holds every row of a layer."""

import random
import time
from datetime import datetime, timedelta

import pyarrow as pa
import pytest

from tests.test_engine import memories

from tessera.functions import fixed as V
from tessera.operators import merge, overlap

WORDS = ["use", "pnpm", "vite", "never", "not", "缓存", "不要", "redis", "tabs", "Ａb", "é", "no", "docker", "builds", "x", "ﬁle", "é", "́"]


def said(r):
    return r.choice(["", "!", "a", "不", " "]) if r.random() < 0.12 else r.choice([" ", "", ", "]).join(r.choices(WORDS, k=r.choice([1, 2, 4, 6, 9])))


def given(seed, rows=60, cands=40):
    r = random.Random(seed)
    layers = [("global", None), ("global", "k"), ("project", "k"), ("project", "j"), ("project", None), ("daily", "k")]
    stored = []
    for _ in range(rows):
        scope, key = r.choice(layers)
        stored.append({"text": said(r), "title": r.choice(["", "note", "vite"]), "scope": scope, "project_key": key, "status": r.choice(["active", "active", "archived"]), "created_at": datetime(2024, 1, 1) + timedelta(minutes=r.randrange(20))})
    asked = []
    for i in range(cands):
        scope, key = r.choice([*layers[:4], ("identity", None)])
        text = r.choice(asked)[2] if asked and r.random() < 0.2 else r.choice(stored)["text"] + r.choice(["", " not"]) if r.random() < 0.3 else said(r)
        asked.append((i + 1, r.choice(["", "note"]), text, scope, key, r.choice(["correction", "fact"])))
    return stored, asked


def later(row):
    return (row.created, row.key)


def brute(stored, asked):
    """cand_id -> (decision, target, score)."""
    layer_of = lambda scope, key: (scope, (key or "\0") if scope == "project" else "*")
    layers, everything, out = {}, [], {}
    for i, m in enumerate(stored):
        if m["status"] == "active":
            row = merge._Row(i + 1, m["title"], m["text"], int((m["created_at"] - datetime(1970, 1, 1)).total_seconds() * 1e6))
            layers.setdefault(layer_of(m["scope"], m["project_key"]), []).append(row)
            everything.append((m["project_key"], merge._Row(row.key, row.title, row.text, row.created)))
    for n, title, text, scope, key, kind in asked:
        scope = "global" if scope == "identity" else scope
        rows = layers.setdefault(layer_of(scope, key), [])
        live = sorted((r for r in rows if r.active), key=later, reverse=True)
        new = merge._Row(-n, title, text, 2**62 + n)
        scores = [max(merge._similar(new.grams, r.grams), merge._similar(new.titled, r.titled) if title else 0.0) for r in live]
        score = max(scores, default=0.0)
        own = key if scope == "project" else None
        far = max((r for k, r in everything if kind == "correction" and own in (None, k) and new.contradicts(r)), key=later, default=None)
        same, hit = next((r for r in live if r.norm == new.norm), None), next((r for r in live if new.contradicts(r)), None)
        target = same
        if same is not None:
            decision, score = "ignore", 1.0
        elif hit is not None:
            decision, target, hit.active = "update", hit, False
        elif live and score >= V.MERGE_SIMILARITY:
            target = live[scores.index(score)]
            share = len(new.grams & target.grams) / len(new.grams) if new.grams else 0.0
            decision = "ignore" if share >= V.CONTAINMENT_THRESHOLD and len(text) < len(target.text) else "merge"
            if decision == "merge":
                target.say(merge._body(target.text, text))
        else:
            decision, target = ("new", None) if far is None else ("update", far)
        if decision in ("new", "update"):
            rows.append(new)
        out[n] = (decision, None if target is None else target.key, round(score, 9))
    return out


@pytest.mark.parametrize("seed, block", [(1, 256), (2, 7), (3, 256)])
def test_sequential_equals_a_fold_over_all_rows(spark, monkeypatch, seed, block):
    monkeypatch.setattr(overlap, "BLOCK", block)
    stored, asked = given(seed)
    c = spark.createDataFrame(asked, "cand_id bigint, title string, text string, scope string, project_key string, kind string")
    got = {r["cand_id"]: (r["decision"], r["target"], round(r["score"], 9)) for r in merge.sequential(c, memories(spark, *stored)).collect()}
    assert got == brute(stored, asked)


def test_grams_of_wide_and_narrow_alphabets_agree(monkeypatch):
    r = random.Random(5)
    norms = [overlap.norm(said(r)) for _ in range(80)]
    columns = overlap.Grams(norms[:30])
    points, sizes = overlap._flat(norms[30:])
    for cells in (1 << 25, 1):
        monkeypatch.setattr(overlap, "CELLS", cells)
        counts, shared = columns.shared(points, sizes)
        assert counts.tolist() == [len(overlap.grams(n)) for n in norms[30:]]
        assert shared.tolist() == [[len(overlap.grams(a) & overlap.grams(b)) for b in norms[:30]] for a in norms[30:]]


LATIN = ["use", "not", "no", "é", "ß", "²", "don't", "A", "a", "café", "\x00", "\x1c", "\xa0", "\x85", "-", "ÿ", "7", "µ", "½", "Ÿ", "never"]


def compared(block, stored):
    r = random.Random(7)
    rows = {"id": [*range(len(stored))], "created": [r.randrange(9) for _ in stored], "scope": [r.choice(["global", "daily"]) for _ in stored], "layer_key": ["*"] * len(stored), "project_key": [r.choice([None, "k"]) for _ in stored]}
    rows |= {"title": [r.choice([None, "", "no", "ﬁ"]) for _ in stored], "text": stored}
    depths = [a.depth for a in block.asked]
    first = {t: overlap._First(depths) for t in ("best", "exact", "clash")} | {"wide": overlap._First([1] * len(depths))}
    block.compare(rows, first, set())
    kept = lambda t, row: [x.tolist() for x in (row[:3] if t == "wide" else row)]
    return {t: [row and kept(t, row) for row in found.rows] for t, found in first.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rows_as_bytes_and_as_code_points_agree(monkeypatch, seed):
    r = random.Random(seed)
    some = lambda: None if r.random() < 0.05 else r.choice(["", " "]).join(r.choices(LATIN, k=r.choice([0, 1, 1, 2, 5, 12])))
    stored = [some() for _ in range(400)]
    asked = [overlap.Asked(i + 1, r.choice([None, "", "no"]), r.choice([some(), r.choice(stored)]), ("global", "*"), 3, r.random() < 0.5, r.choice([None, "k"])) for i in range(60)]
    block = overlap.Block(asked, 0.0, V.CONTRADICTION_OVERLAP)
    found = compared(block, stored)
    monkeypatch.setattr(overlap, "_is_latin", lambda low: False)
    assert found == compared(block, stored)
    assert all(any(rows) for rows in found.values())


def test_latin_letters_stay_as_they_are():
    """What ``_latin`` numbers is composed, in lower case and a letter or number, and so is all that lower case leaves of Latin-1."""
    number = overlap._latin()[2]
    for c in map(chr, range(0x110000)):
        if not 0xD800 <= ord(c) < 0xE000:
            for x in overlap.unicodedata.normalize("NFKC", c).lower():
                if x < "\u0100":
                    assert x != "A" and bool(number[ord(x)]) == bool(overlap.norm(x)) and overlap._stable(x)


def test_long_latin_rows_take_less_than_half_the_time_of_code_points(monkeypatch):
    """Before, all rows were compared as code points (merge_sequential at 1 GB: 55 seconds; with this: 36)."""
    r = random.Random(1)
    stored = ["é" + " ".join(r.choices([w + x for w in ("lo", "ra", "no", "té") for x in "abcdefgh"], k=900)) for _ in range(512)]
    block = overlap.Block([overlap.Asked(i + 1, "", t[:200], ("global", "*"), 1, True) for i, t in enumerate(stored[:40])], 0.0, V.CONTRADICTION_OVERLAP)
    took = []
    for latin in (overlap._is_latin, lambda low: False):
        monkeypatch.setattr(overlap, "_is_latin", latin)
        compared(block, stored)
        start = time.process_time()
        compared(block, stored)
        took.append(time.process_time() - start)
    assert took[0] < took[1] / 2


def test_corrections_measure_only_rows_that_can_contradict_them(monkeypatch):
    """Rows of another layer are measured where their negation differs from a correction's, and then once; before, every row was, twice."""
    measured = []
    shared_bytes = overlap.Grams.shared_bytes

    def counted(self, joined):
        out = shared_bytes(self, joined)
        measured.append(len(out[0]))
        return out

    monkeypatch.setattr(overlap.Grams, "shared_bytes", counted)
    block = overlap.Block([overlap.Asked(1, "", "use pnpm", ("project", "k"), 1, True)], 0.0, V.CONTRADICTION_OVERLAP)
    found = compared(block, ["use pnpm", "never use pnpm", "vite builds"] * 4)
    assert measured == [4] and [i % 3 for i in found["wide"][0][2]] == [1]


def stepped(monkeypatch, block, rows, step):
    """The lists of a batch that is compared ``step`` rows at a time."""
    monkeypatch.setattr(overlap, "ROWS", step)
    depths = [a.depth for a in block.asked]
    first = {t: overlap._First(depths) for t in ("best", "exact", "clash")} | {"wide": overlap._First([1] * len(depths))}
    for some in overlap._steps(pa.RecordBatch.from_pydict(rows)):
        block.compare(some, first, set())
    return {t: [row and [x.tolist() for x in row[:3]] for row in found.rows] for t, found in first.items()}


def test_older_rows_are_not_asked_for_contradictions_already_found(monkeypatch):
    """Of 300 rows of another layer that all contradict a correction, the newest ten decide; before, all 300 were measured."""
    measured = []
    shared_bytes = overlap.Grams.shared_bytes

    def counted(self, joined):
        out = shared_bytes(self, joined)
        measured.append(len(out[0]))
        return out

    monkeypatch.setattr(overlap.Grams, "shared_bytes", counted)
    block = overlap.Block([overlap.Asked(1, "", "use pnpm", ("project", "k"), 1, True)], 0.0, V.CONTRADICTION_OVERLAP)
    n = 300
    rows = {"id": [*range(n)], "created": [*range(n)], "scope": ["daily"] * n, "layer_key": ["*"] * n, "project_key": [None] * n, "title": [""] * n, "text": ["never use pnpm"] * n}
    assert stepped(monkeypatch, block, rows, 10)["wide"][0][2] == [n - 1]
    assert measured == [10]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_small_steps_find_what_one_step_finds(monkeypatch, seed):
    r = random.Random(seed)
    n = 300
    rows = {"id": r.sample(range(1000), n), "created": [r.choice([None, *range(40)]) for _ in range(n)], "scope": [r.choice(["global", "daily", "project"]) for _ in range(n)], "project_key": [r.choice([None, "k", "j"]) for _ in range(n)]}
    rows["layer_key"] = [(k or "\0") if s == "project" else "*" for s, k in zip(rows["scope"], rows["project_key"], strict=True)]
    rows |= {"title": [r.choice([None, "", "note"]) for _ in range(n)], "text": [None if r.random() < 0.05 else said(r) for _ in range(n)]}
    layers = [("global", "*"), ("project", "k"), ("project", "j")]
    asked = [overlap.Asked(i + 1, r.choice([None, "", "note"]), said(r), r.choice(layers), r.choice([1, 2, 5]), r.random() < 0.7, r.choice([None, "k"])) for i in range(60)]
    block = overlap.Block(asked, 0.0, V.CONTRADICTION_OVERLAP)
    found = stepped(monkeypatch, block, rows, n)
    assert found == stepped(monkeypatch, block, rows, 7) and all(any(lists) for lists in found.values())

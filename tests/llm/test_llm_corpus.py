import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, rows_of, rows_of_sql

from tessera.llm import components, fm_quality, langid, merkle, near_dup, substring, topk
from tessera.llm.queries import QUERIES
from tessera.llm.sql import ORACLE_SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_query(spark, name):
    names, rows = rows_of(QUERIES[name](spark, FOLDER))
    if name in ORACLE_SQL:
        assert (names, rows) == rows_of_sql(connect(FOLDER), ORACLE_SQL[name])
    assert rows


def table(spark, texts, ids=None):
    rows = [(i, t, 1, "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, key int, n_removed string")


# -- near-duplicates ---------------------------------------------------------------------------------


def brute_groups(texts):
    sets = []
    for t in texts:
        w = [x.lower() if x.isascii() else x for x in (t or "").split()]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            c = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def corpus(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base, out = rng.choices(words, k=100), []
    for _ in range(120):  # one large group of near copies
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    shared = rng.choices(words, k=25)
    for _ in range(100):
        own = rng.choices(words, k=rng.randint(0, 40))
        out.append(" ".join(own))
        if own and rng.random() < 0.4:
            own[rng.randrange(len(own))] = "edit"
            out.append(" ".join(own))
        out.append(" ".join(shared + rng.choices(words, k=rng.randint(3, 30))))
    return [*out, None, "", " \n", "one two", "One TWO", "a b c d e", "A B c d e", out[0], out[0], "z " * 20_000]


@pytest.mark.parametrize("limit, leaf", [(1024, 1024), (30, 8)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, limit, leaf):
    monkeypatch.setattr(near_dup, "LEAF", leaf)
    texts = corpus()
    got = near_dup.near_duplicates(table(spark, texts), cluster_limit=limit).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(texts)


def test_large_nodes_of_near_copies_do_not_branch(spark, monkeypatch):
    """Groups of near copies, a frequent passage around different texts, and strangers beside both."""
    monkeypatch.setattr(near_dup, "LEAF", 12)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    shared, texts = rng.choices(words, k=60), []
    for _ in range(2):
        base = rng.choices(words, k=90)
        for _ in range(90):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    texts += [" ".join(shared + rng.choices(words, k=rng.choice([5, 20, 60, 90]))) for _ in range(120)]
    rng.shuffle(texts)
    got = near_dup.near_duplicates(table(spark, texts), cluster_limit=40).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(texts)


def test_words_that_look_alike_to_polynomials(spark):
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, two = ("".join(x[b] for b in bits) for x in ("ab", "ba"))
    rows = near_dup.near_duplicates(table(spark, [one, two])).collect()
    assert sorted(r["component_id"] for r in rows) == [0, 1]
    around = [f"v{i}" for i in range(40)]
    texts = [" ".join([*around[:20], x, *around[20:]]) for x in (one, two)]
    assert [r["n_removed"] for r in substring.remove_repeats(table(spark, texts)).collect()] == [0, 0]
    assert [r["n_removed"] for r in substring.remove_repeats(table(spark, [texts[0], texts[0]])).collect()] == [41, 41]


def test_near_duplicates_null_and_repeated_ids(spark):
    rows = near_dup.near_duplicates(table(spark, ["a b c d e f"] * 3 + ["x y z"], [None, 4, 4, None])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in rows if r["n_shingles"] == 2) == [(-1, 4, False), (4, 4, True), (4, 4, True)]
    assert near_dup.near_duplicates(table(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("part_rows", [components.PART_ROWS, 40])
def test_components_of_a_long_path(spark, part_rows):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1002), (5000, 5000)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), part_rows=part_rows).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 1002: 1000}


# -- repeated passages -------------------------------------------------------------------------------


def brute_removed(texts, window):
    seen = {}
    words = [(t or "").encode().split() for t in texts]
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = [[False] * len(w) for w in words]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + window] = [True] * window
    return [(len(w), sum(g), [x for x, y in zip(w, g, strict=True) if not y]) for w, g in zip(words, gone, strict=True)]


@pytest.mark.parametrize("buckets, chunk", [(1, 2_500_000), (500, 300), (7, 2000)])
def test_substring_equals_brute_force(spark, buckets, chunk):
    """Null, empty, short, repeated and very long texts, null and repeated ids; one or many buckets and chunks."""
    rng = random.Random(buckets)
    vocabulary = [f"v{i}" for i in range(400)]
    passages = [rng.choices(vocabulary, k=n) for n in (9, 10, 11, 12, 25, 60)]
    texts = [None, "", "a", "a b " * 30, "Same words Here now " * 8]
    for _ in range(60):
        own = rng.choices(vocabulary, k=rng.randint(0, 50))
        for p in rng.sample(passages, rng.randint(0, 3)):
            at = rng.randint(0, len(own))
            own[at:at] = p
        texts.append(" ".join(own))
    texts += [texts[20], texts[20], " ".join(rng.choices([f"u{i}" for i in range(9000)], k=30_000))]
    want = brute_removed(texts, 10)
    rows = sorted(substring.remove_repeats(table(spark, texts), window=10, buckets=buckets, chunk_bytes=chunk).collect(), key=lambda r: r["doc_id"])
    unnamed = substring.remove_repeats(table(spark, texts, [None, 3] * (len(texts) // 2) + [None] * (len(texts) % 2)), window=10, buckets=buckets, chunk_bytes=chunk).collect()
    assert sorted((r["n_words"], r["text"] or "") for r in unnamed) == sorted((r["n_words"], r["text"] or "") for r in rows)
    assert [(r["n_words"], r["n_removed"], (r["text"] or "").encode().split()) for r in rows] == want
    assert rows[0]["text"] is None and {r["key"] for r in rows} == {1}


def test_buckets_and_chunks_follow_the_corpus():
    assert substring.plan(0, 8) == (8, substring.CHUNK_BYTES)
    for size in (10**9, 3 * 10**10, 10**12):
        buckets, chunk = substring.plan(size, 8)
        assert size / 6 / buckets <= 1.01 * substring.BUCKET_WORDS or buckets == 8 and chunk / 6 / buckets >= substring.SHARE_WORDS
    buckets, chunk = substring.plan(10**14, 8)
    assert chunk == substring.MAX_CHUNK_BYTES and chunk / 6 / buckets >= substring.SHARE_WORDS - 1


def test_substring_keeps_white_space_and_takes_empty_tables(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = substring.remove_repeats(table(spark, [f"one\n\n two {passage}  three", f"{passage}", "plain\ttext "])).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["one\n\n two three", "", "plain\ttext "]
    assert substring.remove_repeats(table(spark, ["x"]).limit(0)).count() == 0


# -- top-k ---------------------------------------------------------------------------------------------


def test_topk_equals_brute_force_with_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 3)
    rng = np.random.default_rng(4)
    vectors = [(i, rng.standard_normal(8).astype(float).tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[0][1]) for i in range(60)]  # copies
    odd = [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (904, [1.0, 2.0]), (None, vectors[0][1]), (1000, [1.0, 0.0]), (1100, [1e17] * 8), (5, vectors[7][1])]
    df = spark.createDataFrame(vectors + odd, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x"))
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, [int(np.floor(1024.0 * x)) for x in v]) for i, v in vectors + odd if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q, qv in good:
        if q % 100 == 0:
            scores = sorted((-min(2**63 - 1, max(-(2**63) + 1, sum(a * b for a, b in zip(qv, v, strict=True)))), i) for i, v in good if i != q and len(v) == len(qv))
            want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scores[:10])]
    assert got == {q: w for q, w in want.items() if w}
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_topk_of_near_copies(spark):
    """The bin of the k-th score is left with many scores in the last round, others lie just above it."""
    rng = np.random.default_rng(8)
    unit = rng.standard_normal((3, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit.copy()
    near[np.arange(3), np.abs(unit).argmin(axis=1)] -= 2 / 1024
    vectors = [v for u, n in zip(unit, near, strict=True) for v in [u] * 8 + [n] * 100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    whole = np.floor(1024.0 * np.array(vectors)).astype(np.int64)
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 108 == 0, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (0, 108, 216):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in range(len(rows)) if i != q)[:10]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


# -- fixity --------------------------------------------------------------------------------------------


def test_merkle_locates_each_kind_of_damage(spark):
    pages = spark.range(0, 300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("body"), F.col("id").cast("string")).alias("html"), F.lit(1).alias("place"))
    worse = pages.where("page_id <> 250").withColumn("html", F.when(F.col("page_id") == 70, "BODY70").when(F.col("page_id") == 130, "longer body").otherwise(F.col("html")))
    worse = worse.unionByName(spark.createDataFrame([(900, "u", "new", 1)], worse.schema))
    found = merkle.audit(merkle.manifest(pages, per_archive=64), merkle.manifest(worse, per_archive=64), per_archive=64).collect()
    assert sorted((r["status"], r["id"]) for r in found if r["status"] != "moved") == [("changed", 70), ("changed", 130), ("extra", 900), ("missing", 250)]
    moved = [r for r in found if r["status"] == "moved"]
    assert {r["archive"] for r in moved} == {"2", "3"} and sum(r["n"] for r in moved) == (191 - 130) + (255 - 250)
    assert len(moved) <= 2 * 7 * 2
    assert merkle.audit(merkle.manifest(pages), merkle.manifest(pages)).count() == 0


def test_merkle_nulls_copies_and_empty_tables(spark):
    rows = [(None, None, None), (None, "u", "x"), (1, "u", None), (1, "u", "two"), (1, "u", "two"), (2, None, "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert merkle.audit(merkle.manifest(pages), merkle.manifest(pages)).count() == 0
    found = merkle.audit(merkle.manifest(pages), merkle.manifest(pages.limit(0))).collect()
    assert {r["status"] for r in found} == {"missing"} and sum(r["n"] for r in found) == 6


def test_merkle_tells_copies_of_an_id_apart(spark):
    rows = [(1, "u", "x")] * 500 + [(1, "u", "y"), (1, "u", "z" * 100_000), (2, "u", "w")]
    kind = "page_id bigint, url string, html string"
    pages, worse = spark.createDataFrame(rows, kind), spark.createDataFrame([*rows[1:-2], (1, "u", "Z" * 100_000), rows[-1]], kind)
    found = merkle.audit(merkle.manifest(pages), merkle.manifest(worse))
    assert [(r["status"], r["id"], r["n"]) for r in found.where("status <> 'moved'").collect()] == [("changed", 1, 502)]
    got = merkle.copies(merkle.records(pages), merkle.records(worse), found).collect()
    assert sorted((r["id"], r["copies_a"], r["copies_b"]) for r in got) == [(1, 0, 1), (1, 1, 0), (1, 500, 499)]


# -- trained models ------------------------------------------------------------------------------------


def test_gru_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = langid.new_model(["a", "b", "c"], hidden=3)
    for kind in ("tables", "recurrent"):
        setattr(model, kind, [x.astype(float) for x in getattr(model, kind)])
    data, label = rng.integers(97, 103, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    grads = langid._gradients(model, data, label)[1]
    for p, g in zip(model.parameters(), grads, strict=True):
        at = tuple(int(x) for x in np.unravel_index(np.abs(g).argmax(), g.shape))
        old, d = p[at], 1e-2
        p[at] = old + d
        up = langid._gradients(model, data, label)[0]
        p[at] = old - d
        down = langid._gradients(model, data, label)[0]
        p[at] = old
        assert g[at] == pytest.approx((up - down) / (2 * d), rel=0.1, abs=1e-4)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, langid.fit(docs)).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    row = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert row["a"] >= 0.97 and 0 <= row["low"] and row["high"] <= 1


def test_language_edges(spark):
    texts = [(b"the cat and the dog " * 20, "en"), ("der hund und die katze für ".encode() * 20, "de")]
    model = langid.train([(w, lang) for raw, lang in texts for w in langid.windows(raw)], steps=60)
    texts = [None, "", "123 !?", "é", "the cat " * 20_000, "the dog and the cat"]
    rows = langid.identify(table(spark, texts).withColumn("score", F.lit("x")), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] == "und" for r in rows] == [True, True, True, False, False, False]
    assert rows[4]["lang_pred"] == rows[5]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in langid.identify(table(spark, texts), None).collect()} == {"und"}
    assert langid.fit(spark.createDataFrame([(1, "a", None)], "doc_id bigint, text string, lang string")) is None


def test_network_equals_a_loop_over_bytes():
    """The whole score against one text, one byte and one gate at a time."""
    rng = np.random.default_rng(2)
    model = langid.new_model(["a", "b", "c"], hidden=4)
    model.bias += rng.standard_normal(3).astype(np.float32)
    raw = b"two words, 12 -- and more"

    def states(d, order):
        table, rec, state, out = model.tables[d].astype(float), model.recurrent[d].astype(float), np.zeros(4), {}
        for t in order:
            x, gate = table[raw[t]], lambda v: min(1.0, max(0.0, 0.25 * v + 0.5))
            z = [gate(x[i] + sum(state[j] * rec[j, i] for j in range(4))) for i in range(4)]
            r = [gate(x[4 + i] + sum(state[j] * rec[j, 4 + i] for j in range(4))) for i in range(4)]
            cand = [min(1.0, max(-1.0, x[8 + i] + sum(r[j] * state[j] * rec[j, 8 + i] for j in range(4)))) for i in range(4)]
            state = np.array([(1 - z[i]) * state[i] + z[i] * cand[i] for i in range(4)])
            out[t] = state
        return out

    ahead, back = states(0, range(len(raw))), states(1, range(len(raw) - 1, -1, -1))
    lettered = [i for w in (b"two", b"words,", b"and", b"more") for i in range(raw.index(w), raw.index(w) + len(w))]
    each = []
    for t in lettered:
        logit = np.concatenate([ahead[t], back[t]]) @ model.out.astype(float) + model.bias
        each.append(np.exp(logit) / np.exp(logit).sum())
    assert langid.score(model, [raw])[0] == pytest.approx(np.mean(each, axis=0), abs=1e-4)


def test_every_language_is_learned(spark):
    """More languages than any fixed bound, repeated rows, null ids, ties."""
    letters = [chr(0x4E00 + 40 * i) * 3 for i in range(70)]
    rows = [(7 * i + j if j < 6 else None, f"{x} {x}", f"l{i:02}") for i, x in enumerate(letters) for j in range(8)]
    drawn = langid.sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert {lang for _, lang in drawn} == {f"l{i:02}" for i in range(70)}
    model = langid.train(drawn, steps=3)
    assert len(model.langs) == 70
    scored = langid.identify(table(spark, ["same text", "same text", None], [None, 5, 5]), model).collect()
    assert len(scored) == 3 and scored[0]["score"] == scored[1]["score"] and scored[0]["lang_pred"] == scored[1]["lang_pred"]


def test_spans_label_each_byte_once():
    model = langid.new_model(["a", "b"], hidden=4)
    for n in (1, 100, 223, 224, 225, 1000):
        assert langid.score(model, [b"ab " * n])[0].sum() == pytest.approx(1, abs=1e-3)


def test_machine_equals_sum_over_pairs():
    rng = np.random.default_rng(3)
    model = fm_quality.Model(0.3, rng.standard_normal(fm_quality.SIZE).astype(np.float32), rng.standard_normal((fm_quality.SIZE, 4)).astype(np.float32))
    per_text, index, value = fm_quality.featurise([b"Some words, some MORE words!", None, b""], np.array([28.0, np.nan, 0.0]))
    got, at = fm_quality.margins(model, per_text, index, value), 0
    for n, g in zip(per_text.tolist(), got.tolist(), strict=True):
        i, x = index[at : at + n], value[at : at + n].astype(float)
        v = model.factors[i].astype(float)
        pairs = sum(v[a] @ v[b] * x[a] * x[b] for a in range(n) for b in range(a + 1, n))
        assert g == pytest.approx(0.3 + model.weights[i] @ x + pairs, rel=1e-3, abs=1e-3)
        at += n


def test_registered_quality_query_equals_a_plain_machine(spark):
    """Every score of the query from features counted word by word and all pairs summed."""
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = fm_quality.fit(docs, labels)
    rows = {r["doc_id"]: r for r in QUERIES["op1_fm_quality"](spark, FOLDER).collect()}
    v, w = model.factors.astype(float), model.weights.astype(float)
    given = docs.collect()
    assert len(rows) == len(given)
    for d in given[::4]:
        _, index, value = fm_quality.featurise([(d["text"] or "").encode()], np.array([float(d["n_chars"])]))
        x = value.astype(float)
        pairs = (v[index] * x[:, None]) @ (v[index] * x[:, None]).T
        margin = model.bias + w[index] @ x + np.triu(pairs, 1).sum()
        assert rows[d["doc_id"]]["score"] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-3)
        assert rows[d["doc_id"]]["predicted"] == int(rows[d["doc_id"]]["score"] >= 0.3)


def test_quality_of_repeated_rows_null_ids_and_conflicting_labels(spark):
    docs = table(spark, ["good words here", "good words here", "bad", "bad"], [1, 1, None, 2])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    drawn = fm_quality.sample(docs, labels)
    assert {y for _, _, y in drawn} <= {0}  # of conflicting labels the least holds; an id that is null has none
    rows = fm_quality.classify(docs, None).collect()
    assert len(rows) == 4 and {r["score"] for r in rows} == {0.5}


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = fm_quality.fit(docs, labels)
    found = fm_quality.classify(docs.join(labels, "doc_id"), model).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    rate = {r["quality"]: r["kept"] for r in found.groupBy("quality").agg(F.avg("predicted").alias("kept")).collect()}
    assert rate[1] >= 0.99 and rate[0] <= 0.1


def test_quality_edges(spark):
    model = fm_quality.Model(0.0, np.zeros(fm_quality.SIZE, np.float32), np.zeros((fm_quality.SIZE, 4), np.float32))
    rows = fm_quality.classify(table(spark, [None, "", "x", "word " * 40_000]).withColumn("predicted", F.lit("p")), model).collect()
    assert [(r["score"], r["predicted"]) for r in rows] == [(0.5, 1)] * 4
    assert {r["score"] for r in fm_quality.classify(table(spark, ["a"]), None).collect()} == {0.5}
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert fm_quality.fit(table(spark, ["a"]), empty) is None


# -- pipeline ------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("kind", F.lit("k"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if name != "op7_packing":
            assert after.columns == columns and after.count() <= docs.count()
        if name == "op4_near_duplicates":
            texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
            ids = [r["doc_id"] for r in docs.orderBy("doc_id").collect()]
            assert sorted(r["doc_id"] for r in after.collect()) == [ids[i] for i, (_, root) in brute_groups(texts).items() if i == root]
        if name == "op10_repeated_passages":
            before = {r["doc_id"]: r["text"] for r in docs.collect()}
            order = sorted(before)
            want = brute_removed([before[i] for i in order], 35)
            got = {r["doc_id"]: r["text"].encode().split() for r in after.collect()}
            assert [got[i] for i in order] == [w[2] for w in want]
        docs = after
    assert docs.count() > 0


def test_pipeline_keeps_one_row_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    words = random.Random(5).choices([f"w{i}" for i in range(500)], k=200)
    near = [*words[:100], "edit", *words[101:]]
    other, alone = ([f"{c}{i}" for i in range(60)] for c in "xy")
    rows = [(None, words), (4, words), (4, words), (3, near), (None, near), (7, other), (7, other), (7, alone), (None, other[::-1]), (None, other[::-1]), (None, [*other[:0:-1], "edit"]), (None, []), (9, None)]
    docs = spark.createDataFrame([(i, None if t is None else " ".join(t)) for i, t in rows], "doc_id bigint, text string")
    after = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert after.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in after.collect()]
    assert sorted((i, t) for i, t in got if i is not None and t) == [(3, " ".join(near)), (7, " ".join(other)), (7, " ".join(alone))]
    assert sum(i is None and bool(t) for i, t in got) == 1  # of three near copies without an id
    assert sum(not t for _, t in got) == 2 and len(got) == 6
    passages = {r["text"] for r in corpus_pipeline.repeated_passages(spark, spark.createDataFrame(got, docs.schema), FOLDER).collect()}
    assert {" ".join(near), " ".join(other), " ".join(alone)} <= passages  # no text is lost with its copies


def test_pipeline_run_equals_brute_force(spark, tmp_path):
    """``run`` over documents with null texts and ids, repeated rows, an empty and a very long text, against plain Python."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    some = docs.where("lang = 'en'").orderBy("doc_id").limit(3).collect()
    odd = [(None, some[0]["text"]), (some[1]["doc_id"], some[1]["text"]), (90_001, None), (90_002, ""), (90_003, " ".join(r["text"] for r in some) * 40), (None, "12 34")]
    whole = docs.unionByName(spark.createDataFrame([(i, t, "en", "extra", len(t or "")) for i, t in odd], docs.schema))
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    stored = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.quality(spark, corpus_pipeline.language(spark, stored, str(tmp_path)), str(tmp_path)).select("doc_id", "text").collect()
    kept = sorted(kept, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert {90_001, 90_002} & {r["doc_id"] for r in kept} == set() and 90_003 in {r["doc_id"] for r in kept}
    first = [kept[i] for i, (_, root) in brute_groups([r["text"] for r in kept]).items() if i == root]
    left = brute_removed([r["text"] for r in first], 35)
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for r, (_, n_removed, _words) in zip(first, left, strict=True):
        if not n_removed:
            n = len(library.encode(r["text"], add_special_tokens=False).ids) + 1
            want[r["doc_id"]] = n
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert set(total) == {r["doc_id"] for r in first} and {k: total[k] for k in want} == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in s) <= 2048 and sorted(s)[0][0] == 0 for s in sequences.values())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_unrelated_members_of_a_middling_node_do_not_branch(spark, monkeypatch):
    """1500 documents with one first token in common, and nothing else: they are compared, not dealt over further nodes."""
    import numpy as np

    rng = np.random.default_rng(3)
    roots = rng.integers(0, 2**63, (1500, near_dup._ROOTS), np.uint64)
    roots[:, 0] = 7
    sketch = rng.integers(0, 2**16, (1500, near_dup.TOKENS), np.uint16)
    sketch[1400:1410] = sketch[5]
    assert (near_dup._in_common(sketch, sketch[5]) == (sketch == sketch[5]).sum(axis=1)).all()

    def settle(*_):
        raise AssertionError("branches")

    monkeypatch.setattr(near_dup, "_settle", settle)
    rows = [(i, bytearray(r.tobytes()), bytearray(k.tobytes())) for i, (r, k) in enumerate(zip(roots, sketch, strict=True))]
    edges = near_dup.candidate_edges(spark.createDataFrame(rows, "key bigint, roots binary, sketch binary")).collect()
    assert len(edges) == 10 and {x for e in edges for x in e} == {5, *range(1400, 1410)}

import collections
import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, chat, common, packing, rules
from tessera.llm.piece_table import PieceTable

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\t\x0b", "a", "one two three", "É\x1cb\x85c　d﻿x ﬁ Σίσυφος", "<|endoftext|>x<|startoftext|>", "don't we've", "日本語 👩‍👩‍👧 İ", ":\U0003d000a \U00019123", "x" * 30_000, "ab " * 20_000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def docs(spark, texts, **extra):
    """Rows with null ids and clashing extra columns."""
    rows = [(i if i % 7 else None, t, "x", 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_words string, score int")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdefghinorstuéß'.,! \n1<|>", max_size=40) | st.text(max_size=30))
def test_encoder_equals_the_library(text):
    library = Tokenizer.from_file(VOCABULARY) if not hasattr(test_encoder_equals_the_library, "lib") else test_encoder_equals_the_library.lib
    test_encoder_equals_the_library.lib = library
    text = text.encode("utf-8", "ignore").decode()
    own, ids = bpe.encoder(VOCABULARY), library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_encode_documents(spark, library):
    rows = bpe.encode_documents(docs(spark, ODD), VOCABULARY).collect()
    want = [library.encode(t or "", add_special_tokens=False).ids for t in ODD]
    assert [r["ids"] for r in rows] == [" ".join(map(str, w)) for w in want]
    assert [r["decoded"] for r in rows] == [library.decode(w, skip_special_tokens=False) for w in want]
    assert [r["n_tokens"] for r in rows] == list(map(len, want))
    digests = bpe.encode_digests(docs(spark, ODD), VOCABULARY).collect()
    assert [d["ids_sha256"] for d in digests] == [hashlib.sha256(r["ids"].encode()).hexdigest() for r in rows]
    assert bpe.encode_documents(docs(spark, ODD).limit(0), VOCABULARY).count() == 0


def test_piece_table_starts_afresh(library):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(200)) for _ in range(12)]
    table = PieceTable(bpe.encoder(VOCABULARY), slots=1 << 10)
    for t in texts * 2:
        ids, counts = table.encode([t.encode(), None, b""], 0)
        assert ids.tolist() == [*library.encode(t, add_special_tokens=False).ids, 0, 0, 0] and counts.tolist()[1:] == [1, 1]


def test_best_fit_packs_exactly():
    rng, packer = random.Random(2), packing.BestFit(100, 8)
    bins = {}
    for _ in range(3000):
        n = rng.choice([rng.randint(1, 100), 100, 7])
        bin_id, offset = packer.place(n)
        assert bins.get(bin_id, 0) == offset and offset + n <= 100
        bins[bin_id] = offset + n
        assert packer.open <= 8 and packer.bits.bit_count() <= 8
    with pytest.raises(ValueError):
        packer.place(101)


def test_best_fit_takes_the_fullest_and_closes_the_fullest():
    packer = packing.BestFit(10, 2)
    assert [packer.place(n) for n in (6, 7)] == [(0, 0), (1, 0)]
    assert packer.place(3) == (1, 7) and packer.place(5) == (2, 0) and packer.place(5) == (2, 5)
    assert packer.place(9) == (3, 0) and packer.place(8) == (4, 0)  # bin 3, the fullest, is closed for bin 4
    assert packer.place(1) == (4, 8) and packer.place(4) == (0, 6)


def test_pack_documents_round_trip(spark, library):
    texts = [*ODD, "the cat sat", "the cat sat", "a b c " * 3000]
    rows = packing.pack_documents(docs(spark, texts), VOCABULARY).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    want = []
    for t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    total = sum(w[2] for w in want)
    assert len(sequences) <= total // 2048 + 3
    assert packing.pack_documents(docs(spark, texts).limit(0), VOCABULARY).count() == 0


def test_best_fit_equals_a_plain_search():
    """Each piece goes to the open bin with the least room that holds it; else the fullest closes for a new one."""
    rng, packer = random.Random(7), packing.BestFit(64, 6)
    open_, made = {}, 0
    for _ in range(4000):
        n = rng.randint(1, 64)
        bin_id, offset = packer.place(n)
        fitting = [free for free in open_.values() if free >= n]
        if fitting:
            assert open_[bin_id] == min(fitting)
        else:
            assert bin_id == made
            made += 1
            if n < 64 and len(open_) == 6:
                fullest = min(open_.values())
                gone = next(b for b, free in open_.items() if free == fullest and b not in {x for bins in packer.by_free.values() for x in bins})
                del open_[gone]
            open_[bin_id] = 64
        assert offset == 64 - open_[bin_id]
        open_[bin_id] -= n
        if not open_[bin_id]:
            del open_[bin_id]


def test_repeated_rows_are_dealt_over_shards(spark):
    rows = spark.createDataFrame([(None, 0, 0, 700, 5)] * 400, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    packed = packing.pack(rows, shard_pieces=40).collect()
    shards = {}
    for r in packed:
        shards[r["sequence_id"] >> 40] = shards.get(r["sequence_id"] >> 40, 0) + 1
    assert len(packed) == 400 and len(shards) == 10 and max(shards.values()) < 80


def test_packing_is_close_to_the_bound(spark):
    """At most 1 % more sequences than the tokens need, on the test documents."""
    rows = packing.pack_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), VOCABULARY)
    got = rows.agg(F.countDistinct("sequence_id").alias("n"), F.sum("length").alias("tokens")).first()
    assert got["n"] <= 1.01 * -(-got["tokens"] // 2048) + 1


def brute_measures(text):
    words = (text or "").encode().split()
    hit = [False] * len(words)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = collections.Counter(grams)
    for i, g in enumerate(grams):
        if seen[g] > 1:
            hit[i : i + 8] = [True] * 8
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(hit)


def test_ledger_against_brute_force(spark):
    rng = random.Random(3)
    texts = ODD + ["same words again " * 9] * 3 + [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(30)] + ["x\nx\n\ny\nx", "a#b <|> $"]
    rows = rules.ledger(docs(spark, texts), keep=("doc_id", "score")).collect()
    assert [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows] == [brute_measures(t) for t in texts]
    assert rules.ledger(docs(spark, texts).limit(0)).count() == 0


def test_policies_and_ablation(spark):
    text = ["few words", "word " * 40, " ".join(f"plain{i}" for i in range(40)), "#### " * 5 + " ".join(f"w{i}" for i in range(30))]
    entries = rules.ledger(docs(spark, text))
    kept = lambda p: [r["k"] for r in entries.select(rules.passes(p).alias("k")).collect()]
    assert kept(("base", 1)) == [False, False, True, True] and kept(("web", 2)) == [False, False, True, False]
    table = {r["rule"]: (r["n_failed"], r["n_only"], r["n_kept"]) for r in rules.ablation(entries).collect()}
    assert table["few_words"] == (1, 1, 1) and table["symbols"] == (1, 1, 1) and table["repeated_words"][0] == 1
    assert len(set(rules.BITS.values())) == len(rules.BITS) and rules.ablation(entries.limit(0)).count() == 5


TURNS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "a: b", ""]), st.text(alphabet="\\#:<>/ turn\nbhlc-é", max_size=25)), min_size=1, max_size=6)


def test_chat_round_trip(spark):
    cases = []

    @settings(max_examples=60, deadline=None)
    @given(TURNS)
    def collect(turns):
        cases.append(turns)

    collect()
    rows = [(c, i, role, text) for c, turns in enumerate(cases) for i, (role, text) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("loss", F.lit(1)).withColumn("valid", F.lit("x"))
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(table)).collect()}
    for c, turns in enumerate(cases):
        assert [(t["role"], t["text"]) for t in out[c]["turns"]] == turns
        assert out[c]["loss_text"] == "".join(t for r, t in turns if r == "assistant")


def test_chat_machine_nulls_and_ties(spark):
    rows = [(1, 1, "user", "a"), (1, 2, "assistant", None), (2, 1, "assistant", "a"), (3, 1, None, "x"), (4, 5, "user", "b"), (4, 5, "assistant", "a"), (5, None, "system", "s"), (5, 1, "user", "u"), (None, 1, "user", "n"), (6, 1, "user", "r"), (6, 1, "user", "r"), (7, 1, "user", "x" * 100_000)]
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))).collect()}
    assert {k: v["valid"] for k, v in out.items()} == {1: True, 2: False, 3: False, 4: False, 5: True, None: True, 6: False, 7: True}
    assert [t["role"] for t in out[4]["turns"]] == ["assistant", "user"] and len(out[6]["turns"]) == 2 and len(out[7]["turns"][0]["text"]) == 100_000
    assert chat.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").limit(0)).count() == 0


def test_chat_template_is_declarative(spark):
    template = chat.Template(head="<s>", after_role="|", tail="</s>", escape="~", loss_roles=("user",), follows=(("", ("user",)), ("user", ("user",))))
    rows = spark.createDataFrame([(1, 1, "user", "a</s>~<s>user|b"), (1, 2, "user", "c")], "conv_id int, turn int, role string, text string")
    out = chat.read_back(chat.format_chats(rows, template), template).first()
    assert out["valid"] and out["loss_text"] == "a</s>~<s>user|bc" and out["formatted"].count("</s>") == 2


def test_word_arrays_equal_split():
    texts = [t.encode() if t is not None else None for t in ODD] + [b"tail ", b" lead", b"x" * 3_000_000 + b" y " + b"z" * 2_000_000]
    hashes, counts = common.word_arrays(texts)
    words = [w for t in texts for w in (t or b"").split()]
    assert counts.tolist() == [len((t or b"").split()) for t in texts] and len(hashes) == len(words)
    assert len(set(hashes.tolist())) == len(set(words))
    assert len({(w, h) for w, h in zip(words, hashes.tolist(), strict=True)}) == len(set(words))
    assert common.word_arrays([None, b""])[0].size == 0


def test_vocabulary_is_not_copied():
    assert json.load(open(VOCABULARY))["model"]["type"] == "BPE"


def alike_by_sums():
    """Two words that any polynomial hash modulo a power of two takes for the same: a Thue-Morse word and its complement."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_look_alike_to_polynomials_differ(spark, library):
    one, two = alike_by_sums()
    assert len(set(common.word_arrays([f"{one} {two}".encode()])[0].tolist())) == 2
    table = PieceTable(bpe.encoder(VOCABULARY))
    for t in (one, two, f"{two} {one}"):
        assert table.encode([t.encode()], 0)[0].tolist() == [*library.encode(t, add_special_tokens=False).ids, 0]
    fill = [" ".join(f"{c}{i}" for i in range(7)) for c in "xyz"]
    text = f"{fill[0]} {one} {fill[1]} {two} {fill[2]}"
    assert rules.measure([text.encode()])["n_repeat_words"].tolist() == [0]
    assert rules.measure([f"{one} {fill[0]} {two} {fill[0]}".encode()])["n_repeat_words"].tolist() == [0]


def test_piece_table_tells_pieces_of_one_hash_apart(library, monkeypatch):
    cut = common.cut_words
    monkeypatch.setattr(common, "cut_words", lambda buffer, seed=0: (*cut(buffer, seed)[:2], cut(buffer, seed)[2] % np.uint64(7)))
    rng, table = random.Random(4), PieceTable(bpe.encoder(VOCABULARY), slots=1 << 12)
    for _ in range(3):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.choice([3, 8, 9, 30, 80]))) for _ in range(60)]
        text = " ".join(rng.choices(words, k=200))
        assert table.encode([text.encode()], 0)[0].tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]

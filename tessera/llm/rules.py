"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores the measurements and one bit for
each failed rule; a policy is a named, versioned bit mask, so applying a policy, comparing two
policies and leave-one-out ablations read the ledger only, never the texts.

Defined results: a null or empty text has all measurements 0 (and fails ``few_words``); repeated
rows, also of null ids, are judged one by one; very long texts are measured whole; an empty table gives
an empty ledger; extra columns are left out of the ledger unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Rule name to bit; a rule keeps its bit for ever, new rules take new bits.
BITS = {"few_words": 0, "repeated_words": 1, "word_length": 2, "symbols": 3, "repeated_lines": 4}

#: Policy name and version to the rules that it enforces.
POLICIES = {
    ("base", 1): ("few_words", "repeated_words"),
    ("web", 1): ("few_words", "repeated_words", "symbols"),
    ("web", 2): ("few_words", "repeated_words", "word_length", "symbols", "repeated_lines"),
}
PRODUCTION = ("web", 2)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def failures() -> dict[str, Column]:
    """Each rule as a condition on the measurements that holds where a document fails it."""
    c = F.col
    return {
        "few_words": c("n_words") < 20,
        "repeated_words": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")),
        "symbols": 10 * c("n_symbols") > 3 * c("n_words"),
        "repeated_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
    }


def mask(policy: tuple[str, int]) -> int:
    return sum(1 << BITS[name] for name in POLICIES[policy])


def measure(texts: list[bytes | None], words: tuple[np.ndarray, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """The measurements of each text; ``words`` are its word hashes and counts where they are known."""
    hashes, counts = words or common.word_arrays(texts)
    chars, symbols, lines, dup_lines = (np.zeros(len(texts), np.int64) for _ in range(4))
    for i, raw in enumerate(texts):
        if not raw:
            continue
        text = raw.decode("utf-8", "replace")
        chars[i] = len(text) - sum(map(text.count, common.SPACES))
        symbols[i] = sum(map(text.count, SYMBOLS))
        own = [line for line in raw.split(b"\n") if line and not line.isspace()]
        lines[i] = len(own)
        dup_lines[i] = len(own) - len(set(own))
    repeat = np.zeros(len(hashes), bool)
    whole = np.flatnonzero(common.whole_windows(counts, WINDOW))
    if len(whole):
        owner = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
        key = common.rolling(hashes, WINDOW)[whole] ^ common.mix(owner[whole], 1)
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        repeat = common.covered(whole[twice], WINDOW, len(hashes))
    values = (counts, chars, symbols, lines, dup_lines, common.per_text(repeat.astype(np.int64), counts))
    return dict(zip(MEASURES, values, strict=True))


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: ``keep``, the measurements, and ``fail_bits`` with a bit per failed rule."""
    source = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + [f"{m} bigint" for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("rules")
        for batch in batches:
            for first, texts in common.steps(batch, "__text"):
                found = measure(texts)
                own = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(own.columns[:-1] + [pa.array(v, pa.int64()) for v in found.values()], [*own.schema.names[:-1], *found])

    bits = sum((F.when(fails, F.lit(1 << BITS[name])).otherwise(F.lit(0)) for name, fails in failures().items()), F.lit(0))
    return common.small_batches(source).mapInArrow(common.trimmed(run), schema).withColumn("fail_bits", bits.cast("long"))


def passes(policy: tuple[str, int] = PRODUCTION) -> Column:
    """True where a ledger row breaks no rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablation(entries: DataFrame, policy: tuple[str, int] = PRODUCTION) -> DataFrame:
    """What each rule of a policy does alone, in one pass over the ledger.

    rule, n_failed (documents that fail it), n_only (documents that would come back without it),
    n_kept (kept by the whole policy).
    """
    whole, bits = mask(policy), F.col("fail_bits")
    seen = bits.bitwiseAND(F.lit(whole))
    sums = [F.sum((seen == 0).cast("long")).alias("n_kept")]
    for name in POLICIES[policy]:
        bit = 1 << BITS[name]
        sums += [F.sum((bits.bitwiseAND(F.lit(bit)) != 0).cast("long")).alias(f"f_{name}"), F.sum((seen == bit).cast("long")).alias(f"o_{name}")]
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(f"f_{n}", F.lit(0)).alias("n_failed"), F.coalesce(f"o_{n}", F.lit(0)).alias("n_only")) for n in POLICIES[policy]])
    return entries.agg(*sums).select(F.explode(rows).alias("r"), F.coalesce("n_kept", F.lit(0)).alias("n_kept")).select("r.*", "n_kept")

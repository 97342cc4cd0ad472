"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct words, hashed into a fixed table and weighted by the root of
their counts (normalised to length 1), and one indicator for the range that each structure statistic
and the stated length fall into. The score is the logistic of

    b + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ],

the sum over all pairs of features of <v_i, v_j> x_i x_j, in time linear in the features.

Training reads a bounded sample of labelled rows outside the held-out fold, featurised on the
executors, and runs AdaGrad here. The model has a fixed size and is broadcast.

Defined results: null and empty texts have statistics of 0 and get a score like any other; a null
length has a range of its own; very long texts are read whole; rows without an id are scored but not
learned from; an empty table gives no rows; rows of a repeated id are scored one by one, and conflicting labels
of an id count as the lowest; without usable labels every score is 0.5; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, rules

WORD_BITS = 17
FACTORS = 4
RANGES = 16
#: Bound on the labelled documents that training reads.
SAMPLE = 6000
EPOCHS = 8
BATCH = 64
MIN_SCORE = 0.3

#: Statistic to the bounds between its ranges.
STATISTICS: dict[str, tuple[float, ...]] = {
    "words": (1, 5, 10, 20, 40, 80, 160, 320, 640, 1280, 2560, 5120),
    "word_length": (1, 2, 3, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 15),
    "symbols_per_word": (0.001, 0.01, 0.03, 0.1, 0.2, 0.3, 0.5, 1, 2, 3),
    "repeated_words": (0.001, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    "repeated_lines": (0.001, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    "words_per_line": (1, 2, 4, 8, 12, 16, 24, 32, 64, 128),
    "distinct_words": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97),
    "upper": (0.001, 0.02, 0.04, 0.06, 0.1, 0.2, 0.3, 0.5, 0.8),
    "digits": (0.001, 0.01, 0.03, 0.1, 0.2, 0.4),
    "marks": (0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.2, 0.3),
    "exclaims_per_word": (0.001, 0.01, 0.05, 0.1, 0.3, 0.6, 1, 1.5),
    "stated_length": (1, 50, 100, 200, 400, 800, 1600, 3200, 6400, 12800, 25600, 51200),
}
_FIXED = 1 << WORD_BITS
SIZE = _FIXED + RANGES * len(STATISTICS)

_CLASS = np.zeros(256, np.uint8)  # 0 others, 1 lower case and beyond ASCII, 2 upper case, 3 digits, 4 marks, 5 white space
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[128:] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = 4
_CLASS[[ord(c) for c in common.SPACES]] = 5


def featurise(texts: list[bytes | None], stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of texts as (count per text, feature, value). ``stated``: lengths, NaN for null."""
    words = common.word_arrays(texts)
    hashes, counts = words
    found, n = rules.measure(texts, words), len(texts)
    owner = np.repeat(np.arange(n), counts)
    key, tf = np.unique((owner << WORD_BITS) | (common.mix(hashes, 21) >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
    own, index, value = key >> WORD_BITS, key & (_FIXED - 1), np.sqrt(tf).astype(np.float32)
    value /= np.sqrt(np.maximum(np.bincount(own, weights=tf, minlength=n), 1))[own].astype(np.float32)

    sizes = np.array([len(t or b"") for t in texts])
    classes = np.zeros((6, n))
    if sizes.sum():
        of = _CLASS[np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)]
        some = np.flatnonzero(sizes)
        for c in range(1, 5):
            classes[c, some] = np.add.reduceat((of == c).astype(np.int32), common.starts_of(sizes)[some])
    exclaims = np.array([(t or b"").count(b"!") for t in texts])
    per = lambda a, b: a / np.maximum(b, 1)
    letters = classes[1] + classes[2]
    statistics = {
        "words": counts,
        "word_length": per(found["word_chars"], counts),
        "symbols_per_word": per(found["n_symbols"], counts),
        "repeated_words": per(found["n_repeat_words"], counts),
        "repeated_lines": per(found["n_dup_lines"], found["n_lines"]),
        "words_per_line": per(counts, found["n_lines"]),
        "distinct_words": per(np.bincount(own, minlength=n), counts),
        "upper": per(classes[2], letters),
        "digits": per(classes[3], sizes),
        "marks": per(classes[4], sizes),
        "exclaims_per_word": per(exclaims, counts),
        "stated_length": stated,
    }
    fixed = np.empty((n, len(STATISTICS)), np.int64)
    for j, (name, bounds) in enumerate(STATISTICS.items()):
        x = np.asarray(statistics[name], float)
        fixed[:, j] = _FIXED + RANGES * j + np.where(np.isnan(x), RANGES - 1, np.searchsorted(bounds, x, side="right"))
    per_text = np.bincount(own, minlength=n) + len(STATISTICS)
    out_index, out_value = np.empty(int(per_text.sum()), np.int64), np.ones(int(per_text.sum()), np.float32)
    starts = common.starts_of(per_text)
    places = np.arange(len(own)) + (np.arange(n) * len(STATISTICS))[own]
    out_index[places], out_value[places] = index, value
    out_index[((starts + per_text)[:, None] - len(STATISTICS)) + np.arange(len(STATISTICS))] = fixed
    return per_text, out_index, out_value


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # (SIZE,)
    factors: np.ndarray  # (SIZE, FACTORS)


def margins(model: Model, per_text: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The machine's output for each text, by the sum-of-squares identity."""
    if not len(per_text):
        return np.zeros(0)
    starts = common.starts_of(per_text)
    vx = model.factors[index] * value[:, None]
    sums = np.add.reduceat(vx, starts, axis=0)
    squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
    linear = np.add.reduceat(model.weights[index] * value, starts)
    return model.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 1, epochs: int = EPOCHS) -> Model | None:
    """rows: (feature, value, label). AdaGrad on the logistic loss, with a pull to 0 on what a batch touches."""
    if not rows or len({r[2] for r in rows}) < 2:
        return None
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(SIZE, np.float32), (rng.standard_normal((SIZE, FACTORS)) * 0.02).astype(np.float32))
    seen_w, seen_v, seen_b = np.full(SIZE, 1e-2, np.float32), np.full((SIZE, FACTORS), 1e-2, np.float32), 1e-2
    label = np.array([r[2] for r in rows], float)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            pick = order[at : at + BATCH]
            per_text = np.array([len(rows[i][0]) for i in pick])
            index, value = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
            miss = ((logistic(margins(model, per_text, index, value)) - label[pick]) / len(pick)).astype(np.float32)
            each = np.repeat(miss, per_text) * value
            vx = model.factors[index] * value[:, None]
            sums = np.repeat(np.add.reduceat(vx, common.starts_of(per_text), axis=0), per_text, axis=0)
            touched, where = np.unique(index, return_inverse=True)
            g_w = np.bincount(where, weights=each) + 1e-5 * model.weights[touched]
            g_v = np.stack([np.bincount(where, weights=each * (sums[:, f] - vx[:, f])) for f in range(FACTORS)], axis=1) + 1e-5 * model.factors[touched]
            seen_w[touched] += g_w * g_w
            seen_v[touched] += g_v * g_v
            model.weights[touched] -= 0.1 * g_w / np.sqrt(seen_w[touched])
            model.factors[touched] -= 0.05 * g_v / np.sqrt(seen_v[touched])
            g_b = float(miss.sum())
            seen_b += g_b * g_b
            model.bias -= 0.1 * g_b / seen_b**0.5
    return model


def _stated(batch: pa.RecordBatch, column: str, first: int, n: int) -> np.ndarray:
    at = batch.schema.get_field_index(column)
    if at < 0:
        return np.full(n, np.nan)
    return batch.column(at).slice(first, n).cast(pa.float64()).to_numpy(zero_copy_only=False)


def sample(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", length: str = "n_chars", limit: int = SAMPLE) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features and label of at most ``limit`` labelled documents outside the held-out fold, drawn by a hash of the id."""
    labelled = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull() & ~common.held_out(key)).select(F.col(key).alias("__key"), F.col("quality").alias("__label"))
    n = labelled.count()
    if not n:
        return []
    draw = F.xxhash64("__key", F.lit(29))
    drawn = labelled.where(F.pmod(draw, F.lit(1_000_000)) < min(1.0, 1.2 * limit / n) * 1_000_000).groupBy("__key").agg(F.min("__label").alias("__label")).orderBy(draw, "__key").limit(limit)
    columns = [F.col(text).alias("__text"), *([F.col(length).alias("__length")] if length in docs.columns else [])]
    rows = docs.select(F.col(key).alias("__key"), *columns).join(F.broadcast(drawn), "__key")  # at most ``limit`` rows of 12 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in common.steps(batch, "__text"):
                per_text, index, value = featurise(texts, _stated(batch, "__length", first, len(texts)))
                cuts = np.cumsum(per_text)[:-1]
                label = batch.column(batch.schema.get_field_index("__label")).slice(first, len(texts)).cast(pa.int32())
                key_of = batch.column(0).slice(first, len(texts)).cast(pa.int64())
                data = [pa.array([x.astype(t).tobytes() for x in np.split(a, cuts)], pa.binary()) for a, t in ((index, np.int32), (value, np.float32))]
                yield pa.RecordBatch.from_arrays([key_of, label, *data], ["k", "label", "features", "vals"])

    found = rows.mapInArrow(run, "k bigint, label int, features binary, vals binary").collect()  # bounded by ``limit``
    return [(np.frombuffer(r["features"], np.int32), np.frombuffer(r["vals"], np.float32), int(r["label"] > 0)) for r in sorted(found, key=lambda r: (r["k"], r["features"]))]


def classify(docs: DataFrame, model: Model | None, text: str = "text", length: str = "n_chars", min_score: float = MIN_SCORE) -> DataFrame:
    """All rows and columns, with score and predicted; columns of these names are replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", score double, predicted int"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE * (FACTORS + 1) floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("fm_quality")
        own = shared.value
        for batch in batches:
            for first, texts in common.steps(batch, text):
                if own is None:
                    score = np.full(len(texts), 0.5)
                else:
                    score = logistic(margins(own, *featurise(texts, _stated(batch, length, first, len(texts)))).astype(float))
                rows = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score), pa.array((score >= min_score).astype(np.int32))], [*rows.schema.names, "score", "predicted"])

    return common.small_batches(docs).mapInArrow(common.trimmed(run), schema)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model | None:
    return train(sample(docs, labels, text, key))

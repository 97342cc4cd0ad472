"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read a text's bytes, one from each end. Every byte gets a distribution over the languages
from both states there; a document's probabilities are the mean over the bytes of its words with a
letter, or with any character beyond ASCII. The network is trained here in numpy by backpropagation through time on windows that are
drawn evenly over the whole texts of a bounded sample of labelled rows. Gates use the piecewise linear sigmoid and candidates the clipped identity, which numpy
evaluates fast and whose derivatives are exact.

Whole texts are read: a text is cut into spans of ``SPAN`` bytes that overlap by ``OVERLAP``; the
overlap warms up the states and is labelled once, so each byte is labelled exactly once, and spans
of many texts go through the network side by side.

Defined results: a null text, or one without a letter, is ``und`` with score 0; very long texts are
read whole; repeated rows, also of null or repeated ids, are scored one by one and equal texts score
alike; ties go to the first language in alphabetical order; without any labelled row every text is
``und``; an empty table gives no rows; other columns pass through, but for ``lang_pred`` and ``score``,
which are replaced. Rows without an id are in no held-out fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HIDDEN = 8
SPAN = 256
OVERLAP = 16
#: Bound on the labelled documents of each language that training reads.
SAMPLE_PER_LANG = 1500
TRAIN_SPAN = 64
#: Windows drawn from each of them, wherever they lie in its text.
TRAIN_WINDOWS = 32
TRAIN_STEPS = 500
TRAIN_BATCH = 256
#: Documents below this score, and ``und``, are rejected by the filter.
MIN_SCORE = 0.3
#: Spans that go through the network at once.
LANES = 2048


@dataclass
class Model:
    """Weights: for each direction the gates' input table (256 x 3H) and recurrent matrix (H x 3H), and the output layer."""

    langs: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray  # (2H x K)
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent, self.out, self.bias]


def new_model(langs: list[str], hidden: int = HIDDEN, seed: int = 8) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Model(
        langs,
        [draw(256, 3 * hidden, scale=0.4) for _ in range(2)],
        [draw(hidden, 3 * hidden, scale=0.5 / hidden**0.5) for _ in range(2)],
        draw(2 * hidden, len(langs), scale=0.3),
        np.zeros(len(langs), np.float32),
    )


# -- forward and backward through time ----------------------------------------------------------


def _gate(x: np.ndarray) -> np.ndarray:
    """Piecewise linear sigmoid, in place."""
    x *= 0.25
    x += 0.5
    return np.minimum(np.maximum(x, 0, out=x), 1, out=x)


def _run(table: np.ndarray, rec: np.ndarray, data: np.ndarray, steps: range, keep: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """States of one direction, step by step. data: (T x B) bytes; states are (B x H)."""
    h = rec.shape[0]
    state = np.zeros((data.shape[1], h), np.float32)
    gates_of, cand_of = np.ascontiguousarray(rec[:, : 2 * h]), np.ascontiguousarray(rec[:, 2 * h :])
    for t in steps:
        x = table[data[t]]
        gates = _gate(x[:, : 2 * h] + state @ gates_of)
        z, r = gates[:, :h], gates[:, h:]
        rs = r * state
        raw = x[:, 2 * h :] + rs @ cand_of
        cand = np.minimum(np.maximum(raw, -1), 1)
        if keep is not None:
            keep.append((t, state, gates, rs, raw, cand))
        state = state + z * (cand - state)
        yield t, state


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=-1, keepdims=True)
    return logits


def _label(model: Model, data: np.ndarray) -> np.ndarray:
    """Probabilities (T x B x K) of every position of the spans in the columns of ``data`` (T x B)."""
    h, steps = model.out.shape[0] // 2, data.shape[0]
    logits = np.empty((steps, data.shape[1], len(model.langs)), np.float32)
    for t, state in _run(model.tables[0], model.recurrent[0], data, range(steps)):
        np.dot(state, model.out[:h], out=logits[t])
    logits += model.bias
    for t, state in _run(model.tables[1], model.recurrent[1], data, range(steps - 1, -1, -1)):
        logits[t] += state @ model.out[h:]
    return _softmax(logits)


def _gradients(model: Model, data: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions, and its gradient by each parameter, by backpropagation through time."""
    h, (steps, lanes) = model.out.shape[0] // 2, data.shape
    kept: list[list] = [[], []]
    states = [np.empty((steps, lanes, h), np.float32) for _ in range(2)]
    for d, order in enumerate((range(steps), range(steps - 1, -1, -1))):
        for t, state in _run(model.tables[d], model.recurrent[d], data, order, kept[d]):
            states[d][t] = state
    both = np.concatenate(states, axis=2)
    prob = _softmax(both @ model.out + model.bias)
    truth = prob[:, np.arange(lanes), label]
    loss = float(-np.log(np.maximum(truth, 1e-9)).mean())
    prob[:, np.arange(lanes), label] -= 1
    prob /= steps * lanes
    flat = prob.reshape(-1, prob.shape[2])
    grads: dict[str, np.ndarray] = {"out": both.reshape(-1, 2 * h).T @ flat, "bias": flat.sum(axis=0)}
    back = prob @ model.out.T
    tables, recs = [], []
    for d in range(2):
        rec = model.recurrent[d]
        g_table, g_rec = np.zeros_like(model.tables[d]), np.zeros_like(rec)
        g_state = np.zeros((lanes, h), np.float32)
        for t, before, gates, rs, raw, cand in reversed(kept[d]):
            g_state = g_state + back[t, :, d * h : (d + 1) * h]
            z, r = gates[:, :h], gates[:, h:]
            g_raw = g_state * z * (np.abs(raw) < 1)
            g_z = g_state * (cand - before)
            g_rs = g_raw @ rec[:, 2 * h :].T
            g_gates = np.concatenate([g_z, g_rs * before], axis=1) * (0.25 * ((gates > 0) & (gates < 1)))
            g_rec[:, : 2 * h] += before.T @ g_gates
            g_rec[:, 2 * h :] += rs.T @ g_raw
            g_in = np.concatenate([g_gates, g_raw], axis=1)
            order = np.argsort(data[t], kind="stable")
            seen, first = np.unique(data[t][order], return_index=True)
            g_table[seen] += np.add.reduceat(g_in[order], first, axis=0)
            g_state = g_state * (1 - z) + g_gates @ rec[:, : 2 * h].T + g_rs * r
        tables.append(g_table)
        recs.append(g_rec)
    return loss, [*tables, *recs, grads["out"], grads["bias"]]


def windows(raw: bytes, n: int = TRAIN_WINDOWS, seed: int = 0) -> list[bytes]:
    """``n`` windows that start evenly drawn over a whole text."""
    at = np.random.default_rng([seed, len(raw)]).integers(max(1, len(raw) - TRAIN_SPAN // 2), size=n)
    return [raw[i : i + TRAIN_SPAN] for i in at.tolist()]


def train(drawn: list[tuple[bytes, str]], steps: int = TRAIN_STEPS, seed: int = 8) -> Model | None:
    """Fits the network to labelled windows by Adam; every language is drawn equally often."""
    by_lang: dict[str, list[bytes]] = {}
    for raw, lang in drawn:
        if raw:
            by_lang.setdefault(lang, []).append(raw)
    langs = sorted(by_lang)
    if not langs:
        return None
    model, rng = new_model(langs, seed=seed), np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    for step in range(1, steps + 1):
        label = rng.integers(0, len(langs), TRAIN_BATCH)
        data = np.full((TRAIN_SPAN, TRAIN_BATCH), 32, np.uint8)
        for lane, k in enumerate(label.tolist()):
            own = by_lang[langs[k]]
            part = np.frombuffer(own[rng.integers(len(own))], np.uint8)
            data[: len(part), lane] = part
        _, grads = _gradients(model, data, label)
        rate = 0.02 * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for p, g, (m, v) in zip(model.parameters(), grads, moments, strict=True):
            np.clip(g, -0.5, 0.5, out=g)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


# -- scoring ------------------------------------------------------------------------------------


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def pooled(raw: bytes) -> np.ndarray:
    """Mask over the bytes of the words that hold a letter, or any byte beyond ASCII; all bytes where no word does."""
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = common.cut_runs(data)
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    has = letters[ends] > letters[starts]
    change = np.zeros(len(data) + 1, np.int8)
    change[starts[has]], change[ends[has]] = 1, -1
    mask = np.cumsum(change[:-1], dtype=np.int8) > 0
    return mask if mask.any() else np.ones(len(data), bool)


def score(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over the pooled bytes of each non-empty text."""
    step = SPAN - 2 * OVERLAP
    total = np.zeros((len(texts), len(model.langs)))
    spans: list[tuple[int, int, int, int, int]] = []  # text, from, to, first labelled, end of labelled
    for i, raw in enumerate(texts):
        n = len(raw)
        for at in range(0, n, step):
            low, high = max(0, at - OVERLAP), min(n, at + step + OVERLAP)
            spans.append((i, low, high, at - low, min(at + step, n) - low))
    spans.sort(key=lambda s: s[2] - s[1])
    arrays, masks = [np.frombuffer(t, np.uint8) for t in texts], [pooled(t) for t in texts]
    for first in range(0, len(spans), LANES):
        own = spans[first : first + LANES]
        length = own[-1][2] - own[-1][1]
        data, weight = np.full((len(own), length), 32, np.uint8), np.zeros((len(own), length), bool)
        for lane, (i, low, high, start, end) in enumerate(own):
            data[lane, : high - low] = arrays[i][low:high]
            weight[lane, start:end] = masks[i][low + start : low + end]
        prob = _label(model, np.ascontiguousarray(data.T))
        prob *= weight.T[:, :, None]
        np.add.at(total, np.array([s[0] for s in own]), prob.sum(axis=0))
    return total / np.array([max(1, int(m.sum())) for m in masks])[:, None]


def has_letter(raw: bytes | None) -> bool:
    if not raw:
        return False
    return raw[:200].decode("utf-8", "ignore").isalpha() or any(map(str.isalpha, raw.decode("utf-8", "replace")))


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = SAMPLE_PER_LANG) -> list[tuple[bytes, str]]:
    """Windows of at most about ``per_lang`` labelled rows of each language outside the held-out fold, drawn by a hash of their id."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~common.held_out(key))
    counts = {r[lang]: r["count"] for r in labelled.groupBy(lang).count().collect()}  # a row for each language
    if not counts:
        return []
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_lang / n))]), F.col(lang))
    order = F.xxhash64(F.col(key), F.lit(17))
    drawn = labelled.where(F.pmod(order, F.lit(1_000_000)) < share * 1_000_000)
    raw = F.col(text).cast("binary")
    starts = F.greatest(F.lit(1), F.octet_length(raw) - TRAIN_SPAN // 2)
    parts = F.transform(F.sequence(F.lit(0), F.lit(TRAIN_WINDOWS - 1)), lambda i: F.substring(raw, (F.pmod(F.xxhash64(order, i), starts) + 1).cast("int"), F.lit(TRAIN_SPAN)))
    rows = drawn.orderBy(order, key).select(F.col(lang).alias("lang"), parts.alias("parts")).limit(per_lang * len(counts)).collect()  # bounded rows of 2 KB
    return [(bytes(part), r["lang"]) for r in rows for part in r["parts"]]


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All rows and columns, with lang_pred and score; columns of these names are replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", lang_pred string, score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("langid")
        own = shared.value
        for batch in batches:
            for first, texts in common.steps(batch, text):
                preds, scores = ["und"] * len(texts), np.zeros(len(texts))
                lettered = [i for i, t in enumerate(texts) if own and has_letter(t)]
                if lettered:
                    prob = score(own, [texts[i] for i in lettered])
                    best = prob.argmax(axis=1)
                    for i, k, p in zip(lettered, best.tolist(), prob.max(axis=1).tolist(), strict=True):
                        preds[i], scores[i] = own.langs[k], min(1.0, p)
                rows = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(preds), pa.array(scores)], [*rows.schema.names, "lang_pred", "score"])

    return common.small_batches(docs).mapInArrow(common.trimmed(run), schema)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model | None:
    return train(sample(docs, text, lang, key))

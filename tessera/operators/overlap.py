"""Blocks of candidates against stored rows, in one pass over the rows.

Similarity, containment and contradiction are shares of bigrams. A task turns its rows into a matrix over the
bigrams that the block's candidates hold, and one product with the candidates' matrix gives what every row
shares with every candidate. The pass keeps, for each candidate and test, the first few rows; only those leave
a task. Its cost is linear in the rows, whatever a layer holds.

Rows of Latin-1 letters, once composed and in lower case, are compared as bytes, all of a step at once; other
rows as code points. Both count the same grams.

The newest rows of a batch come first. A contradiction counts by time alone, so a candidate that has found as many as
it wants asks no older row for one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as V

#: Candidates that one pass compares, and characters of them.
BLOCK, BLOCK_CHARS = 256, 8_000_000
#: Rows, and cells of a matrix, that a task compares at a time.
ROWS, CELLS, BATCH_CHARS = 512, 1 << 25, 4_000_000
LISTED = "cand_id bigint, test string, id bigint, created bigint, score double, share double, len bigint"
#: A row without a time is the oldest.
UNDATED = -(2**63)
_POINTS = 0x110000


def norm(text: str) -> str:
    return regex.sub(r"[^\p{L}\p{N}\p{Script=Han}]+", "", unicodedata.normalize("NFKC", text).lower())


def grams(norm: str) -> frozenset[str]:
    return frozenset([norm] if len(norm) == 1 else (norm[i : i + 2] for i in range(len(norm) - 1)))


def statement(text: str) -> tuple[bool, str]:
    """Whether a negation occurs, and the text without negations and white space."""
    low = unicodedata.normalize("NFKC", text).lower()
    negative, rest = _affirmed(low)
    return negative, regex.sub(r"\s+", "", rest)


def _affirmed(low: str) -> tuple[bool, str]:
    rest = low
    for word in V.NEGATIONS:
        rest = rest.replace(word, "")
    return any(w in low for w in V.NEGATIONS), rest


#: Stands between rows of bytes: no text in lower case holds it.
_BETWEEN = b"A"


@lru_cache(1)
def _latin() -> tuple[bytes, bytes, bytes, list[bytes], int]:
    """For texts of bytes: what ``norm`` drops, white space, the number of each letter (from 1), the negations and how many numbers there are.

    A Latin-1 text that is composed and in lower case stays so whatever is taken out of it, as it has no marks that combine.
    """
    points = [chr(c) for c in range(256) if chr(c) != "A"]
    drop = [c for c in points if not regex.fullmatch(r"[\p{L}\p{N}\p{Script=Han}]", c)]
    white = [c for c in points if regex.fullmatch(r"\s", c)]
    kept = [c for c in points if c not in drop and unicodedata.normalize("NFKC", c).lower() == c]
    number = bytearray(256)
    for i, c in enumerate(kept):
        number[ord(c)] = i + 1
    words = [w.encode("latin-1") for w in V.NEGATIONS if w.isascii()]
    return "".join(drop).encode("latin-1"), "".join(white).encode("latin-1"), bytes(number), words, len(kept) + 1


def _sizes(joined: bytes) -> np.ndarray:
    """The number of bytes of each row."""
    return np.diff(np.flatnonzero(np.frombuffer(joined, np.uint8) == _BETWEEN[0]), prepend=-1) - 1


def _is_latin(low: str) -> bool:
    if low.isascii():
        return True
    try:
        low.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _joined(low: list[str]) -> bytes:
    return b"".join([t.encode("latin-1") + _BETWEEN for t in low])


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether ``norm`` keeps it, and whether it is white space."""
    out = []
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, _POINTS)]))
    for pattern in (r"[\p{L}\p{N}\p{Script=Han}]+", r"\s+"):
        held = np.zeros(_POINTS, bool)
        for found in regex.findall(pattern, points):
            held[_flat([found])[0]] = True
        out.append(held)
    return out[0], out[1]


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and the number of each."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.array([len(t) for t in texts], np.int64)


def _kept(points: np.ndarray, sizes: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = np.concatenate([[0], np.cumsum(keep)])
    ends = np.cumsum(sizes)
    return points[keep], sums[ends] - sums[ends - sizes]


class Grams:
    """The grams of a block's candidates, as columns."""

    def __init__(self, norms: list[str]):
        sets = [grams(n) for n in norms]
        names = sorted({g for s in sets for g in s})
        at = {g: i for i, g in enumerate(names)}
        # a single character stands for itself: it follows a mark that no norm holds
        points = np.array([[0, ord(g)] if len(g) == 1 else [ord(g[0]), ord(g[1])] for g in names], np.int64).reshape(-1, 2)
        self.first, self.second = points[:, 0], points[:, 1]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.held = np.zeros((len(names), len(norms)), np.float32)
        for c, own in enumerate(sets):
            self.held[[at[g] for g in own], c] = 1

        _, _, number, _, self.letters = _latin()
        narrow = (self.first < 256) & (self.second < 256)
        code = np.frombuffer(number, np.uint8).astype(np.int64)
        a, b = code[np.where(narrow, self.first, 0)], code[np.where(narrow, self.second, 0)]
        #: The grams that rows of bytes can hold, and their cells.
        self.narrow = np.flatnonzero(narrow & (b > 0) & ((a > 0) | (self.first == 0)))
        self.cells = (a * self.letters + b)[self.narrow]
        self.narrow_held = np.ascontiguousarray(self.held[self.narrow])

    def shared_bytes(self, joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For normalised rows of bytes: the size of each, and as ``shared``."""
        wide = self.letters
        codes = np.frombuffer(_BETWEEN + joined, np.uint8)
        codes = np.frombuffer(_latin()[2], np.uint8)[codes]
        ends = np.flatnonzero(codes == 0)
        n, sizes = len(ends) - 1, np.diff(ends) - 1
        pair = codes[:-1].astype(np.uint16)
        pair *= wide
        pair += codes[1:]
        bits = np.zeros((n, wide * wide), bool)
        for r, (start, stop) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            bits[r][pair[start:stop].astype(np.int64)] = True
        bits = bits.reshape(n, wide, wide)
        bits[:, 0, :] = False
        bits[:, :, 0] = False
        alone = np.flatnonzero(sizes == 1)
        bits[alone, 0, codes[ends[alone] + 1]] = True
        bits = bits.reshape(n, wide * wide)
        counts = np.count_nonzero(bits, axis=1)
        return sizes, counts.astype(np.int64), (bits[:, self.cells].astype(np.float32) @ self.narrow_held).astype(np.int64)

    def shared(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For normalised rows: distinct grams of each, and how many it shares with each candidate."""
        n, wide = len(sizes), len(self.first)
        number = np.zeros(_POINTS, np.int64)
        number[points], number[0] = 1, 1
        alphabet = np.flatnonzero(number)
        number[:] = -1
        number[alphabet] = np.arange(len(alphabet))
        letters = len(alphabet)
        row = np.repeat(np.arange(n), sizes)
        coded = number[points]
        inner = row[1:] == row[:-1]
        alone = np.flatnonzero(sizes == 1)
        pair = np.concatenate([(coded[:-1] * letters + coded[1:])[inner], coded[(np.cumsum(sizes) - sizes)[alone]]])
        row = np.concatenate([row[:-1][inner], alone])
        a, b = number[self.first], number[self.second]
        known = np.flatnonzero((a >= 0) & (b >= 0))
        columns = a[known] * letters + b[known]
        found = np.zeros((n, wide), np.float32)
        if letters * letters * n <= CELLS:
            bits = np.zeros((n, letters * letters), bool)
            bits[row, pair] = True
            counts = bits.sum(axis=1)
            found[:, known] = bits[:, columns]
        else:
            own = np.unique(row * letters * letters + pair)
            row, pair = np.divmod(own, letters * letters)
            counts = np.bincount(row, minlength=n)
            if len(columns):
                order = np.argsort(columns)
                at = np.minimum(np.searchsorted(columns[order], pair), len(columns) - 1)
                hit = columns[order][at] == pair
                found[row[hit], known[order[at[hit]]]] = 1
        return counts.astype(np.int64), (found @ self.held).astype(np.int64)


@dataclass
class Asked:
    """A candidate: ``depth`` rows are wanted for each test of its layer; ``far`` is the key it corrects (None: any)."""

    cand_id: int
    title: str | None
    text: str | None
    layer: tuple[str | None, str | None]
    depth: int = 1
    corrects: bool = False
    far: str | None = None


class _First:
    """The first rows found for each candidate, by score, time and id."""

    def __init__(self, depths: list[int]):
        self.depths = depths
        self.rows: list[list[np.ndarray] | None] = [None] * len(depths)

    def add(self, c: int, *columns: np.ndarray) -> None:
        """``columns``: score, created, id, share, len."""
        held = self.rows[c]
        if held is not None:
            if len(held[0]) == self.depths[c]:
                keep = columns[0] >= held[0][-1]
                if not keep.any():
                    return
                if not keep.all():
                    columns = tuple(x[keep] for x in columns)
            columns = tuple(np.concatenate(p) for p in zip(held, columns, strict=True))
        k = self.depths[c]
        if len(columns[0]) > 4 * k + 64:  # rows of a score under the k-th need no sorting
            least = np.partition(columns[0], len(columns[0]) - k)[len(columns[0]) - k]
            columns = tuple(x[m] for m in [columns[0] >= least] for x in columns)
        order = np.lexsort((columns[2], columns[1], columns[0]))[::-1][:k]
        self.rows[c] = [x[order] for x in columns]

    def since(self) -> np.ndarray:
        """For a test without a score: the time from which on a row can still come in, for each candidate."""
        return np.array([UNDATED if held is None or len(held[0]) < k else held[1][-1] for held, k in zip(self.rows, self.depths, strict=True)], np.int64)


def _contains(asked: str, stored: str) -> bool:
    return asked in stored if len(asked) <= len(stored) else stored in asked


def _stable(text: str) -> bool:
    return text.isascii() or (unicodedata.is_normalized("NFKC", text) and text.lower() == text)


class Block:
    """Candidates with what comparisons need, made once on the driver."""

    def __init__(self, asked: list[Asked], threshold: float, overlap: float):
        self.asked, self.threshold, self.overlap = asked, threshold, overlap
        self.layers = {layer: i for i, layer in enumerate(dict.fromkeys(a.layer for a in asked if None not in a.layer))}
        self.layer = np.array([self.layers.get(a.layer, -2) for a in asked])
        self.keys = {key: i for i, key in enumerate(dict.fromkeys(a.far for a in asked if a.corrects and a.far is not None))}
        self.corrects = np.array([a.corrects for a in asked])
        self.any_key = np.array([a.corrects and a.far is None for a in asked])
        self.key = np.array([self.keys[a.far] if a.corrects and a.far is not None else -2 for a in asked])
        texts = [a.text or "" for a in asked]
        self.given = np.array([a.text is not None for a in asked])
        self.norms = [norm(t) for t in texts]
        self.titled = np.array([bool(a.title) and a.text is not None for a in asked])
        said = [statement(t) for t in texts]
        self.negative, self.rest = np.array([s[0] for s in said]), [s[1] for s in said]
        self.length = np.array([len(r) for r in self.rest], np.int64)
        rest_norms = [norm(r) for r in self.rest]
        # a text in another gives a share of 1, but where there is no bigram or normalising again changes the text
        self.odd = np.array([len(n) <= 1 or not _stable(r) for n, r in zip(rest_norms, self.rest, strict=True)])
        self.body, self.affirmed = Grams(self.norms), Grams(rest_norms)
        self.full = Grams([norm(f"{a.title} {a.text}") if t else "" for a, t in zip(asked, self.titled, strict=True)]) if self.titled.any() else None
        self.exact: dict[str, list[int]] = {}
        for c, n in enumerate(self.norms):
            if self.given[c]:
                self.exact.setdefault(n, []).append(c)

    def compare(self, rows: dict, first: dict[str, _First], seen: set[int]) -> None:
        """Takes some rows (columns as lists) into ``first``, and the layers that they are of into ``seen``."""
        layer = np.array([self.layers.get(x, -1) for x in zip(rows["scope"], rows["layer_key"], strict=True)])
        key = np.array([self.keys.get(k, -1) for k in rows["project_key"]])
        near = layer[:, None] == self.layer[None, :]
        seen.update(layer[layer >= 0].tolist())
        far = self.any_key[None, :] | (key[:, None] == self.key[None, :])
        given = np.array([t is not None for t in rows["text"]])[:, None] & self.given[None, :]
        created = _times(rows["created"])
        late = {test: created[:, None] >= first[test].since()[None, :] for test in ("clash", "wide")}
        asked = given & (near & late["clash"] | far & late["wide"])
        at = np.flatnonzero((near | asked).any(axis=1))
        low = [unicodedata.normalize("NFKC", rows["text"][r] or "").lower() for r in at.tolist()]
        latin = np.array([_is_latin(t) for t in low], bool)
        for kind in (True, False):
            own = np.flatnonzero(latin == kind)
            if len(own):
                r = at[own]
                some = {name: [rows[name][i] for i in r.tolist()] for name in ("id", "title", "text")} | {"created": created[r], "low": [low[i] for i in own.tolist()]}
                self._compare(some, kind, near[r], far[r], given[r], asked[r], first)

    def _compare(self, rows: dict, latin: bool, near: np.ndarray, far: np.ndarray, given: np.ndarray, asked: np.ndarray, first: dict[str, _First]) -> None:
        ids, created = np.array(rows["id"], np.int64), rows["created"]
        length = np.array([len(t or "") for t in rows["text"]], np.int64)
        score, share, exact = (np.zeros(near.shape, kind) for kind in (float, float, bool))
        at = np.flatnonzero(near.any(axis=1))  # other rows are asked for contradictions alone
        if len(at):
            score[at], share[at], exact[at] = self._alike([rows["low"][r] for r in at], [rows["title"][r] for r in at], [rows["text"][r] for r in at], given[at], latin)
        clash = (self._clashes_bytes if latin else self._clashes)(rows["low"], asked)
        none = np.zeros(len(ids))
        tests = (("best", near & (score >= self.threshold), score), ("exact", near & exact & given, None), ("clash", near & clash, None), ("wide", clash & far, None))
        for name, hit, by in tests:
            for c in np.flatnonzero(hit.any(axis=0)).tolist():
                r = np.flatnonzero(hit[:, c])
                first[name].add(c, (none if by is None else by[:, c])[r], created[r], ids[r], share[r, c], length[r])

    def _alike(self, low: list[str], titles: list, texts: list, given: np.ndarray, latin: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Similarity, share of the candidate's grams, and equality, of each row and candidate."""
        if latin:
            joined = _joined(low).translate(None, _latin()[0])
            sizes, own, shared = self.body.shared_bytes(joined)
        else:
            points, sizes = _flat(low)
            points, sizes = _kept(points, sizes, _classes()[0][points])
            own, shared = self.body.shared(points, sizes)
        total = own[:, None] + self.body.sizes[None, :] - shared
        score = np.where(given & (total > 0), shared / np.maximum(total, 1), 0.0)
        share = shared / np.maximum(self.body.sizes, 1)[None, :]
        if self.full is not None:
            # a row without a title has no titled form, as null takes all of a concatenation
            both = [unicodedata.normalize("NFKC", f"{a} {t}").lower() if a is not None and t is not None else "" for a, t in zip(titles, texts, strict=True)]
            if latin and all(map(_is_latin, both)):
                _, titled, shared = self.full.shared_bytes(_joined(both).translate(None, _latin()[0]))
            else:
                at, of = _flat(both)
                titled, shared = self.full.shared(*_kept(at, of, _classes()[0][at]))
            total = titled[:, None] + self.full.sizes[None, :] - shared
            score = np.where(given & self.titled[None, :] & (total > 0), np.maximum(score, shared / np.maximum(total, 1)), score)
        exact = np.zeros(given.shape, bool)
        wanted = {len(n) for n in self.exact}
        ends = np.cumsum(sizes + 1 if latin else sizes)
        for r in np.flatnonzero(np.isin(sizes, list(wanted))).tolist():
            said = joined[ends[r] - 1 - sizes[r] : ends[r] - 1].decode("latin-1") if latin else points[ends[r] - sizes[r] : ends[r]].tobytes().decode("utf-32-le")
            for c in self.exact.get(said, ()):
                exact[r, c] = True
        return score, share, exact

    def _clashes_bytes(self, low: list[str], asked: np.ndarray) -> np.ndarray:
        """Which of the ``asked`` pairs contradict each other, for Latin-1 rows."""
        drop, white, _, words, _ = _latin()
        out = np.zeros(asked.shape, bool)
        at = np.flatnonzero(asked.any(axis=1))
        if not len(at):
            return out
        joined = rest = _joined([low[r] for r in at])
        for word in words:
            rest = rest.replace(word, b"")
        negative = _sizes(joined) != _sizes(rest)
        wanted = asked[at] & (negative[:, None] != self.negative[None, :])
        some = wanted.any(axis=1)
        if not some.any():
            return out
        said = rest.split(_BETWEEN)
        said = [said[r].translate(None, white) for r in np.flatnonzero(some)]
        at, wanted = at[some], wanted[some]
        length = np.array([len(t) for t in said], np.int64)
        count, own, shared = self.affirmed.shared_bytes(b"".join([t + _BETWEEN for t in said]).translate(None, drop))
        out[at] = self._overlapping(wanted, length, own, shared, count <= 1, lambda r: said[r].decode("latin-1"))
        return out

    def _clashes(self, low: list[str], asked: np.ndarray) -> np.ndarray:
        """As ``_clashes_bytes``, for any rows."""
        letters, white = _classes()
        out = np.zeros(asked.shape, bool)
        at = np.flatnonzero(asked.any(axis=1))
        said = [_affirmed(low[r]) for r in at.tolist()]
        wanted = asked[at] & (np.array([s[0] for s in said], bool)[:, None] != self.negative[None, :])
        some = np.flatnonzero(wanted.any(axis=1))
        if not len(some):
            return out
        at, wanted, rest = at[some], wanted[some], [said[r][1] for r in some.tolist()]
        points, sizes = _flat(rest)
        length = _kept(points, sizes, ~white[points])[1]
        kept, count = _kept(points, sizes, letters[points])
        odd = count <= 1
        for r, text in enumerate(rest):
            if not text.isascii():
                rest[r] = text = regex.sub(r"\s+", "", text)
                if not _stable(text):
                    odd[r] = True
        if any(not _stable(rest[r]) for r in np.flatnonzero(odd).tolist()):  # their norms are made anew
            norms = [norm(t) if odd[r] else t for r, t in enumerate(rest)]
            points, sizes = _flat(norms)
            kept, count = _kept(points, sizes, letters[points])
        own, shared = self.affirmed.shared(kept, count)
        out[at] = self._overlapping(wanted, length, own, shared, odd, lambda r: regex.sub(r"\s+", "", rest[r]))
        return out

    def _overlapping(self, wanted: np.ndarray, length: np.ndarray, own: np.ndarray, shared: np.ndarray, odd: np.ndarray, said: Callable[[int], str]) -> np.ndarray:
        """Of the ``wanted`` pairs, those where the shorter statement is in the longer one, or most of its grams are. ``odd``: rows whose grams do not tell the first."""
        shorter = self.length[None, :] <= length[:, None]
        size = np.where(shorter, self.affirmed.sizes[None, :], own[:, None])
        wanted = wanted & (np.minimum(self.length[None, :], length[:, None]) > 0)
        out = wanted & (size > 0) & (shared / np.maximum(size, 1) >= self.overlap)
        left = wanted & ~out & (odd[:, None] | self.odd[None, :])
        for r in np.flatnonzero(left.any(axis=1)).tolist():
            text = said(r)
            for c in np.flatnonzero(left[r]).tolist():
                out[r, c] = _contains(self.rest[c], text)
        return out


def _times(created: list) -> np.ndarray:
    return np.array([UNDATED if c is None else c for c in created], np.int64)


def _steps(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch as lists, of bounded number and text at a time, the newest first."""
    rows = batch.to_pydict()
    newest = np.argsort(_times(rows["created"]), kind="stable")[::-1].tolist()
    rows = {name: [column[r] for r in newest] for name, column in rows.items()}
    sizes = np.array([len(t or "") + len(s or "") for t, s in zip(rows["text"], rows["title"], strict=True)], np.int64)
    start = 0
    while start < len(sizes):
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start : start + ROWS]), BATCH_CHARS, "right")))
        stop = min(stop, start + ROWS, len(sizes))
        yield {name: column[start:stop] for name, column in rows.items()}
        start = stop


def listed(rows: DataFrame, asked: list[Asked], threshold: float, overlap: float = V.CONTRADICTION_OVERLAP) -> DataFrame:
    """For each candidate and test, the first rows: cand_id, test, id, created, score, share, len.

    ``rows``: id, created, scope, layer_key, project_key, title, text. Tests: ``best`` (similarity of at
    least ``threshold``, highest first), ``exact`` (equal when normalised) and ``clash`` (contradicts), of which
    ``depth`` rows are given, newest first; ``wide`` (the newest row that a correction contradicts); ``pool``
    (one row without an id: the layer has rows). ``share`` is that of the candidate's grams which the row holds.
    """
    block = Block(asked, threshold, overlap)
    spark = rows.sparkSession
    rows = rows.select("id", "created", "scope", "layer_key", "project_key", "title", "text")
    if not block.corrects.any():
        layers = spark.createDataFrame(list(block.layers) or [(None, None)], "scope string, layer_key string")
        rows = rows.join(F.broadcast(layers), ["scope", "layer_key"], "left_semi").select("id", "created", "scope", "layer_key", "project_key", "title", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depths = [a.depth for a in block.asked]
        first = {t: _First(depths) for t in ("best", "exact", "clash")} | {"wide": _First([1] * len(depths))}
        seen: set[int] = set()
        for batch in batches:
            for some in _steps(batch):
                block.compare(some, first, seen)
        for test, found in first.items():
            held = [(a.cand_id, *columns) for a, columns in zip(block.asked, found.rows, strict=True) if columns is not None]
            if held:
                cands, *columns = zip(*held, strict=True)
                score, created, ids, share, length = map(np.concatenate, columns)
                own = [c for c, x in zip(cands, columns[0], strict=True) for _ in x]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *[pa.array(x) for x in ([test] * len(ids), ids, created, score, share, length)]], _NAMES)
        own = [a.cand_id for a, layer in zip(block.asked, block.layer.tolist(), strict=True) if layer in seen]
        if own:
            n = len(own)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(["pool"] * n), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int64())], _NAMES)

    found = rows.mapInArrow(run, LISTED)
    place = F.row_number().over(W.partitionBy("cand_id", "test").orderBy(F.desc("score"), F.desc("created"), F.desc("id")))
    ranked = found.withColumn("__r", place)
    if len({a.depth for a in asked}) == 1:
        ranked = ranked.withColumn("depth", F.lit(asked[0].depth))
    else:
        depths = spark.createDataFrame([(a.cand_id, a.depth) for a in asked], "cand_id bigint, depth int")
        ranked = ranked.join(F.broadcast(depths), "cand_id")
    return ranked.where(F.col("__r") <= F.when(F.col("test").isin("wide", "pool"), 1).otherwise(F.col("depth"))).drop("depth")


_NAMES = [part.strip().split(" ")[0] for part in LISTED.split(",")]

"""Byte-pair encoding by backtracking, and decoding by an offset table.

The encoder never replays merges. An Aho-Corasick automaton over the token strings finds every
token at every place of a word in one pass; the encoder takes the longest token at each place and
goes on while the new token is compatible with the one before, which a table of merge ranks tells
(two tokens are compatible if encoding their joined text gives exactly these two). Where no token
is compatible it steps back and tries the next shorter one; a place found dead stays dead, so each
place is left at most once and the work stays linear in the word. The result is the merge order's.

Decoding joins token strings cut from one long string by a table of offsets.

Defined results: a null text counts as empty, has no tokens and decodes to the empty string; an
empty string likewise; texts of any length are encoded whole, piece by piece of white space;
repeated rows, also of null ids, are encoded one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common

#: Stands after the last letter of a word while matching; no text holds it, as letters are byte symbols.
END = "\0"
_LOW = (1 << 20) - 1
START = _LOW
#: No character below it combines or is unassigned.
FIRST_COMBINING = "\u0300"
#: Pieces between white space that a worker remembers.
CACHE_PIECES = 1_400_000
_ODD_SPACES = re.compile("[\\x1c-\\x1f]")
_SPACES = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


class Remembered(dict):
    """What ``make`` gives for a key; when full, the entries used since the last time stay."""

    def __init__(self, make, limit: int = CACHE_PIECES):
        self.make, self.limit, self.older = make, limit // 2, {}

    def __missing__(self, key):
        value = self.older.get(key, self)
        if value is self:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_symbols() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return table


class Encoder:
    """A word-end BPE vocabulary file of the ``tokenizers`` library, read as JSON."""

    def __init__(self, path: str):
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._special_start = os.path.commonprefix(list(self.special))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile(split["pattern"]["Regex"])
        self._symbols = byte_symbols()
        self.parts: dict[int, tuple[int, int]] = {}
        self.ranks: dict[int, int] = {}  # by left << 20 | right
        self.rank_of: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab.get(left + right)
            a, b = vocab.get(left), vocab.get(right)
            if None in (made, a, b):
                continue
            self.ranks[a << 20 | b] = rank
            if made not in self.parts:
                self.parts[made], self.rank_of[made] = (a, b), rank
        tokens = range(max(vocab.values()) + 1)
        self.rank_list = [self.rank_of.get(i, -1) for i in tokens]
        self.left, self.right = ([self.parts.get(i, (i, i))[side] for i in tokens] for side in (0, 1))
        self.automaton, shown_of = ahocorasick.Automaton(), {}
        self.sizes: dict[int, int] = {}
        for token, i in vocab.items():
            shown = token.removesuffix(self.suffix) + END if token.endswith(self.suffix) else token
            self.sizes[i], shown_of[i] = len(shown), shown
            self.automaton.add_word(shown, i)
        self.automaton.make_automaton()
        #: Whether a token may follow another, by before << 20 | token; ``START`` stands before the first.
        self._fits = Remembered(lambda pair: self.usable(pair & _LOW) and (pair >> 20 == START or self._seam_holds(pair >> 20, pair & _LOW)), 600_000)
        #: The longest token that a token starts with, other than itself.
        self._shorter = Remembered(lambda token: self._prefix_of(shown_of[token]), len(vocab) * 2 + 2)
        self._usable: dict[int, bool] = {}
        self._words_seen = Remembered(self.word, 150_000)
        self._closing = frozenset(".,!?;:)")
        names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        top = max(names) + 1
        self.blob = "".join(names.get(i, "") for i in range(top))
        self.offsets = [0]
        for i in range(top):
            self.offsets.append(self.offsets[-1] + len(names.get(i, "")))

    # -- compatibility -------------------------------------------------------------------------

    def _seam_holds(self, a: int, b: int) -> bool:
        """Whether the text of two tokens, encoded as one, gives exactly these two tokens.

        Undoes merges from the latest: at each step the pair that meets at the seam must not have
        had an earlier merge of its own than the one that built the side which is undone next.
        """
        ranks, rank_of, left, right = self.ranks, self.rank_list, self.left, self.right
        limit = sys.maxsize  # ranks from here on come too late to join the seam
        while True:
            meet = ranks.get(a << 20 | b)
            if meet is not None and meet < limit:
                return False
            rank_a, rank_b = rank_of[a], rank_of[b]
            if rank_a > rank_b:  # of equal ranks the left one merges first, so the right is undone first
                limit, a = rank_a, right[a]
            elif rank_b >= 0:
                limit, b = rank_b + 1, left[b]
            else:
                return True

    def usable(self, token: int) -> bool:
        """Whether merging the token's own text gives the token; others never occur in an encoding."""
        known = self._usable.get(token)
        if known is None:
            parts = self.parts.get(token)
            known = parts is None or (self.usable(parts[0]) and self.usable(parts[1]) and self._joins(*parts))
            self._usable[token] = known
        return known

    def _prefix_of(self, shown: str) -> int | None:
        return next((self.automaton.get(shown[:n]) for n in range(len(shown) - 1, 0, -1) if self.automaton.exists(shown[:n])), None)

    def _joins(self, a: int, b: int) -> bool:
        limit = self.ranks[a << 20 | b]
        while True:
            rank_a, rank_b = self.rank_of.get(a, -1), self.rank_of.get(b, -1)
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:
                limit, a = min(limit, rank_a), self.parts[a][1]
            else:
                limit, b = min(limit, rank_b + 1), self.parts[b][0]
            meet = self.ranks.get(a << 20 | b)
            if meet is not None and meet < limit:
                return False

    # -- encoding ------------------------------------------------------------------------------

    def word(self, word: str) -> list[int]:
        """Ids of one word of the pre-tokenizer, already normalised."""
        if word.isascii() and word.isprintable():
            text = word + END
        else:
            text = word.encode().decode("latin-1").translate(self._symbols) + END
        # the longest match at each place, as long as neighbours are compatible, is the encoding
        out, fits, before, pos = [token for _, token in self.automaton.iter_long(text)], self._fits, START, 0
        for k, token in enumerate(out):
            if not fits[before << 20 | token]:
                return self._backtrack(text, out[:k], pos, token)
            pos += self.sizes[token]
            before = token
        return out if pos == len(text) else self._backtrack(text, out[:-1], pos - self.sizes[before], before)

    def _backtrack(self, text: str, out: list[int], pos: int, token: int | None) -> list[int]:
        """Goes on from the accepted tokens ``out``, which end at ``pos``; ``token`` is to be replaced by a shorter one."""
        size, sizes, fits, shorter, longest = len(text), self.sizes, self._fits, self._shorter, self.automaton.iter_long
        dead = bytearray(size + 1)
        token = shorter[token]
        while pos < size:
            before = out[-1] if out else START
            while token is not None and (dead[pos + sizes[token]] or not fits[before << 20 | token]):
                token = shorter[token]
            if token is not None:
                out.append(token)
                pos += sizes[token]
                token = next(longest(text, pos), (0, None))[1] if pos < size else None
            elif out:
                dead[pos] = 1
                token = out.pop()
                pos -= sizes[token]
                token = shorter[token]
            else:
                raise ValueError(f"no encoding of {text[:-1]!r}")
        return out

    def piece(self, piece: str) -> list[int]:
        """Ids of a text without white space."""
        if self._special_start in piece and self._special_re:
            out: list[int] = []
            for part in self._special_re.split(piece):
                out += [self.special[part]] if part in self.special else self._plain(part)
            return out
        return self._plain(piece)

    def _plain(self, text: str) -> list[int]:
        if not text.isascii():
            if max(text) >= FIRST_COMBINING and any(unicodedata.combining(c) or unicodedata.category(c) == "Cn" for c in text):
                return self._by_library(text)
            text = unicodedata.normalize("NFC", text)
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        if text.isalpha():
            return self._words_seen[text]
        if text[-1:] in self._closing and text[:-1].isalpha():
            return self._words_seen[text[:-1]] + self._words_seen[text[-1]]
        out: list[int] = []
        for word in self._words.findall(text):
            out += self._words_seen[word]
        return out

    def _by_library(self, text: str) -> list[int]:
        """Ids of a text with unassigned or combining characters, on which character tables of different
        age disagree: the library's own tables normalise it and cut it into words."""
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
        text = self._library.normalizer.normalize_str(text)
        return [i for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text) for i in self._words_seen[text[a:b]]]

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The text cut at white space, as the normaliser sees it."""
        return [p for p in _SPACES.split(text) if p] if _ODD_SPACES.search(text) else text.split()

    def encode(self, text: str | None) -> list[int]:
        return [i for p in self.pieces(text or "") for i in self.piece(p)]

    # -- decoding ------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by a blank, as a vocabulary without a decoder has it."""
        blob, at, last = self.blob, self.offsets, len(self.offsets) - 2
        return " ".join([blob[at[i] : at[i + 1]] if 0 <= i <= last else "" for i in ids])


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(4)
def _shown(path: str) -> Remembered:
    """A piece's ids as text, and their decoding."""
    own = encoder(path)

    def make(piece: str) -> tuple[str, str]:
        ids = own.piece(piece)
        return " ".join(map(str, ids)), own.decode(ids)

    return Remembered(make, CACHE_PIECES * 4 // 5)


def _forget() -> None:
    _shown.cache_clear()
    encoder.cache_clear()


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every whole text encoded and decoded again: key, n_tokens, ids (decimal, blank between), decoded.

    The vocabulary file must be readable at ``path`` on every executor.
    """
    return _encoded(docs, path, text, key, digests=False)


def encode_digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As ``encode_documents``, with SHA-256 digests of both strings in place of the strings."""
    return _encoded(docs, path, text, key, digests=True)


def _encoded(docs: DataFrame, path: str, text: str, key: str, digests: bool) -> DataFrame:
    source = docs.select(F.col(key), F.col(text).alias("__text"))
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"] if digests else [key, "n_tokens", "ids", "decoded"]
    schema = f"`{key}` {source.schema[0].dataType.simpleString()}, n_tokens bigint, {names[2]} string, {names[3]} string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("bpe", _forget)
        shown_of = _shown(path)
        for batch in batches:
            for first, texts in common.steps(batch, "__text"):
                counts, ids, decoded = [], [], []
                for raw in texts:
                    shown = list(map(shown_of.__getitem__, Encoder.pieces(raw.decode("utf-8", "replace")))) if raw else []
                    line = " ".join([s[0] for s in shown])
                    back = " ".join([s[1] for s in shown])
                    counts.append(line.count(" ") + 1 if line else 0)
                    ids.append(hashlib.sha256(line.encode()).hexdigest() if digests else line)
                    decoded.append(hashlib.sha256(back.encode()).hexdigest() if digests else back)
                own = batch.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([own, pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names)

    return common.small_batches(source).mapInArrow(common.trimmed(run), schema)

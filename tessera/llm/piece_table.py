"""Token ids of whole texts, a batch at a time, from a table of pieces in numpy arrays.

A batch's bytes are cut at white space and each piece gets a 64-bit hash of its bytes, without a
Python object for a piece that is known. The table (open addressing, linear probing) leads from the
hash to the piece's bytes and ids in two pools; only pieces that are not in it yet are decoded and
encoded. Every piece's bytes are compared with those that its slot holds, and a piece that merely
shares a hash is looked up again under another one. The table has a fixed number of slots and starts
afresh when half are used.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np

from . import bpe, common

SLOTS = 1 << 22
#: Set in every hash, as 0 stands for an empty slot.
_USED = np.uint64(1 << 63)


class PieceTable:
    def __init__(self, encoder: bpe.Encoder, slots: int = SLOTS):
        self.encoder, self.slots = encoder, slots
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.place, self.size = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
        self.pool, self.filled, self.used = np.zeros(1 << 16, np.uint32), 0, 0
        self.spelled, self.letters = np.zeros(self.slots, np.int64), np.zeros(self.slots, np.int32)
        self.bytes, self.spent = np.zeros(1 << 16, np.uint8), 0

    def _slots_of(self, hashes: np.ndarray) -> np.ndarray:
        """The slot that holds each hash, or the empty one where it would go."""
        mask = np.uint64(self.slots - 1)
        slot = (hashes & mask).astype(np.int64)
        left = np.flatnonzero((self.keys[slot] != hashes) & (self.keys[slot] != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & int(mask)
            found = self.keys[slot[left]]
            left = left[(found != hashes[left]) & (found != 0)]
        return slot

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        known, rare = self.encoder.piece, self.encoder.encode
        ids = [known(raw.decode()) if raw.isascii() else rare(raw.decode("utf-8", "replace")) for raw in pieces]
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        if self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), np.uint32)])
        self.pool[self.filled : self.filled + len(flat)] = flat
        place = (self.filled + np.cumsum(size) - size).astype(np.int32)
        self.filled += len(flat)
        self.used += len(pieces)
        letters = np.fromiter(map(len, pieces), np.int32, len(pieces))
        spelling = np.frombuffer(b"".join(pieces), np.uint8)
        if self.spent + len(spelling) + 8 > len(self.bytes):  # eight more, as bytes are read eight at a time
            self.bytes = np.concatenate([self.bytes, np.zeros(max(len(self.bytes), len(spelling) + 8), np.uint8)])
        self.bytes[self.spent : self.spent + len(spelling)] = spelling
        spelled = self.spent + np.cumsum(letters, dtype=np.int64) - letters
        self.spent += len(spelling)
        left = np.arange(len(pieces))
        while len(left):
            slot, first = np.unique(self._slots_of(hashes[left]), return_index=True)
            own = left[first]
            self.keys[slot], self.place[slot], self.size[slot] = hashes[own], place[own], size[own]
            self.spelled[slot], self.letters[slot] = spelled[own], letters[own]
            left = np.delete(left, first)

    def _others(self, slot: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The pieces of ``data`` whose slot holds another piece."""
        bad = self.letters[slot] != sizes
        where, known, given = self.spelled[slot], np.ndarray(len(self.bytes) - 7, "<u8", self.bytes, 0, (1,)), common.lanes(data)
        at = np.flatnonzero(~bad & (sizes <= common.LONG_WORD))
        for k in range(0, common.LONG_WORD, 8):
            at = at[sizes[at] > k]
            bad[at] |= common.lane(known, where[at], sizes[at], k) != common.lane(given, starts[at], sizes[at], k)
        for i in np.flatnonzero(~bad & (sizes > common.LONG_WORD)).tolist():
            bad[i] = not np.array_equal(self.bytes[where[i] : where[i] + sizes[i]], data[starts[i] : starts[i] + sizes[i]])
        return np.flatnonzero(bad)

    def _known(self, hashes: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slots of all hashes, after learning those that are missing."""
        slot = self._slots_of(hashes)
        missing = np.flatnonzero(self.keys[slot] == 0)
        if not len(missing):
            return slot
        new, first = np.unique(hashes[missing], return_index=True)
        at = missing[first]
        if self.used + len(new) > self.slots // 2:
            new, at = np.unique(hashes, return_index=True)
            while len(new) > self.slots // 2:  # a batch with more pieces than the table takes
                self.slots *= 2
            self.reset()
        self._learn(new, [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        return self._slots_of(hashes)

    def encode(self, texts: list[bytes | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each followed by ``end``, and the number of each text's ids."""
        raw = b" ".join(t or b"" for t in texts)
        lengths = np.array([len(t or b"") for t in texts], np.int64)
        bounds = np.cumsum(lengths + 1)
        data = np.frombuffer(raw, np.uint8)
        starts, ends, hashes = common.cut_words(data)
        hashes |= _USED
        while True:
            slot = self._known(hashes, raw, starts, ends)
            others = self._others(slot, data, starts, ends - starts)
            if not len(others):
                break
            hashes[others] = common.mix(hashes[others], 5) | _USED
        place, size = self.place[slot].astype(np.int64), self.size[slot].astype(np.int64)
        upto = np.searchsorted(starts, bounds)  # pieces before the end of each text
        totals = np.concatenate([[0], np.cumsum(size)])[upto]
        counts = np.diff(totals, prepend=0) + 1
        ids = np.full(int(counts.sum()), end, np.uint32)
        shift = np.repeat(np.arange(len(texts)), np.diff(upto, prepend=0))  # one end token for each text before
        out = np.cumsum(size) - size + shift
        total = int(size.sum())
        within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        ids[np.repeat(out, size) + within] = self.pool[np.repeat(place, size) + within]
        return ids, counts


@lru_cache(2)
def piece_table(path: str) -> PieceTable:
    return PieceTable(bpe.encoder(path))


def forget() -> None:
    piece_table.cache_clear()
    bpe.encoder.cache_clear()

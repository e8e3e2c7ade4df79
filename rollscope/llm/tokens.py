"""Token ids of whole texts with a public tokenizer, one encoding per distinct piece.

The tokenizer normalises, splits and only then merges, so the ids of a text are
the ids of its pieces in order.  White space always splits.  Words of plain
signs (printable ASCII without the apostrophe, and the letters U+00C0-U+00FF)
are split further into the tokenizer's own pieces by numpy: normalising leaves
them alone and lower-casing maps letter by letter; a piece goes straight to the
merge model.  All other words go through the whole tokenizer.

Each Python worker keeps the ids of what it has met, by its bytes (a bounded table,
emptied when full); a text's ids are gathered by numpy.
"""
from __future__ import annotations

import gc
import os
from array import array

import numpy as np

from . import words as W

WORD_BPE = "word_bpe_49k.json"
MOST_UNITS = 1 << 19          # pieces and words that a worker keeps (about 150 bytes each)
SLICE = 1 << 20

# classes of bytes: 0 white space, 1 letter, 2 digit (a piece of its own), 3 other sign, 9 not plain
_CLASS = np.full(256, 9, np.uint8)
_CLASS[33:127] = 3
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[ord("'")] = 9                                   # contractions are left to the tokenizer
_CLASS[W._SPACE] = 0
_CLASS[0xC3] = 1
_CLASS[0x80:0xC0] = 1                                  # after 0xC3 only
#: The byte alphabet of byte-level merges: printable Latin-1 bytes stand for themselves, the others, in
#: order, for the letters from U+0100 on.
_LETTER = {b: 256 + i for i, b in enumerate(x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or x >= 174))}


def find_units(data: np.ndarray, off: np.ndarray):
    """(start, end, first, whole, lowered bytes): byte ranges of the units, each
    row's first unit, and which units are whole words for the tokenizer."""
    start, end, first = W.find_words(data, off)
    if not len(start):
        return start, end, first, np.zeros(0, bool), data
    before = np.concatenate([np.zeros(1, np.uint8), data[:-1]])
    kind = _CLASS[data]
    follows = (data & 0xC0) == 0x80
    kind[follows & (before != 0xC3)] = 9
    sign = np.flatnonzero(follows & ((data == 0x97) | (data == 0xB7)) & (before == 0xC3))      # the signs U+00D7, U+00F7
    kind[sign] = kind[sign - 1] = 3
    kind[:-1][(data[:-1] == 60) & (data[1:] == 124)] = 9                                        # "<|": special tokens
    odd = np.concatenate([np.zeros(1, np.int32), np.cumsum(kind == 9, dtype=np.int32)])
    odd = odd[end] > odd[start]
    change = np.zeros(len(data) + 1, np.int8)
    change[start[odd]] += 1
    change[end[odd]] -= 1
    whole = np.cumsum(change[:-1], dtype=np.int8) > 0
    inside = kind != 0
    s = inside & ~whole & ((kind != np.concatenate([_CLASS[32:33], kind[:-1]])) | (kind == 2))
    s[start] = True
    edge = np.zeros(len(data), bool)
    edge[end - 1] = True
    edge[:-1] |= s[1:] & inside[:-1]
    low = data + np.uint8(32) * (((data >= 65) & (data <= 90)) | ((before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)))
    unit = np.flatnonzero(s)
    return unit, np.flatnonzero(edge) + 1, np.searchsorted(unit, off), whole[unit], low.astype(np.uint8)


class Encoder:
    _made: dict[str, "Encoder"] = {}

    @classmethod
    def of(cls, name: str) -> "Encoder":
        """The worker's encoder for a vocabulary file of ``public_tokenizers``
        (or a path)."""
        if name not in cls._made:
            cls._made[name] = cls(name)
        return cls._made[name]

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        if not os.path.isabs(name):
            import public_tokenizers
            name = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(name)
        self.by_pieces = os.path.basename(name) == WORD_BPE
        self.clear()

    def clear(self):
        self.known = ({}, {})                               # place of a piece, and of a word, by its bytes
        self.at = np.zeros(1 << 12, np.int64)               # where its ids begin in the pool
        self.size = np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.count = self.used = 0

    def _learn(self, units, word: bool):
        """Keep the ids of new units (bytes): plain pieces, or words for the whole tokenizer."""
        gc.disable()              # many small objects come and go: nothing here makes cycles
        try:
            merge = self.tokenizer.model.tokenize
            if word:
                words = [u.decode() for u in units]
                got = [array("I", e.ids) for i in range(0, len(words), 4096)
                       for e in self.tokenizer.encode_batch_fast(words[i:i + 4096], add_special_tokens=False)]
            else:
                got = [array("I", [t.id for t in merge(u.decode() if u.isascii() else u.decode("latin-1").translate(_LETTER))])
                       for u in units]
            sizes = np.array([len(x) for x in got], np.int64)
            flat = np.frombuffer(b"".join(got), np.uint32)
            del got
        finally:
            gc.enable()
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        while self.count + len(units) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.at, self.size))
        self.pool[self.used:self.used + len(flat)] = flat
        here = slice(self.count, self.count + len(units))
        self.at[here], self.size[here] = self.used + np.cumsum(sizes) - sizes, sizes
        self.known[word].update(zip(units, range(here.start, here.stop)))
        self.used += len(flat)
        self.count = here.stop

    def _places(self, found, word: bool) -> np.ndarray:
        """The places of the units of an Arrow array; units are the same only if their bytes are."""
        found = found.dictionary_encode()
        units, place = found.dictionary.to_pylist(), self.known[word].get
        at = np.array([place(u, -1) for u in units], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self.count + np.arange(len(new))
            self._learn([units[i] for i in new.tolist()], word)
        return at[found.indices.to_numpy()]

    def encode(self, col):
        """Yield (row, ids) for every text of an Arrow string column (null: no ids)."""
        data, off = W.text_bytes(col)
        for i, j, part, po in W.slices(data, off, SLICE):
            if self.by_pieces:
                start, end, first, whole, low = find_units(part, po)
            else:
                (start, end, first), low = W.find_words(part, po), part
                whole = np.ones(len(start), bool)
            if self.count > MOST_UNITS:
                self.clear()
            place = np.empty(len(start), np.int64)
            place[~whole] = self._places(W.gathered(low, start[~whole], end[~whole]), False)
            place[whole] = self._places(W.gathered(part, start[whole], end[whole]), True)
            at, size = self.at[place], self.size[place]
            total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            ids = self.pool[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
            cut = total[first]
            for r in range(j - i):
                yield i + r, ids[cut[r]:cut[r + 1]]


def two_bytes(ids: np.ndarray) -> bytes:
    """Ids as little-endian 16-bit numbers; larger ones are an error."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("an id over 65,535 does not fit the 16-bit format")
    return ids.astype("<u2").tobytes()

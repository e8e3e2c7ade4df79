"""Operator 13: alignment of two tokenizers by merge-path partitioning.

A is a byte-level BPE of space + text, B a sentencepiece model that adds the space
itself.  Both cut the same bytes; where an A token and a B token end together,
a group ends, and the two tokens are linked.

1. Texts fall into units at spaces after a solid character: neither tokenizer has
   a token across such a place, so a unit's ids are the same alone as in the text.
   Each Python worker keeps the ids of the units that it has met, by their bytes.
   A unit whose joined token bytes differ from its own bytes makes its document
   one without tokens.
2. The token ends of a block of texts are two ascending lists.  Merge path: on
   evenly spaced diagonals of their grid, binary searches (all at once) find where
   the merge of the lists crosses; between two crossings lies a piece of ``PIECE``
   steps, whatever the texts and tokens are.  Pieces are merged independently and
   emit their common ends; where a diagonal separates the A token from the B token of
   a common end, the two border pieces are stitched.  Groups run from one
   common end to the next, over pieces.
3. A first pass counts linked id pairs.  The shorter token of a pair is a suffix of the
   longer, so there are no more pairs than the vocabularies have suffixes (some
   600,000), whatever the data: tasks and the driver hold at most that many counts, and
   they are broadcast to the second pass, which aligns again and sums up by document.

A long text is worked through in blocks of units; blocks end where groups end.

Cases: null and empty texts, and texts whose joined bytes differ (a text that holds
U+2581, for one), have no tokens: zeros, and '' for the hash.  Strings of special tokens are
plain text.  Repeated rows come out, and count, as often as they come.  Null doc_ids stay
null.  An empty table gives an empty result.  Columns beside doc_id and text are not read.
"""
from __future__ import annotations

import gc
import hashlib
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tokens import _LETTER

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
PIECE = 1 << 16                # steps of the merge in one piece
UNITS = 1 << 16                # units in one block
MOST_UNITS = 1 << 20           # units that a worker keeps (about 250 bytes each)
SLICE = 1 << 20
#: A space, plain letters, and signs but the apostrophe: two pieces of A's own splitting.
PLAIN = re.compile(rb" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+([!-&(-/:-@\[-`{-~]*)")


def with_spaces(data: np.ndarray, off: np.ndarray):
    """(bytes, offsets) with a space before every text that is not empty."""
    some = np.flatnonzero(np.diff(off) > 0)
    moved = np.concatenate([[0], np.cumsum(np.diff(off) > 0)])
    return np.insert(data, off[some], np.uint8(32)), off + moved


def unit_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where units begin: with a text, and at a space after a solid character -- printable
    ASCII, or one outside the blocks that hold white space."""
    n = len(data)
    start = np.zeros(n + 1, bool)
    start[off] = True
    if n > 4:
        b = np.concatenate([np.zeros(4, np.uint8), data])
        one, two, three, four = b[3:-1], b[2:-2], b[1:-3], b[:-4]
        follows = (one & 0xC0) == 0x80
        solid = (one > 32) & (one < 127)
        solid |= follows & (two >= 0xC3) & (two <= 0xDF)
        solid |= follows & ((two & 0xC0) == 0x80) & (((three >= 0xE4) & (three <= 0xEF)) | (((three & 0xC0) == 0x80) & (four >= 0xF0)))
        start[:-1] |= (data == 32) & solid
    return np.flatnonzero(start[:-1])


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """How many of ``a`` the merge of the ascending ``a`` and ``b`` (of equals, ``a`` first) has
    taken at the diagonals 0, piece, 2 * piece, ... and at the end."""
    n, m = len(a), len(b)
    diagonal = np.append(np.arange(0, n + m, piece), n + m)
    low, high = np.maximum(0, diagonal - m), np.minimum(diagonal, n)
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        first = open_ & (a[np.minimum(mid, n - 1)] <= b[np.clip(diagonal - mid - 1, 0, m - 1)])
        low, high = np.where(first, mid + 1, low), np.where(open_ & ~first, mid, high)
    return low


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE):
    """(index in a, index in b) of the values that both ascending lists have."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = merge_path(a, b, piece)
    other = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b)) - at
    got = []
    for i, i2, j, j2 in zip(at[:-1].tolist(), at[1:].tolist(), other[:-1].tolist(), other[1:].tolist()):
        if i and j < len(b) and a[i - 1] == b[j]:                 # the border runs through a common end
            got.append((np.array([i - 1]), np.array([j])))
        x, y = a[i:i2], b[j:j2]
        if len(x) and len(y):
            k = np.searchsorted(y, x)
            hit = np.flatnonzero(y[np.minimum(k, len(y) - 1)] == x)
            got.append((i + hit, j + k[hit]))
    left, right = (np.concatenate(v) for v in zip(*got)) if got else (np.zeros(0, np.int64),) * 2
    return left, right


class Aligner:
    _made: dict[tuple, "Aligner"] = {}

    @classmethod
    def of(cls, a: str, b: str) -> "Aligner":
        if (a, b) not in cls._made:
            cls._made[a, b] = cls(a, b)
        return cls._made[a, b]

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        if not (os.path.isabs(a) and os.path.isabs(b)):
            import public_tokenizers
            a, b = public_tokenizers.path(a), public_tokenizers.path(b)
        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        letters = {v: k for k, v in _LETTER.items()} | {k: k for k in range(256) if k not in _LETTER}
        self.a_bytes = [bytes(letters[ord(c)] for c in self.a.id_to_token(i)) if all(ord(c) in letters for c in self.a.id_to_token(i))
                        else self.a.id_to_token(i).encode() for i in range(self.a.get_vocab_size())]
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any("▁" in x.lstrip("▁") for x in names):
            raise ValueError("a piece of the second vocabulary goes on after a space: texts can't be cut at spaces")
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode()
                        for i, x in enumerate(names)]
        self.space = self.b.piece_to_id("▁")
        self.lengths = [np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes)]
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.width = np.array([len(str(i)) for i in range(most)], np.int64)
        self.digits = np.frombuffer(b"".join(str(i).encode().ljust(self.width[-1] + 1, b"0") for i in range(most)),
                                    np.uint8).reshape(most, -1)
        self.clear()

    def clear(self):
        self.known: dict[bytes, int] = {}
        self.good = np.zeros(1 << 12, bool)
        self.at = np.zeros((2, 1 << 12), np.int64)
        self.size = np.zeros((2, 1 << 12), np.int64)
        self.pool = [np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)]
        self.used = [0, 0]

    def _learn(self, units: list[bytes]):
        gc.disable()
        try:
            texts = [u.decode() for u in units]
            plain = [PLAIN.fullmatch(u) for u in units]
            rest = [t for t, p in zip(texts, plain) if not p]
            rest = iter([e.ids for i in range(0, len(rest), 4096)
                         for e in self.a.encode_batch_fast(rest[i:i + 4096], add_special_tokens=False)])
            a = [array("i", self.merged(u, p.start(1)) if p else next(rest)) for u, p in zip(units, plain)]
            b = [array("i", x if len(t) > 1 else [self.space]) for i in range(0, len(texts), 4096)
                 for t, x in zip(texts[i:i + 4096], self.b.encode([t[1:] for t in texts[i:i + 4096]], num_threads=1))]
            good = [b"".join(map(self.a_bytes.__getitem__, x)) == u == b"".join(map(self.b_bytes.__getitem__, y))
                    for u, x, y in zip(units, a, b)]
        finally:
            gc.enable()
        n, more = len(self.known), len(units)
        while n + more > len(self.good):
            self.good = np.concatenate([self.good, self.good])
            self.at, self.size = np.hstack([self.at, self.at]), np.hstack([self.size, self.size])
        self.good[n:n + more] = good
        for k, got in enumerate((a, b)):
            size = np.array([len(x) for x in got], np.int64)
            flat = np.frombuffer(b"".join(got), np.int32)
            while self.used[k] + len(flat) > len(self.pool[k]):
                self.pool[k] = np.concatenate([self.pool[k], self.pool[k]])
            self.pool[k][self.used[k]:self.used[k] + len(flat)] = flat
            self.at[k, n:n + more], self.size[k, n:n + more] = self.used[k] + np.cumsum(size) - size, size
            self.used[k] += len(flat)
        self.known.update(zip(units, range(n, n + more)))

    def merged(self, unit: bytes, cut: int) -> list[int]:
        """A's ids of a plain unit: its word and its signs, merged apart."""
        letters, merge = unit.decode("latin-1").translate(_LETTER), self.a.model.tokenize
        ids = [t.id for t in merge(letters[:cut])]
        return ids + [t.id for t in merge(letters[cut:])] if cut < len(letters) else ids

    def places(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        off = np.append(starts, len(data)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(data)]).dictionary_encode()
        units = found.dictionary.to_pylist()
        new = [u for u in units if u not in self.known]
        if new:
            self._learn(new)
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))[found.indices.to_numpy()]

    def ids(self, k: int, place: np.ndarray):
        """(ids, first id of each unit) of tokenizer k (0: A, 1: B)."""
        at, size = self.at[k][place], self.size[k][place]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.pool[k][np.repeat(at - total[:-1], size) + np.arange(total[-1])], total

    def blocks(self, col):
        """Yield (rows, bounds, (a ids, a firsts), (b ids, b firsts), a links, b links): for the units of
        a block, the rows of its texts and each row's bounds in units; the ids and each unit's
        first one; the linked tokens.  Texts without tokens do not come.  Rows come in order;
        a long text may come in several blocks."""
        data, off = W.text_bytes(col)
        for i, j, part, po in W.slices(data, off, SLICE):
            part, po = with_spaces(part, po)
            if not len(part):
                continue
            if len(self.known) > MOST_UNITS:
                self.clear()
            starts = unit_starts(part, po)
            place = self.places(part, starts)
            row = np.searchsorted(po, starts, side="right") - 1
            bad = np.zeros(j - i, bool)
            bad[row[~self.good[place]]] = True
            keep = ~bad[row]
            place, row = place[keep], row[keep]
            for u in range(0, len(place), UNITS):
                own, rows = place[u:u + UNITS], row[u:u + UNITS]
                a, b = self.ids(0, own), self.ids(1, own)
                left, right = common_ends(np.cumsum(self.lengths[0][a[0]]), np.cumsum(self.lengths[1][b[0]]))
                edge = np.append(np.flatnonzero(np.diff(rows, prepend=-1)), len(rows))
                yield (i + rows[edge[:-1]]).tolist(), edge, a, b, left, right

    def written(self, a, b, left, right):
        """The groups as bytes ``a1,a2|b1;a3|b2,b3;`` and the place after each group."""
        ga, gb = left + 1, right + 1
        na, nb = np.diff(ga, prepend=0), np.diff(gb, prepend=0)
        ids = np.empty(len(a) + len(b), np.int64)
        mark = np.full(len(ids), ord(","), np.uint8)
        pa_, pb = np.arange(len(a)) + np.repeat(gb - nb, na), np.arange(len(b)) + np.repeat(ga, nb)
        ids[pa_], ids[pb] = a, b
        mark[pa_[left]], mark[pb[right]] = ord("|"), ord(";")
        width = self.width[ids]
        out = self.digits[ids]
        out[np.arange(len(ids)), width] = mark
        end = np.cumsum(width + 1)
        return out[np.arange(out.shape[1]) <= width[:, None]].tobytes(), end[pb[right]]


def pair_counts(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECES) -> DataFrame:
    """(a, b, n): how many links hold A id ``a`` linked with B id ``b``."""
    def run(batches):
        aligner = Aligner.of(a, b)
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merged(keys, counts):
            x, where = np.unique(np.concatenate(keys), return_inverse=True)
            return x, np.bincount(where, np.concatenate(counts), len(x)).astype(np.int64)

        for batch in batches:
            for _, _, x, y, left, right in aligner.blocks(batch.column(0)):
                new, count = np.unique(y[0][right].astype(np.int64) << 32 | x[0][left], return_counts=True)
                key, n = merged((key, new), (n, count))
        yield pa.RecordBatch.from_arrays([pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array((key >> 32).astype(np.int32)),
                                          pa.array(n)], ["a", "b", "n"])
        W.release()

    each = docs.select("text").mapInArrow(run, "a int, b int, n long")
    return each.groupBy("a", "b").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECES, groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) for each document."""
    spark = docs.sparkSession
    counted = pair_counts(docs, a, b).toArrow()               # no more rows than suffixes of the vocabularies
    key = counted["b"].to_numpy().astype(np.int64) << 32 | counted["a"].to_numpy()
    order = np.argsort(key)
    key, n = key[order], counted["n"].to_numpy()[order]
    most = np.zeros(int(key[-1] >> 32) + 1 if len(key) else 1, np.int64)
    np.maximum.at(most, key >> 32, n)
    shared = spark.sparkContext.broadcast((key, n, n == most[key >> 32]))

    def run(batches):
        aligner = Aligner.of(a, b)
        key, n, best = shared.value
        for batch in batches:
            sums, sha, text = np.zeros((len(batch), 5), np.int64), {}, {}
            for rows, edge, x, y, left, right in aligner.blocks(batch.column(1)):
                at = np.searchsorted(key, y[0][right].astype(np.int64) << 32 | x[0][left])
                raw, ends = aligner.written(x[0], y[0], left, right)
                link = np.searchsorted(right, y[1][edge])               # links before each row's first unit
                first = lambda v: np.concatenate([[0], np.cumsum(v)])[link]
                sums[rows] += np.stack([np.diff(v) for v in (x[1][edge], y[1][edge], link, first(best[at]), first(n[at]))], axis=1)
                cut = np.concatenate([[0], ends])[link].tolist()
                for r, i, j in zip(rows, cut[:-1], cut[1:]):
                    own = raw[i:j - 1] if r not in sha else b";" + raw[i:j - 1]
                    sha.setdefault(r, hashlib.sha256()).update(own)
                    if groups:
                        text.setdefault(r, []).append(own)
            cols = [batch.column(0), *[pa.array(sums[:, k]) for k in (0, 1, 2, 2, 3, 4)],
                    pa.array([sha[r].hexdigest() if r in sha else "" for r in range(len(batch))])]
            if groups:
                cols.append(pa.array([b"".join(text.get(r, [])).decode() for r in range(len(batch))], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names)
        W.release()

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * groups
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, ", ".join(f"{x} {'string' if x.startswith('groups') else 'long'}" for x in names))

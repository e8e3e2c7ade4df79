"""Operator 3: substring dedup with a count-min prefilter.

A window is ``k`` consecutive words of one document.  A word goes if a window
covers it whose word sequence also starts earlier (smaller doc_id, or the same
document and an earlier start); windows are judged on the input.

1. Every partition of the input (a chunk) makes a count-min sketch of its
   windows: the cells that their hashes fall into, a cell twice if it was hit
   more than once, sorted and difference-coded.  The sketch is as wide as the
   data are large: it has ``2^CELL_BITS`` cells in each of its shards, and as
   many shards as the session has shuffle partitions.
2. A shard adds up the sketches of all chunks and tells each chunk which of its
   cells were hit twice or more.  The counts are never too small, so every
   repeated window is among them.
3. A second pass over the text takes the windows in such cells only, with 96
   bits of hash.  A chunk marks all but its own first window of each sequence
   itself; the first ones are grouped exactly, shard by shard, and all but the
   first of a group go back to their chunks as positions.
4. The chunks take the covered words out.

Shards are dealt by hash and chunks by input partition, and a chunk sends a
sequence once however often it holds it: no common window or group of copies makes
a large task.  A chunk must hold the same rows in both
passes: their number and their words are compared, and a difference is an error.

Cases: null, empty or word-less texts have no words (n_words 0, the hash of
the empty string); a text under k words keeps all.  Of rows that repeat a doc_id, the
one of the earlier chunk counts as the earlier, within a chunk the smaller
text.  Null doc_ids come after all others.  Columns beside doc_id and text are
not read.
"""
from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import parallel

WINDOW = 20
CELL_BITS = 26
CHUNK_BYTES = 32 << 20         # of input files: larger partitions make several chunks
LAST = np.iinfo(np.int64).max
_U = np.uint64
BLOBS = "shard int, chunk long, a binary, b binary, c binary, d binary"
ARROW = pa.schema([("shard", pa.int32()), ("chunk", pa.int64())] + [(x, pa.binary()) for x in "abcd"])


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending numbers as 16-bit differences; 65535 stands for a step without a number."""
    d = np.diff(x, prepend=np.int64(0))
    q, r = np.divmod(d, 65535)
    out = np.full(len(x) + int(q.sum()), 65535, np.uint16)
    out[np.arange(len(x)) + np.cumsum(q)] = r
    return out.tobytes()


def unpack_sorted(raw) -> np.ndarray:
    d = np.frombuffer(raw, np.uint16)
    return np.cumsum(d, dtype=np.int64)[d != 65535]


def window_hashes(part, start, end, first, k, seed):
    """(hash, index) of all windows of a slice; index counts the slice's words."""
    h = W.rolling(W.word_hashes(part, start, end, seed), k)
    last = np.repeat(first[1:], np.diff(first))[:len(h)]
    at = np.flatnonzero(np.arange(len(h)) + k <= last)
    return h[at], at


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def cell_of(h: np.ndarray) -> np.ndarray:
    return (h & _U((1 << CELL_BITS) - 1)).astype(np.int64)


def by_shard(key: np.ndarray, shards: int):
    """Bounds of the shards within sorted keys ``shard << CELL_BITS | cell``."""
    return np.searchsorted(key, np.arange(shards + 1, dtype=np.int64) << CELL_BITS)


def ordered(table: pa.Table):
    """doc_ids (null: LAST) and texts of a chunk in the order (doc_id, text)."""
    ids = pc.fill_null(table["doc_id"], LAST).to_numpy()
    text = pc.fill_null(table["text"], "").combine_chunks()
    order = np.argsort(ids, kind="stable")
    twice = np.flatnonzero(np.diff(ids[order]) == 0)
    if len(twice):
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], text[i].as_py().encode())))
    return ids[order], text.take(pa.array(order)), order


def sketch(docs: DataFrame, k: int, shards: int) -> DataFrame:
    """A chunk's cells by shard, and under shard -1 its numbers of rows and words."""
    def cells(table):
        keys, n_words = [], 0
        data, off = W.text_bytes(table["text"])
        for _, _, part, po in W.slices(data, off):
            start, end, first = W.find_words(part, po)
            n_words += len(start)
            h, _ = window_hashes(part, start, end, first, k, 3)
            keys.append(shard_of(h, shards) << CELL_BITS | cell_of(h))
        return np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64), n_words

    def per_partition(batches):
        held: dict[int, list] = {}
        rows: dict[int, list] = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            for chunk in pc.unique(t["chunk"]).to_pylist():
                own = t.filter(pc.equal(t["chunk"], chunk))
                x, n = cells(own)
                held.setdefault(chunk, []).append(x)
                r = rows.setdefault(chunk, [0, 0])
                r[0] += len(own)
                r[1] += n
        for chunk in rows:
            x = np.sort(np.concatenate(held.pop(chunk)))
            # a cell counts twice at most
            x = x[np.concatenate([np.ones(min(2, len(x)), bool), x[2:] != x[:-2]])] if len(x) else x
            cut = by_shard(x, shards)
            found = [s for s in range(shards) if cut[s + 1] > cut[s]]
            blobs = [pack_sorted(x[cut[s]:cut[s + 1]] - (s << CELL_BITS)) for s in found]
            none = [None] * (len(found) + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1] + found, pa.int32()), pa.array([chunk] * len(none), pa.int64()),
                 pa.array([np.array(rows[chunk], np.int64).tobytes()] + blobs, pa.binary())]
                + [pa.array(none, pa.binary())] * 3, schema=ARROW)

    return docs.select("chunk", "text").mapInArrow(per_partition, BLOBS)


def repeated_cells(sketches: DataFrame) -> DataFrame:
    """For each chunk and shard, the cells whose count over all chunks is two or more."""
    def add(table):
        if table["shard"][0].as_py() == -1:
            return table
        count = np.zeros(1 << CELL_BITS, np.uint8)
        for raw in table["a"].chunks:
            for x in raw:
                cells = unpack_sorted(x.as_buffer())
                new = np.ones(len(cells), bool)
                new[1:] = cells[1:] != cells[:-1]
                count[cells[new]] = np.minimum(2, count[cells[new]] + 1)
                count[cells[~new]] = 2
        out = []
        for x in table["a"].to_pylist():
            cells = unpack_sorted(x)
            cells = cells[count[cells] > 1]
            out.append(pack_sorted(np.unique(cells)) if len(cells) else None)
        table = table.set_column(2, "a", pa.array(out, pa.binary()))
        return table.filter(pc.is_valid(table["a"]))

    return sketches.groupBy("shard").applyInArrow(add, BLOBS)


def candidate_windows(docs: DataFrame, cells: DataFrame, k: int, shards: int) -> DataFrame:
    """A chunk's first windows of each sequence in repeated cells, by shard: position in the
    chunk, doc_id and 96 bits of hash.  Under shard -1 - chunk, the positions of its others."""
    def take(left: pa.Table, right: pa.Table):
        ids, text, _ = ordered(left)
        hot, told = [np.zeros(0, np.int64)], None
        for s, raw in zip(right["shard"].to_pylist(), right["a"].to_pylist()):
            if s < 0:
                told = np.frombuffer(raw, np.int64)
            else:
                hot.append(unpack_sorted(raw) + (s << CELL_BITS))
        hot = np.sort(np.concatenate(hot))
        data, off = W.text_bytes(text)
        base, found = 0, []
        for i, _, part, po in W.slices(data, off):
            start, end, first = W.find_words(part, po)
            h, at = window_hashes(part, start, end, first, k, 3)
            if len(hot) and len(h):
                key = shard_of(h, shards) << CELL_BITS | cell_of(h)
                p = np.searchsorted(hot, key)
                hit = hot[np.minimum(p, len(hot) - 1)] == key
                if hit.any():
                    g, at2 = window_hashes(part, start, end, first, k, 5)
                    doc = ids[i + np.searchsorted(first, at[hit], side="right") - 1]
                    found.append((base + at[hit], doc, h[hit], (g[hit] >> _U(32)).astype(np.uint32)))
            base += len(start)
        if told is not None and (told[0] != len(ids) or told[1] != base):
            raise ValueError("the input's partitions changed between two passes: write it to a table first")
        if not found:
            return ARROW.empty_table()
        pos, doc, h, g = (np.concatenate(x) for x in zip(*found))
        # positions rise with (doc_id, start), and the sort is stable: the first of a run is the chunk's first
        order = np.lexsort((g, h))
        later = np.zeros(len(pos), bool)
        later[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
        others = pos[later]
        pos, doc, h, g = pos[~later], doc[~later], h[~later], g[~later]
        s = shard_of(h, shards)
        order = np.argsort(s, kind="stable")
        pos, doc, h, g = pos[order], doc[order], h[order], g[order]
        cut = np.searchsorted(s[order], np.arange(shards + 1))
        found = [x for x in range(shards) if cut[x + 1] > cut[x]]
        part = lambda a: [a[cut[x]:cut[x + 1]].tobytes() for x in found]
        chunk = left["chunk"][0].as_py()
        rows = [found, [chunk] * len(found), [pack_sorted(pos[cut[x]:cut[x + 1]]) for x in found], part(doc), part(h), part(g)]
        if len(others):
            rows = [x + [y] for x, y in zip(rows, (-1 - chunk, chunk, pack_sorted(others), None, None, None))]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(rows, ARROW)], schema=ARROW)

    return docs.groupBy("chunk").cogroup(cells.groupBy("chunk")).applyInArrow(take, BLOBS)


def later_windows(windows: DataFrame) -> DataFrame:
    """For each chunk, the positions of windows that are not the first of their group."""
    def group(table):
        if table["shard"][0].as_py() < 0:                  # found by the chunk itself
            return table
        chunk = table["chunk"].to_numpy()
        pos = [unpack_sorted(x) for x in table["a"].to_pylist()]
        size = [len(x) for x in pos]
        join = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table[c].to_pylist()])
        at, doc, h, g = np.concatenate(pos), join("b", np.int64), join("c", np.uint64), join("d", np.uint32)
        order = np.lexsort((at, np.repeat(chunk, size), doc, g, h))
        same = np.zeros(len(at), bool)
        same[1:] = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
        later = np.zeros(len(at), bool)
        later[order] = same
        out, i = [], 0
        for n in size:
            own = at[i:i + n][later[i:i + n]]
            out.append(pack_sorted(own) if len(own) else None)
            i += n
        none = pa.array([None] * len(out), pa.binary())
        table = pa.Table.from_arrays([table["shard"], table["chunk"], pa.array(out, pa.binary()), none, none, none],
                                     schema=ARROW)
        return table.filter(pc.is_valid(table["a"]))

    return windows.groupBy("shard").applyInArrow(group, BLOBS)


def dedup(docs: DataFrame, k: int = WINDOW, text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for each document.

    ``docs`` must give the same partitions when it is read again, as files do;
    write other inputs to a table first (``common.cut``)."""
    spark = docs.sparkSession
    shards = parallel(spark)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes", "128m").lower().rstrip("b")
    size = int(size[:-1]) << {"k": 10, "m": 20, "g": 30}[size[-1]] if size[-1] in "kmg" else int(size)
    pieces = max(1, -(-size // CHUNK_BYTES))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(
        "chunk", F.spark_partition_id().cast("long") * pieces + F.pmod(F.xxhash64("doc_id"), F.lit(pieces)))
    windows = candidate_windows(docs, repeated_cells(sketch(docs, k, shards)), k, shards)
    later = later_windows(windows)

    def finish(left: pa.Table, right: pa.Table):
        if not len(left):
            return pa.Table.from_pylist([], schema=out)
        ids, texts, order = ordered(left)
        raw = [x.as_buffer().to_pybytes() for x in texts]
        sizes, hashes, kept, gone = [], [], [], []
        cover = None
        if len(right):
            starts = np.concatenate([unpack_sorted(x) for x in right["a"].to_pylist()])
            total = sum(len(x.split()) for x in raw)
            cover = np.bincount(starts, minlength=total + 1) - np.bincount(np.minimum(starts + k, total), minlength=total + 1)
            cover = np.cumsum(cover) > 0
        base = 0
        for x in raw:
            ws = x.split()                       # bytes split at exactly \x20 \x09-\x0D
            n, lost = len(ws), 0
            if cover is not None:
                own = cover[base:base + n]
                lost = int(own.sum())
                if lost:
                    ws = list(compress(ws, (~own).tolist()))
            base += n
            left_over = b" ".join(ws)
            sizes.append(n)
            gone.append(lost)
            hashes.append(hashlib.sha256(left_over).hexdigest())
            if text:
                kept.append(left_over.decode())
        cols = [left["doc_id"].take(pa.array(order)), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(hashes)]
        return pa.Table.from_arrays(cols + [pa.array(kept, pa.string())] * text, schema=out)

    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                     ("kept_sha256", pa.string())] + [("kept", pa.string())] * text)
    return docs.groupBy("chunk").cogroup(later.select("chunk", "a").groupBy("chunk")).applyInArrow(
        finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * text)

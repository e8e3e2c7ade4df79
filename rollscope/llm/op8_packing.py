"""Operator 8: packing into windows by best-fit decreasing.

1. Every text is tokenized once; a document is cut into full windows and a
   tail.  Each task numbers its pieces of a length, and the pieces go to a table.
2. The number of pieces of each length (as many numbers as a window has
   tokens) is all the plan needs: pieces of one length are alike.  Best-fit
   decreasing runs over these counts; a segment tree indexed by remaining
   capacity finds the tightest open windows, and runs of equal windows are
   handled at once.  So the plan is the exact result over all pieces, its size
   depends on the window and not on the data, and it is broadcast.
3. A piece's rank among those of its length (its number in its task, plus the
   pieces of earlier tasks) gives its window and offset.

Cases: a null text is empty (the end id alone, one piece).  Repeated rows are
packed as often as they come.  A null doc_id stays null.  An empty table gives
no pieces.  Columns beside doc_id and text are not read.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import cut
from .tokens import WORD_BPE, Encoder, two_bytes

WINDOW = 2048


class CapacityTree:
    """Segment tree over remaining capacities 0..window: each leaf keeps the open
    windows (as runs of sequence ids) with that capacity, each node how many runs."""

    def __init__(self, window: int):
        self.half = 1 << window.bit_length()
        self.count = [0] * (2 * self.half)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int):
        i = self.half + capacity
        while i:
            self.count[i] += by
            i //= 2

    def push(self, capacity: int, run: tuple[int, int]):
        self.runs[capacity].append(run)
        self._add(capacity, 1)

    def pop(self, capacity: int) -> tuple[int, int]:
        self._add(capacity, -1)
        return self.runs[capacity].pop()

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of ``least`` or more with an open window."""
        i = self.half + least
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.half:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.half


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, first rank, n, first sequence, offset)``: the pieces of a
    length from this rank on go to n sequences in a row, one each, at the offset."""
    tree, plan, opened = CapacityTree(window), [], 0
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            free = tree.tightest(length)
            if free is None:                       # none fits: open as many windows as the rest needs
                free, run = window, (opened, -(-left // (window // length)))
                opened += run[1]
            else:
                run = tree.pop(free)
            each = free // length                  # a window stays the tightest until no further piece fits
            n = min(run[1], left // each)
            if n == 0:                             # the last, partly filled window
                n, each = 1, left
            for k in range(each):
                plan.append((length, rank + k * n, n, run[0], window - free + k * length))
            rank, left = rank + n * each, left - n * each
            tree.push(free - each * length, (run[0], n))
            if run[1] > n:
                tree.push(free, (run[0] + n, run[1] - n))
    return plan


def pieces(docs: DataFrame, vocabulary: str, end_id: int, window: int) -> DataFrame:
    """One row for each piece, numbered by task and length."""
    def cut_up(batches):
        enc, part = Encoder.of(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for b in batches:
            doc, start, length, crc, total, rank, raw = ([] for _ in range(7))
            ids_of = b.column(0).to_pylist()
            for r, ids in enc.encode(b.column(1)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), window):
                    own = ids[at:at + window]
                    doc.append(ids_of[r])
                    start.append(at)
                    length.append(len(own))
                    crc.append(zlib.crc32(own.tobytes()))
                    total.append(len(ids))
                    rank.append(int(seen[len(own)]))
                    raw.append(two_bytes(own))
                    seen[len(own)] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total, rank, [part] * len(doc))]
                + [pa.array(raw, pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "part", "ids"])
        W.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut_up, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rank long, part long, ids binary")


def pack(docs: DataFrame, vocabulary: str = WORD_BPE, end_id: int = 1, window: int = WINDOW,
         ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])
    for every piece; ids as little-endian 16-bit numbers."""
    spark = docs.sparkSession
    table = cut(pieces(docs, vocabulary, end_id, window), "pieces")
    each = table.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}   # at most `window` rows
    plan = sorted(best_fit_decreasing(counts, window))
    key = np.array([(p[0] << 44) + p[1] for p in plan], np.int64)
    shared = spark.sparkContext.broadcast((key, np.array([p[1] for p in plan], np.int64),
                                           np.array([p[3] for p in plan], np.int64),
                                           np.array([p[4] for p in plan], np.int64)))
    base = each.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
                       .alias("base"))

    def place(batches):
        key, first, sequence, offset = shared.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            i = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            b = b.append_column("sequence_id", pa.array(sequence[i] + rank - first[i]))
            yield b.append_column("offset", pa.array(offset[i])).select(names + ["sequence_id", "offset"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * ids
    ranked = table.join(base, ["length", "part"]).select(*names, (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                             + "ids binary, " * ids + "sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n, ids): the packed windows themselves, at most a window of ids each."""
    got = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"),
                                            F.sum("length").alias("n"))
    return got.select("sequence_id", "n", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))

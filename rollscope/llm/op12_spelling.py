"""Operator 12: spelling variants by a dictionary of trie-node pairs.

Words are runs of letters of the texts (A-Z lower-cased).  Two words are near if
one inserted, deleted or replaced code point makes one into the other.

1. Every task counts its words exactly (an Arrow hash table of bounded size);
   the counts meet in one aggregate.
2. All words are sorted by range and numbered.  A node of the forward trie is a
   prefix; its number is the rank of the first word that begins with it and
   its depth.  The sorted words of a task give these by the length that each word
   shares with the one before; a task's first words take their nodes from the last
   word of the tasks before it (one word a task).  The reversed words make the
   backward trie alike.
3. Each word puts pairs (prefix node, suffix node) into the dictionary: for each
   position, the nodes around the skipped code point, and for each gap the nodes
   that meet there (a whole word, with a position to insert).
4. Words that share a pair are near: two that skip are a replacement; one that
   skips and a whole one are an insertion.  Node numbers are exact, so no pair is
   checked again.  A code point skipped within a run of equal ones makes the same
   word wherever it is, so only the first of a run meets whole words: every two near
   words meet exactly once.
5. A pair has as many skipping words as the alphabet has letters, at most, and one
   whole word: no group grows with the data.  A group sends each of its words a number
   of near words and the best of them, and no pairs.
6. Chains of forms are followed by pointer jumping: a form is at least twice as
   frequent, so there are few rounds.

Cases: null and empty texts have no words.  A null doc_id counts as '' in the hash
that deletes a code point.  Repeated rows count as often as they come.  Of near words
of equal count the smallest in code-point order is the form.  An empty table gives an
empty result.  Columns beside doc_id and text are not read.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import cut, drop, parallel

LEAST_LETTERS = 5
LEAST_COUNT = 3
DELETE = 97                    # of the hashes of (doc_id, run), one in so many loses a code point
HELD = 1 << 18                 # words that a task counts before it passes them on

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def find_runs(data: np.ndarray, off: np.ndarray):
    """(start, end, row): byte ranges of the runs of A-Z, a-z and U+00C0-U+00FF, and their rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    edge[n] = True
    s, e = inside.copy(), inside.copy()
    s[1:] &= ~inside[:-1] | edge[1:n]
    e[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(s)
    return start, np.flatnonzero(e) + 1, np.searchsorted(off, start, side="right") - 1


def crc_of_runs(data, start, end, state) -> np.ndarray:
    """crc32 of each run, continued from the crc32 ``state`` of what stands before it."""
    out = state.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    live, at = np.arange(len(start)), start.copy()
    while len(live):
        c = out[live]
        out[live] = _CRC[(c ^ data[at]) & np.uint32(255)] ^ (c >> np.uint32(8))
        at = at + 1
        on = at < end[live]
        live, at = live[on], at[on]
    return out ^ np.uint32(0xFFFFFFFF)


def words_of(ids: list, col, least: int, every: int):
    """Yield Arrow tables (word, n): the words of a batch, slice by slice."""
    data, off = W.text_bytes(col)
    before = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in ids], np.uint32)
    for i, _, part, po in W.slices(data, off):
        start, end, row = find_runs(part, po)
        if not len(start):
            continue
        low = W.lowered(part)
        more = np.concatenate([[0], np.cumsum((part & 0xC0) == 0x80)])
        letters = (end - start) - (more[end] - more[start])
        crc = crc_of_runs(low, start, end, before[i + row])
        less = crc % np.uint32(every) == 0
        raw, shorter = low.tobytes(), []
        for k in np.flatnonzero(less & (letters > least)).tolist():
            w = raw[start[k]:end[k]].decode()
            p = int(crc[k]) % len(w)
            shorter.append(w[:p] + w[p + 1:])
        keep = ~less & (letters >= least)
        whole = W.gathered(low, start[keep], end[keep]).cast(pa.string())
        n = pc.value_counts(pa.concat_arrays([whole, pa.array(shorter, pa.string())]))
        yield pa.Table.from_arrays([n.field("values"), n.field("counts")], ["word", "n"])


def counted(docs: DataFrame, least: int = LEAST_LETTERS, count: int = LEAST_COUNT, every: int = DELETE) -> DataFrame:
    """(word, n) for each distinct word of ``least`` code points or more that occurs ``count`` times or more."""
    def run(batches):
        held, size = [], 0

        def merged():
            t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return pa.table([t["word"], t["n_sum"]], ["word", "n"])

        for b in batches:
            for t in words_of(b.column(0).to_pylist(), b.column(1), least, every):
                held.append(t)
                size += len(t)
                if size > 2 * HELD:
                    held, size = [merged()], 0
                    if len(held[0]) > HELD:
                        yield from held[0].to_batches(1 << 14)
                        held = []
        if held:
            yield from merged().to_batches(1 << 14)
        W.release()

    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def shared_prefix(a: str, b: str) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def numbered_nodes(words: DataFrame, spelled: str, rank: str, nodes: str, depth: int) -> DataFrame:
    """``words`` with the ranks 0, 1, ... of its column ``spelled`` (distinct strings of less
    than ``depth`` code points) and the array of its trie nodes, one for each depth from 0
    (the root): ``rank of the first word below the node * depth + the node's depth``."""
    spark, names = words.sparkSession, words.columns
    at = names.index(spelled)
    schema = T.StructType([*words.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__i", T.LongType()),
                           T.StructField("__nodes", T.ArrayType(T.LongType())), T.StructField("__first", T.StringType())])

    def local(batches):
        """Ranks and first words within a task; a row of its own tells the first and the last word."""
        part, last, first, i, stack = TaskContext.get().partitionId(), "", None, 0, []
        for b in batches:
            own = []
            for w in b.column(at).to_pylist():
                k = shared_prefix(last, w) if i else -1
                stack = stack[:k + 1] + [i] * (len(w) - k)
                own.append(stack)
                first = w if first is None else first
                last, i = w, i + 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([part] * len(b), pa.int32()), pa.array(range(i - len(b), i), pa.int64()),
                 pa.array(own, pa.list_(pa.int64())), pa.array([None] * len(b), pa.string())], schema.names)
        if i:
            none = [pa.array([last if k == at else None], f.type) for k, f in enumerate(b.schema)]
            yield pa.RecordBatch.from_arrays(
                [*none, pa.array([part], pa.int32()), pa.array([i], pa.int64()), pa.array([stack], pa.list_(pa.int64())),
                 pa.array([first])], schema.names)

    table = cut(words.repartitionByRange(parallel(spark), spelled).sortWithinPartitions(spelled).mapInArrow(local, schema), "trie")
    base, last, above, parts = 0, "", [], []
    for r in table.where("__first is not null").orderBy("__part").collect():          # one row a task
        shares = shared_prefix(last, r["__first"]) if parts else -1
        given = above[:shares + 1]                      # nodes that words before this task have opened
        parts.append((r["__part"], base, given))
        above = [given[d] if x == 0 and d <= shares else (base + x) * depth + d for d, x in enumerate(r["__nodes"])]
        base, last = base + r["__i"], r[spelled]
    known = spark.createDataFrame(parts, "__part int, __base long, __given array<long>")
    rows = table.where("__first is null").join(F.broadcast(known), "__part")           # as many rows as tasks
    return rows.select(*names, (F.col("__base") + F.col("__i")).alias(rank), F.expr(
        f"transform(__nodes, (x, d) -> IF(x = 0 AND d < size(__given), __given[d], (__base + x) * {depth}L + d))").alias(nodes))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, rank, n_near, best): ``words`` (word, n), each with its rank, the number of its near
    words and the best of them as struct (n, r), ``r`` its negative rank (null without one)."""
    depth = (words.agg(F.max(F.length("word"))).first()[0] or 0) + 1
    forward = numbered_nodes(words, "word", "rank", "prefix", depth).withColumn("drow", F.reverse("word"))
    both = cut(numbered_nodes(forward, "drow", "back", "suffix", depth), "nodes")
    size = "size(prefix) - 1"
    # kind 0: the whole word; 1: a code point is skipped; 2: the first of a run of equal ones is
    pairs = both.select("rank", "n", F.expr(f"""inline(concat(
        transform(sequence(0, {size}), i -> struct(prefix[i] AS p, suffix[{size} - i] AS s, 0 AS kind)),
        transform(sequence(0, {size} - 1), i -> struct(prefix[i] AS p, suffix[{size} - 1 - i] AS s,
            IF(i > 0 AND substr(word, i, 1) = substr(word, i + 1, 1), 1, 2) AS kind))))"""))
    met = pairs.groupBy("p", "s").agg(F.collect_list(F.struct("kind", "n", "rank")).alias("m")).where("size(m) > 1")
    told = met.select(F.expr("""inline(transform(m, x -> struct(x.rank AS rank, filter(m, y ->
        y.rank <> x.rank AND ((x.kind > 0 AND y.kind > 0) OR (x.kind = 2 AND y.kind = 0) OR (x.kind = 0 AND y.kind = 2))) AS near)))""")
                      ).where("size(near) > 0")
    told = told.groupBy("rank").agg(F.sum(F.size("near")).alias("n_near"), F.max(F.expr(
        "array_max(transform(near, y -> struct(y.n AS n, -y.rank AS r)))")).alias("best"))
    return both.select("word", "n", "rank").join(told, "rank", "left")


def roots(forms: DataFrame) -> DataFrame:
    """(rank, root) of ``forms`` (rank, form): the last of the chain of forms, by pointer jumping."""
    at = cut(forms.select("rank", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        step = cut(at.join(on, "root", "left").select("rank", F.coalesce("next", "root").alias("root"),
                                                      F.col("next").isNotNull().alias("moved")), "roots")
        moved = not step.where("moved").isEmpty()
        drop(at)
        at = step
        if not moved:
            return at.select("rank", "root")


def variants(docs: DataFrame, least: int = LEAST_LETTERS, count: int = LEAST_COUNT, every: int = DELETE,
             ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each counted word."""
    words = cut(counted(docs, least, count, every), "words")
    found = cut(near_words(words), "near")
    formed = F.col("best.n") >= ratio * F.col("n")
    forms = found.where(formed).select("rank", (-F.col("best.r")).alias("form"), F.col("best.n").alias("form_n"))
    forms = forms.join(roots(forms), "rank")
    name = found.select(F.col("rank").alias("k"), "word")
    forms = (forms.join(name.withColumnRenamed("k", "form").withColumnRenamed("word", "form_word"), "form")
             .join(name.withColumnRenamed("k", "root").withColumnRenamed("word", "root_word"), "root")
             .select("rank", "form_word", "root_word", "form_n"))
    return found.join(forms, "rank", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")

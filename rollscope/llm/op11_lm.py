"""Operator 11: scores of an interpolated modified Kneser-Ney n-gram model.

The tokens of a text are its words, A-Z lower-cased, and one end.  The model learns from
the documents that ``learn`` holds for, and scores all.

1. Texts become *chunks* of about ``CHUNK`` tokens: 64-bit hashes of the chunk's words,
   common words first, and the tokens as places in that list.  They are written as a
   table bucketed by the task that made them, so that no later step shuffles them.
2. From the highest order down, each chunk sends its distinct n-grams, with their counts,
   to the shards that their hashes name: sorted arrays of 48 bits within a shard.  A
   shard adds the counts up and answers each chunk in the order of its question.  It
   also tells one of the chunks that hold an n-gram that it is the owner.
3. Owners count for the order below: an n-gram adds one to the continuations of its
   last words, and its count and whether it is 1, 2 or more to its context's sums.  So
   each order takes one exchange, and no n-gram is sent with its parts.
4. The discounts of an order come from its numbers of n-grams with count 1 to 4.
5. A chunk's answers are its slice of the model.  The worker writes it to an unlinked
   temporary file -- sorted hashes and counts -- maps that into memory, and looks the tokens
   up by binary search, block by block.

There are so many shards that each gets some ``SHARD`` n-grams, and at least as many as the
session has shuffle partitions.  A common n-gram is one entry of each chunk, so no word,
context or document makes a large task.  Orders above 2 are a parameter; each order more
adds an exchange of all distinct n-grams of the chunks.

Probability of a token with context: (count - D) / total + G * (that of the shorter context),
D by count 1, 2, 3 and more, G the discounts' share of the context; the lowest order gives
its share to all known tokens and one unknown alike.  Contexts that were not seen are
skipped.  Where an order's discounts cannot be estimated (too few n-grams), they are 0.5, 1, 1.5.

Cases: null and empty texts are one end.  Without a row to learn from every token has
probability 1.  Repeated rows are learned from and scored as often as they come.  A
null doc_id stays null.  An empty table gives an empty result.  Columns beside doc_id,
text and those of ``learn`` are not read.
"""
from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import cut, parallel, shared

ORDER = 2
CHUNK = 1 << 20                # tokens
SHARD = 1 << 22                # n-grams, of all chunks
BLOCK = 1 << 18                # tokens looked up at once
FALLBACK = (0.5, 1.0, 1.5)
_U = np.uint64
_LOW = _U((1 << 48) - 1)
BEGIN, END = W.mix64(np.array([1, 2], np.uint64))
ASKED = "shard long, task long, chunk long, grams binary, counts binary"
TOLD = "task long, chunk long, shard long, counts binary"


def packed(x: np.ndarray) -> bytes:
    """Whole numbers (a column or a matrix) byte by byte, compressed: high bytes are mostly zeros."""
    x = np.ascontiguousarray(x, np.int64).reshape(-1)
    planes = x.view(np.uint8).reshape(-1, 8).T
    used = max((k + 1 for k in range(8) if planes[k].any()), default=0)
    head = np.array([len(x), used], np.int64).tobytes()
    return head + (pa.compress(planes[:used].tobytes(), codec="zstd", asbytes=True) if used else b"")


def unpacked(raw) -> np.ndarray:
    raw = raw.as_buffer().to_pybytes()
    size, used = np.frombuffer(raw[:16], np.int64).tolist()
    out = np.zeros((size, 8), np.uint8)
    if used:
        planes = np.frombuffer(pa.decompress(raw[16:], size * used, codec="zstd", asbytes=True), np.uint8)
        out[:, :used] = planes.reshape(used, size).T
    return out.reshape(-1).view(np.int64)


def chunks(docs: DataFrame, learn: Column, order: int) -> DataFrame:
    """(task, chunk, doc_id[], learn[], size[], words, ids, n_tokens): texts as places in the chunk's list of words."""
    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        doc, use, size, hashes, held = [], [], [], [], 0

        def chunk():
            h = np.concatenate(hashes)
            words, where, n = np.unique(h, return_inverse=True, return_counts=True)
            by_count = np.argsort(-n, kind="stable")
            place = np.empty(len(words), np.int64)
            place[by_count] = np.arange(len(words))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in (
                (task, pa.int64()), ((task << 32) + made, pa.int64()), (doc, pa.list_(pa.int64())), (use, pa.list_(pa.bool_())),
                (size, pa.list_(pa.int64())), (words[by_count].tobytes(), pa.binary()), (packed(place[where]), pa.binary()),
                (len(h), pa.int64()))], names)

        for b in batches:
            ids, learns = b.column(0).to_pylist(), b.column(2).to_pylist()
            data, off = W.text_bytes(b.column(1))
            for i, j, part, po in W.slices(data, off):
                start, end, first = W.find_words(part, po)
                # an end after the words of each text
                hashes.append(np.insert(W.word_hashes(W.lowered(part), start, end), first[1:], END))
                doc += ids[i:j]
                use += [bool(x) for x in learns[i:j]]
                size += (np.diff(first) + 1).tolist()
                held += len(hashes[-1])
                if held >= CHUNK:
                    yield chunk()
                    doc, use, size, hashes, held, made = [], [], [], [], 0, made + 1
        if hashes:
            yield chunk()
        W.release()

    names = ["task", "chunk", "doc_id", "learn", "size", "words", "ids", "n_tokens"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", learn.alias("learn")).mapInArrow(
        run, "task long, chunk long, doc_id array<long>, learn array<boolean>, size array<long>, words binary, ids binary, n_tokens long")


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``column``: grouping by it needs no shuffle."""
    spark = df.sparkSession
    name = f"llm_{uuid.uuid4().hex}"
    df.write.bucketBy(2 * parallel(spark), column).option("path", shared(spark, name)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")                      # the files stay; the catalog keeps nothing
    return out


class Tokens:
    """The tokens of a chunk, each text behind ``order - 1`` begins."""

    def __init__(self, row: pa.Table, order: int, shards: int):
        one = {c: row[c][0] for c in row.column_names}
        self.chunk, self.order, self.shards = one["chunk"].as_py(), order, shards
        self.size = np.array(one["size"].as_py(), np.int64)
        self.doc_id, learn = one["doc_id"].values, np.array(one["learn"].as_py(), bool)
        ids = unpacked(one["ids"])
        words = np.frombuffer(one["words"].as_buffer(), np.uint64)
        first = np.cumsum(self.size) - self.size
        self.hash = np.insert(words[ids], np.repeat(first, order - 1), BEGIN)
        self.first = first + (order - 1) * (np.arange(len(first)) + 1)       # place of each text's first token
        self.at = np.flatnonzero(np.insert(np.ones(len(ids), bool), np.repeat(first, order - 1), False))
        self.learn = np.repeat(learn, self.size)                             # of tokens

    def keys(self, k: int, at: np.ndarray) -> np.ndarray:
        """Shard (above 48 bits) and hash of the n-grams of ``k`` tokens that end at the places ``at``."""
        h = self.hash[at]
        for i in range(1, k):
            h = W.mix64(h * W._STEP + self.hash[at - i])
        h = W.mix64(h + _U(k))
        return ((h >> _U(32)) * _U(self.shards) >> _U(32)) << _U(48) | h & _LOW

    def ends(self, k: int) -> np.ndarray:
        """Places where n-grams of ``k`` tokens end; below the highest order also each text's last begin."""
        return self.at if k == self.order else np.union1d(self.at, self.first - 1)


def asked(grams: np.ndarray, counts: np.ndarray, chunk: int) -> pa.RecordBatch:
    """A chunk's question: for each shard its sorted n-grams as differences, and the counts (a row each)."""
    shard = grams >> _U(48)
    names, first = np.unique(shard, return_index=True)
    edge = np.append(first, len(grams)).tolist()
    low = (grams & _LOW).astype(np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(names.astype(np.int64)), pa.array([chunk >> 32] * len(names), pa.int64()), pa.array([chunk] * len(names), pa.int64()),
        pa.array([packed(np.diff(low[i:j], prepend=0)) for i, j in zip(edge[:-1], edge[1:])], pa.binary()),
        pa.array([packed(counts[:, i:j]) for i, j in zip(edge[:-1], edge[1:])], pa.binary())], ["shard", "task", "chunk", "grams", "counts"])


def answers(questions: DataFrame, columns: int) -> DataFrame:
    """Sums over all chunks, for each chunk in the order of its question, with a last column
    that names the owner; chunk -1 has the shard's numbers of n-grams by count."""
    def add(table):
        table = table.sort_by("chunk")
        grams, counts, edge = [], [], [0]
        for g, c in zip(table["grams"], table["counts"]):
            grams.append(np.cumsum(unpacked(g)))
            counts.append(unpacked(c).reshape(columns, -1))
            edge.append(edge[-1] + len(grams[-1]))
        counts = np.concatenate(counts, axis=1)
        known, where = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.zeros((columns + 1, len(where)), np.int64)
        for k in range(columns):
            one = np.zeros(len(known), np.int64)
            np.add.at(one, where, counts[k])
            if k == 0:
                first = np.bincount(np.minimum(one, 5), minlength=6)[1:5].tolist() + [int((one > 0).sum()), int(one.sum())]
            last = [int((one > 0).sum()), int(one.sum())]
            total[k] = one[where]
        holds = np.flatnonzero(counts[0] > 0)[::-1]
        owner = np.full(len(known), -1)
        owner[where[holds]] = holds                       # the first chunk's entry is written last
        total[columns, owner[owner >= 0]] = 1
        stats = np.array(first + last, np.int64).tobytes()
        shard = table["shard"][0].as_py()
        return pa.table([pa.array([-1] + table[c].to_pylist(), pa.int64()) for c in ("task", "chunk")] + [pa.array([shard] * (len(table) + 1), pa.int64()),
                         pa.array([stats] + [packed(total[:, i:j]) for i, j in zip(edge[:-1], edge[1:])], pa.binary())],
                        ["task", "chunk", "shard", "counts"])

    return questions.groupBy("shard").applyInArrow(add, TOLD)


def numbers(told: DataFrame) -> np.ndarray:
    """Of an order: n-grams of count 1, 2, 3, 4, distinct ones, sum; and distinct ones and sum of the last column."""
    total = np.zeros(8, np.int64)
    for r in told.where("chunk = -1").select("counts").collect():            # 64 bytes a shard
        total += np.frombuffer(r["counts"], np.int64)
    return total


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts by count: none for 0, then for 1, 2, and 3 or more."""
    n1, n2, n3, n4 = n[:4].astype(float).tolist()
    if min(n1, n2, n3, n4) > 0:
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        if all(0 < x <= k for k, x in enumerate(d, 1)):
            return np.array([0.0, *d])
    return np.array([0.0, *FALLBACK])


def told_counts(told: pa.Table, chunk: int, level: int, columns: int) -> np.ndarray:
    """A chunk's answers on an order: a row for each of ``columns``, in the order of its sorted n-grams."""
    told = told.filter(pc.and_(pc.equal(told["level"], level), pc.equal(told["chunk"], chunk))).sort_by("shard")
    return np.concatenate([unpacked(x).reshape(columns, -1) for x in told["counts"]], axis=1)


def columns(level: int, order: int) -> int:
    """An answer's: the highest order has counts; others continuations, and as a context the sum and the
    numbers of 1, 2, and 3 or more; the lowest the tokens' own counts too.  The owner comes last."""
    return (1 if level == order else 6 if level == 1 else 5) + 1


def ask_highest(corpus: DataFrame, order: int, shards: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for k in range(len(b)):
                t = Tokens(pa.Table.from_batches([b.slice(k, 1)]), order, shards)
                grams, where = np.unique(t.keys(order, t.at), return_inverse=True)
                yield asked(grams, np.bincount(where[t.learn], minlength=len(grams))[None], t.chunk)
        W.release()

    return corpus.mapInArrow(run, ASKED)


def ask_lower(corpus: DataFrame, above: DataFrame, level: int, order: int, shards: int) -> DataFrame:
    """Owners of n-grams of the order above count their continuations and contexts."""
    def count(t, told):
        up = t.ends(level + 1)
        _, one = np.unique(t.keys(level + 1, up), return_index=True)
        counts = told_counts(told, t.chunk, level + 1, columns(level + 1, order))
        own = np.flatnonzero(counts[-1])
        place, n = up[one[own]], counts[0][own]
        at = t.ends(level)
        grams, where = np.unique(t.keys(level, at), return_inverse=True)
        ends, context = where[np.searchsorted(at, place)], where[np.searchsorted(at, place - 1)]
        total = np.zeros(len(grams), np.int64)
        np.add.at(total, context, n)
        tally = lambda x: np.bincount(x, minlength=len(grams))
        got = [tally(ends), total, tally(context[n == 1]), tally(context[n == 2]), tally(context[n > 2])]
        if level == 1:
            got.append(tally(where[np.searchsorted(at, t.at[t.learn])]))
        return asked(grams, np.stack(got), t.chunk)

    def run(left: pa.Table, right: pa.Table):
        out = pa.Table.from_batches([count(Tokens(left.slice(k, 1), order, shards), right) for k in range(len(left))])
        W.release()
        return out

    return corpus.groupBy("task").cogroup(above.where("chunk >= 0").groupBy("task")).applyInArrow(run, ASKED)


class Slice:
    """The part of an order that a chunk needs, mapped from an unlinked file: sorted n-grams and their counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.file = tempfile.TemporaryFile()
        for x in (grams.view(np.int64), *counts):
            self.file.write(np.ascontiguousarray(x, np.int64).data)
        self.file.flush()
        held = np.memmap(self.file, np.int64, "r", shape=(1 + len(counts), len(grams)))
        self.grams, self.counts = held[0].view(np.uint64), held[1:]

    def find(self, keys: np.ndarray) -> np.ndarray:
        return self.counts[:, np.searchsorted(self.grams, keys)]


def log_probabilities(t: Tokens, slices: dict, stats: dict, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability, own count in training) of the tokens at the places ``at``."""
    d, words = discounts(stats[1]), stats[1]
    counts = slices[1].find(t.keys(1, at))
    p = np.full(len(at), 1.0 / (words[6] + 1))
    if words[5]:
        kinds = np.array([words[0], words[1], words[4] - words[0] - words[1]])
        p = (np.maximum(counts[0] - d[np.minimum(counts[0], 3)], 0) + (d[1:] @ kinds) * p) / words[5]
    for k in range(2, t.order + 1):
        d = discounts(stats[k])
        n = slices[k].find(t.keys(k, at))[0]
        _, total, *kinds = slices[k - 1].find(t.keys(k - 1, at - 1))[:5]
        seen = np.maximum(n - d[np.minimum(n, 3)], 0) + sum(x * y for x, y in zip(d[1:], kinds)) * p
        p = np.where(total > 0, seen / np.maximum(total, 1), p)
    return np.log10(p), counts[5]


def score(docs: DataFrame, learn: Column, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each document."""
    if order < 2:
        raise ValueError("the order must be 2 or more")
    spark = docs.sparkSession
    corpus = bucketed(chunks(docs, learn, order), "task")
    tokens = corpus.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(parallel(spark), -(-tokens // SHARD))
    told, stats = {}, {}
    for k in range(order, 0, -1):
        questions = ask_highest(corpus, order, shards) if k == order else ask_lower(corpus, told[k + 1], k, order, shards)
        told[k] = cut(answers(questions, columns(k, order) - 1).withColumn("level", F.lit(k)), "told")
        stats[k] = numbers(told[k])
    every = told[1]
    for k in range(2, order + 1):
        every = every.unionByName(told[k])
    n, v = int(stats[1][7]), int(stats[1][6])

    def scored(t, told):
        slices = {k: Slice(np.unique(t.keys(k, t.ends(k))), told_counts(told, t.chunk, k, columns(k, order)))
                  for k in range(1, order + 1)}
        logs, own = np.empty(len(t.at)), np.empty(len(t.at), np.int64)
        for i in range(0, len(t.at), BLOCK):
            logs[i:i + BLOCK], own[i:i + BLOCK] = log_probabilities(t, slices, stats, t.at[i:i + BLOCK])
        first = np.cumsum(t.size) - t.size
        base = np.log10((own + 1.0) / (n + (v + 1)))
        return pa.table([t.doc_id, pa.array(~t.learn[first]), pa.array(t.size), pa.array(np.add.reduceat(own > 0, first, dtype=np.int64)),
                         pa.array(np.full(len(first), n)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(logs, first))],
                        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(left: pa.Table, right: pa.Table):
        out = pa.concat_tables([scored(Tokens(left.slice(k, 1), order, shards), right) for k in range(len(left))])
        W.release()
        return out

    return corpus.groupBy("task").cogroup(every.where("chunk >= 0").groupBy("task")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Of seven documents, the one by the hash of its doc_id (null: '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2

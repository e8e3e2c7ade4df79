"""Operator 2: token ids in canonical length-limited Huffman files.

1. Every text is tokenized once; its ids, with an end id, go to a table in the
   shared folder.
2. Global counts of the ids (as many numbers as the vocabulary has ids) give
   code lengths of at most ``LIMIT`` bits by package-merge; codes are canonical,
   so the file format stores lengths only.
3. Documents are range-partitioned and sorted by doc_id.  Each task writes
   independent blocks of whole documents, about ``BLOCK`` ids each: the bits,
   and the bit offset of every ``EVERY``-th id (checkpoints).
4. The reader decodes a block from its checkpoints on, all of them in step,
   with one table lookup for each id.

The format is a Parquet table of blocks (Spark's committer makes the files
whole or absent) and a table of code lengths beside it.

Cases: a null text is empty (the end id alone).  Rows that repeat a doc_id
follow each other in the order of a hash of their ids; null doc_ids come last.  An empty
table gives no blocks.  Columns beside doc_id and text are not read.
"""
from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import COUNTER_SCHEMA, counter_rows, cut, merged_counters, parallel, shared
from .tokens import WORD_BPE, Encoder, two_bytes

LIMIT = 18
BLOCK = 1 << 16
EVERY = 256
IDS = 1 << 16              # ids are 16-bit numbers


def token_table(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, ids): 16-bit little-endian ids of each text and the end id."""
    def encode(batches):
        enc = Encoder.of(vocabulary)
        for b in batches:
            ids = [two_bytes(np.append(x, np.uint32(end_id))) for _, x in enc.encode(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(ids, pa.binary())],
                                             ["doc_id", "ids"])
        W.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        encode, "doc_id long, ids binary")


def id_counts(tokens: DataFrame) -> np.ndarray:
    def count(batches):
        total = np.zeros(IDS, np.int64)
        for b in batches:
            _, off, data = b.column(0).buffers()
            off = np.frombuffer(off, np.int32)[b.column(0).offset:][[0, len(b)]] if len(b) else (0, 0)
            if off[1] > off[0]:
                total += np.bincount(np.frombuffer(data, "<u2")[off[0] // 2:off[1] // 2], minlength=IDS)
        yield counter_rows(total)

    return merged_counters(tokens.select("ids").mapInArrow(count, COUNTER_SCHEMA), IDS)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for absent ids."""
    out = np.zeros(len(counts), np.uint8)
    ids = np.flatnonzero(counts)
    n = len(ids)
    if n <= 1:
        out[ids] = 1
        return out
    limit = max(limit, int(n - 1).bit_length())
    ids = ids[np.argsort(counts[ids], kind="stable")]
    leaf = counts[ids].astype(np.int64)
    lists, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        weight = np.concatenate([leaf, packages])
        order = np.argsort(weight, kind="stable")
        weight = weight[order]
        lists.append(order < n)
        packages = weight[:len(weight) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * n - 2
    for is_leaf in reversed(lists):           # a package taken at one level is two items of the level below
        leaves = int(is_leaf[:take].sum())
        out[ids[:leaves]] += 1
        take = 2 * (take - leaves)
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    size = lengths[ids].astype(np.int64)
    if len(ids):
        longest = int(size.max())
        step = np.int64(1) << (longest - size)
        codes[ids] = ((np.cumsum(step) - step) >> (longest - size)).astype(np.uint64)
    return codes


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray):
    """(bits as big-endian 32-bit words, checkpoints) of a block's ids."""
    size = lengths[ids].astype(np.int64)
    at = np.cumsum(size) - size
    word, bit = at >> 5, at & 31
    v = codes[ids] << (64 - size - bit).astype(np.uint64)
    out = np.zeros(int(at[-1] + size[-1] + 31 >> 5) + 1, np.uint64)
    new = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[new]] += np.add.reduceat(v >> np.uint64(32), new)
    out[word[new] + 1] += np.add.reduceat(v & np.uint64(0xFFFFFFFF), new)
    return out.astype(">u4").tobytes(), at[::EVERY].astype("<u4").tobytes()


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each window of ``longest`` bits, ``id * 64 + length``."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    longest = int(lengths[ids].max())
    size = lengths[ids].astype(np.int64)
    table = np.repeat(ids * 64 + size, np.int64(1) << (longest - size))
    return np.concatenate([table, np.full((1 << longest) - len(table), 1)]).astype(np.uint32), longest


def decode_blocks(blocks, table: np.ndarray, longest: int) -> list[np.ndarray]:
    """Ids of blocks ``(bits, checkpoints, n)``; all checkpoints advance in step."""
    words, lanes, sizes, base = [], [], [], 0
    for bits, marks, n in blocks:
        w = np.frombuffer(bits, ">u4").astype(np.uint64)
        marks = np.frombuffer(marks, "<u4").astype(np.int64)
        words.append(w)
        lanes.append(marks + 32 * base)
        sizes.append(len(marks))
        base += len(w)
    words = np.concatenate(words + [np.zeros(EVERY * longest // 32 + 2, np.uint64)])
    at = np.concatenate(lanes)
    out = np.empty((EVERY, len(at)), np.uint32)
    mask, top = np.uint64((1 << longest) - 1), np.uint64(64 - longest)
    for k in range(EVERY):
        w = at >> 5
        pair = (words[w] << np.uint64(32)) | words[w + 1]
        got = table[(pair >> (top - (at & 31).astype(np.uint64))) & mask]
        out[k] = got >> 6
        at = at + (got & 63)
    out = out.T
    found, i = [], 0
    for (_, _, n), m in zip(blocks, sizes):
        found.append(out[i:i + m].reshape(-1)[:n])
        i += m
    return found


def write_tokens(docs: DataFrame, path: str, vocabulary: str = WORD_BPE, end_id: int = 2) -> None:
    """Tokenize ``docs`` and write the files: ``path/blocks`` and ``path/codebook``."""
    spark = docs.sparkSession
    tokens = cut(token_table(docs, vocabulary, end_id), "tokens")
    lengths = code_lengths(id_counts(tokens))
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, length int") \
        .coalesce(1).write.parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))

    def encode(batches):
        lengths, codes = book.value
        part, block, before = TaskContext.get().partitionId(), 0, 0
        held, size = [], 0

        def close():
            nonlocal held, size, block, before
            ids = np.concatenate([np.frombuffer(x, "<u2") for _, x in held])
            bits, marks = encode_bits(ids, lengths, codes)
            row = pa.RecordBatch.from_pylist([{
                "part": part, "block": block, "before": before, "n": len(ids), "doc_ids": [d for d, _ in held],
                "sizes": [len(x) // 2 for _, x in held], "marks": marks, "bits": bits}], schema=arrow)
            block, before, held, size = block + 1, before + len(ids), [], 0
            return row

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append((d, x))
                size += len(x) // 2
                if size >= BLOCK:
                    yield close()
        if held:
            yield close()
        W.release()

    arrow = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("before", pa.int64()), ("n", pa.int64()),
                       ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                       ("marks", pa.binary()), ("bits", pa.binary())])
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("ids")]
    (tokens.repartitionByRange(parallel(spark), *order).sortWithinPartitions(*order)
     .mapInArrow(encode, "part int, block long, before long, n long, doc_ids array<long>, sizes array<long>, "
                         "marks binary, bits binary").write.parquet(f"{path}/blocks"))


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the
    files, ids as little-endian 32-bit numbers."""
    book = spark.read.parquet(f"{path}/codebook").collect()          # at most one row for each id of the vocabulary
    lengths = np.zeros(IDS, np.uint8)
    for r in book:
        lengths[r["id"]] = r["length"]
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))       # a row for each file's task
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    sizes = spark.sparkContext.broadcast(lengths)

    def decode(batches):
        table, longest = decode_table(sizes.value)
        for b in batches:
            for i in range(0, len(b), 32):
                rows = b.slice(i, 32).to_pylist()
                done = decode_blocks([(r["bits"], r["marks"], r["n"]) for r in rows], table, longest)
                doc, start, n, crc, raw = [], [], [], [], []
                for r, x in zip(rows, done):
                    at = 0
                    for d, m in zip(r["doc_ids"], r["sizes"]):
                        own = x[at:at + m].astype("<u4").tobytes()
                        doc.append(d)
                        start.append(r["base"] + r["before"] + at)
                        n.append(m)
                        crc.append(zlib.crc32(own))
                        if ids:
                            raw.append(own)
                        at += m
                cols = [pa.array(x, pa.int64()) for x in (doc, start, n, crc)] + [pa.array(raw, pa.binary())] * ids
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(cols)])
        W.release()

    # a row for each task that wrote (the session's shuffle partitions): small whatever the data
    return blocks.join(F.broadcast(parts), "part").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def round_trip(docs: DataFrame, vocabulary: str = WORD_BPE, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to fresh files in the shared folder and read them back."""
    path = shared(docs.sparkSession, f"huffman-{uuid.uuid4().hex}")
    write_tokens(docs, path, vocabulary, end_id)
    return read_tokens(docs.sparkSession, path, ids=False)

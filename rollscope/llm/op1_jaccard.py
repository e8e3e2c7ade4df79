"""Operator 1: n-gram Jaccard join by set-relation skipping.

A document is the set of its distinct word n-grams.  The exact join of all
sets at ``100 * |A n B| >= percent * |A u B|`` runs in these steps:

1. Equal sets are one set (128-bit digest); its id is the smallest doc_id.
2. A global order of n-grams, rare ones first, comes from a fixed-size counter
   sketch; two linked sets share an n-gram of their prefixes in that order.
3. The index lists (one per prefix n-gram) hold ``(set, size, position)``.
   Set-relation skipping, part one: within a list, entries are skipped by size
   and, in blocks of one size, by position -- once the first position of a
   block leaves too few n-grams for the needed overlap, the block goes.
4. Each list's first set is a pivot; its answers in the list are computed
   exactly.  Linked sets get a common label.
5. Part two: what is left are pairs of different labels.  The labels' roots
   are compared first, and the answers of a member follow incrementally from
   the answer of its root: with distance ``D`` of two roots and ``x``, ``y``
   of the members to their roots, the members' distance is ``D - x - y`` at
   least (Jaccard distance is a metric).  Only pairs that this does not
   settle are compared exactly.

Before an exact comparison, pairs whose parity bits show them too far apart are
left out (a lower bound of the distance: no link is lost).

No pair within a label is ever made, so a group of n near copies costs O(n)
pairs, and no link between different sets is lost for components.  The pairs found
on the way tie the components together; they are not all links.

``link_counts`` adds each document's number of links, over all pairs.  Linked sets
share a component, so the sets of a component are compared exactly with each other,
in a grid of salted blocks of bounded size: a task counts the links of two blocks,
and no pair is stored.  A component of m sets costs O(m^2) comparisons and sends
each set to one task for each of its blocks.

Cases: null or word-less text has an empty set (n_shingles 0) and is linked
with nothing; fewer than ``k`` words are one n-gram.  Repeated rows come out as
often as they went in.  A null doc_id is its own class (component_id null).
Rows that repeat a doc_id with other text are separate sets of one node.
Columns beside doc_id and text are not read.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import COUNTER_SCHEMA, components, counter_rows, cut, drop, merged_counters

SKETCH_BITS = 20          # counters of the order sketch: 2^20, whatever the data
FILTER_BITS = 23          # bits of the id filter: 1 MB, whatever the data
PARITY_BITS = 1024
BLOCK_SETS = 2048         # of one component, in one block of the grid that counts links
BLOCK_GRAMS = 1 << 20


def sets_of(col, k: int):
    """Yield (row, sorted distinct n-gram hashes) for the texts of a batch."""
    data, off = W.text_bytes(col)
    for i, j, part, po in W.slices(data, off):
        start, end, first = W.find_words(part, po)
        h = W.word_hashes(W.lowered(part), start, end)
        roll = W.rolling(h, k)
        for r in range(j - i):
            a, b = int(first[r]), int(first[r + 1])
            if b - a >= k:
                yield i + r, np.unique(roll[a:b - k + 1])
            elif b > a:
                yield i + r, np.array([W.whole(h[a:b])], np.uint64)
            else:
                yield i + r, np.zeros(0, np.uint64)


def survey(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, digest, parity) for each document (digest null for an empty set),
    and the order sketch: counters of n-grams by hash prefix, as levels 0..255, rare to
    common.  ``parity`` has a bit for each of PARITY_BITS hash classes: is the number
    of the set's n-grams in it odd?  Two sets differ in as many n-grams at least as
    their parities differ in bits."""
    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            n, digest, parity = [], [], []
            for _, h in sets_of(b.column(1), k):
                n.append(len(h))
                digest.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                odd = np.bincount((h & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
                parity.append(np.packbits(odd.astype(bool)).view(np.int64))
                np.add.at(total, h >> np.uint64(64 - SKETCH_BITS), 1)
            none = [None] * len(b)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(n, pa.int32()), pa.array(digest, pa.binary()),
                 pa.array(parity, pa.list_(pa.int64())), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names)
        counts = counter_rows(total)
        none = [None] * len(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(none, pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.binary()),
             pa.array(none, pa.list_(pa.int64())), *counts.columns], names)
        W.release()

    names = ["doc_id", "n", "digest", "parity", "slice", "counts"]
    table = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, f"doc_id long, n int, digest binary, parity array<long>, {COUNTER_SCHEMA}"), "survey")
    counts = merged_counters(table.where("slice is not null").select("slice", "counts"), 1 << SKETCH_BITS)
    return (table.where("slice is null").select("doc_id", "n", "digest", "parity"),
            np.minimum(255, 6 * np.log2(1.0 + counts)).astype(np.uint8))


def index_entries(docs: DataFrame, ids: np.ndarray, level: np.ndarray, k: int, percent: int) -> DataFrame:
    """(id, n, pos, token) for the prefix of each set whose id is in the filter ``ids``."""
    shared = docs.sparkSession.sparkContext.broadcast((np.packbits(ids), level))

    def prefix(batches):
        bits, level = shared.value
        bits = np.unpackbits(bits).astype(bool)
        for b in batches:
            b = b.filter(pa.array(bits[hashed(b.column(0))]))
            n, pre = [], []
            for _, h in sets_of(b.column(1), k):
                m = len(h)
                n.append(m)
                rare = np.lexsort((h, level[h >> np.uint64(64 - SKETCH_BITS)])) if m else np.zeros(0, np.int64)
                pre.append(h[rare[:m - (percent * m + 99) // 100 + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(pre, pa.list_(pa.int64()))],
                                             ["id", "n", "prefix"])
        W.release()

    return (docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
            .mapInArrow(prefix, "id long, n int, prefix array<long>").select("id", "n", F.posexplode("prefix").alias("pos", "token")))


def hashed(ids) -> np.ndarray:
    """Places of an Arrow column of ids in an id filter."""
    return (W.mix64(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids (column ``id``): a filter without misses, of fixed size."""
    def bits(batches):
        total = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            total[hashed(b.column(0))] = True
        yield counter_rows(np.packbits(total).view(np.int64))

    # the words of the bitmaps are or-ed on the executors, slice by slice
    def join(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, raw in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(raw.as_buffer(), np.int64)
                total[s] = total[s] | x if s in total else x
        if total:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(list(total), pa.int32()),
                                              "counts": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    out = np.zeros((16, (1 << FILTER_BITS) // 64 // 16), np.int64)
    rows = ids.select("id").where("id is not null").mapInArrow(bits, COUNTER_SCHEMA)
    for r in rows.repartition(16, "slice").mapInArrow(join, COUNTER_SCHEMA).collect():
        out[r["slice"]] |= np.frombuffer(r["counts"], np.int64)
    return np.unpackbits(out.reshape(-1).view(np.uint8)).astype(bool)


def sets_for(docs: DataFrame, a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(id, hashes, in_a, in_b): the sets of the ids in ``a`` and ``b`` (and of the
    few others that the id filters let through), built from the text again."""
    ends = [np.packbits(id_filter(x.select(F.col(x.columns[0]).alias("id")).distinct())) for x in (a, b)]
    shared = docs.sparkSession.sparkContext.broadcast(ends)

    def build(batches):
        first, second = (np.unpackbits(x).astype(bool) for x in shared.value)
        for b in batches:
            at = hashed(b.column(0))
            b = b.append_column("in_a", pa.array(first[at])).append_column("in_b", pa.array(second[at]))
            b = b.filter(pa.array(first[at] | second[at]))
            if len(b):
                sets = [h.view(np.int64) for _, h in sets_of(b.column(1), k)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(sets, pa.list_(pa.int64())), b.column(2), b.column(3)], ["id", "hashes", "in_a", "in_b"])
        W.release()

    return cut(docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
               .mapInArrow(build, "id long, hashes array<long>, in_a boolean, in_b boolean"), "sets")


def compared(sets: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Exact sizes and overlap of the sets of each pair: (a, b, na, nb, common)."""
    x = sets.where("in_a").select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    y = sets.where("in_b").select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    return cut(pairs.join(y, "b").join(x, "a").select(
        "a", "b", F.size("ha").alias("na"), F.size("hb").alias("nb"),
        F.size(F.array_intersect("ha", "hb")).alias("common")), name)


def plausible(pairs: DataFrame, parities: DataFrame, most) -> DataFrame:
    """``pairs`` without those whose distance is above ``most`` for certain: sets that
    differ in ``v`` n-grams or more, of sizes n and m, have a distance of
    ``2 v / (n + m + v)`` or more."""
    x = parities.select(F.col("id").alias("a"), F.col("n").alias("pn"), F.col("parity").alias("pp"))
    y = parities.select(F.col("id").alias("b"), F.col("n").alias("qn"), F.col("parity").alias("qp"))
    v = F.expr("aggregate(zip_with(pp, qp, (x, y) -> bit_count(x ^ y)), 0, (s, v) -> s + v)")
    return (pairs.join(x, "a").join(y, "b").withColumn("v", v).where(2 * F.col("v") / (F.col("pn") + F.col("qn") + F.col("v")) <= most)
            .drop("pn", "pp", "qn", "qp", "v").distinct())


def linked(percent: int):
    return F.expr(f"100L * common >= {percent}L * (na + nb - common)")


def distance():
    return 1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))


def may_link(percent: int, x: str, y: str):
    """Size filter, and the block-skip bound: what is left from the entries'
    positions on must hold the overlap that the two sizes need."""
    return F.expr(f"100L * least({x}n, {y}n) >= {percent}L * greatest({x}n, {y}n) and "
                  f"{100 + percent}L * least({x}n - {x}pos, {y}n - {y}pos) >= {percent}L * ({x}n + {y}n)")


def block_links(table: pa.Table, percent: int) -> pa.Table:
    """(digest, linked): for the sets of two blocks (or of one), how many documents of the
    other block (of the same one, its own included) each set links with."""
    hashes = table["hashes"].combine_chunks()
    off = hashes.offsets.to_numpy().astype(np.int64)
    n = np.diff(off)
    _, token, found = np.unique(hashes.values.to_numpy()[off[0]:off[-1]], return_inverse=True, return_counts=True)
    # n-grams of one set alone are in no overlap
    shared = found[token] > 1
    off = np.concatenate([[0], np.cumsum(shared)])[off - off[0]]
    token = token[shared]
    copies, block = table["copies"].to_numpy(), table["block"].to_numpy()
    x = np.flatnonzero(block == table["lo"][0].as_py())
    twice = table["lo"][0].as_py() != table["hi"][0].as_py()
    y = np.flatnonzero(block == table["hi"][0].as_py())
    own = np.concatenate([token[off[j]:off[j + 1]] for j in y]) if len(y) else token[:0]
    ends = np.concatenate([[0], np.cumsum(off[y + 1] - off[y])])
    linked, mark = np.zeros(len(n), np.int64), np.zeros(len(found), bool)
    for i in x:
        mark[token[off[i]:off[i + 1]]] = True
        common = np.diff(np.concatenate([[0], np.cumsum(mark[own])])[ends])
        mark[token[off[i]:off[i + 1]]] = False
        if not twice:
            common[y == i] = n[i]
        hit = y[100 * common >= percent * (n[i] + n[y] - common)]
        linked[i] += copies[hit].sum()
        if twice:
            linked[hit] += copies[i]
    return pa.Table.from_arrays([table["digest"], pa.array(linked)], ["digest", "linked"])


def count_links(docs: DataFrame, table: DataFrame, label: DataFrame, k: int, percent: int) -> DataFrame:
    """(digest, n_links): with how many other documents a document of this set is linked
    (rows without a doc_id aside).  Linked sets are in one component, so each component's
    sets are compared with each other, block by block."""
    sets = table.where("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.max("n").alias("n"), F.count("*").alias("copies"))
    sets = cut(sets.join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "classes")
    blocks = sets.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("grams")).where("m > 1").select(
        "comp", F.expr(f"greatest(ceil(m / {BLOCK_SETS}), ceil(grams / {BLOCK_GRAMS}))").alias("blocks"))
    some = cut(sets.join(blocks, "comp").select("id", "digest", "copies", "comp", "blocks", F.expr(
        "pmod(xxhash64(digest), blocks)").alias("block")), "several")
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(id_filter(some.select("id").distinct())))

    def build(batches):
        bits = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            b = b.filter(pa.array(bits[hashed(b.column(0))]))
            if len(b):
                got = [h for _, h in sets_of(b.column(1), k)]
                digest = [hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None for h in got]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(digest, pa.binary()), pa.array([h.view(np.int64) for h in got], pa.list_(pa.int64()))],
                    ["id", "digest", "hashes"])
        W.release()

    built = (docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
             .mapInArrow(build, "id long, digest binary, hashes array<long>"))
    grid = some.join(built, ["id", "digest"]).dropDuplicates(["id", "digest"]).withColumn(
        "other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    grid = grid.select("comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                       "block", "digest", "copies", "hashes")
    counted = grid.groupBy("comp", "lo", "hi").applyInArrow(lambda t: block_links(t, percent), "digest binary, linked long")
    counted = counted.groupBy("digest").agg(F.sum("linked").alias("linked"))
    return sets.join(counted, "digest", "left").select("digest", (F.coalesce("linked", "copies") - 1).alias("n_links"))


def member_columns() -> list:
    """A document's columns in the survey joined with the ids of the sets and their components."""
    own = F.col("doc_id").isNotNull()
    return ["doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(own, F.coalesce("id", "doc_id")).alias("set_id"),
            F.when(own, F.coalesce("comp", "id", "doc_id")).alias("component_id")]


def link_counts(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): with the members, the number of other
    documents that each document is linked with, those with the same set included; 0 for
    an empty set or a null doc_id."""
    table, reps, label, _ = joined(docs, k, percent)
    found = F.when(F.col("doc_id").isNotNull(), F.col("n_links"))
    members = table.join(count_links(docs, table, label, k, percent), "digest", "left").join(reps, "digest", "left").join(label, "id", "left")
    return members.select(*member_columns(), F.coalesce(found, F.lit(0)).alias("n_links")).drop("set_id")


def join_sets(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``members(doc_id, n_shingles, set_id, component_id)``
    has one row per document; ``links(a, b, na, nb, common)`` exact pairs between
    distinct sets, enough to tie each component together but not all of its links
    (``link_counts`` counts them all)."""
    table, reps, label, links = joined(docs, k, percent)
    members = table.join(reps, "digest", "left").join(label, "id", "left").select(*member_columns())
    return members, links


def joined(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(table, reps, label, links): the survey's documents, the id of each set, the
    components ``label(id, comp)`` and the links that tie them together."""
    slack = 1 - percent / 100 + 1e-9
    table, level = survey(docs, k)
    reps = cut(table.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id")), "reps")
    entry = index_entries(docs, id_filter(reps.select("id")), level, k, percent)
    lists = Window.partitionBy("token")
    index = cut(entry.select("token", "id", "n", "pos", F.count("*").over(lists).alias("c"),
                             F.min(F.struct("id", "n", "pos")).over(lists).alias("p"))
                .where("c > 1").select("token", "id", "n", "pos", "c", F.col("p.id").alias("pid"),
                                       F.col("p.n").alias("pn"), F.col("p.pos").alias("ppos")), "index")

    # the pivots' answers
    parities = table.where("digest is not null and doc_id is not null").select(F.col("doc_id").alias("id"), "n", "parity")
    stars = index.where("id <> pid").where(may_link(percent, "", "p")).select(F.col("pid").alias("a"), F.col("id").alias("b"))
    stars = cut(plausible(stars.distinct(), parities, F.lit(slack)), "stars")
    sets = sets_for(docs, stars.select("a"), stars.select("b"), k)
    found = compared(sets, stars, "answers")
    drop(sets)
    links = found.where(linked(percent))
    label = cut(components(links.select("a", "b")), "labels")

    # pairs of different labels: block heads first (a list of two has no pair but the pivot's)
    by = (index.where("c > 2").select("token", "id", "n", "pos").join(label, "id", "left")
          .withColumn("label", F.coalesce("comp", "id")).drop("comp"))
    mixed = cut(by.withColumn("lo", F.min("label").over(lists)).withColumn("hi", F.max("label").over(lists))
                .where("lo <> hi").drop("lo", "hi"), "mixed")
    head = mixed.groupBy("token", "label", "n").agg(F.min("pos").alias("pos"))
    x = head.select("token", F.col("label").alias("a"), F.col("n").alias("xn"), F.col("pos").alias("xpos"))
    y = head.select("token", F.col("label").alias("b"), F.col("n").alias("yn"), F.col("pos").alias("ypos"))
    blocks = cut(x.join(y, "token").where("a < b").where(may_link(percent, "x", "y")).select("token", "a", "b").distinct(),
                 "blocks")
    # a member's distance to its label's root: known if it was compared with it, else 1 at most
    direct = found.join(label.select(F.col("id").alias("b"), F.col("comp").alias("a")), ["a", "b"]).select(
        F.col("b").alias("id"), distance().alias("away")).groupBy("id").agg(F.max("away").alias("away"))
    away = cut(label.where("id <> comp").join(direct, "id", "left")
               .select("id", F.col("comp").alias("label"), F.coalesce("away", F.lit(1.0)).alias("away")), "away")
    most = away.groupBy("label").agg(F.max("away").alias("most"))
    near = (F.lit(slack) + F.coalesce("ma", F.lit(0.0)) + F.coalesce("mb", F.lit(0.0)))

    def with_most(pairs):
        return (pairs.join(most.select(F.col("label").alias("a"), F.col("most").alias("ma")), "a", "left")
                .join(most.select(F.col("label").alias("b"), F.col("most").alias("mb")), "b", "left"))

    roots = cut(plausible(with_most(blocks.select("a", "b").distinct()), parities, near).select("a", "b"), "roots")
    if roots.isEmpty():
        all_links = links
    else:
        blocks = blocks.join(roots, ["a", "b"])
        heads = blocks.select("token", F.col("a").alias("label")).union(blocks.select("token", F.col("b").alias("label")))
        mixed = cut(mixed.join(heads.distinct(), ["token", "label"], "left_semi"), "open-lists")
        touched = cut(mixed.select("id").union(mixed.select(F.col("label").alias("id"))).distinct(), "touched")
        sets = sets_for(docs, touched, touched, k)
        root_found = compared(sets, roots, "root-answers")
        open_roots = root_found.where(~linked(percent)).select("a", "b", distance().alias("d"))
        close = with_most(open_roots).where("ma is not null or mb is not null").where(F.col("d") <= near).select("a", "b", "d")
        entries = mixed.join(away.drop("label"), "id", "left").withColumn("away", F.coalesce("away", F.lit(0.0)))
        left = entries.select("token", F.col("label").alias("a"), F.col("id").alias("xid"), F.col("n").alias("xn"),
                              F.col("pos").alias("xpos"), F.col("away").alias("xaway"))
        right = entries.select("token", F.col("label").alias("b"), F.col("id").alias("yid"), F.col("n").alias("yn"),
                               F.col("pos").alias("ypos"), F.col("away").alias("yaway"))
        rest = (blocks.join(close, ["a", "b"]).join(left, ["token", "a"]).join(right, ["token", "b"])
                .where(may_link(percent, "x", "y"))
                .where(F.col("d") <= slack + F.col("xaway") + F.col("yaway"))
                .select(F.col("xid").alias("a"), F.col("yid").alias("b")).distinct())
        more = compared(sets, plausible(rest, parities, F.lit(slack)), "more").where(linked(percent))
        all_links = links.union(root_found.where(linked(percent))).union(more)
        # the labels found so far stand for their links
        grown = label.where("id <> comp").select(F.col("comp").alias("a"), F.col("id").alias("b"))
        grown = grown.union(root_found.where(linked(percent)).select("a", "b")).union(more.select("a", "b"))
        label = cut(components(grown), "labels")
    return table, reps, label, all_links


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those of a component's documents but the
    smallest doc_id.  Of rows that repeat this doc_id with the same set, the one of the
    smallest text stays; rows that repeat it with other sets all stay.  Rows with an
    empty set or a null doc_id stay."""
    members, _ = join_sets(docs, k, percent)
    keep = members.where("n_shingles > 0 and doc_id = component_id").select("doc_id").distinct()
    keyed = docs.withColumn("__id", F.col("doc_id").cast("long"))
    empty = ~F.coalesce(F.col("text"), F.lit("")).rlike("[^ \\t-\\r]")
    alone = keyed.where(empty | F.col("__id").isNull()).drop("__id")
    one = (keyed.where(~empty & F.col("__id").isNotNull())
           .join(keep.withColumnRenamed("doc_id", "__id"), "__id", "left_semi"))
    twice = cut(docs.select(F.col("doc_id").cast("long").alias("__id")).groupBy("__id").count().where("count > 1").select("__id"), "twice")
    same = (one.join(twice, "__id", "left_semi").select("__id", F.col("text").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")))
    text = same.columns.index("__text")

    def sets(batches):
        for b in batches:
            digest = [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for _, h in sets_of(b.column(text), k)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digest, pa.binary())], [*b.schema.names, "__set"])
        W.release()

    same = same.mapInArrow(sets, T.StructType([*same.schema.fields, T.StructField("__set", T.BinaryType())]))
    same = same.groupBy("__id", "__set").agg(F.min_by("__row", "__text").alias("__row")).select("__row.*")
    return one.join(twice, "__id", "left_anti").drop("__id").unionByName(same).unionByName(alone)

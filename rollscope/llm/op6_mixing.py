"""Operator 6: mixing sources to target weights.

Tokens (words) are aggregated by source.  The weights share the whole size out
as targets; a target stops at ``CAP`` times its source's size, and what is over
is shared out again by weight until none is above.  A source's rate is its
target over its size; each document comes floor(rate) times, plus once more if
a number drawn from a hash of the seed and its doc_id is below the fraction.

The sharing is a loop of aggregates over the sources' table that returns two
numbers a round.  The sources are broadcast only if their measured size is
under ``BROADCAST_BYTES``; beyond that the join is Spark's own.

Cases: a null text has size 0; a source of size 0 has target and rate 0; the
null source is one more source, the last.  Rows that repeat a doc_id draw the
same number.  An empty table gives no rows.  Columns of ``docs`` keep their
names in ``mix``; ``plan`` holds them in one struct, so none can clash.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 1
BROADCAST_BYTES = 8 << 20
WORD = "[^ \\t-\\r]+"


def size_of(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) of ``sizes(source, size)``."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]                      # binary order of UTF-8: by code point
    table = numbered(sums, order, "i").withColumn(
        "w", F.element_at(F.array(*[F.lit(w).cast("decimal(38,0)") for w in weights]), (F.col("i") % len(weights) + 1).cast("int")))
    table = cut(table.withColumn("cap", (cap * F.col("source_size")).cast("decimal(38,0)")), "sources")
    first = table.agg(F.sum("source_size").alias("t"), F.sum("w").alias("w")).first()
    total, num, den = int(first["t"] or 0), int(first["t"] or 0), int(first["w"] or 0)

    def above():
        return F.expr(f"w * {num}BD > cap * {den}BD")

    while True:
        r = table.agg(F.sum(F.when(above(), F.col("cap"))).alias("c"), F.sum(F.when(~above(), F.col("w"))).alias("w")).first()
        num_, den_ = total - int(r["c"] or 0), int(r["w"] or 0)
        if den_ in (0, den):
            break
        num, den = num_, den_
    return table.select("source", "source_size", F.when(above(), F.col("cap").cast("double"))
                        .otherwise(F.expr(f"cast(w * {num}BD AS double) / {max(den, 1)}D")).alias("target"))


def plan(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """(doc, size, source_size, target, copies): ``doc`` holds the document's columns."""
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("source"),
                        size_of("text").alias("size"))
    targets = cut(source_targets(sized.select("source", "size"), weights, cap), "targets")
    took = targets.agg(F.sum(F.coalesce(F.length("source"), F.lit(0)) * 4 + 64).alias("b")).first()["b"] or 0
    side = F.broadcast(targets) if took < BROADCAST_BYTES else targets
    side = side.withColumnRenamed("source", "__s")
    joined = sized.join(side, F.col("source").eqNullSafe(F.col("__s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("")))), 1, 8),
                  16, 10).cast("double") / float(1 << 32)
    return (joined.withColumn("__r", rate)
            .select("doc", "size", "source_size", "target",
                    (F.floor("__r") + (draw < F.col("__r") - F.floor("__r")).cast("int")).cast("long").alias("copies")))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as its copies."""
    planned = plan(docs, weights, cap, seed).where("copies > 0")
    return planned.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        *[F.col(f"doc.`{c}`") for c in docs.columns])

"""Tolerance equality of two keyed tables (G12, re-aimed from a parameter-set
comparison): full outer join on the key, |a - b| <= atol + rtol * |b| per
value column, one status per key, and an all-close summary."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K


def tolerance_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str],
                   rtol: float = K.ALLCLOSE_RTOL, atol: float = K.ALLCLOSE_ATOL) -> DataFrame:
    """Per key: ``status`` in missing_left / missing_right / close / differs.
    A shuffle join on ``keys`` (both sides can be large)."""
    la = a.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("_in_a"))
    lb = b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("_in_b"))
    j = la.join(lb, list(keys), "full_outer")
    close = None
    for v in values:
        c = F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) <= F.lit(atol) + F.lit(rtol) * F.abs(F.col(f"b_{v}"))
        close = c if close is None else (close & c)
    status = (F.when(F.col("_in_a").isNull(), F.lit("missing_left"))
               .when(F.col("_in_b").isNull(), F.lit("missing_right"))
               .when(close, F.lit("close")).otherwise(F.lit("differs")))
    return j.withColumn("status", status).drop("_in_a", "_in_b")


def allclose_summary(diff: DataFrame) -> DataFrame:
    """One row: every key present on both sides and close?"""
    ok = F.col("status") == "close"
    return diff.agg(F.bool_and(ok).alias("all_close"), F.count(F.lit(1)).alias("n_keys"),
                    F.sum(F.when(ok, 0).otherwise(1)).cast("long").alias("n_bad"))


# ------------------------------------------------------------------ large sets
def write_blocks(df: DataFrame, path: str, keys: Sequence[str], values: Sequence[str], block) -> None:
    """A parameter set as blocks: rows in folders by ``block`` (a column over the keys), and beside them one digest
    row a block -- rows, two sums of row hashes of different seeds, and whether all values are finite."""
    rows = df.select(*keys, *values).withColumn("block", block.cast("long"))
    rows.repartition("block").write.partitionBy("block").parquet(f"{path}/rows")
    finite = None
    for v in values:
        one = F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")) & (F.abs(F.col(v).cast("double")) != F.lit(float("inf")))
        finite = one if finite is None else finite & one
    wide = lambda h: h.cast("decimal(38,0)")
    rows.groupBy("block").agg(
        F.count(F.lit(1)).alias("n"), F.sum(wide(F.xxhash64(*keys, *values))).alias("h1"),
        F.sum(wide(F.xxhash64(F.lit("second"), *values, *keys))).alias("h2"), F.bool_and(finite).alias("finite"),
    ).write.parquet(f"{path}/digests")


def block_diff(a: str, b: str, keys: Sequence[str], values: Sequence[str], spark, rtol: float = K.ALLCLOSE_RTOL,
               atol: float = K.ALLCLOSE_ATOL) -> tuple[DataFrame, list[int]]:
    """G12 over two sets of ``write_blocks``: (keys and ``status``, blocks that were compared by value).

    A block whose digests are equal and whose values are all finite has the same rows on both sides:
    its keys are ``close``, and its values are not read.  Only the other blocks (their numbers, as many as the
    caller's blocks at most, prune the folders) are joined value by value, as ``tolerance_diff`` does."""
    da, db = (spark.read.parquet(f"{p}/digests") for p in (a, b))
    both = da.alias("x").join(db.alias("y"), "block", "full_outer")
    same = F.coalesce((F.col("x.n") == F.col("y.n")) & (F.col("x.h1") == F.col("y.h1")) & (F.col("x.h2") == F.col("y.h2"))
                      & F.col("x.finite") & F.col("y.finite"), F.lit(False))
    open_ = sorted(r["block"] for r in both.where(~same).select("block").collect())
    ra, rb = (spark.read.parquet(f"{p}/rows") for p in (a, b))
    left, right = (d.where(F.col("block").isin(open_)) if open_ else d.where(F.lit(False)) for d in (ra, rb))
    differing = tolerance_diff(left.drop("block"), right.drop("block"), keys, values, rtol, atol).select(*keys, "status")
    equal = (ra.where(~F.col("block").isin(open_)) if open_ else ra).select(*keys, F.lit("close").alias("status"))
    return differing.unionByName(equal), open_

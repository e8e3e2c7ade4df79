"""Shared Spark helpers: tables cut in the shared folder, components, counters."""
from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscope.session import checkpoint_path


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of fewer rows than Spark's default of
    10,000; a batch size that the session has set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, *parts: str) -> str:
    """A place in this application's part of the shared folder."""
    return checkpoint_path(spark, f"llm-{spark.sparkContext.applicationId}", *parts)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application's operators have left in the shared
    folder.  Results that are still to be read need some of them: write these first."""
    _delete(spark, shared(spark))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table of its own in the shared folder and read it back:
    later work starts from files that outlive any executor."""
    spark = df.sparkSession
    path = shared(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table made by ``cut`` that nothing reads any more."""
    _delete(df.sparkSession, df._llm_path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def parallel(spark: SparkSession) -> int:
    """The session's own measure of how far to deal out data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (64-bit ids): rows ``(id, comp)``
    for every id that has an edge, ``comp`` the smallest id of its component.

    Alternates large-star and small-star steps (each a hash aggregate and a
    join on ids) until the edges are stars: every id has one parent and no
    parent has one.  Every round's edges are a table in the shared folder; only
    the answer to that test reaches the driver.
    """
    def stars(e):
        ends = e.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            e.select(F.col("b").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where(
            "up > 1 or (up > 0 and down > 0)").isEmpty()

    def oriented(e):
        return (e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .where("a <> b").distinct())

    e = cut(oriented(edges), "edges")
    while not stars(e):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.join(low, e.b == low.u).select("a", F.col("m").alias("b")).distinct()
        large = cut(large, "large")
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = (large.join(low, large.a == low.u).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                 .union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        following = cut(small, "edges")
        drop(large)
        drop(e)
        e = following
    return e.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(
        e.select(F.col("b").alias("id"), F.col("b").alias("comp"))).distinct()


def with_parts(text: Column, use) -> Column:
    """``use(part)`` for a text, where ``part(start, length)`` is its substring in code
    points.  The text is spread to four bytes a code point once, so a part costs its own
    length and not the way to it (a text may have 2^29 code points).  The mark in front of
    a part is the decoder's byte order mark, so a part's own first U+FEFF stays."""
    def part_of(wide):
        return lambda start, length: F.decode(
            F.concat(F.lit(b"\0\0\xfe\xff"), F.substr(wide, start * 4 + 1, length * 4)), "UTF-32")

    # a lambda's variable is evaluated once, whatever ``use`` does with it
    return F.get(F.transform(F.array(F.encode(text, "UTF-32")), lambda wide: use(part_of(wide))), F.lit(0))


COUNTER_SCHEMA = "slice int, counts binary"


def counter_rows(counts: np.ndarray, parts: int = 16):
    """A task's counters as rows ``(slice, counts)``."""
    pieces = np.split(counts, parts)
    keep = [k for k, x in enumerate(pieces) if x.any()]
    return pa.RecordBatch.from_pydict({"slice": pa.array(keep, pa.int32()),
                                       "counts": pa.array([pieces[k].astype(np.int64).tobytes() for k in keep],
                                                          pa.binary())})


def merged_counters(rows: DataFrame, size: int, parts: int = 16) -> np.ndarray:
    """Sum of the tasks' counters: ``size`` numbers, a bound that does not
    depend on the data.  Slices are added up on the executors, batch by batch."""
    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(raw.as_buffer(), np.int64)
                total[k] = total[k] + x if k in total else x
        if total:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(list(total), pa.int32()),
                                              "counts": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    out = np.zeros((parts, size // parts), np.int64)
    for r in rows.repartition(parts, "slice").mapInArrow(add, COUNTER_SCHEMA).collect():
        out[r["slice"]] += np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with its rows' numbers 0, 1, ... in the given order as column
    ``name``: sorted by range, numbered within a range, and moved by the sizes
    of the ranges before (as many rows as the session has shuffle partitions)."""
    from pyspark.sql import Window
    spark = df.sparkSession
    rows = cut(df.repartitionByRange(parallel(spark), *order).sortWithinPartitions(*order)
               .withColumn("__id", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("__part", F.shiftright("__id", 33)).withColumn(
        "__id", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    base = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    base = base.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__base"))
    return rows.join(base, "__part").withColumn(name, F.col("__id") + F.col("__base")).drop("__id", "__part", "__base")

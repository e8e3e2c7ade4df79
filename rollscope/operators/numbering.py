"""Exact numbers 1, 2, ... within keys, over many tasks."""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_path


def numbered_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "number",
                    total: str | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with each row's number within ``keys`` in the given order (equal rows of the order in
    any), and with ``total``, the number of the key's rows.

    The rows are sorted by range over (keys, order), so one key may fill many tasks, and written to
    a table in the shared folder: their places in it do not change when a task runs again.  Each
    task's rows of a key are a run; the runs (as many as keys and tasks together) get the number of
    rows before them by a window over the runs of a key, and are joined back.  No window and no
    group holds the rows of a key."""
    spark, columns = df.sparkSession, df.columns
    by = [*keys, *order]
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = checkpoint_path(spark, "rollscope-io", f"numbered-{uuid.uuid4().hex}")
    df.write.parquet(f"{path}-rows")                  # the ranges are drawn from it: what made the rows runs once
    rows = (spark.read.schema(df.schema).parquet(f"{path}-rows").repartitionByRange(n, *by).sortWithinPartitions(*by)
            .withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    runs = rows.groupBy("__part", *keys).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*keys).orderBy("__part")
    runs = runs.withColumn("__base", F.sum("__rows").over(before) - F.col("__rows") - F.col("__first") + 1)
    runs = runs.withColumn("__total", F.sum("__rows").over(Window.partitionBy(*keys)))
    runs = runs.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__base", "__total")
    same = (rows["__part"] == runs["__p"])
    for i, k in enumerate(keys):
        same &= rows[k].eqNullSafe(runs[f"__k{i}"])
    out = rows.join(runs, same)
    return out.select(*[rows[c] for c in columns], (F.col("__at") + F.col("__base")).alias(name),
                      *([F.col("__total").alias(total)] if total else []))

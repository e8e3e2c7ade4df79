"""Connected components of an edge table."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_path


def table_of(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: a round's lineage ends there."""
    path = checkpoint_path(df.sparkSession, "rollscope-io", f"graph-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b; of one orderable type): the smallest node that it
    is connected with.  Each round links every node's larger neighbours, then its smaller ones, to the
    smallest node it sees (hash aggregates and joins on nodes); the rounds end when the edges are
    stars, after about the logarithm of the longest path."""
    def low_to_high(e):
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    e = table_of(low_to_high(edges))
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = table_of(e.join(least, e["b"] == least["n"]).select("a", F.col("m").alias("b")).distinct())
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = (large.join(least, large["a"] == least["n"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                 .union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct())
        e = table_of(small)
        # stars: nobody has two parents, and no parent has one
        roots = e.select(F.col("b").alias("r")).distinct()
        if e.groupBy("a").count().where("count > 1").isEmpty() and e.join(roots, e["a"] == roots["r"], "left_semi").isEmpty():
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("r", "r")).distinct()

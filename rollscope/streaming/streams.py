"""Structured Streaming operators (ST1-ST3).

ST1 follows the reward log directory as new JSON files arrive; ST2 keeps
live windowed metrics with a watermark; ST3 emits a group's advantages when
its G-th rollout arrives.  State is bounded by the watermark, and
checkpoints go under the shared ``spark.checkpoint.dir``.
"""
from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..operators.groups import group_advantages
from ..session import checkpoint_path
from ..sources.io import REWARD_LOG_SCHEMA


def start(df: DataFrame, name: str, path: str | None = None, fmt: str = "parquet", mode: str = "append",
          trigger: dict | None = None, partition_by: list[str] | None = None):
    """Start a streaming query whose state and progress live under the shared
    ``spark.checkpoint.dir`` (``<dir>/streams/<name>``), so a restarted driver
    or a lost executor resumes from the last committed batch."""
    w = (df.writeStream.queryName(name).outputMode(mode).format(fmt)
         .option("checkpointLocation", checkpoint_path(df.sparkSession, "streams", name)))
    if partition_by:
        w = w.partitionBy(*partition_by)
    if trigger:
        w = w.trigger(**trigger)
    return w.start(path) if path else w.start()


@contextmanager
def state_partitions(spark: SparkSession, n: int):
    """A stream with state that is started in here first keeps it in ``n`` partitions, 8 at least and never more than
    the session's shuffles have; its checkpoint fixes them.  Every batch, also one without rows, writes
    the files of every partition's state, so partitions that hold little are all cost."""
    key = "spark.sql.shuffle.partitions"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(int(was), max(n, 8))))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def follow_reward_log(spark: SparkSession, path: str, schema: T.StructType = REWARD_LOG_SCHEMA,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """ST1: the reward log as a stream (each new file is read once)."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Make ``ts`` a TIMESTAMP (event time must be one).  A TIMESTAMP_NTZ
    wall clock is read as UTC, whatever the session time zone is."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        tz = df.sparkSession.conf.get("spark.sql.session.timeZone")
        return df.withColumn(ts, F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(ts)).cast("timestamp"))
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def live_metrics(stream: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value",
                 window: str = "1 day", slide: str | None = None, watermark: str = "1 day") -> DataFrame:
    """ST2: per (window, key) count / mean / max of ``value``; rows later
    than the watermark are dropped, closed windows are emitted once."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    stream = event_time(stream, ts)
    return (stream.withWatermark(ts, watermark).groupBy(w.alias("window"), key)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"), F.max(value).alias("max_value")))


def metrics_with_quarantine(stream: DataFrame, out: str, ts: str = "ts", key: str = "event_type", value: str = "value",
                            window: str = "2 days", slide: str | None = "1 day", delay: str = "1 day"):
    """ST2 with eviction and a quarantine: a writer for ``stream`` (start it with a checkpoint).

    Each batch first tells late rows from the others: a row is late if it is older than the
    latest event time of the batches before, less ``delay``.  Late rows go to ``out``/late as they
    came; nothing is dropped unseen.  The others join the open windows, a table of as many
    rows as there are open windows and keys; windows that end before the new limit are
    closed: they are written once and never held again.  A batch reads the tables of the batch
    before and overwrites its own, so a batch that runs again leaves the same.
    ``closed_windows`` and ``late_rows`` read the results."""
    spark = stream.sparkSession
    stream = event_time(stream, ts)
    w = F.window(ts, window, slide) if slide else F.window(ts, window)

    def limit(n):
        """The limit that batch ``n`` leaves (None before the first)."""
        return spark.read.parquet(f"{out}/limit/batch={n}").first()["limit"] if n >= 0 else None

    def step(batch, n):
        before = limit(n - 1)
        rows = batch.withColumn("late", F.coalesce(F.col(ts) < F.lit(before), F.lit(False)) if before else F.lit(False))
        rows.write.mode("overwrite").partitionBy("late").parquet(f"{out}/rows/batch={n}")
        # read back: what follows sees the same rows as the quarantine
        rows = spark.read.schema(rows.schema).parquet(f"{out}/rows/batch={n}")
        after = rows.agg((F.max(ts) - F.expr(f"INTERVAL {delay}")).alias("limit"))
        after = after.select(F.greatest("limit", F.lit(before).cast("timestamp")).alias("limit"))
        after.write.mode("overwrite").parquet(f"{out}/limit/batch={n}")
        after = limit(n)
        new = rows.where("not late").select(w.alias("window"), key, value).groupBy("window", key).agg(
            F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.count(value).alias("n_values"), F.max(value).alias("max_value"))
        if n:
            held = spark.read.parquet(f"{out}/windows/batch={n - 1}").where("not closed").drop("closed")
            new = new.unionByName(held).groupBy("window", key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"),
                                                                   F.sum("n_values").alias("n_values"), F.max("max_value").alias("max_value"))
        new = new.withColumn("closed", F.coalesce(F.col("window.end") <= F.lit(after), F.lit(False)) if after else F.lit(False))
        new.write.mode("overwrite").parquet(f"{out}/windows/batch={n}")

    return stream.writeStream.foreachBatch(step)


def closed_windows(spark: SparkSession, out: str) -> DataFrame:
    """(window, key, n, mean_value, max_value, batch) of the windows that ST2 has closed, each once."""
    d = spark.read.parquet(f"{out}/windows").where("closed")
    return d.withColumn("mean_value", F.col("total") / F.col("n_values")).drop("closed", "total", "n_values")


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """The rows that came too late, with the batch that brought them."""
    return spark.read.parquet(f"{out}/rows").where(F.col("late").cast("boolean")).drop("late")


ADVANTAGE_BUCKETS = 256


def streaming_advantages(stream: DataFrame, ts: str = "ts", reward: str = "reward", gap: str = "1 hour",
                         watermark: str = "1 hour", g: int = K.DEFAULT_G, eps: float = K.ADVANTAGE_EPSILON,
                         keys=("step", "group_id"), buckets: int = ADVANTAGE_BUCKETS) -> DataFrame:
    """ST3: the advantages of a rollout group in the batch that brings its G-th rollout.

    Each group has state: the rollouts so far (fewer than G) and a timer, ``gap`` of event
    time after its latest row.  A full group is emitted at once; its state then only
    remembers that, so a rollout that is sent again (same ``gen_idx``, the first one counts)
    or one beyond G changes nothing.  When the watermark passes the timer, a group
    that is still short is emitted with ``incomplete``, and the state goes.  Rows later than
    the watermark are dropped; a group that speaks up again after its timer is a new one.

    Spark keeps the state by bucket, a hash of the group's keys: a Python call for each group costs
    far more than its G rows, so a batch makes ``buckets`` calls at most, and each treats the groups of its
    bucket together.  A bucket's timer is its groups' earliest.  ``buckets`` must stay as it is as long as
    a checkpoint is used.

    On a table that is no stream the result is the same for all rollouts together."""
    types = {f.name: f.dataType for f in stream.schema}
    out = T.StructType([*[T.StructField(k, types[k]) for k in keys]]).add("gen_idx", "long").add(reward, "double") \
        .add("group_size", "long").add("group_mean", "double").add("group_std", "double").add("advantage", "double").add("incomplete", "boolean")
    stream = event_time(stream, ts).select(*keys, F.col("gen_idx").cast("long").alias("gen_idx"),
                                           F.col(reward).cast("double").alias("r"), F.col(ts).alias("ts"))
    if not stream.isStreaming:
        once = stream.groupBy(*keys, "gen_idx").agg(F.min_by("r", F.struct("ts", "r")).alias(reward))
        return group_advantages(once, reward, keys, eps, g).select([F.col(f.name).cast(f.dataType) for f in out])
    wait = int(pd.Timedelta(gap).total_seconds() * 1000)
    # pandas would turn integers beside a NULL into floats: the NULLs of the keys go as bits, that of gen_idx as a flag
    own = [f"k{i}" for i in range(len(keys))]
    group = ["nulls", *own]
    key = [F.unix_micros(k) if isinstance(types[k], T.TimestampType) else F.col(k) for k in keys]
    filled = [F.coalesce(c, F.lit("" if isinstance(types[k], T.StringType) else 0).cast("long" if isinstance(types[k], T.TimestampType) else types[k]))
              if isinstance(types[k], (T.StringType, T.NumericType, T.TimestampType)) else c for c, k in zip(key, keys)]
    nulls = sum((F.col(k).isNull().cast("long") * (1 << i) for i, k in enumerate(keys)), F.lit(0))
    stream = stream.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket"), nulls.cast("long").alias("nulls"),
                           *[c.alias(n) for c, n in zip(filled, own)], F.coalesce("gen_idx", F.lit(0)).cast("long").alias("gen"),
                           F.col("gen_idx").isNull().alias("no_gen"), "r", F.unix_micros("ts").alias("us"), "ts")
    rollout = [f for f in stream.schema if f.name not in ("bucket", "us", "ts")]
    held = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in rollout]) \
        .add("timer", T.ArrayType(T.LongType())).add("done", T.ArrayType(T.BooleanType()))
    result = T.StructType([T.StructField(f.name, f.dataType) for f in rollout]).add("group_size", "long").add("group_mean", "double") \
        .add("group_std", "double").add("advantage", "double").add("incomplete", "boolean")

    def pick(d, rows):
        return {c: v[rows] for c, v in d.items()}

    def joined(parts):
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    def codes(d, of):
        """Numbers from 0, the same for rows that agree in the columns ``of``."""
        code = np.zeros(len(d["r"]), "int64")
        for c in of:
            x, values = pd.factorize(d[c], use_na_sentinel=False)
            code = pd.factorize(code * len(values) + x)[0]
        return code

    def most(values, code):
        m = np.full(code.max() + 1, values.min())
        np.maximum.at(m, code, values)
        return m

    def first(d, code):
        """The rollouts of each group that count: which rows are the first of their ``gen_idx``, G at most."""
        again = pd.Series(codes({**d, "code": code}, ["code", "gen"])).duplicated().to_numpy() & ~d["no_gen"]
        rows = np.flatnonzero(~again)
        rows = rows[np.argsort(code[rows], kind="stable")]
        n = np.bincount(code[rows])
        return np.sort(rows[np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) < g])

    def in_order(d):
        return pick(d, np.lexsort((d["r"], d["gen"], d["no_gen"], d["us"])))

    def arrived(frames, now):
        """A bucket's rows of the batch in the order in which they count, and the timers of their groups.  A
        frame leaves G rows of a group, however often its rollouts were sent."""
        parts = []
        for f in frames:
            if len(f):
                d = in_order({c: f[c].to_numpy() for c in [*group, "gen", "no_gen", "r", "us"]})
                code = codes(d, group)
                latest = most(np.nan_to_num(d["us"] // 1000).astype("int64"), code)
                d["timer"] = np.maximum(latest + wait, now + 1)[code]
                parts.append(pick(d, first(d, code)))
        if not parts:
            return []
        d = in_order(joined(parts)) if len(parts) > 1 else parts[0]
        d["done"] = np.zeros(len(d.pop("us")), bool)
        return [d]

    def advantages(d, code, size):
        """The output rows of whole groups, those of one size at a time."""
        order = np.argsort(code, kind="stable")
        size = size[code[order]]
        for n in np.unique(size):
            p = pick(d, order[size == n])
            x = p["r"].reshape(-1, n)
            mean = x.mean(axis=1, keepdims=True)
            std = x.std(axis=1, ddof=1, keepdims=True) if n > 1 else np.full_like(mean, np.nan)
            yield pd.DataFrame({**{c: p[c] for c in [*group, "gen", "no_gen", "r"]}, "group_size": n, "group_mean": np.repeat(mean, n),
                                "group_std": np.repeat(std, n), "advantage": ((x - mean) / (std + eps)).ravel(), "incomplete": bool(n < g)})

    def step(_, frames, state):
        now = state.getCurrentWatermarkMs()
        old = [{c: pd.Series(list(v)).to_numpy() for c, v in zip(held.names, state.get)}] if state.exists else []
        parts = old + ([] if state.hasTimedOut else arrived(frames, now))
        if not parts:
            return
        d = joined(parts)
        code, since = codes(d, group), sum(len(p["r"]) for p in old)
        timer, done = most(d["timer"], code), most(d["done"], code)
        gone = timer < now
        gone[code[since:]] = False                       # who speaks up in this batch is not short yet
        rows = np.flatnonzero(~done[code])
        rows = rows[first(pick(d, rows), code[rows])] if len(rows) else rows
        size = np.bincount(code[rows], minlength=len(timer))
        full = size == g
        ready = rows[(full | gone)[code[rows]]]
        if len(ready):
            yield from advantages(pick(d, ready), code[ready], size)
        d["timer"], d["done"] = timer[code], (done | full)[code]
        marks = np.unique(code, return_index=True)[1][(done | full) & ~gone]
        d = pick(d, np.concatenate([marks, rows[~(full | gone)[code[rows]]]]))
        if len(d["r"]):
            state.update(tuple(d[c].tolist() for c in held.names))
            state.setTimeoutTimestamp(int(d["timer"].min()))
        elif state.exists:
            state.remove()

    a = stream.withWatermark("ts", watermark).groupBy("bucket").applyInPandasWithState(step, result, held, "append", "EventTimeTimeout")
    back = [F.timestamp_micros(n) if isinstance(types[k], T.TimestampType) else F.col(n) for n, k in zip(own, keys)]
    return a.select(*[F.when(F.col("nulls").bitwiseAND(F.lit(1 << i)) == 0, c).alias(k) for i, (c, k) in enumerate(zip(back, keys))],
                    F.when(~F.col("no_gen"), F.col("gen")).alias("gen_idx"), F.col("r").alias(reward),
                    "group_size", "group_mean", "group_std", "advantage", "incomplete")

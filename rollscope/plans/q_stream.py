"""The streaming operators (ST1-ST3): every query starts a stream over files
derived from the whole given tables and returns what the stream wrote."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_path
from ..streaming import streams as ST
from . import sqlgen as S
from .catalog import r6, register
from .fixtures import ROWS_PER_TASK, table
from .q_class import CTE, scored_f1


def _base(spark, name: str) -> str:
    """A fresh folder for a stream's files and state under the shared checkpoint directory."""
    return checkpoint_path(spark, "rollscope-io", f"{name}-{uuid.uuid4().hex}")


_ST2 = """WITH f AS (SELECT *, least(event_id * 8 // (SELECT max(event_id) + 1 FROM events) + CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END, 7) AS file FROM events),
  m AS (SELECT file, max(ts) AS latest FROM f GROUP BY 1),
  l AS (SELECT file, max(latest) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS before FROM m),
  r AS (SELECT f.*, coalesce(ts < before, false) AS late FROM f JOIN l USING (file)) """


def _st2(spark, sf_dir) -> str:
    """ST2 as a stream over eight files of the events, one a batch, every 50th event two files late; the folder of its results."""
    base = _base(spark, "st2")
    ev = table(spark, sf_dir, "events")
    n = ev.agg(F.max("event_id")).first()[0] + 1
    file = F.least(F.expr(f"event_id * 8 div {n}") + F.when(F.col("event_id") % 50 == 0, 2).otherwise(0), F.lit(7))
    for k in range(8):
        ev.where(file == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    q = (ST.metrics_with_quarantine(stream, f"{base}/out").option("checkpointLocation", f"{base}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{base}/out"


@register("st2_live_metrics", _ST2 + ", w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) - INTERVAL (i) DAY AS start, event_type, value FROM r, range(2) t(i) WHERE NOT late) "
          "SELECT CAST(epoch(start) AS BIGINT) AS window_start, event_type, count(*) AS n, "
          f"{S.r6('avg(value)')} AS mean_value, {S.r6('max(value)')} AS max_value FROM w "
          "WHERE start + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2")
def q_st2(spark, sf_dir):
    """ST2: the sliding windows that the stream has closed, of the rows that came in time."""
    m = ST.closed_windows(spark, _st2(spark, sf_dir))
    return m.select(F.unix_timestamp(F.col("window.start")).alias("window_start"), "event_type", "n",
                    r6("mean_value").alias("mean_value"), r6("max_value").alias("max_value"))


@register("st2_late_rows", _ST2 + "SELECT event_id, event_type, file AS batch FROM r WHERE late")
def q_st2_late(spark, sf_dir):
    """ST2's quarantine: every row that came too late, with its batch."""
    return ST.late_rows(spark, _st2(spark, sf_dir)).select("event_id", "event_type", F.col("batch").cast("long").alias("batch"))


@register("st3_advantages",
          CTE + ", a AS (SELECT *, avg(reward) OVER w AS m, stddev_samp(reward) OVER w AS sd, count(*) OVER w AS n "
          "FROM scored WINDOW w AS (PARTITION BY step, group_id)) "
          f"SELECT step, group_id, gen_idx, {S.r6('(reward - m) / (sd + 0.0001)')} AS advantage, "
          "n AS group_size, n <> 8 AS incomplete FROM a")
def q_st3(spark, sf_dir):
    """ST3 as a stream over four deliveries, read one a batch, whose borders cut groups (rollouts are
    stamped one minute apart, and each delivery sends the last rows of the one before again):
    every group is emitted in the batch that completes it.  Many tasks write a delivery's files; the stream
    goes on from its checkpoint when all of them are there, since a batch that saw only some of the files would move
    the watermark past the rows of the others."""
    base = _base(spark, "st3")
    d = scored_f1(spark, sf_dir).select("step", "group_id", "gen_idx", "reward", "row_id",
                                        F.timestamp_seconds(F.col("row_id") * 60 + 3600).alias("ts"))
    d.write.parquet(f"{base}/scored")
    d = spark.read.schema(d.schema).parquet(f"{base}/scored")
    last, rows = d.agg(F.max("row_id"), F.count(F.lit(1))).first()
    n = last + 1
    for k in range(4):
        own = d.where((F.col("row_id") >= k * n // 4 - 2) & (F.col("row_id") < (k + 1) * n // 4 + 3))
        own.drop("row_id").write.mode("append").parquet(f"{base}/in")
        a = ST.streaming_advantages(spark.readStream.schema(d.drop("row_id").schema).parquet(f"{base}/in"))
        with ST.state_partitions(spark, rows // 4 // ROWS_PER_TASK):
            q = (a.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
                 .start(f"{base}/out"))
        q.awaitTermination()
    a = spark.read.schema(a.schema).parquet(f"{base}/out")
    return a.select("step", "group_id", "gen_idx", r6("advantage").alias("advantage"), "group_size", "incomplete")


@register("st1_follow_log", CTE + f" SELECT step, image_path AS img_path, {S.r6('r_accuracy')} AS reward FROM scored")
def q_st1(spark, sf_dir):
    """ST1 end to end: the scored rollouts are written as the per-step reward
    log (S5), followed as a stream (one read per new file), and the stream is
    written to parquet under the shared checkpoint folder; the result is that
    parquet table."""
    from ..functions import constants as K
    from ..sources import io as IO
    base = _base(spark, "st1")
    IO.write_reward_log(IO.reward_log_records(scored_f1(spark, sf_dir), K.EMOTION_CLASSES), f"{base}/log")
    q = ST.start(ST.follow_reward_log(spark, f"{base}/log").select("step", "img_path", "reward"),
                 f"st1_{uuid.uuid4().hex[:8]}", path=f"{base}/out", trigger={"availableNow": True})
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("step", "img_path", r6("reward").alias("reward"))

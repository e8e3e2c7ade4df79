"""Source/sink round trips (fresh temp dirs) and stream = batch checks."""
import datetime
import os

from pyspark.sql import functions as F

from rollscope.functions import constants as K
from rollscope.plans.fixtures import f1_rollouts, f5_items, table
from rollscope.plans.q_class import scored_f1
from rollscope.sources import io as IO
from rollscope.streaming import streams as ST

from testdata_paths import SF001


def test_s1_class_folders_read_listing_only(spark, tmp_path):
    for cls in ["backpack", "broom", "not_a_class"]:
        os.makedirs(tmp_path / cls)
        for i in range(3):
            (tmp_path / cls / f"{i}.jpg").write_bytes(b"x" * 10)
    df = IO.scan_class_folders(spark, str(tmp_path), K.GENERATOR_CLASSES)
    got = sorted((os.path.basename(r["image_path"]), r["target"]) for r in df.collect())
    assert got == sorted((f"{i}.jpg", c) for c in ["backpack", "broom"] for i in range(3))
    assert "content" not in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1][:80]


def test_s2_label_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2 3 4\nbad line\n5 6 7 x\n  8 9 10 11  \n")
    (tmp_path / "b.txt").write_text("only three numbers\n1 2 3\n")
    got = {os.path.basename(r["label_path"]): r["boxes"] for r in IO.read_box_label_files(spark, str(tmp_path)).collect()}
    assert [tuple(b) for b in got["a.txt"]] == [(1.0, 2.0, 3.0, 4.0), (8.0, 9.0, 10.0, 11.0)]
    assert got["b.txt"] is None


def test_s3_s4_split_round_trip_prunes_partitions(spark, tmp_path):
    items = f5_items(spark, SF001)
    IO.save_dataset(items, str(tmp_path / "ds"))
    train = IO.load_split(spark, str(tmp_path / "ds"), "train")
    assert train.count() == items.where(F.col("split") == "train").count()
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_s5_reward_log_round_trip(spark, tmp_path):
    recs = IO.reward_log_records(scored_f1(spark, SF001), K.EMOTION_CLASSES)
    IO.write_reward_log(recs, str(tmp_path / "log"))
    back = IO.read_reward_log(spark, str(tmp_path / "log"))
    assert back.count() == recs.count()
    r = back.where(F.col("img_path") == "img/0.jpg").orderBy("reward").first()
    assert set(r["pred_probs"]) == set(K.EMOTION_CLASSES)


def test_s6_s7_s8_writers(spark, tmp_path):
    sc = scored_f1(spark, SF001)
    IO.write_qa(IO.qa_records(sc, "solution", "completion"), str(tmp_path / "qa"))
    assert spark.read.json(str(tmp_path / "qa")).count() == sc.count()
    IO.write_clean_report(sc.withColumn("cleaned", F.col("think")), str(tmp_path / "rep"))
    assert spark.read.parquet(str(tmp_path / "rep")).count() == sc.count()
    from rollscope.plans.fixtures import f3_tokens
    tok = f3_tokens(spark, SF001)
    IO.write_token_logs(tok, str(tmp_path / "tok"))
    assert spark.read.parquet(str(tmp_path / "tok")).count() == tok.count()


def test_st1_follow_log_equals_batch(spark, tmp_path):
    recs = IO.reward_log_records(scored_f1(spark, SF001), K.EMOTION_CLASSES)
    IO.write_reward_log(recs, str(tmp_path / "log"))
    s = ST.follow_reward_log(spark, str(tmp_path / "log"))
    q = (s.writeStream.format("memory").queryName("st1_out").trigger(availableNow=True)
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.awaitTermination(120)
    assert spark.table("st1_out").count() == recs.count()


def test_st2_live_metrics_equal_batch(spark, tmp_path):
    ev = table(spark, SF001, "events")
    ev.repartition(4).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    q = (ST.live_metrics(stream, watermark="0 seconds").writeStream.format("memory").queryName("st2_out")
         .outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start())
    q.awaitTermination(120)
    got = spark.table("st2_out")
    batch = ST.live_metrics(ev, watermark="0 seconds")
    # windows still open at the end of the stream are not emitted in append mode
    assert 0 < got.count() <= batch.count()
    joined = got.join(batch, ["window", "event_type"])
    assert joined.where(got["n"] != batch["n"]).count() == 0


def test_st2_state_is_bounded_and_late_rows_are_kept(spark, tmp_path):
    """Many days in many batches: only the windows that can still change are held; a window comes out once; late rows are
    counted; the closed windows equal a batch aggregate of the rows in time."""
    schema = "id long, ts timestamp, event_type string, value double"
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    os.makedirs(tmp_path / "in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    day = lambda d, h=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, hours=h)
    for b in range(12):
        rows = [(b * 10 + h, day(b, 2 * h), "ab"[h % 2], float(h)) for h in range(10)]
        if b >= 4:
            rows += [(1000 + b, day(b - 4), "a", 99.0)]                  # four days old: late
            rows += [(2000 + b, day(b - 1, 20), "a", None)]              # old, but not older than the delay
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):                                                   # a second start finds nothing new
        q = ST.metrics_with_quarantine(stream, out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
    late = ST.late_rows(spark, out).collect()
    assert sorted(r["id"] for r in late) == [1000 + b for b in range(4, 12)]
    held = {r["batch"]: r["count"] for r in spark.read.parquet(f"{out}/windows").where("not closed").groupBy("batch").count().collect()}
    assert len(held) == 12 and max(held.values()) <= 8                   # at most 4 open windows of 2 keys
    got = ST.closed_windows(spark, out)
    rows = spark.read.schema(schema).parquet(str(tmp_path / "in")).where("id < 1000 or id >= 2000")
    want = rows.groupBy(F.window("ts", "2 days", "1 day").alias("window"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.max("value").alias("x")).where(F.col("window.end") <= F.lit(day(10, 18)))
    flat = lambda d, *c: sorted((r["window"]["start"], r["event_type"], *[r[k] for k in c]) for r in d.collect())
    assert flat(got, "n", "mean_value", "max_value") == flat(want, "n", "m", "x") and got.count() > 15


def test_st3_emits_when_the_group_is_full(spark, tmp_path):
    """Batch by batch: a full group comes out with its last rollout, long before the gap has passed; one that is
    short at its timer is flagged; what is sent again, also in a later batch, counts once."""
    schema = "step long, group_id long, gen_idx long, reward double, ts timestamp"
    rows = lambda *r: [(0, g, i, v, datetime.datetime(2024, 1, 1, 0, m)) for g, i, v, m in r]
    os.makedirs(tmp_path / "in")
    stream = ST.streaming_advantages(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), gap="30 minutes",
                                     watermark="10 minutes", g=3)
    seen = set()

    def batch(*r):
        spark.createDataFrame(rows(*r), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
             .trigger(availableNow=True).start(str(tmp_path / "out")))
        q.awaitTermination()
        got = {tuple(x) for x in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()}
        new = got - seen
        seen.update(got)
        return sorted((x[1], x[2], x[3], x[4], round(x[7], 3), x[8]) for x in new)

    assert batch((1, 0, 1.0, 0), (1, 1, 2.0, 1), (2, 0, 5.0, 2)) == []
    assert batch((1, 1, 9.0, 2), (2, 1, 5.0, 3)) == []                         # 1 is sent again: still two of three
    full = batch((1, 2, 3.0, 4))
    assert full == [(1, 0, 1.0, 3, -1.0, False), (1, 1, 2.0, 3, 0.0, False), (1, 2, 3.0, 3, 1.0, False)]
    assert batch((1, 0, 7.0, 5), (1, 5, 7.0, 5)) == []                         # resent, and beyond G
    short = batch((3, 0, 1.0, 55))                                              # the watermark passes group 2's timer
    short += batch((3, 0, 1.0, 55))
    assert short == [(2, 0, 5.0, 2, 0.0, True), (2, 1, 5.0, 2, 0.0, True)]
    assert len(seen) == 5


def test_st3_stream_equals_batch(spark, tmp_path):
    f1 = scored_f1(spark, SF001).withColumn("ts", F.timestamp_seconds(F.col("row_id") * 60 + 3600))
    f1 = f1.select("step", "group_id", "gen_idx", "reward", "ts").where("not (group_id = 5 and gen_idx = 3)")
    f1.union(f1.where("group_id = 7 and gen_idx = 2")).repartition(3).write.parquet(str(tmp_path / "r"))
    spark.sql("SELECT -1L AS step, -1L AS group_id, 0L AS gen_idx, 0D AS reward, timestamp'2200-01-01' AS ts") \
        .write.mode("append").parquet(str(tmp_path / "r"))
    schema = "step long, group_id long, gen_idx long, reward double, ts timestamp"
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "r"))
    q = (ST.streaming_advantages(stream).writeStream.format("parquet").trigger(availableNow=True)
         .option("checkpointLocation", str(tmp_path / "ck")).start(str(tmp_path / "out")))
    q.awaitTermination(120)
    from rollscope.operators.groups import group_advantages
    key = lambda d: {(r["step"], r["group_id"], r["gen_idx"]): r for r in d.collect()}
    got = key(spark.read.parquet(str(tmp_path / "out")).where("step >= 0"))
    batch = key(group_advantages(f1))
    table = key(ST.streaming_advantages(spark.read.schema(schema).parquet(str(tmp_path / "r"))).where("step >= 0"))
    assert got.keys() == batch.keys() == table.keys()
    assert all(abs(got[k]["advantage"] - batch[k]["advantage"]) < 1e-9 > abs(table[k]["advantage"] - batch[k]["advantage"]) for k in got)
    assert {k[1] for k, r in got.items() if r["incomplete"]} == {k[1] for k, r in table.items() if r["incomplete"]} == {5}


def test_start_helper_checkpoints_under_shared_dir(spark, tmp_path):
    ev = table(spark, SF001, "events")
    ev.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    name = f"st_helper_{os.getpid()}"
    q = ST.start(stream.select("event_id"), name, fmt="memory", trigger={"availableNow": True})
    q.awaitTermination(120)
    assert spark.table(name).count() == ev.count()
    from rollscope.session import checkpoint_path
    assert os.path.isdir(checkpoint_path(spark, "streams", name).replace("file:", ""))


def test_s5_bounded_files_per_step(spark, tmp_path):
    recs = IO.reward_log_records(scored_f1(spark, SF001), K.EMOTION_CLASSES)
    recs.repartition(8).createOrReplaceTempView("recs_dealt")
    IO.write_reward_log(spark.table("recs_dealt"), str(tmp_path / "log"), files_per_step=2)
    for d in (tmp_path / "log").iterdir():
        if d.is_dir():
            assert len([f for f in d.iterdir() if f.name.endswith(".json")]) <= 2
    assert IO.read_reward_log(spark, str(tmp_path / "log")).count() == recs.count()

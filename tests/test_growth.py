"""What grows with the tables: the memory of a join, the rows of a task, the files of a step."""
import numpy as np
import pytest
from pyspark.sql import functions as F


def test_attached_responses_are_never_broadcast(spark, tmp_path):
    """A side that packs many rows into few bytes of a file is not held whole by a task."""
    from rollscope.operators import prompts as P
    d = lambda n: spark.range(n).select((F.col("id") % 50).alias("group_id"), F.expr("id div 50").alias("gen_idx"))
    for name, n in (("p", 400), ("r", 300)):
        d(n).write.parquet(str(tmp_path / name))
    got = P.attach_responses(spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "r")))
    for out, rows in zip(got, (300, 100, 0)):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == rows


def test_scored_rows_are_dealt_to_many_tasks(spark, tmp_path):
    """One row group of a file does not make one task of the scoring."""
    from rollscope.plans.catalog import QUERIES, load_all
    from rollscope.plans.fixtures import ROWS_PER_TASK
    load_all()
    spark.range(ROWS_PER_TASK * 5 // 2).withColumnRenamed("id", "event_id").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.range(500).withColumnRenamed("id", "s_suppkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    for name, tasks in (("b8_accuracy", 3), ("b8_accuracy_500_classes", 3), ("x9_match_large", 8)):
        assert QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == tasks, name
    for name in ("g8_gather", "l4_select_threshold"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange RoundRobinPartitioning(3)" in plan, name


def test_running_best_computes_its_metrics_once(spark):
    from rollscope.operators import groups as G
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(len(b))
            yield b

    d = spark.range(100).selectExpr("id AS step", "id % 7 / 7D AS value").mapInPandas(seen, "step long, value double")
    got = G.running_best(d, block=4, levels=3)
    assert {r["step"]: r["prev_best"] for r in got.collect()}[99] == 6 / 7 and runs.value == 100


def test_classes_are_looked_up_in_one_set(spark):
    from rollscope.functions import sparse as SP
    d = spark.createDataFrame([(["c1", "x", "c499", "c1"], ["0.5", "0.1", "0.2", "0.3"])], "k array<string>, v array<string>")
    d = d.select(SP.sparse_probs("k", "v", [f"c{i}" for i in range(500)]).alias("p"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert d.first()["p"] == (["c1", "c499"], [0.3, 0.2])
    assert "array_intersect" not in plan


@pytest.mark.parametrize("n,m", [(1, 1), (1, 4), (6, 6), (40, 40), (40, 55), (120, 121)])
def test_one_matrix_equals_the_padded_form(n, m):
    from rollscope.functions import matching as M
    r = np.random.default_rng(n * m)
    for cost in (r.random((n, m)), -r.integers(0, 4, (n, m)).astype(float), np.zeros((n, m)),
                 np.add.outer(r.integers(0, 9, n), r.integers(0, 9, m)) + r.integers(0, 3, (n, m)) / 1000):
        a, b = M.solve_one(cost), M.solve_padded(cost[None], np.array([n]))[0]
        assert len(set(a.tolist())) == n and a.min() >= 0
        assert cost[np.arange(n), a].sum() == pytest.approx(cost[np.arange(n), b].sum(), abs=1e-9)


def test_a_thousand_rows_are_matched_in_a_second():
    """Rows and columns with prices and few exact pairs: 5 s before, by augmenting paths alone."""
    import time
    from rollscope.functions import matching as M
    i = np.arange(1000)
    score = np.add.outer(100 + i % 17, 50 + i % 23) - (1 + np.add.outer(i * 13, i * 5) % 37).astype(float)
    score[i, (i * 7) % 1000] += (1 + (i * 13 + (i * 7) % 1000 * 5) % 37)
    t = time.process_time()
    got = M.batch_assignment([score / 1000])[0]
    assert time.process_time() - t < 2
    assert got == pytest.approx((100 + i % 17 + 50 + i % 23).sum() / 1000)


def test_a_step_of_few_rows_is_one_file_and_rows_are_made_once(spark, tmp_path):
    """Writers by step: small steps have one file (up to two at the border of a task's range), a hot step several, and
    what makes the rows runs once although they are dealt by range."""
    import os
    from rollscope.sources import io as IO
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(len(b))
            yield b

    d = spark.range(4000).selectExpr("CASE WHEN id % 4 = 0 THEN 100 ELSE id % 40 END AS step", "id AS group_id", "0L AS gen_idx", "'q' AS q", "'a' AS a")
    d = d.mapInPandas(seen, d.schema)
    IO.write_qa(IO.qa_records(d, "q", "a"), str(tmp_path / "qa"))
    files = {s: len([f for f in os.listdir(tmp_path / "qa" / s) if f.startswith("part-")]) for s in os.listdir(tmp_path / "qa") if s.startswith("step=")}
    assert len(files) == 31 and sum(files.values()) <= 31 + 2 * 4 and files["step=100"] <= 4
    assert runs.value == 4000 and spark.read.json(str(tmp_path / "qa")).count() == 4000
    IO.write_clean_report(d.selectExpr("step", "group_id", "gen_idx", "q AS completion", "a AS cleaned"), str(tmp_path / "report"))
    assert runs.value == 8000


def test_folders_of_a_shelf_come_from_one_task(spark, tmp_path):
    """The class folders of a shelf, and the images of a shelf, are written by one task each."""
    import os
    import re
    from rollscope.plans import q_io
    from rollscope.session import checkpoint_path
    spark.range(3000).selectExpr("id AS p_partkey", "int(id % 50) AS p_size", "1D AS p_retailprice").write.parquet(str(tmp_path / "part.parquet"))
    seen = lambda: set(os.listdir(checkpoint_path(spark, "rollscope-io").replace("file:", ""))) if os.path.isdir(checkpoint_path(spark, "rollscope-io").replace("file:", "")) else set()
    before = seen()
    rows = q_io.q_s1(spark, str(tmp_path)).collect()
    assert sum(r["n_items"] for r in rows) == 3000
    path = os.path.join(checkpoint_path(spark, "rollscope-io").replace("file:", ""), next(x for x in seen() - before if x.startswith("classes-")))
    for shelf in (x for x in os.listdir(path) if x.startswith("shelf=")):
        tasks = {re.match(r"part-(\d+)-", f)[1] for _, _, fs in os.walk(os.path.join(path, shelf)) for f in fs if f.startswith("part-")}
        assert len(tasks) == 1


def test_streaming_advantages_hold_state_by_bucket(spark, tmp_path):
    """ST3: a batch calls Python for a bucket of groups, not for each group; keys that only differ beyond a float's digits or
    in a NULL stay apart; a rollout sent thousands of times counts once, the first."""
    import datetime
    import json

    from rollscope.streaming import streams as ST
    big = 1 << 53
    d = spark.range(16000).selectExpr("0L AS step", "id div 8 AS group_id", "id % 8 AS gen_idx", "id % 7 / 7D AS reward", "timestamp_seconds(id + 3600) AS ts")
    odd = spark.range(32).selectExpr("-1L AS step", f"element_at(array(NULL, 0L, {big}L, {big + 1}L), int(id div 8) + 1) AS group_id", "id % 8 AS gen_idx",
                                     "id * id / 9D AS reward", "timestamp_seconds(id + 3600) AS ts")
    hot = spark.range(25000).selectExpr("-2L AS step", "7L AS group_id", "id % 3 AS gen_idx", "25000D - id AS reward", "timestamp_seconds(id + 3600) AS ts")
    d.union(odd).union(hot).write.parquet(str(tmp_path / "in"))
    schema = "step long, group_id long, gen_idx long, reward double, ts timestamp"
    a = ST.streaming_advantages(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), g=8, watermark="365 days")
    q = a.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start(str(tmp_path / "out"))
    q.awaitTermination()
    held = [o["numRowsTotal"] for p in q.recentProgress for o in json.loads(p.json)["stateOperators"]]
    assert 0 < max(held) <= 256
    key = lambda x: {(r["step"], r["group_id"], r["gen_idx"]): (r["group_size"], round(r["advantage"], 9), r["incomplete"]) for r in x.collect()}
    got = key(spark.read.schema(a.schema).parquet(str(tmp_path / "out")))
    want = key(ST.streaming_advantages(spark.read.schema(schema).parquet(str(tmp_path / "in"))))
    assert got == {k: v for k, v in want.items() if k[0] > -2} and len(got) == 16032
    late = spark.createDataFrame([(-3, 0, 0, 0.0, datetime.datetime(1999, 1, 1))], schema)
    late.write.mode("append").parquet(str(tmp_path / "in"))                 # the watermark passes the hot group's timer
    q = a.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start(str(tmp_path / "out"))
    q.awaitTermination()
    got = key(spark.read.schema(a.schema).parquet(str(tmp_path / "out")).where("step = -2"))
    assert got == {k: v for k, v in want.items() if k[0] == -2} and {v[2] for v in got.values()} == {True}


def test_deliveries_of_a_stream_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """st3_advantages: no file of the stream holds a quarter of the table; the session's own setting stays."""
    import glob

    from rollscope.plans import fixtures, q_stream
    spark.range(4000).withColumnRenamed("id", "event_id").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(fixtures, "spread", lambda df: df.repartition(3))
    monkeypatch.setattr(q_stream, "_base", lambda *_: str(tmp_path / "st3"))
    got = q_stream.q_st3(spark, str(tmp_path))
    assert len(glob.glob(str(tmp_path / "st3" / "in" / "part-*"))) >= 8
    assert got.distinct().count() == got.count() == 4000 and got.where("group_size <> 8 OR incomplete").count() == 0
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"

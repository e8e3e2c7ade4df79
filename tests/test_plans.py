"""Plan-shape checks: the exchanges and Python nodes each headline plan is
meant to have (guards against a refactor silently adding a shuffle)."""
import pytest

from rollscope.plans.catalog import QUERIES, load_all

from testdata_paths import SF001

load_all()


def plan(spark, name):
    return QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,exchanges", [
    ("g3_advantage", 1),      # one hash partitioning on (step, group_id), reused by the window
    ("b8_accuracy", 0),       # narrow
    ("t5_remove_sentences", 0),
    ("t1_process", 0),
    ("p8a_emotion_prompt", 0),
    ("x11a_r1_multibox", 1),  # l_orderkey, reused by numbering window and per-image aggregate
])
def test_exchange_count(spark, name, exchanges):
    p = plan(spark, name)
    assert p.count("Exchange hashpartitioning") + p.count("Exchange RoundRobin") == exchanges, p


def events(spark, parts):
    return spark.read.parquet(f"{SF001}/events.parquet").repartition(parts)


@pytest.mark.parametrize("parts", [2, 40])
def test_plans_do_not_depend_on_the_number_of_partitions(spark, parts):
    from rollscope.operators import groups as G
    from rollscope.operators import prompts as P
    from rollscope.streaming import streams as ST
    shape = lambda df: df._jdf.queryExecution().executedPlan().toString()
    live = shape(ST.live_metrics(events(spark, parts)))
    assert live.index("partial_count") > live.index("Exchange hashpartitioning(window")      # the partial step is below
    d = events(spark, parts).selectExpr("event_id div 8 AS group_id", "event_id div 128 AS step", "event_id % 8 AS gen_idx",
                                        "value AS reward", "event_type", "user_id")
    best = shape(G.best_of_group(d).select("step", "group_id", "gen_idx"))
    assert "WindowGroupLimit" in best and "user_id" not in best.split("Exchange hashpartitioning(step")[0]
    few = shape(P.few_shot(d.select("event_type", "reward"), "event_type", "reward"))
    assert "WindowGroupLimit" in few and "Python" not in few and "Pandas" not in few


def test_running_best_has_no_unbounded_window(spark):
    from rollscope.operators import groups as G
    rows = [(s, float((s * 7919) % 1000) / 1000) for s in range(0, 5000, 3)]
    d = spark.createDataFrame(rows, "step long, value double")
    got = G.running_best(d, block=8, levels=4)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    best, want = 0.0, {}
    for s, v in rows:
        want[s] = best
        best = max(best, v)
    assert {r["step"]: r["prev_best"] for r in got.collect()} == want


@pytest.mark.parametrize("name", ["g3_advantage", "b8_accuracy", "g8_gather", "t1_process", "t4_remove_class_names",
                                  "t5_remove_sentences", "p8a_emotion_prompt", "g6_loss", "l4_select"])
def test_no_python_in_core_plans(spark, name):
    p = plan(spark, name)
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p


def test_scan_reads_only_needed_columns(spark):
    p = plan(spark, "g3_advantage")
    scan = [line for line in p.splitlines() if "FileScan parquet" in line][0]
    assert "ReadSchema: struct<event_id:bigint>" in scan


def test_regex_parsed_once(spark):
    df = QUERIES["b8_accuracy"](spark, SF001)
    opt = df._jdf.queryExecution().optimizedPlan().toString()
    assert opt.count("regexp_extract_all") == 4     # keys + values, completion + solution


def test_stored_groups_move_no_rows(spark):
    from rollscope.plans.q_class import q_g3_stored
    for buckets in (4, 16):
        p = q_g3_stored(spark, SF001, buckets)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in p and p.count("Bucketed: true") == 2 and f"SelectedBucketsCount: {buckets} out of {buckets}" in p


def test_block_diff_reads_only_blocks_that_differ(spark, tmp_path):
    from pyspark.sql import functions as F
    from rollscope.operators import diff as DF
    nan, inf = float("nan"), float("inf")
    a = [(k, float(k), 1.0) for k in range(400)] + [(1000, nan, 1.0), (1001, inf, 1.0), (1002, None, 1.0)]
    b = [(k, float(k) * (1.01 if k == 57 else 1.0), 1.0) for k in range(390) if k != 123] + [(2000, 1.0, 1.0), *a[-3:]]
    schema = "k long, v double, w double"
    x, y = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    for d, name in ((x, "a"), (y, "b")):
        DF.write_blocks(d, str(tmp_path / name), ["k"], ["v", "w"], F.expr("k div 50"))
    got, compared = DF.block_diff(str(tmp_path / "a"), str(tmp_path / "b"), ["k"], ["v", "w"], spark)
    scans = [s for s in got._jdf.queryExecution().executedPlan().toString().split("FileScan")[1:] if "v#" in s.split("]")[0]]
    assert len(scans) == 2 and all("PartitionFilters: [" in s and "PartitionFilters: []" not in s.split("ReadSchema")[0] for s in scans)
    want = DF.tolerance_diff(x, y, ["k"], ["v", "w"]).select("k", "status")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert compared == [1, 2, 7, 20, 40]              # the changed, the missing, the short, the not finite, the new

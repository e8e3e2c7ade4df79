"""Numbers within keys over many tasks, and the documents and reports that need them."""
import json
import os

from pyspark.sql import functions as F

from rollscope.operators.numbering import numbered_within
from rollscope.sources import io as IO


def test_one_key_with_most_rows(spark):
    """Numbers are 1..n in order; the key with most rows lies in several tasks, and no window holds its rows."""
    d = spark.range(5000).select(F.when(F.col("id") % 10 < 8, 7).when(F.col("id") % 10 == 8, 1).otherwise(None).alias("step"),
                                 (F.col("id") * 37 % 5000).alias("k"), F.lit("x").alias("n"))
    out = numbered_within(d, ["step"], ["k"], "i", total="of", parts=6)
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault(r["step"], []).append((r["k"], r["i"], r["of"]))
    assert {s: len(v) for s, v in by.items()} == {7: 4000, 1: 500, None: 500}
    for v in by.values():
        assert [(i, of) for _, i, of in sorted(v)] == [(i + 1, len(v)) for i in range(len(v))]
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    windows = [i for i, x in enumerate(plan) if "Window [" in x]
    assert len(windows) == 2 and any("Aggregate [__part" in x for x in plan[windows[-1]:])     # over the runs only


def test_empty_and_ties(spark):
    d = spark.createDataFrame([(1, 5), (1, 5), (1, 4)], "step int, k int")
    assert sorted(r["i"] for r in numbered_within(d, ["step"], ["k"], "i").collect()) == [1, 2, 3]
    assert numbered_within(d.where("step > 1"), ["step"], ["k"], "i").collect() == []


def joined(folder):
    return "\n".join(open(os.path.join(folder, f), encoding="utf-8").read().rstrip("\n")
                     for f in sorted(os.listdir(folder)) if f.startswith("part-"))


def test_documents_parse_and_hot_step_has_several_files(spark, tmp_path):
    d = spark.range(3000).select((F.col("id") % 10 == 0).cast("long").alias("step"), F.expr("id div 8").alias("group_id"), (F.col("id") % 8).alias("gen_idx"),
                                 F.concat(F.lit('q "\n" é '), F.col("id").cast("string")).alias("q"),
                                 F.when(F.col("id") != 50, F.concat(F.lit("a,"), F.col("id").cast("string"))).alias("a"))
    IO.write_qa_documents(d, str(tmp_path / "qa"), "q", "a", parts=5)
    rows = sorted(((r["step"], r["group_id"], r["gen_idx"], r["q"], r["a"]) for r in d.collect()))
    for step in (0, 1):
        folder = str(tmp_path / "qa" / f"step={step}")
        doc = json.loads(joined(folder))
        own = [r for r in rows if r[0] == step]
        assert doc["qa_pairs"] == [{"question_id": i, "question_text": r[3], "model_answer": r[4]} for i, r in enumerate(own)]
        assert (doc["metadata"]["step"], doc["metadata"]["data_version"]) == (step, "1.1")
        assert doc["metadata"].get("unpaired") == (1 if step == 1 else None)
    assert len([f for f in os.listdir(tmp_path / "qa" / "step=0") if f.startswith("part-")]) > 2


def test_text_report(spark, tmp_path):
    d = spark.createDataFrame([(0, 1, 0, "b", "B"), (0, 0, 1, "a\nx", None), (1, 0, 0, "c", "C")],
                              "step long, group_id long, gen_idx long, completion string, cleaned string")
    IO.write_text_report(d, str(tmp_path / "r"))
    rule = "=" * 50
    assert joined(str(tmp_path / "r" / "step=0")) == (f"Sample 1:\nCompletion: a\nx\nCleaned Response: None\n{rule}\n"
                                                      f"Sample 2:\nCompletion: b\nCleaned Response: B\n{rule}")
    assert joined(str(tmp_path / "r" / "step=1")).startswith("Sample 1:\nCompletion: c")

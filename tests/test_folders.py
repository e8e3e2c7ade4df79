"""Very many small files: written, listed and read by tasks, with the rows that Spark's own sources give."""
import gzip
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rollscope.sources import folders as FO
from rollscope.sources import io as IO

ODD = {"a/x.txt": b"one\ntwo\r\nthree\rfour", "a/_b=1/y.txt": b"\xef\xbb\xbfbom\n\n\nlast\n", "empty.txt": b"", "end.txt": b"\n",
       "long.txt": b"".join(b"line %d of a file that is read in ranges\r\n" % i for i in range(300)), "wide.txt": b"x" * 5000 + b"\nshort\n" + b"y" * 3000,
       "utf.txt": "größe\nπ\n".encode(), "_hidden/z.txt": b"no\n", ".h.txt": b"no\n", "packed.gz": gzip.compress(b"p 1\np 2\n" * 500)}


def _odd(tmp_path):
    for name, text in ODD.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(text)
    return str(tmp_path)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [7, 64, 1 << 23])
def test_lines_equal_sparks_text_source(spark, tmp_path, monkeypatch, size):
    root = _odd(tmp_path)
    monkeypatch.setattr(FO, "RANGE", size)
    want = spark.read.option("recursiveFileLookup", "true").text(root).select(F.regexp_extract("_metadata.file_path", "([^/]*)$", 1).alias("f"), "value")
    got = FO.read_lines(spark, root).select(F.regexp_extract("path", "([^/]*)$", 1).alias("f"), "value")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    listed = {r["path"]: r["size"] for r in FO.list_files(spark, root).collect()}
    assert listed == {f"{root}/{n}": len(t) for n, t in ODD.items() if not n.startswith((".", "_"))}


def test_label_files_by_tasks(spark, tmp_path, monkeypatch):
    """a file for each image, in order; no file is named on the driver, and one of several ranges keeps its order."""
    rows = [(i // 50, i, b, f"{i}  {b} {i + b} {b}.5" if (i + b) % 7 else f"bad line {b}") for i in range(200) for b in range(i % 5 + 1)]
    lines = spark.createDataFrame(rows, "shelf long, image long, box_no long, value string")
    IO.write_label_files(lines.repartition(3), str(tmp_path / "l"), ["box_no"])
    names = [f for _, _, fs in os.walk(tmp_path / "l") for f in fs if f != "_SUCCESS"]
    assert sorted(names) == sorted(f"image={i}.txt" for i in range(200))
    want = {i: [(float(i), float(b), float(i + b), b + .5) for b in range(i % 5 + 1) if (i + b) % 7] or None for i in range(200)}
    for size in (1 << 23, 5):
        monkeypatch.setattr(FO, "RANGE", size)
        back = IO.read_box_label_files(spark, str(tmp_path / "l"))
        assert "FileScan" not in _plan(back)
        got = {int(r["label_path"].rsplit("=")[-1][:-4]): r["boxes"] and [tuple(b) for b in r["boxes"]] for r in back.collect()}
        assert got == want


def test_box_log_by_tasks(spark, tmp_path):
    """JSON lines by step with null fields, the columns that Spark's source gives, an unnamed step, two appends."""
    rows = [(s, f"img/{k}", "ü\n\"q\"", None, "t", [[1.0, 2.0, 3.0, 4.5]] * (k % 3), None if k % 2 else [], None, k / 8, "e" if k % 3 else None) for s in (*range(60), None) for k in range(4)]
    recs = spark.createDataFrame(rows, IO.BOX_REWARD_LOG_SCHEMA)
    for _ in range(2):
        IO.write_reward_log(recs, str(tmp_path / "log"))
    back = IO.read_reward_log(spark, str(tmp_path / "log"), IO.BOX_REWARD_LOG_SCHEMA)
    plain = spark.read.schema(IO.BOX_REWARD_LOG_SCHEMA).json(str(tmp_path / "log"))
    assert "FileScan" not in _plan(back) and back.schema == plain.schema
    assert _plan(back).count("from_json") <= 1
    key = lambda d: Counter(map(str, d.select(*recs.columns).collect()))
    assert key(back) == key(plain) == key(recs.union(recs))
    text = (tmp_path / "log" / "step=3").glob("*.json")
    assert all('"sol":null' in line for f in text for line in f.read_text().splitlines())


def test_class_folders_by_tasks(spark, tmp_path):
    """folders by shelf and class with names that Spark escapes, scanned without a listing on the driver."""
    rows = [(s, c, f"{s}/{c}/{k}") for s in range(30) for c in ("cup", "a/b: 5%", "not a class", None) for k in range(s % 3 + 1)]
    IO.write_class_lines(spark.createDataFrame(rows, "shelf long, class string, v string"), str(tmp_path / "c"), ["shelf", "class"], "v")
    by = spark.read.text(str(tmp_path / "c"))
    assert Counter((r["shelf"], r["class"], r["value"]) for r in by.collect()) == Counter(rows)
    listed = IO.scan_class_folders(spark, str(tmp_path / "c"), ["class=cup"])
    assert "FileScan" not in _plan(listed) and sorted(r["target"] for r in listed.collect()) == ["class=cup"] * 30
    assert IO.read_text_lines(spark, str(tmp_path / "c")).count() == len(rows)


def test_a_retried_task_replaces_its_files(spark, tmp_path):
    """A task that fails after some files leaves no half file that a reader sees, and no file twice."""
    df = spark.range(100).select((F.col("id") % 10).alias("k"), F.col("id").cast("string").alias("v")).coalesce(1).sortWithinPartitions("k")
    broken = df.withColumn("v", F.when(F.col("k") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        FO.write_folders(broken, str(tmp_path / "w"), ["k"], "v", ".txt", named=True)
    FO.write_folders(df, str(tmp_path / "w"), ["k"], "v", ".txt", named=True)
    assert Counter(r["value"] for r in FO.read_lines(spark, str(tmp_path / "w")).collect()) == Counter(str(i) for i in range(100))

"""Sources and sinks.

Readers are ordinary Spark data sources (binaryFile, text, parquet, json);
writers are DataFrame writers partitioned by split or step, so a job that
loses an executor simply re-runs the lost tasks and the committer keeps
the output consistent (no file locks, no appends to a shared file).
Where a table has a file for each image, step or class, a folder of the
``file:`` scheme is written, listed and read by ``folders``.
"""
from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import boxes as B
from ..operators.numbering import numbered_within
from ..session import checkpoint_path
from . import folders as FO

REWARD_LOG_SCHEMA = T.StructType([
    T.StructField("step", T.LongType()),
    T.StructField("img_path", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("solution", T.StringType()),
    T.StructField("reward", T.DoubleType()),
    T.StructField("pred_probs", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("gt_probs", T.MapType(T.StringType(), T.DoubleType())),
])

#: The box tasks' record: boxes instead of class maps, the target phrase and the match value.
BOX_REWARD_LOG_SCHEMA = T.StructType([
    T.StructField("step", T.LongType()),
    T.StructField("img_path", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("sol", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("gt_bbox", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("pred_bbox", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("iou", T.DoubleType()),
    T.StructField("reward", T.DoubleType()),
    T.StructField("error", T.StringType()),
])


def clustered(df: DataFrame, files_per_step: int, step: str = "step") -> DataFrame:
    """Rows dealt by ranges of (step, salt), so that the neighbouring steps of a task have one file
    each and their folders are moved whole when the job commits; a hot step is written by up
    to ``files_per_step`` tasks, and has no more files.  The salt is a hash of the row, so a retried task
    deals alike.  The rows are first written as they come to a table in the shared folder: the ranges
    are drawn from it, and what made the rows runs once."""
    spark = df.sparkSession
    hashable = [f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    path = checkpoint_path(spark, "rollscope-io", f"dealt-{uuid.uuid4().hex}")
    df.write.parquet(path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (spark.read.schema(df.schema).parquet(path)
            .repartitionByRange(n, F.col(step), F.pmod(F.xxhash64(*hashable), F.lit(files_per_step))))


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """(path) of every file under ``root``, as Spark names it."""
    if at := FO.there(spark, root):
        return FO.list_files(spark, at).select(F.concat(F.lit("file:"), "path").alias("path"))
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")


# ----------------------------------------------------------------------- S1
def write_class_lines(df: DataFrame, path: str, keys: Sequence[str], value: str) -> None:
    """Text files in folders by ``keys``; the folders of a first key are written by one task."""
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys[0])
    if at := FO.local_path(df.sparkSession, path):
        FO.write_folders(df.sortWithinPartitions(*keys), at, keys, value, ".txt")
    else:                                             # the first key's folder is moved whole when the job commits
        df.select(*keys, value).write.partitionBy(*keys).text(path)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of every line of the files under ``path``."""
    if at := FO.there(spark, path):
        return FO.read_lines(spark, at)
    return spark.read.option("recursiveFileLookup", "true").text(path).select(F.url_decode("_metadata.file_path").alias("path"), "value")


def scan_class_folders(spark: SparkSession, root: str, classes: Sequence[str]) -> DataFrame:
    """Every file under ``root/<class>/`` -> (image_path, target).  Only
    the file listing is read (``content`` is pruned).  The class list is a
    fixed parameter, so joining it is a broadcast of a bounded table."""
    files = _listing(spark, root)
    files = files.withColumn("target", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1))
    cls = spark.createDataFrame([(c,) for c in classes], "target string")
    return files.join(F.broadcast(cls), "target").select(F.col("path").alias("image_path"), "target")


# ----------------------------------------------------------------------- S2
def write_label_files(lines: DataFrame, path: str, order: Sequence[str]) -> None:
    """A label file ``shelf=../image=..`` for each ``image`` of ``lines`` (shelf, image, value), its lines in the given order.
    A shelf, the folder of neighbouring images, is written by one task and listed by any."""
    lines = lines.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shelf") \
        .sortWithinPartitions("shelf", "image", *order)
    if at := FO.local_path(lines.sparkSession, path):
        FO.write_folders(lines, at, ["shelf", "image"], "value", ".txt", named=True)
    else:
        lines.select("shelf", "image", "value").write.partitionBy("shelf", "image").text(path)


def _tokens(line):
    return F.split(F.trim(F.regexp_replace(line, r"(?U)\s+", " ")), " ")


def _numbers(tok):
    return [F.get(tok, F.lit(i)).try_cast("double") for i in range(4)]


def read_box_label_files(spark: SparkSession, path: str) -> DataFrame:
    """One label file per image; lines with exactly four whitespace-
    separated floats become boxes (file order kept), other lines are skipped;
    a file without boxes gives NULL.  Files are read line by line, so a large
    one is split among tasks; the block's offset and the line's number within
    the block keep the order."""
    if at := FO.there(spark, path):
        def blocks(whole):
            tok = F.transform(FO.lines_of("text"), _tokens)
            nums = F.transform(F.filter(tok, lambda t: F.size(t) == 4), lambda t: F.array(*_numbers(t)))
            ok = F.filter(nums, lambda v: F.forall(v, lambda x: x.isNotNull()))
            return FO.read_blocks(spark, at, whole).select(F.concat(F.lit("file:"), "path").alias("label_path"), "at", F.transform(
                F.coalesce(ok, F.array().cast("array<array<double>>")), lambda v: B.box(*[v[i] for i in range(4)])).alias("b"))

        parts = blocks(False).groupBy("label_path").agg(F.array_sort(F.collect_list(F.struct("at", "b"))).alias("bs"))
        both = blocks(True).select("label_path", "b").union(parts.select("label_path", F.flatten(F.transform("bs", lambda x: x["b"]))))
        return both.select("label_path", F.when(F.size("b") > 0, F.col("b")).alias("boxes"))
    files = _listing(spark, path).select(F.col("path").alias("label_path"))              # contents are not read
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("label_path"), F.col("value").alias("line"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line_no"))
    tok = lines.withColumn("tok", _tokens("line"))
    nums = _numbers(F.col("tok"))
    ok = (F.size("tok") == 4) & nums[0].isNotNull() & nums[1].isNotNull() & nums[2].isNotNull() & nums[3].isNotNull()
    boxes = tok.where(ok).select("label_path", "line_no", B.box(*nums).alias("b"))
    per_file = boxes.groupBy("label_path").agg(F.array_sort(F.collect_list(F.struct("line_no", "b"))).alias("_bs"))
    per_file = per_file.select("label_path", F.transform("_bs", lambda x: x["b"]).alias("boxes"))
    return files.select("label_path").join(per_file, "label_path", "left")


# ------------------------------------------------------------------- S3, S4
def save_dataset(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The table plus its split manifest = parquet partitioned by ``split``."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """S3: one split; the filter on the partition column prunes directories."""
    return spark.read.parquet(path).where(F.col("split") == split)


# ----------------------------------------------------------------------- S5
def reward_log_records(scored: DataFrame, classes: Sequence[str]) -> DataFrame:
    """S5 record shape for class tasks: step, img_path, content, solution,
    reward, pred_probs, gt_probs (maps in class order)."""
    from ..functions.dist import probs_map
    from ..operators.rewards import class_col
    pred = probs_map([F.col(class_col("pred", c)) for c in classes], classes)
    gt = probs_map([F.col(class_col("gt", c)) for c in classes], classes)
    return scored.select(F.col("step").cast("long"), F.col("image_path").alias("img_path"),
                         F.col("completion").alias("content"), "solution", F.col("r_accuracy").alias("reward"),
                         pred.alias("pred_probs"), gt.alias("gt_probs"))


def box_reward_log_records(scored: DataFrame, target) -> DataFrame:
    """S5 record shape for box tasks, from a scored box table (``gt_boxes``,
    ``pred_boxes``, ``iou``, ``reward``, ``error``)."""
    def plain(c):
        return F.transform(c, lambda b: F.array(b["x1"], b["y1"], b["x2"], b["y2"]))

    return scored.select(F.col("step").cast("long"), F.col("image_path").alias("img_path"),
                         F.col("completion").alias("content"), F.col("solution").alias("sol"), target.alias("target"),
                         plain("gt_boxes").alias("gt_bbox"), plain("pred_boxes").alias("pred_bbox"), "iou", "reward", "error")


def write_reward_log(records: DataFrame, path: str, files_per_step: int = 4) -> None:
    """JSON lines, one directory per step, NULL fields kept, non-ASCII
    kept, at most ``files_per_step`` files in a step.  Appending adds new
    files; it never rewrites existing ones."""
    records = clustered(records, files_per_step)
    if at := FO.local_path(records.sparkSession, path):
        record = F.to_json(F.struct(*[c for c in records.columns if c != "step"]), {"ignoreNullFields": "false"})
        FO.write_folders(records.sortWithinPartitions("step").select("step", record.alias("record")), at, ["step"], "record", ".json")
        return
    (records.write.mode("append").partitionBy("step").option("ignoreNullFields", "false")
     .json(path))


def read_reward_log(spark: SparkSession, path: str, schema: T.StructType = REWARD_LOG_SCHEMA) -> DataFrame:
    at = FO.there(spark, path)
    if not (at and os.path.isdir(at) and any(e.name.startswith("step=") for e in os.scandir(at))):
        return spark.read.schema(schema).json(path)
    lines = FO.read_lines(spark, at).where(~F.col("value").rlike(r"^\s*$"))
    data = T.StructType([f for f in schema.fields if f.name != "step"])
    return lines.select(F.from_json("value", data).alias("r"), FO.key_of(F.col("path"), "step").try_cast(schema["step"].dataType).alias("step")).select("r.*", "step")


# ----------------------------------------------------------------------- S6
def qa_records(df: DataFrame, question: str, answer: str, step: str = "step",
               order: Sequence[str] = ("group_id", "gen_idx"), data_version: str = "1.1") -> DataFrame:
    """S6 as flat records: one QA pair per row with its step metadata.
    ``question_id`` is the rollout key, not a position.  Rows with a missing
    question or answer are the count-mismatch case and are flagged."""
    return df.select(
        F.struct(F.col(step).cast("long").alias("step"), F.current_timestamp().alias("timestamp"),
                 F.lit(data_version).alias("data_version")).alias("metadata"),
        F.col(step).cast("long").alias("step"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in order]).alias("question_id"),
        F.col(question).cast("string").alias("question_text"),
        F.col(answer).cast("string").alias("model_answer"),
        (F.col(question).isNull() | F.col(answer).isNull()).alias("unpaired"))


def write_qa(records: DataFrame, path: str, files_per_step: int = 4) -> None:
    clustered(records, files_per_step).write.mode("append").partitionBy("step").json(path)


def write_lines(lines: DataFrame, path: str, by: Sequence[str], key: str = "step", parts: int | None = None) -> None:
    """Text files by ``key``: the column ``line`` of ``lines`` in the order of ``by`` (which starts
    with the key).  Several tasks write a key's lines; its files, read in the order of their
    names, give them in order."""
    n = parts or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartitionByRange(n, *by).sortWithinPartitions(*by)
    ordered.select(key, "line").write.mode("append").partitionBy(key).text(path)


def write_qa_documents(df: DataFrame, path: str, question: str, answer: str, step: str = "step",
                       order: Sequence[str] = ("group_id", "gen_idx"), data_version: str = "1.1", parts: int | None = None) -> None:
    """One JSON document for each step, ``{"metadata": {step, timestamp, data_version}, "qa_pairs":
    [{question_id, question_text, model_answer}, ...]}``; question_id is the position in the step,
    from 0.  The document is the step's files in the order of their names: a head, a line for
    each pair, a foot.  Pairs that lack a question or an answer make the counts differ: the
    metadata then say how many (``unpaired``)."""
    pairs = df.select(F.col(step).cast("long").alias("step"), *order, F.col(question).cast("string").alias("question_text"),
                      F.col(answer).cast("string").alias("model_answer"))
    # written once (numbered_within): the heads and the lines come from the same rows
    pairs = numbered_within(pairs, ["step"], order, "n", total="of", parts=parts)
    one = F.to_json(F.struct((F.col("n") - 1).alias("question_id"), "question_text", "model_answer"), {"ignoreNullFields": "false"})
    body = pairs.select("step", F.lit(1).alias("kind"), "n", F.concat(one, F.when(F.col("n") < F.col("of"), ",").otherwise("")).alias("line"))
    steps = pairs.groupBy("step").agg(F.count_if(F.col("question_text").isNull() | F.col("model_answer").isNull()).alias("bad"))
    meta = F.to_json(F.struct("step", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                              F.lit(data_version).alias("data_version"), F.nullif("bad", F.lit(0)).alias("unpaired")))
    head = steps.select("step", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"),
                        F.concat(F.lit('{"metadata": '), meta, F.lit(', "qa_pairs": [')).alias("line"))
    foot = steps.select("step", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("n"), F.lit("]}").alias("line"))
    write_lines(head.union(body).union(foot), path, ["step", "kind", "n"], parts=parts)


def read_qa_documents(spark: SparkSession, path: str) -> DataFrame:
    """(step, question_id, question_text, model_answer, data_version, unpaired) of the documents of S6,
    line by line, by any number of tasks; ``unpaired`` as the metadata of the step have it."""
    lines = spark.read.text(path)
    meta = F.from_json(F.regexp_extract("value", r'^\{"metadata": (.*), "qa_pairs": \[$', 1), "data_version string, unpaired long")
    heads = lines.where(F.col("value").startswith('{"metadata": ')).select(F.col("step").cast("long").alias("step"), meta.alias("m"))
    pair = F.from_json(F.regexp_replace("value", r",\z", ""), "question_id long, question_text string, model_answer string")
    pairs = lines.where(F.col("value").startswith('{"question_id":')).select(F.col("step").cast("long").alias("step"), pair.alias("p"))
    return pairs.join(heads, "step").select("step", "p.*", "m.data_version", F.coalesce("m.unpaired", F.lit(0)).cast("long").alias("unpaired"))


# ------------------------------------------------------------------- S7, S8
def write_clean_report(df: DataFrame, path: str, completion: str = "completion", cleaned: str = "cleaned",
                       files_per_step: int = 4, order: Sequence[str] = ("group_id", "gen_idx")) -> None:
    """Raw vs cleaned text side by side, one directory per step; ``sample`` counts the step's rows
    from 1 in the given order."""
    rows = numbered_within(df.select("step", *order, completion, cleaned), ["step"], order, "sample")
    clustered(rows, files_per_step).write.mode("append").partitionBy("step").parquet(path)


def write_text_report(df: DataFrame, path: str, completion: str = "completion", cleaned: str = "cleaned",
                      order: Sequence[str] = ("group_id", "gen_idx"), parts: int | None = None) -> None:
    """S7 as text, by step: ``Sample i:``, the completion, the cleaned response, a rule of 50 signs."""
    rows = numbered_within(df.select("step", *order, completion, cleaned), ["step"], order, "sample", parts=parts)
    line = F.concat(F.lit("Sample "), F.col("sample").cast("string"), F.lit(":\nCompletion: "), F.coalesce(completion, F.lit("None")),
                    F.lit("\nCleaned Response: "), F.coalesce(cleaned, F.lit("None")), F.lit("\n" + "=" * 50))
    write_lines(rows.select("step", "sample", line.alias("line")), path, ["step", "sample"], parts=parts)


def write_token_logs(tokens: DataFrame, path: str, files_per_step: int = 4) -> None:
    """Per-token policy / reference log-probs and KL, by step."""
    from ..operators.tokens import token_kl
    clustered(tokens.withColumn("kl", token_kl("logp", "ref_logp")), files_per_step).write.mode("append").partitionBy("step").parquet(path)


# ---------------------------------------------------- rollouts stored by group
def store_by_group(df: DataFrame, path: str, buckets: int, keys: Sequence[str] = ("step", "group_id")) -> DataFrame:
    """``df`` stored in ``buckets`` buckets by rollout group, each sorted: attaching responses (P14, by
    ``attach_in_groups``), group statistics (G2, G3) and the best of a group (L4) over the stored
    table move no rows.  The files stay under ``path``; the catalog keeps no entry."""
    spark, name = df.sparkSession, f"rollouts_{uuid.uuid4().hex}"
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name))
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out

"""Sources and sinks (S1-S8), each written to files in the shared folder and read back."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import box_rewards as BR
from ..operators import rewards as R
from ..sources import io as IO
from . import sqlgen as S
from .catalog import r6, register
from .fixtures import f2_box_pairs, f2_box_pairs_sql, f2_box_rollouts, f3_tokens, f3_tokens_sql, f5_items, f5_items_sql
from .q_boxes import _X11A
from .q_class import _parsed_cte, parsed_f1, scored_f1
from .q_text import s_process, s_rr

F5_SQL = f"WITH items AS ({f5_items_sql()}) "


_CLS = [(side, c) for side in ("pred", "gt") for c in K.EMOTION_CLASSES]


@register("s5_reward_log", "WITH " + _parsed_cte().strip() + " SELECT step, image_path AS img_path, completion AS content, solution, "
          + f"{S.r6('r_accuracy')} AS reward, " + ", ".join(f"{S.r6(R.class_col(s, c))} AS {R.class_col(s, c)}" for s, c in _CLS) + " FROM scored")
def q_s5(spark, sf_dir):
    """S5 through storage: the class tasks' records are written as JSON lines
    by step, read back, and their maps flattened to columns."""
    path = _scratch(spark, "reward-log")
    IO.write_reward_log(IO.reward_log_records(scored_f1(spark, sf_dir), K.EMOTION_CLASSES), path)
    back = IO.read_reward_log(spark, path)
    return back.select(F.col("step").cast("long"), "img_path", "content", "solution", r6("reward").alias("reward"),
                       *[r6(F.col(f"{s}_probs")[c]).alias(R.class_col(s, c)) for s, c in _CLS])


def _boxes_sql(x: str) -> str:
    """A box list as text with one decimal."""
    one = " || ',' || ".join(f"CAST(CAST(round(b.{k} * 10) AS BIGINT) AS VARCHAR)" for k in ("x1", "y1", "x2", "y2"))
    return f"array_to_string(list_transform({x}, lambda b: {one}), ';')"


@register("s5_box_reward_log", _X11A.rsplit("SELECT image_id, ", 1)[0]
          + f"SELECT image_id // 64 AS step, concat('img/', CAST(image_id AS VARCHAR)) AS img_path, {_boxes_sql('g')} AS gt_bbox, "
          + f"{_boxes_sql('pr')} AS pred_bbox, " + _X11A.rsplit("SELECT image_id, ", 1)[1])
def q_s5_box(spark, sf_dir):
    """The box tasks' records through storage, their boxes flattened to text."""
    path = _scratch(spark, "box-reward-log")
    d = BR.r1_multibox_reward(f2_box_rollouts(spark, sf_dir)).withColumns(
        {"step": F.expr("image_id div 64"), "image_path": F.concat(F.lit("img/"), F.col("image_id").cast("string"))})
    IO.write_reward_log(IO.box_reward_log_records(d, F.lit("item")), path)
    back = IO.read_reward_log(spark, path, IO.BOX_REWARD_LOG_SCHEMA)

    def flat(c):
        return F.array_join(F.transform(c, lambda b: F.array_join(F.transform(
            b, lambda v: F.round(v * 10).cast("long").cast("string")), ",")), ";")

    return back.select(F.col("step").cast("long"), "img_path", flat("gt_bbox").alias("gt_bbox"), flat("pred_bbox").alias("pred_bbox"),
                       r6("reward").alias("reward"), r6("iou").alias("iou"), "error")


@register("s6_qa_records", "WITH " + _parsed_cte().strip() + " SELECT step, '1.1' AS data_version, concat(CAST(group_id AS VARCHAR), '-', "
          "CAST(gen_idx AS VARCHAR)) AS question_id, solution AS question_text, completion AS model_answer, "
          "solution IS NULL OR completion IS NULL AS unpaired FROM scored")
def q_s6(spark, sf_dir):
    """S6 through storage: the QA records written by step and read back (all but the write time)."""
    path = _scratch(spark, "qa")
    records = IO.qa_records(scored_f1(spark, sf_dir), "solution", "completion")
    IO.write_qa(records, path)
    back = spark.read.schema(records.schema).json(path)
    return back.select(F.col("step").cast("long"), F.col("metadata.data_version").alias("data_version"), "question_id",
                       "question_text", "model_answer", "unpaired")


@register("s6_qa_documents", "WITH " + _parsed_cte().strip() + ", r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY group_id, gen_idx) - 1 AS k, "
          "CASE WHEN row_id % 37 = 0 THEN NULL ELSE think END AS a FROM parsed) SELECT step, k AS question_id, solution AS question_text, "
          "a AS model_answer, '1.1' AS data_version, CAST(count(*) FILTER (a IS NULL) OVER (PARTITION BY step) AS BIGINT) AS unpaired FROM r")
def q_s6_documents(spark, sf_dir):
    """S6 as the steps' JSON documents with positional ids, written by several tasks and read back; some answers are missing."""
    path = _scratch(spark, "qa-documents")
    d = parsed_f1(spark, sf_dir).withColumn("a", F.expr("CASE WHEN row_id % 37 <> 0 THEN think END"))
    IO.write_qa_documents(d, path, "solution", "a")
    return IO.read_qa_documents(spark, path)


def _scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    import uuid
    from ..session import checkpoint_path
    return checkpoint_path(spark, "rollscope-io", f"{name}-{uuid.uuid4().hex}")


@register("s4_save_load_split", F5_SQL + "SELECT row_id, target, split FROM items WHERE split = 'train'")
def q_s4(spark, sf_dir):
    """S4 then S3 through storage: the derived table is written partitioned
    by split, and the split is read back with partition pruning."""
    path = _scratch(spark, "dataset")
    IO.save_dataset(f5_items(spark, sf_dir), path)
    return IO.load_split(spark, path, "train").select("row_id", "target", "split")


@register("s1_class_scan", F5_SQL + "SELECT row_id // 200 AS shelf, target, count(*) AS n_items FROM items GROUP BY 1, 2")
def q_s1(spark, sf_dir):
    """S1 over class folders derived from the catalog: folders of shelves (200
    items each) with a folder for each class and one of no class, and one file in
    it with a line for each item, scanned by listing only.  Compared: every file by its shelf,
    class and number of lines, so a lost or doubled file shows; folders outside the
    list are ignored."""
    path = _scratch(spark, "classes")
    items = f5_items(spark, sf_dir).select(F.col("target").alias("class"), F.expr("row_id div 200").alias("shelf"), "image_path")
    other = items.withColumn("class", F.lit("not a class"))
    IO.write_class_lines(items.unionByName(other), path, ["shelf", "class"], "image_path")
    listed = IO.scan_class_folders(spark, path, [f"class={c}" for c in K.GENERATOR_CLASSES])
    tail = lambda c: F.regexp_extract(c, "/(shelf=.*)$", 1).alias("file")
    held = IO.read_text_lines(spark, path).groupBy(tail("path")).agg(F.count(F.lit(1)).alias("n_items"))
    return (listed.select("target", tail("image_path")).join(held, "file")
            .select(F.regexp_extract("file", "^shelf=([0-9]+)/", 1).cast("long").alias("shelf"),
                    F.regexp_replace("target", "^class=", "").alias("target"), "n_items"))


@register("s7_clean_report", "WITH " + _parsed_cte().strip() + " SELECT step, group_id, gen_idx, completion, "
          + s_rr(s_process("think", "a"), K.FLOAT_FULL) + " AS cleaned, row_number() OVER (PARTITION BY step ORDER BY group_id, gen_idx) AS sample FROM parsed")
def q_s7(spark, sf_dir):
    """S7 through storage: raw completion and its cleaned reasoning written
    side by side per step, numbered within the step, then read back."""
    path = _scratch(spark, "report")
    IO.write_clean_report(parsed_f1(spark, sf_dir).withColumn("cleaned", T.remove_floats_full(T.process_text("think", "a"))), path)
    return spark.read.parquet(path).select(F.col("step").cast("long"), "group_id", "gen_idx", "completion", "cleaned", "sample")


@register("s8_token_log", "WITH tok AS (" + f3_tokens_sql() + ") SELECT seq_id, pos, step, round(logp, 6) + 0.0 AS logp, round(ref_logp, 6) + 0.0 AS ref_logp, round(exp(ref_logp - logp) - (ref_logp - logp) - 1, 6) + 0.0 "
          "AS kl FROM tok")
def q_s8(spark, sf_dir):
    """S8 through storage: token log-probs and KL written per step, read back."""
    path = _scratch(spark, "tokens")
    IO.write_token_logs(f3_tokens(spark, sf_dir), path)
    return spark.read.parquet(path).select("seq_id", "pos", F.col("step").cast("long"), r6("logp").alias("logp"),
                                           r6("ref_logp").alias("ref_logp"), r6("kl").alias("kl"))


_S2_LINE_SPARK = ("CASE WHEN (image_id + box_no) % 7 = 0 THEN concat('bad line ', CAST(box_no AS STRING)) "
                  "WHEN (image_id + box_no) % 11 = 0 THEN concat_ws(' ', CAST(gx1 AS STRING), CAST(gy1 AS STRING), "
                  "CAST(gx2 AS STRING)) ELSE concat_ws('  ', CAST(gx1 AS STRING), CAST(gy1 AS STRING), "
                  "CAST(gx2 AS STRING), concat(CAST(gy2 AS STRING), '.5')) END")


@register("s2_label_files", "WITH pairs AS (" + f2_box_pairs_sql() + "), ok AS (SELECT * FROM pairs "
          "WHERE (image_id + box_no) % 7 <> 0 AND (image_id + box_no) % 11 <> 0) "
          "SELECT pairs.image_id // 16 AS image, CAST(count(ok.gx1) AS BIGINT) AS n_boxes, coalesce(string_agg(CAST(ok.gx1 AS VARCHAR) || ',' || "
          "CAST(ok.gy1 AS VARCHAR) || ',' || CAST(ok.gx2 AS VARCHAR) || ',' || CAST(ok.gy2 AS VARCHAR), ';' ORDER BY image_id, box_no), '') AS boxes "
          "FROM pairs LEFT JOIN ok USING (image_id, box_no) GROUP BY 1")
def q_s2(spark, sf_dir):
    """S2 over label files written from the F2 boxes, one file for each image
    (here the boxes of 16 neighbouring orders): one text line per box (extra spaces, a decimal), junk lines and 3-number
    lines mixed in; images without a good line have no boxes."""
    path = _scratch(spark, "labels")
    lines = f2_box_pairs(spark, sf_dir).selectExpr("image_id div 16 AS image", "image_id", "box_no", f"{_S2_LINE_SPARK} AS value")
    # 256 neighbouring images lie in one folder
    IO.write_label_files(lines.withColumn("shelf", F.expr("image div 256")), path, ["image_id", "box_no"])
    boxes = F.expr("array_join(transform(boxes, b -> concat_ws(',', cast(b.x1 AS bigint), cast(b.y1 AS bigint), "
                   "cast(b.x2 AS bigint), cast(floor(b.y2) AS bigint))), ';')")
    return IO.read_box_label_files(spark, path).select(
        F.regexp_extract("label_path", r"/image=([0-9]+)[./]", 1).cast("long").alias("image"),
        F.coalesce(F.size("boxes"), F.lit(0)).cast("long").alias("n_boxes"), F.coalesce(boxes, F.lit("")).alias("boxes"))

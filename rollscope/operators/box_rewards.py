"""Box rewards (X10, X11a-d) composed from the box column functions.

Each reward parses both texts, scores the pair matrix, solves the optimal
assignment per row (``match_sum``) and applies the task's leak penalty.
The parsed box arrays are materialised in their own projection first, so
the (regex) parsers run once per row even though the scores use them
several times.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import constants as K
from ..functions import text as T
from ..functions.matching import match_sum
from ..functions.text import _c


def with_match(df: DataFrame, gt: str, pred: str, out: str, score=None) -> DataFrame:
    """Append ``out`` = optimal assignment sum of the gt x pred score matrix.
    The matrix is materialised in its own projection first so the
    assignment UDF receives a plain column."""
    d = df.withColumn("_m", B.pair_matrix(gt, pred, score))
    return d.withColumn(out, match_sum("_m")).drop("_m")


def with_multi_box_iou(df: DataFrame, gt: str, pred: str, out: str = "iou") -> DataFrame:
    """Matched IoU sum / number of predictions; 0 if either side is empty."""
    g, p = F.col(gt), F.col(pred)
    empty = g.isNull() | p.isNull() | (F.size(g) == 0) | (F.size(p) == 0)
    d = with_match(df, gt, pred, "_ms")
    return d.withColumn(out, F.when(empty, F.lit(0.0)).otherwise(F.col("_ms") / F.size(p))).drop("_ms")


def _clamp01(c) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def _leak_mult(think) -> Column:
    t = _c(think)
    return F.when(t.isNotNull() & B.coord_leak(t), F.lit(K.LEAK_FACTOR)).otherwise(F.lit(1.0))


def r1_multibox_reward(df: DataFrame, completion: str = "completion", solution: str = "solution") -> DataFrame:
    """Gt boxes are ``[x, y, w, h]`` (converted), prediction parsed by X1;
    reward = clamp(X10, 0, 1); ``error`` says why a reward is 0."""
    d = df.select("*", B.extract_boxes(solution).alias("_g0"), B.extract_boxes(completion).alias("_pb"))
    d = d.withColumn("_gb", F.when(F.col("_g0").isNotNull(), B.xywh_to_xyxy("_g0")))
    bad = F.col("_g0").isNull() | (F.size("_gb") == 0) | F.col("_pb").isNull()
    d = with_multi_box_iou(d, "_gb", "_pb", "_iou")
    d = d.withColumn("iou", F.when(~bad, F.col("_iou"))).drop("_iou")
    d = d.withColumn("reward", F.when(bad, F.lit(0.0)).otherwise(_clamp01(F.col("iou"))))
    d = d.withColumn("error", F.when(F.col("_g0").isNull(), F.lit("no_gt"))
                     .when(F.size("_gb") == 0, F.lit("No ground truth bbox found"))
                     .when(F.col("_pb").isNull(), F.lit("No predicted bbox found")))
    return d.withColumnRenamed("_gb", "gt_boxes").withColumnRenamed("_pb", "pred_boxes").drop("_g0")


def cot_multibox_reward(df: DataFrame, completion: str = "completion", solution: str = "solution") -> DataFrame:
    """X1 on both sides, clamp(X10), x0.1 when the think is only a
    coordinate list, capped at 1.  A missing think gets no penalty and
    ``error = 'missing_think'``."""
    d = df.select("*", B.extract_boxes(solution).alias("gt_boxes"), B.extract_boxes(completion).alias("pred_boxes"),
                  T.extract_think(completion, "b").alias("think"))
    d = with_multi_box_iou(d, "gt_boxes", "pred_boxes", "iou")
    d = d.withColumn("reward", F.least(_clamp01(F.col("iou")) * _leak_mult("think"), F.lit(1.0)))
    return d.withColumn("error", F.when(F.col("think").isNull(), F.lit("missing_think")))


def r1_referred_reward(df: DataFrame, completion: str = "completion", solution: str = "solution") -> DataFrame:
    """Every strict box anywhere in either text, X7 IoU (variant b)
    matrix, optimal assignment, divided by max(n_gt, n_pred)."""
    d = df.select("*", B.extract_all_strict_boxes(solution).alias("gt_boxes"),
                  B.extract_all_strict_boxes(completion).alias("pred_boxes"))
    ng, npred = F.size("gt_boxes"), F.size("pred_boxes")
    d = with_match(d, "gt_boxes", "pred_boxes", "_ms", score=lambda g, p: B.iou(g, p, "b"))
    return d.withColumn("reward", F.when((ng == 0) | (npred == 0), F.lit(0.0))
                        .otherwise(F.col("_ms") / F.greatest(ng, npred))).drop("_ms")


def cot_referred_reward(df: DataFrame, completion: str = "completion", solution: str = "solution") -> DataFrame:
    """X11d: first strict box of the stripped solution and of the answer (or
    whole content), X7 IoU, x0.1 on a coordinate-only think, capped at 1."""
    d = df.select("*", B.extract_first_strict_box(T.py_strip(solution)).alias("gt_box"),
                  B.extract_first_strict_box(T.extract_answer(completion, "c")).alias("pred_box"),
                  T.extract_think(completion, "b").alias("think"))
    geo = B.geometry("gt_box", "pred_box")
    d = d.withColumn("iou", geo["iou"]).withColumn("geometry", geo)
    d = d.withColumn("reward", F.least(F.col("iou") * _leak_mult("think"), F.lit(1.0)))
    return d.withColumn("error", F.when(F.col("think").isNull(), F.lit("missing_think")))

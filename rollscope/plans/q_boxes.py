"""Box rollouts (fixture F2 from ``lineitem``): X1-X13."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import constants as K
from ..functions import text as T
from ..functions.matching import match_sum
from ..operators import box_rewards as BR
from . import sqlgen as S
from .catalog import r6, register
from .fixtures import f2_box_pairs, f2_box_pairs_sql, f2_box_rollouts, f2_box_rollouts_sql

XY = ("x1", "y1", "x2", "y2")


# ------------------------------------------------------------ oracle helpers
def s_box(a: list[str]) -> str:
    return "struct_pack(" + ", ".join(f"{k} := TRY_CAST({v} AS DOUBLE)" for k, v in zip(XY, a)) + ")"


def s_extract_boxes(x: str) -> str:
    # validity by DuckDB's own JSON parser (which also takes a trailing comma: not JSON), numbers by its types
    clean = "replace(replace(m, chr(10), ''), ' ', '')"
    valid = f"(json_valid({clean}) AND NOT regexp_matches({clean}, ',[\\t\\r]*\\]$'))"
    four = [f"json_extract({clean}, '$[{i}]')" for i in range(4)]
    number = " AND ".join(f"json_type({x}) IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE')" for x in four)
    nums = f"regexp_extract_all(m, {S.q(K.BRACKET_NUMBER)}, 0)"
    parse = (f"CASE WHEN {valid} AND json_array_length({clean}) = 4 AND {number} THEN {s_box([f'CAST({x} AS VARCHAR)' for x in four])} "
             f"WHEN {valid} THEN NULL "
             f"WHEN len({nums}) = 4 THEN {s_box([f'{nums}[{i}]' for i in range(1, 5)])} END")
    lst = (f"list_filter(list_transform(regexp_extract_all({S.answer_b(x)}, {S.q(K.BRACKET)}, 0), "
           f"lambda m: {parse}), lambda b: b IS NOT NULL)")
    return f"(CASE WHEN len({lst}) > 0 THEN {lst} END)"


def s_all_strict(x: str) -> str:
    p = S.q(K.STRICT_BOX_GROUPS)
    return (f"list_transform(regexp_extract_all({x}, {p}), lambda m: "
            + s_box([f"regexp_extract(m, {p}, {i})" for i in range(1, 5)]) + ")")


def s_first_strict(x: str) -> str:
    p = S.q(K.STRICT_BOX_GROUPS)
    g = [f"regexp_extract({x}, {p}, {i})" for i in range(1, 5)]
    bad = " OR ".join(f"regexp_full_match({v}, '-?0+[1-9][0-9]*')" for v in g)
    return f"(CASE WHEN regexp_matches({x}, {p}) AND NOT ({bad}) THEN {s_box(g)} END)"


def s_iou(a: str, b: str, variant: str = "a") -> str:
    xa, ya = f"greatest({a}.x1, {b}.x1)", f"greatest({a}.y1, {b}.y1)"
    xb, yb = f"least({a}.x2, {b}.x2)", f"least({a}.y2, {b}.y2)"
    area_a = f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))"
    area_b = f"(({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1))"
    if variant == "a":
        inter = f"(({xb} - {xa}) * ({yb} - {ya}))"
        union = f"({area_a} + {area_b} - {inter})"
        return (f"(CASE WHEN {xb} <= {xa} OR {yb} <= {ya} THEN 0.0 WHEN {union} > 0 THEN {inter} / {union} "
                f"ELSE 0.0 END)")
    inter = f"(greatest(0.0, {xb} - {xa}) * greatest(0.0, {yb} - {ya}))"
    union = f"({area_a} + {area_b} - {inter})"
    return f"(CASE WHEN {union} = 0 THEN 0.0 ELSE {inter} / {union} END)"


def s_matrix(gt: str, pred: str, variant: str = "a") -> str:
    return (f"list_transform({gt}, lambda gb_: list_transform({pred}, lambda pb_: "
            f"{s_iou('gb_', 'pb_', variant)}))")


def s_dp(m: str) -> str:
    """Subset DP in DuckDB list lambdas (same optimum as Hungarian)."""
    n = f"len({m})"
    k = f"(CASE WHEN len({m}) > 0 THEN len({m}[1]) ELSE 0 END)"
    w = (f"(CASE WHEN {n} >= {k} THEN {m} ELSE list_transform(range({k}), lambda j: "
         f"list_transform(range({n}), lambda i: {m}[i + 1][j + 1])) END)")
    big, small = f"greatest({n}, {k})", f"least({n}, {k})"
    full = f"((1 << {small}) - 1)"
    init = f"list_transform(range({full} + 1), lambda x: CASE WHEN x = 0 THEN 0.0 ELSE -1e300 END)::DOUBLE[]"
    body = (f"list_reduce(range({big}), lambda state, i: list_transform(range({full} + 1), lambda mask: "
            f"greatest(state[mask + 1], list_reduce(range({small}), lambda acc, j: CASE WHEN (mask & (1 << j)) != 0 "
            f"THEN greatest(acc, state[mask - (1 << j) + 1] + {w}[i + 1][j + 1]) ELSE acc END, -1e300::DOUBLE))), "
            f"{init})")
    return f"(CASE WHEN {small} = 0 THEN 0.0 ELSE {body}[{full} + 1] END)"


def s_center(b: str) -> list[str]:
    return [f"({b}.x1 + ({b}.x2 - {b}.x1) / 2)", f"({b}.y1 + ({b}.y2 - {b}.y1) / 2)",
            f"({b}.x2 - {b}.x1)", f"({b}.y2 - {b}.y1)"]


IMG = f"WITH img AS ({f2_box_rollouts_sql()}) "
PAIRS = f"WITH pairs AS ({f2_box_pairs_sql()}) "


def _long(spark_df, col, side):
    return (spark_df.select("image_id", F.posexplode(col).alias("pos", "b"))
            .select("image_id", F.lit(side).alias("side"), (F.col("pos") + 1).cast("long").alias("idx"),
                    *[r6(F.col("b")[k]).alias(k) for k in XY]))


def _long_sql(src: str, expr: str, side: str) -> str:
    return (f"SELECT image_id, '{side}' AS side, CAST(idx AS BIGINT) AS idx, "
            + ", ".join(f"{S.r6(f'bx.{k}')} AS {k}" for k in XY)
            + f" FROM (SELECT image_id, unnest({expr}) AS bx, generate_subscripts({expr}, 1) AS idx FROM {src})")


# ------------------------------------------------------------------- queries
#: Numbers beyond JSON that the parser takes as numbers.
_X1_MORE = ("CASE WHEN image_id % 41 = 0 THEN replace(completion, '</answer>', ', [NaN, 1, 2, Infinity], [-Infinity,0,0,1]</answer>') "
            "ELSE completion END")
_IMG_MORE = f"WITH img AS (SELECT * REPLACE ({_X1_MORE} AS completion) FROM ({f2_box_rollouts_sql()})) "


@register("x1_parse", _IMG_MORE + _long_sql("img", s_extract_boxes("completion"), "pred") + " UNION ALL "
          + _long_sql("img", s_extract_boxes("solution"), "gt"))
def q_x1(spark, sf_dir):
    d = f2_box_rollouts(spark, sf_dir).withColumn("completion", F.expr(_X1_MORE)).select("image_id", B.extract_boxes("completion").alias("p"),
                                              B.extract_boxes("solution").alias("g"))
    return _long(d, "p", "pred").unionByName(_long(d, "g", "gt"))


@register("x2_parse_one", IMG + "SELECT image_id, " + ", ".join(
    f"{S.r6(f'b.{k}')} AS {k}" for k in XY) + f" FROM (SELECT image_id, {s_first_strict(S.answer_c('completion'))} "
          "AS b FROM img)")
def q_x2(spark, sf_dir):
    d = f2_box_rollouts(spark, sf_dir).select(
        "image_id", B.extract_first_strict_box(T.extract_answer("completion", "c")).alias("b"))
    return d.select("image_id", *[r6(F.col("b")[k]).alias(k) for k in XY])


@register("x3_parse_all", IMG + _long_sql("img", s_all_strict("completion"), "pred"))
def q_x3(spark, sf_dir):
    d = f2_box_rollouts(spark, sf_dir).select("image_id", B.extract_all_strict_boxes("completion").alias("p"))
    return _long(d, "p", "pred")


@register("x4_convert", IMG + _long_sql(
    "img", "list_transform(gt, lambda b: struct_pack(x1 := b.x1, y1 := b.y1, x2 := b.x1 + b.x2, y2 := b.y1 + b.y2))",
    "gt"))
def q_x4(spark, sf_dir):
    d = f2_box_rollouts(spark, sf_dir).select("image_id", B.xywh_to_xyxy("gt").alias("g"))
    return _long(d, "g", "gt")


_GB = "struct_pack(x1 := CAST(gx1 AS DOUBLE), y1 := CAST(gy1 AS DOUBLE), x2 := CAST(gx2 AS DOUBLE), y2 := CAST(gy2 AS DOUBLE))"
_PB = "struct_pack(x1 := CAST(px1 AS DOUBLE), y1 := CAST(py1 AS DOUBLE), x2 := CAST(px2 AS DOUBLE), y2 := CAST(py2 AS DOUBLE))"


def _pair_boxes(spark, sf_dir):
    p = f2_box_pairs(spark, sf_dir)
    return p.select("image_id", "box_no",
                    B.box(*[F.col(f"g{k}") for k in XY]).alias("g"), B.box(*[F.col(f"p{k}") for k in XY]).alias("p"))


@register("x5_center", PAIRS + "SELECT image_id, box_no, " + ", ".join(
    f"{S.r6(e)} AS {n}" for e, n in zip(s_center("g"), ("cx", "cy", "w", "h")))
          + f" FROM (SELECT image_id, box_no, {_GB} AS g FROM pairs)")
def q_x5(spark, sf_dir):
    c = B.center("g")
    return _pair_boxes(spark, sf_dir).select("image_id", "box_no", *[r6(c[k]).alias(k) for k in ("cx", "cy", "w", "h")])


@register("x6_iou", PAIRS + f"SELECT image_id, box_no, {S.r6(s_iou('g', 'p', 'a'))} AS iou_a, "
          f"{S.r6(s_iou('g', 'p', 'b'))} AS iou_b, {S.r6(s_iou('p', 'g', 'b'))} AS iou_b_inv "
          f"FROM (SELECT image_id, box_no, {_GB} AS g, "
          "struct_pack(x1 := CAST(px1 AS DOUBLE), y1 := CAST(py2 AS DOUBLE), x2 := CAST(px2 AS DOUBLE), "
          "y2 := CAST(py1 AS DOUBLE)) AS p FROM pairs)")
def q_x6(spark, sf_dir):
    """IoU of the gt box and its prediction; the prediction's y is inverted
    (y1 > y2) so both variants' handling of inverted boxes is exercised."""
    p = f2_box_pairs(spark, sf_dir)
    g = B.box(*[F.col(f"g{k}") for k in XY])
    inv = B.box(F.col("px1"), F.col("py2"), F.col("px2"), F.col("py1"))
    return p.select("image_id", "box_no", r6(B.iou(g, inv, "a")).alias("iou_a"), r6(B.iou(g, inv, "b")).alias("iou_b"),
                    r6(B.iou(inv, g, "b")).alias("iou_b_inv"))


def _s_geometry(g: str, p: str, weights=(0.5, 0.5, 0.0)) -> list[str]:
    cg, cp = s_center(g), s_center(p)
    dist = f"sqrt(({cg[0]} - {cp[0]}) * ({cg[0]} - {cp[0]}) + ({cg[1]} - {cp[1]}) * ({cg[1]} - {cp[1]}))"
    cs = f"(1.0 - {dist} / {float((1000 ** 2 + 1000 ** 2) ** 0.5)!r})"
    a1, a2 = f"({cg[2]} / ({cg[3]} + 1e-6))", f"({cp[2]} / ({cp[3]} + 1e-6))"
    ar = (f"(CASE WHEN {a1} <= 0 OR {a2} <= 0 OR isnan({a1}) OR isnan({a2}) THEN 0.0 ELSE "
          f"least(1.0, greatest(0.0, 1.0 - abs(ln({a1} / {a2})) / 2.302585092994046)) END)")
    i = s_iou(g, p, "b")
    comp = f"least(1.0, greatest(0.0, {weights[0]} * {i} + {weights[1]} * {cs} + {weights[2]} * {ar}))"
    return [i, cs, ar, comp]


@register("x7_geometry", PAIRS + "SELECT image_id, box_no, " + ", ".join(
    f"{S.r6(e)} AS {n}" for e, n in zip(_s_geometry("g", "p"), ("iou", "center_score", "aspect_score", "composite")))
          + f" FROM (SELECT image_id, box_no, {_GB} AS g, {_PB} AS p FROM pairs)")
def q_x7(spark, sf_dir):
    geo = B.geometry("g", "p")
    return _pair_boxes(spark, sf_dir).select(
        "image_id", "box_no", *[r6(geo[k]).alias(k) for k in ("iou", "center_score", "aspect_score", "composite")])


@register("x7_geometry_cot", PAIRS + f"SELECT image_id, box_no, {S.r6(_s_geometry('g', 'p', (0.4, 0.3, 0.3))[3])} AS composite "
          f"FROM (SELECT image_id, box_no, {_GB} AS g, {_PB} AS p FROM pairs)")
def q_x7_cot(spark, sf_dir):
    """X7 with the weights of the reasoning tasks."""
    geo = B.geometry("g", "p", alpha=0.4, beta=0.3, gamma=0.3)
    return _pair_boxes(spark, sf_dir).select("image_id", "box_no", r6(geo["composite"]).alias("composite"))


@register("x8_pairs", IMG + "SELECT image_id, CAST(len(gt) AS BIGINT) AS n_gt, CAST(len(pred) AS BIGINT) AS n_pred, "
          f"{S.r6('coalesce(list_sum(list_transform(m, lambda r: list_sum(r))), 0.0)')} AS matrix_sum, "
          f"{S.r6('coalesce(list_max(list_transform(m, lambda r: list_max(r))), 0.0)')} AS matrix_max "
          f"FROM (SELECT image_id, gt, pred, {s_matrix('gt', 'pred')} AS m FROM img)")
def q_x8(spark, sf_dir):
    d = f2_box_rollouts(spark, sf_dir).select("image_id", "gt", "pred", B.pair_matrix("gt", "pred").alias("m"))
    flat = F.flatten("m")
    return d.select("image_id", F.size("gt").cast("long").alias("n_gt"), F.size("pred").cast("long").alias("n_pred"),
                    r6(F.aggregate(flat, F.lit(0.0), lambda a, x: a + x)).alias("matrix_sum"),
                    r6(F.coalesce(F.array_max(flat), F.lit(0.0))).alias("matrix_max"))


@register("x9_match", IMG + "SELECT image_id, CAST(len(gt) AS BIGINT) AS n_gt, CAST(len(pred) AS BIGINT) AS n_pred, "
          f"{S.r6(s_dp('m'))} AS match_sum FROM (SELECT image_id, gt, pred, {s_matrix('gt', 'pred')} AS m FROM img)")
def q_x9(spark, sf_dir):
    d = f2_box_rollouts(spark, sf_dir).select("image_id", "gt", "pred", B.pair_matrix("gt", "pred").alias("m"))
    return d.select("image_id", F.size("gt").cast("long").alias("n_gt"), F.size("pred").cast("long").alias("n_pred"),
                    r6(match_sum("m")).alias("match_sum"))


def _s_multi(gt: str, pred: str, m: str = "m") -> str:
    """X10 given the precomputed matrix column ``m``."""
    return (f"(CASE WHEN {pred} IS NULL OR len({pred}) = 0 OR {gt} IS NULL OR len({gt}) = 0 THEN 0.0 "
            f"ELSE {s_dp(m)} / len({pred}) END)")


@register("x10_multi", IMG + f"SELECT image_id, {S.r6(_s_multi('gt', 'pred'))} AS multi_iou FROM "
          f"(SELECT *, {s_matrix('gt', 'pred')} AS m FROM img)")
def q_x10(spark, sf_dir):
    d = BR.with_multi_box_iou(f2_box_rollouts(spark, sf_dir), "gt", "pred", "multi_iou")
    return d.select("image_id", r6("multi_iou").alias("multi_iou"))


_X11A = (IMG + ", p AS (SELECT image_id, {g} AS g0, {pr} AS pr FROM img), "
         "q0 AS (SELECT image_id, g0, pr, CASE WHEN g0 IS NULL THEN NULL ELSE list_transform(g0, lambda b: "
         "struct_pack(x1 := b.x1, y1 := b.y1, x2 := b.x1 + b.x2, y2 := b.y1 + b.y2)) END AS g FROM p), "
         "q AS (SELECT *, {mx} AS m FROM q0) "
         "SELECT image_id, {r} AS reward, {it} AS iou, CASE WHEN g0 IS NULL THEN 'no_gt' "
         "WHEN len(g) = 0 THEN 'No ground truth bbox found' WHEN pr IS NULL THEN 'No predicted bbox found' END AS error "
         "FROM q").format(g=s_extract_boxes("solution"), pr=s_extract_boxes("completion"), mx=s_matrix("g", "pr"),
                          r=S.r6("CASE WHEN g0 IS NULL OR len(g) = 0 OR pr IS NULL THEN 0.0 ELSE "
                                 f"least(greatest({_s_multi('g', 'pr')}, 0.0), 1.0) END"),
                          it=S.r6(f"CASE WHEN g0 IS NULL OR len(g) = 0 OR pr IS NULL THEN NULL ELSE {_s_multi('g', 'pr')} END"))


@register("x11a_r1_multibox", _X11A)
def q_x11a(spark, sf_dir):
    d = BR.r1_multibox_reward(f2_box_rollouts(spark, sf_dir))
    return d.select("image_id", r6("reward").alias("reward"), r6("iou").alias("iou"), "error")


_X11B = (IMG + ", p0 AS (SELECT image_id, {g} AS g, {pr} AS pr, {th} AS think FROM img), "
         "p AS (SELECT *, {mx} AS m FROM p0) "
         "SELECT image_id, {r} AS reward, CASE WHEN think IS NULL THEN 'missing_think' END AS error FROM p"
         ).format(g=s_extract_boxes("solution"), pr=s_extract_boxes("completion"), th=S.think_b("completion"),
                  mx=s_matrix("g", "pr"),
                  r=S.r6(f"least(least(greatest({_s_multi('g', 'pr')}, 0.0), 1.0) * CASE WHEN think IS NOT NULL AND "
                         f"regexp_matches(think, {S.q(K.COORD_LEAK.replace('$', chr(92) + 'z'))}) THEN 0.1 ELSE 1.0 END, 1.0)"))


@register("x11b_cot_multibox", _X11B)
def q_x11b(spark, sf_dir):
    d = BR.cot_multibox_reward(f2_box_rollouts(spark, sf_dir))
    return d.select("image_id", r6("reward").alias("reward"), "error")


_X11C = (IMG + ", p0 AS (SELECT image_id, {g} AS g, {pr} AS pr FROM img), p AS (SELECT *, {mx} AS m FROM p0) "
         "SELECT image_id, {r} AS reward FROM p").format(
    g=s_all_strict("solution"), pr=s_all_strict("completion"), mx=s_matrix("g", "pr", "b"),
    r=S.r6(f"CASE WHEN len(g) = 0 OR len(pr) = 0 THEN 0.0 ELSE {s_dp('m')} / greatest(len(g), len(pr)) END"))


@register("x11c_r1_referred", _X11C)
def q_x11c(spark, sf_dir):
    d = BR.r1_referred_reward(f2_box_rollouts(spark, sf_dir))
    return d.select("image_id", r6("reward").alias("reward"))


_X11D = (IMG + ", p AS (SELECT image_id, {g} AS g, {pr} AS pr, {th} AS think FROM img) "
         "SELECT image_id, {r} AS reward, CASE WHEN think IS NULL THEN 'missing_think' END AS error FROM p").format(
    g=s_first_strict(S.strip("solution")), pr=s_first_strict(S.answer_c("completion")), th=S.think_b("completion"),
    r=S.r6(f"least(CASE WHEN g IS NULL OR pr IS NULL THEN 0.0 ELSE {s_iou('g', 'pr', 'b')} END * CASE WHEN "
           f"think IS NOT NULL AND regexp_matches(think, {S.q(K.COORD_LEAK.replace('$', chr(92) + 'z'))}) THEN 0.1 "
           "ELSE 1.0 END, 1.0)"))


@register("x11d_cot_referred", _X11D)
def q_x11d(spark, sf_dir):
    d = BR.cot_referred_reward(f2_box_rollouts(spark, sf_dir))
    return d.select("image_id", r6("reward").alias("reward"), "error")


@register("x12_leak", IMG + f"SELECT image_id, coalesce(regexp_matches({S.think_b('completion')}, "
          f"{S.q(K.COORD_LEAK.replace('$', chr(92) + 'z'))}), false) AS leaked FROM img")
def q_x12(spark, sf_dir):
    d = f2_box_rollouts(spark, sf_dir)
    return d.select("image_id", F.coalesce(B.coord_leak(T.extract_think("completion", "b")), F.lit(False)).alias("leaked"))


@register("x13_format", IMG + "SELECT image_id, CASE WHEN regexp_full_match(completion, "
          f"{S.q('(?s)' + K.FORMAT_TAGS)}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS tags_format, CASE WHEN regexp_full_match("
          f"completion, {S.q('(?s)' + K.FORMAT_ONE_BOX)}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS one_box_format FROM img")
def q_x13(spark, sf_dir):
    d = f2_box_rollouts(spark, sf_dir)
    return d.select("image_id", B.tags_format("completion").alias("tags_format"),
                    B.one_box_format("completion").alias("one_box_format"))


@register("t8b_think_tagged", IMG + f"SELECT image_id, {S.think_b('completion')} AS think FROM img")
def q_t8b(spark, sf_dir):
    """T8 form (b): ``<think...>`` with attributes allowed, DOTALL, NULL when absent."""
    d = f2_box_rollouts(spark, sf_dir)
    return d.select("image_id", T.extract_think("completion", "b").alias("think"))


@register("t9b_answer_last", IMG + f"SELECT image_id, {S.answer_b('completion')} AS answer FROM img")
def q_t9b(spark, sf_dir):
    """T9 form (b): the last answer block, DOTALL, stripped; NULL when absent."""
    d = f2_box_rollouts(spark, sf_dir)
    return d.select("image_id", T.extract_answer("completion", "b").alias("answer"))

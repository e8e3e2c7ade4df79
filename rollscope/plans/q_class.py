"""Class-distribution rollouts (fixture F1): T8-T10, B1-B9, L3, G1-G3, G7-G9, L4, L5."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import dist as D
from ..functions import text as T
from ..operators import groups as G
from ..operators import rewards as R
from . import sqlgen as S
from .catalog import r6, register
from .fixtures import f1_rollouts, f1_sql

CL = K.EMOTION_CLASSES
PRED = [R.class_col("pred", c) for c in CL]
GT = [R.class_col("gt", c) for c in CL]


# ------------------------------------------------------------------ Spark side
def parsed_f1(spark, sf_dir):
    return R.parse_class_rollouts(f1_rollouts(spark, sf_dir), CL)


def scored_f1(spark, sf_dir):
    """accuracy + format + total (the fused form of the class reward registry)."""
    return R.score_class_rollouts(f1_rollouts(spark, sf_dir), CL)


def advantaged_f1(spark, sf_dir):
    return G.group_advantages(scored_f1(spark, sf_dir))


# ----------------------------------------------------------------- oracle side
def _parsed_cte(cl=CL) -> str:
    pk, pv = S.kv(S.norm(S.answer_a("completion")), K.KV_PATTERN_LOOSE)
    gk, gv = S.kv(S.norm(S.answer_a("solution")), K.KV_PATTERN_LOOSE)
    pred_cols = [R.class_col("pred", c) for c in cl]
    gt_cols = [R.class_col("gt", c) for c in cl]
    probs = [f"{S.prob('pk', 'pv', c)} AS {p}" for c, p in zip(cl, pred_cols)]
    probs += [f"{S.prob('gk', 'gv', c)} AS {g}" for c, g in zip(cl, gt_cols)]
    fmt_ans = S.strip(f"regexp_extract(completion, {S.q('(?s)<answer>(.*?)</answer>')}, 1)")
    fk, fv = S.kv("fans", K.KV_PATTERN_LOOSE)
    fprobs = [S.prob("fk", "fv", c) for c in cl]
    fmt = (f"CASE WHEN NOT regexp_full_match(completion, {S.q('(?s)' + K.FORMAT_TAGS)}) THEN 0.0 "
           f"WHEN {' AND '.join(f'{p} = 0' for p in fprobs)} THEN 0.0 "
           f"ELSE exp(-abs({' + '.join(fprobs)} - 1.0)) END")
    acc = S.hybrid(gt_cols, pred_cols)
    return f"""
    f1 AS ({f1_sql(cl)}),
    p0 AS (SELECT *, {S.think_a('completion')} AS think, {pk} AS pk, {pv} AS pv, {gk} AS gk, {gv} AS gv,
                  {fmt_ans} AS fans FROM f1),
    p1 AS (SELECT *, {fk} AS fk, {fv} AS fv FROM p0),
    parsed AS (SELECT *, {', '.join(probs)} FROM p1),
    scored0 AS (SELECT *, CASE WHEN regexp_matches(think, {S.q(K.NUMBER_LEAK)}) THEN {acc} * 0.1 ELSE {acc} END
                          AS r_accuracy, {fmt} AS r_format FROM parsed),
    scored AS (SELECT *, r_accuracy + r_format AS reward FROM scored0),
    adv AS (SELECT *, (reward - group_mean) / (group_std + 0.0001) AS advantage FROM (
              SELECT *, avg(reward) OVER w AS group_mean, stddev_samp(reward) OVER w AS group_std,
                     count(*) OVER w AS group_size
              FROM scored WINDOW w AS (PARTITION BY step, group_id)))
    """


CTE = "WITH " + _parsed_cte().strip()
CTE_IMAGE = "WITH " + _parsed_cte(K.IMAGE_CLASSES).strip()


# --------------------------------------------------------------------- queries
@register("t8_think", CTE + " SELECT row_id, think FROM parsed")
def q_t8(spark, sf_dir):
    return f1_rollouts(spark, sf_dir).select("row_id", T.extract_think("completion", "a").alias("think"))


@register("t9_answer", f"WITH f1 AS ({f1_sql(CL)}) SELECT row_id, {S.answer_a('completion')} AS answer, "
                       f"{S.answer_c('completion')} AS answer_or_content FROM f1")
def q_t9(spark, sf_dir):
    return f1_rollouts(spark, sf_dir).select(
        "row_id", T.extract_answer("completion", "a").alias("answer"),
        T.extract_answer("completion", "c").alias("answer_or_content"))


@register("t10_norm", f"WITH f1 AS ({f1_sql(CL)}) SELECT row_id, {S.norm(S.answer_a('completion'))} AS norm_answer, "
                      f"{S.norm(S.answer_a('solution'))} AS norm_solution FROM f1")
def q_t10(spark, sf_dir):
    return f1_rollouts(spark, sf_dir).select(
        "row_id", T.normalize_answer(T.extract_answer("completion", "a")).alias("norm_answer"),
        T.normalize_answer(T.extract_answer("solution", "a")).alias("norm_solution"))


@register("b1_probs", CTE + " SELECT row_id, " + ", ".join(f"{S.r6(p)} AS {p}" for p in PRED + GT) + " FROM parsed")
def q_b1(spark, sf_dir):
    return parsed_f1(spark, sf_dir).select("row_id", *[r6(p).alias(p) for p in PRED + GT])


_STRICT_SQL_K, _STRICT_SQL_V = S.kv("completion", K.KV_PATTERN_STRICT)


@register("b1s_probs_strict",
          f"WITH f1 AS ({f1_sql(CL)}) SELECT row_id, "
          + ", ".join(f"{S.r6(S.prob(_STRICT_SQL_K, _STRICT_SQL_V, c))} AS s_{c}" for c in CL) + " FROM f1")
def q_b1s(spark, sf_dir):
    """B1': the strict ``'key':value`` pattern over the raw completion."""
    probs = D.parse_probs("completion", CL, K.KV_PATTERN_STRICT)
    return f1_rollouts(spark, sf_dir).select("row_id", *[r6(p).alias(f"s_{c}") for p, c in zip(probs, CL)])


_AM_NAME, _AM_VAL = S.argmax(PRED, CL)


@register("b2_argmax", CTE + f" SELECT row_id, {_AM_NAME} AS top_class, {S.r6(_AM_VAL)} AS top_prob FROM parsed")
def q_b2(spark, sf_dir):
    name, val = D.argmax_class([F.col(p) for p in PRED], CL)
    return parsed_f1(spark, sf_dir).select("row_id", name.alias("top_class"), r6(val).alias("top_prob"))


@register("b3_kl", CTE + f" SELECT row_id, {S.r6(S.kl(GT, PRED))} AS kl FROM parsed")
def q_b3(spark, sf_dir):
    return parsed_f1(spark, sf_dir).select(
        "row_id", r6(D.kl_divergence([F.col(g) for g in GT], [F.col(p) for p in PRED])).alias("kl"))


@register("b4_hybrid", CTE + f" SELECT row_id, {S.r6(S.hybrid(GT, PRED))} AS hybrid FROM parsed")
def q_b4(spark, sf_dir):
    d = D.with_hybrid(parsed_f1(spark, sf_dir), GT, PRED, "hybrid")
    return d.select("row_id", r6("hybrid").alias("hybrid"))


@register("b5_cos", CTE + f" SELECT row_id, {S.r6(S.cos_mse(GT, PRED))} AS cos_mse FROM parsed")
def q_b5(spark, sf_dir):
    return parsed_f1(spark, sf_dir).select(
        "row_id", r6(D.cos_mse_reward([F.col(g) for g in GT], [F.col(p) for p in PRED])).alias("cos_mse"))


@register("b6_pair", CTE + f" SELECT row_id, {S.r6(S.hybrid(GT, PRED))} AS reward, "
                           f"{S.r6(' + '.join(PRED))} AS pred_sum, {S.r6(' + '.join(GT))} AS gt_sum FROM parsed")
def q_b6(spark, sf_dir):
    d = D.with_hybrid(parsed_f1(spark, sf_dir), GT, PRED, "reward")
    return d.select("row_id", r6("reward").alias("reward"),
                    r6(sum(F.col(p) for p in PRED)).alias("pred_sum"), r6(sum(F.col(g) for g in GT)).alias("gt_sum"))


@register("b7_leak", CTE + f" SELECT row_id, regexp_matches(think, {S.q(K.NUMBER_LEAK)}) AS leaked FROM parsed")
def q_b7(spark, sf_dir):
    return parsed_f1(spark, sf_dir).select("row_id", D.number_leak("think").alias("leaked"))


@register("b8_accuracy", CTE + f" SELECT row_id, {S.r6('r_accuracy')} AS r_accuracy FROM scored")
def q_b8(spark, sf_dir):
    return scored_f1(spark, sf_dir).select("row_id", r6("r_accuracy").alias("r_accuracy"))


@register("b9_format", CTE + f" SELECT row_id, {S.r6('r_format')} AS r_format FROM scored")
def q_b9(spark, sf_dir):
    d = D.with_class_format(f1_rollouts(spark, sf_dir), "completion", CL, "r_format")
    return d.select("row_id", r6("r_format").alias("r_format"))


_L3_K, _ = S.kv(S.norm(S.answer_a("completion")), K.KV_PATTERN_LOOSE)
_L3_LIST = "[" + ", ".join(S.q(c) for c in CL) + "]"


@register("l3_member",
          f"WITH f1 AS ({f1_sql(CL)}) SELECT row_id, CAST(len({_L3_K}) AS BIGINT) AS n_keys, "
          f"CAST(len(list_filter({_L3_K}, lambda k: list_contains({_L3_LIST}, k))) AS BIGINT) AS n_member FROM f1")
def q_l3(spark, sf_dir):
    keys, _ = D.kv_arrays(T.normalize_answer(T.extract_answer("completion", "a")))
    cls = F.array(*[F.lit(c) for c in CL])
    return f1_rollouts(spark, sf_dir).select(
        "row_id", F.size(keys).cast("long").alias("n_keys"),
        F.size(F.filter(keys, lambda k: F.array_contains(cls, k))).cast("long").alias("n_member"))


@register("g1_total", CTE + f" SELECT row_id, {S.r6('r_accuracy')} AS r_accuracy, {S.r6('r_format')} AS r_format, "
                            f"{S.r6('reward')} AS reward FROM scored")
def q_g1(spark, sf_dir):
    """The reward registry: each reward in turn, then their sum."""
    return R.apply_rewards(f1_rollouts(spark, sf_dir), R.class_registry(CL)).select("row_id", r6("r_accuracy").alias("r_accuracy"),
                                           r6("r_format").alias("r_format"), r6("reward").alias("reward"))


@register("g11_model_reward", f"WITH f1 AS ({f1_sql(CL)}) SELECT row_id, "
          + S.r6("length(completion) / (length(concat('Rate ', image_path)) + 1.0) + 0.01 * length(solution) + step % 7 + 0.5 * gen_idx")
          + " AS reward FROM f1")
def q_g11(spark, sf_dir):
    """A caller's scorer that reads prompt, completion, solution, step and the rollout's place."""
    def load():
        import pyarrow.compute as pc

        def score(prompts, completions, solution, step, gen_idx, **_):
            size = [pc.utf8_length(x).to_numpy() for x in (prompts, completions, solution)]
            return size[1] / (size[0] + 1.0) + 0.01 * size[2] + step.to_numpy() % 7 + 0.5 * gen_idx.to_numpy()
        return score

    d = f1_rollouts(spark, sf_dir).withColumn("problem", F.concat(F.lit("Rate "), F.col("image_path")))
    d = R.apply_rewards(d, {"model": R.model_reward("model", load)})
    return d.select("row_id", r6("reward").alias("reward"))


@register("g2_stats", CTE + f" SELECT row_id, step, group_id, {S.r6('group_mean')} AS group_mean, "
                            f"{S.r6('group_std')} AS group_std, CAST(group_size AS BIGINT) AS group_size FROM adv")
def q_g2(spark, sf_dir):
    return advantaged_f1(spark, sf_dir).select("row_id", "step", "group_id", r6("group_mean").alias("group_mean"),
                                               r6("group_std").alias("group_std"),
                                               F.col("group_size").cast("long").alias("group_size"))


@register("g3_advantage", CTE + f" SELECT row_id, {S.r6('advantage')} AS advantage FROM adv")
def q_g3(spark, sf_dir):
    return advantaged_f1(spark, sf_dir).select("row_id", r6("advantage").alias("advantage"))


_G8_SQL = ("SELECT step, " + S.r6("avg(r_accuracy)") + " AS rewards_accuracy, " + S.r6("avg(r_format)")
           + " AS rewards_format, " + S.r6("avg(reward)") + " AS reward, " + S.r6("avg(group_std)")
           + " AS reward_std, CAST(count(*) AS BIGINT) AS n_rollouts FROM adv GROUP BY step")


@register("g8_gather", CTE + " " + _G8_SQL)
def q_g8(spark, sf_dir):
    d = advantaged_f1(spark, sf_dir)
    return (d.groupBy("step").agg(
        r6(F.avg("r_accuracy")).alias("rewards_accuracy"), r6(F.avg("r_format")).alias("rewards_format"),
        r6(F.avg("reward")).alias("reward"), r6(F.avg("group_std")).alias("reward_std"),
        F.count(F.lit(1)).alias("n_rollouts")))


_G7_LONG = ("SELECT step, metric, value FROM (SELECT step, avg(r_accuracy) AS \"rewards/accuracy\", "
            "avg(r_format) AS \"rewards/format\", avg(reward) AS reward, avg(group_std) AS reward_std "
            "FROM adv GROUP BY step) UNPIVOT (value FOR metric IN (\"rewards/accuracy\", \"rewards/format\", "
            "reward, reward_std))")


@register("g7_metrics", CTE + f", m AS ({_G7_LONG}) SELECT step, metric, {S.r6('value')} AS value FROM m")
def q_g7(spark, sf_dir):
    m = G.step_metrics(advantaged_f1(spark, sf_dir), ["accuracy", "format"])
    return m.select("step", "metric", r6("value").alias("value"))


LOG_EVERY = 5


@register("g9_flush", CTE + f", m AS ({_G7_LONG}) SELECT CAST(floor(step / {LOG_EVERY}) AS BIGINT) AS log_idx, "
                            f"metric, {S.r6('avg(value)')} AS value, count(*) AS n_steps, max(step) AS last_step "
                            "FROM m GROUP BY 1, 2")
def q_g9(spark, sf_dir):
    m = G.step_metrics(advantaged_f1(spark, sf_dir), ["accuracy", "format"])
    f = G.log_flush(m, LOG_EVERY)
    return f.select("log_idx", "metric", r6("value").alias("value"), "n_steps", "last_step")


@register("l4_select", CTE + " SELECT step, group_id, row_id, " + S.r6("reward") + " AS reward FROM ("
          "SELECT *, row_number() OVER (PARTITION BY step, group_id ORDER BY reward DESC, gen_idx ASC) AS rk "
          "FROM scored) WHERE rk = 1")
def q_l4(spark, sf_dir):
    b = G.best_of_group(scored_f1(spark, sf_dir))
    return b.select("step", "group_id", "row_id", r6("reward").alias("reward"))


@register("l4_select_threshold", CTE + " SELECT step, group_id, row_id, " + S.r6("reward") + " AS reward FROM ("
          "SELECT *, row_number() OVER (PARTITION BY step, group_id ORDER BY reward DESC, gen_idx ASC) AS rk "
          "FROM scored) WHERE rk = 1 AND reward >= 1.0")
def q_l4t(spark, sf_dir):
    b = G.best_of_group(scored_f1(spark, sf_dir), min_reward=1.0)
    return b.select("step", "group_id", "row_id", r6("reward").alias("reward"))


_L5_SQL = (CTE + ", m AS (SELECT step, avg(r_accuracy) AS value FROM scored GROUP BY step), "
           "pb AS (SELECT step, value, greatest(0.0, coalesce(max(value) OVER (ORDER BY step ROWS BETWEEN "
           "UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS prev_best FROM m) "
           "SELECT step, " + S.r6("value") + " AS value, " + S.r6("prev_best") + " AS prev_best, "
           "value > prev_best AS improved, value > prev_best AND value > 0.499 AS keep FROM pb")


@register("l5_running_best", _L5_SQL)
def q_l5(spark, sf_dir):
    m = scored_f1(spark, sf_dir).groupBy("step").agg(F.avg("r_accuracy").alias("value"))
    rb = G.running_best(m)
    return rb.select("step", r6("value").alias("value"), r6("prev_best").alias("prev_best"), "improved", "keep")


@register("b8_accuracy_image_classes", CTE_IMAGE + f" SELECT row_id, {S.r6('r_accuracy')} AS r_accuracy, "
          f"{S.r6('r_format')} AS r_format FROM scored")
def q_b8_image(spark, sf_dir):
    """B8/B9 with the 10 image classes (five of them two words long: their
    keys never survive the answer normalisation, ruling D1)."""
    d = R.score_class_rollouts(f1_rollouts(spark, sf_dir, K.IMAGE_CLASSES), K.IMAGE_CLASSES)
    return d.select("row_id", r6("r_accuracy").alias("r_accuracy"), r6("r_format").alias("r_format"))


@register("g3_stored_by_group", CTE + f" SELECT step, group_id, gen_idx, {S.r6('advantage')} AS advantage FROM adv")
def q_g3_stored(spark, sf_dir, buckets: int = 8):
    """P13, P14, scoring, G2 and G3 over prompts and responses that are stored by group: no row moves between tasks."""
    import uuid
    from ..operators import prompts as P
    from ..session import checkpoint_path
    from ..sources import io as IO
    base = checkpoint_path(spark, "rollscope-io", f"by-group-{uuid.uuid4().hex}")
    f1 = f1_rollouts(spark, sf_dir)
    prompts = IO.store_by_group(f1.where("gen_idx = 0").select("step", "group_id", "solution"), f"{base}/prompts", buckets)
    responses = IO.store_by_group(f1.select("step", "group_id", "gen_idx", "completion"), f"{base}/responses", buckets)
    both = P.attach_in_groups(P.fan_out(prompts), responses)
    return G.group_advantages(R.score_class_rollouts(both, CL)).select("step", "group_id", "gen_idx", r6("advantage").alias("advantage"))

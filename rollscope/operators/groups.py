"""Group statistics over rollouts and per-step metrics.

Rollout groups are keyed explicitly by ``(step, group_id)``; one rollout is
one row.  G2/G3 are windows over one exchange by group (a group is bounded by
G); L4 is rank 1 of a window, limited map-side; the step metrics G7/G9 are
partial and final hash aggregates, so a hot step or metric is pre-aggregated
before the shuffle.
"""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import checkpoint_path

GROUP_KEYS = ("step", "group_id")


def group_advantages(df: DataFrame, reward: str = "reward", keys: Sequence[str] = GROUP_KEYS,
                     eps: float = K.ADVANTAGE_EPSILON, expected_size: int | None = K.DEFAULT_G,
                     method: str = "window") -> DataFrame:
    """G2 + G3: group mean and *sample* std broadcast back to every rollout;
    advantage = (r - mean) / (std + eps).  A group of one has no sample std:
    std and advantage are NULL and ``single`` is true.  ``incomplete`` flags
    groups whose size differs from ``expected_size``.

    ``method="window"`` (default): one hash exchange on the group key and
    the upstream (parsing, scoring) runs once.  A rollout group is the G
    answers to one prompt, so a group is bounded by G and no window
    partition can be hot; the window buffer spills if one ever is.

    ``method="aggregate"``: per-group statistics by a hash aggregate
    (partial sums merged map-side, so even an unbounded hot group is cheap)
    joined back on the key -- Spark broadcasts the statistics only when
    their measured size is under the broadcast threshold, otherwise it is a
    shuffle join whose hot keys AQE splits.  The input is consumed twice,
    so everything upstream is computed twice unless the caller persisted
    it (measured 1.6x slower on scored rollouts at sf0.1); use it for
    inputs whose groups are not bounded."""
    r = F.col(reward)
    if method == "window":
        w = Window.partitionBy(*keys)
        out = df.withColumns({"group_mean": F.avg(r).over(w), "group_std": F.stddev_samp(r).over(w),
                              "group_size": F.count(F.lit(1)).over(w)})
    else:
        stats = df.groupBy(*keys).agg(F.avg(r).alias("group_mean"), F.stddev_samp(r).alias("group_std"),
                                      F.count(F.lit(1)).alias("group_size"))
        stats = stats.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                             "group_mean", "group_std", "group_size")
        cond = [df[k].eqNullSafe(stats[f"_k{i}"]) for i, k in enumerate(keys)]   # a NULL key is a group too
        out = df.join(stats, cond, "inner").drop(*[f"_k{i}" for i in range(len(keys))])
    derived = {"advantage": (r - F.col("group_mean")) / (F.col("group_std") + F.lit(eps)),
               "single": F.col("group_size") == 1}
    if expected_size is not None:
        derived["incomplete"] = F.col("group_size") != F.lit(expected_size)
    return out.withColumns(derived)


def best_of_group(df: DataFrame, reward: str = "reward", keys: Sequence[str] = GROUP_KEYS,
                  tiebreak: str = "gen_idx", min_reward: float | None = None) -> DataFrame:
    """L4 rejection sampling: keep the best rollout of each group (ties go to
    the lowest ``tiebreak``), optionally only when it reaches ``min_reward``.

    Rank 1 of a window: Spark keeps the best row of each group in every task
    before the shuffle (``WindowGroupLimit``), so a hot group is reduced
    map-side, and columns that the caller does not read never enter the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(reward).desc_nulls_last(), F.col(tiebreak).asc())
    out = df.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")
    if min_reward is not None:
        out = out.where(F.col(reward) >= F.lit(min_reward))
    return out


def step_metrics_wide(df: DataFrame, reward_names: Sequence[str], step: str = "step") -> DataFrame:
    """G7 + G8 (wide): per step the mean of each reward, of the total and of
    the per-rollout group std (the reference repeats the group std per
    rollout before averaging, so this is a mean over rollouts)."""
    aggs = [F.avg(f"r_{n}").alias(f"rewards_{n}") for n in reward_names]
    aggs += [F.avg("reward").alias("reward"), F.avg("group_std").alias("reward_std")]
    return df.groupBy(step).agg(*aggs)


def to_long(wide: DataFrame, id_cols: Sequence[str], metric_col: str = "metric",
            value_col: str = "value") -> DataFrame:
    vals = [c for c in wide.columns if c not in id_cols]
    return wide.unpivot(list(id_cols), vals, metric_col, value_col)


def step_metrics(df: DataFrame, reward_names: Sequence[str], step: str = "step") -> DataFrame:
    """G7 long form: (step, metric, value)."""
    wide = step_metrics_wide(df, reward_names, step)
    renamed = wide.select(step, *[F.col(c).alias(c.replace("rewards_", "rewards/")) for c in wide.columns if c != step])
    return to_long(renamed, [step])


def log_flush(metrics: DataFrame, every: int, step: str = "step") -> DataFrame:
    """Unweighted mean of each metric's per-step values over tumbling
    windows of ``every`` steps (one log line per window)."""
    return (metrics.groupBy(F.floor(F.col(step) / F.lit(every)).cast("long").alias("log_idx"), "metric")
            .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_steps"),
                 F.max(step).alias("last_step")))


def running_best(metrics: DataFrame, value: str = "value", order: str = "step",
                 initial: float = 0.0, threshold: float = 0.499, block: int = 1024, levels: int = 4) -> DataFrame:
    """Best value seen *before* each row (in ``order``), whether the row
    improves on it, and whether the improvement also clears ``threshold``.

    A prefix maximum over a global order, as a tree: rows are taken in blocks
    of ``block`` consecutive order values, the blocks' maxima again in blocks,
    and so on for ``levels`` levels.  Every window runs within one block, so it
    holds ``block`` rows at most as long as the order values span less than
    ``block ** (levels + 1)`` (10^15 by default); each level's table is joined
    back on its block id.  The levels all read the metrics, which are written to the shared folder
    first: what made them runs once.
    """
    spark, path = metrics.sparkSession, checkpoint_path(metrics.sparkSession, "rollscope-io", f"running-best-{uuid.uuid4().hex}")
    metrics.write.parquet(path)
    metrics = spark.read.schema(metrics.schema).parquet(path)

    def inside(df, key, parent, val, out):
        w = Window.partitionBy(parent).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.max(val).over(w))

    def up(c):
        return F.floor(F.col(c) / F.lit(block)).cast("long")

    d = inside(metrics.withColumn("_b1", up(order)), order, "_b1", value, "_p0")
    table, offsets = d.groupBy("_b1").agg(F.max(value).alias("_m")), []
    for k in range(1, levels + 1):
        table = inside(table.withColumn(f"_b{k + 1}", up(f"_b{k}")), f"_b{k}", f"_b{k + 1}", "_m", f"_p{k}")
        offsets.append(table.select(f"_b{k}", f"_b{k + 1}", f"_p{k}"))
        table = table.groupBy(f"_b{k + 1}").agg(F.max("_m").alias("_m"))
    before = offsets[-1]
    for k in range(levels - 1, 0, -1):
        before = offsets[k - 1].join(before, f"_b{k + 1}")
    best = [F.coalesce(F.col(f"_p{k}"), F.lit(initial)) for k in range(levels + 1)]
    d = d.join(before.select("_b1", *[f"_p{k}" for k in range(1, levels + 1)]), "_b1", "left")
    d = d.withColumn("prev_best", F.greatest(F.lit(initial), *best))
    d = d.withColumn("improved", F.col(value) > F.col("prev_best"))
    d = d.withColumn("keep", F.col("improved") & (F.col(value) > F.lit(threshold)))
    return d.drop("_b1", *[f"_p{k}" for k in range(levels + 1)])

"""Token-level math over long-form token logs.

``token_logs`` holds one row per (seq_id, pos).  Everything per sequence is
a hash aggregate on ``seq_id`` (partial aggregation map-side); the only
window (first end token per sequence) shares that same partitioning, so
the per-sequence aggregate after it adds no exchange.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import _c


def token_kl(logp, ref_logp) -> Column:
    """Per-token KL estimate e^(ref - lp) - (ref - lp) - 1."""
    d = _c(ref_logp) - _c(logp)
    return F.exp(d) - d - F.lit(1.0)


def with_mask(tokens: DataFrame, seq: str = "seq_id", pos: str = "pos", eos: str = "is_eos") -> DataFrame:
    """``mask`` = position is at or before the first end token of its
    sequence (all positions when there is none)."""
    w = Window.partitionBy(seq)
    first = F.min(F.when(F.col(eos), F.col(pos))).over(w)
    last = F.max(pos).over(w)
    return tokens.withColumn("mask", F.col(pos) <= F.coalesce(first, last))


def completion_lengths(tokens: DataFrame, seq: str = "seq_id", pos: str = "pos", eos: str = "is_eos") -> DataFrame:
    """G4 per sequence: completion length = first end position, else the
    sequence length (positions are 1..n)."""
    return tokens.groupBy(seq).agg(
        F.coalesce(F.min(F.when(F.col(eos), F.col(pos))), F.max(pos)).alias("length"))


def sequence_stats(tokens: DataFrame, keys=("seq_id", "step", "group_id")) -> DataFrame:
    """Per sequence: masked length and masked mean KL (G4 + G5)."""
    t = with_mask(tokens).withColumn("kl", token_kl("logp", "ref_logp"))
    m = F.col("mask").cast("double")
    return t.groupBy(*keys).agg(F.sum(m).alias("length"), (F.sum(F.col("kl") * m) / F.sum(m)).alias("mean_kl"))


def sequence_loss(seq_stats: DataFrame, advantage: str = "advantage", beta: float = K.LOSS_BETA) -> DataFrame:
    """G6 per sequence: masked mean of -(A - beta * kl) = -A + beta * mean_kl
    (the probability ratio is numerically 1)."""
    return seq_stats.withColumn("loss", -F.col(advantage) + F.lit(beta) * F.col("mean_kl"))


def step_loss(seq_loss: DataFrame, step: str = "step") -> DataFrame:
    """G6 per step: mean over sequences (an average of per-sequence averages).
    A group of one has no advantage and so no loss; ``n_without_loss`` counts
    the sequences that the mean leaves out for that."""
    return seq_loss.groupBy(step).agg(F.avg("loss").alias("loss"), F.count_if(F.col("loss").isNull()).alias("n_without_loss"))


def token_metrics(seq_stats: DataFrame, step: str = "step") -> DataFrame:
    """G7 token part: mean completion length and mean masked KL per step."""
    return seq_stats.groupBy(step).agg(F.avg("length").alias("completion_length"), F.avg("mean_kl").alias("kl"))


def gather_logprob(logits, target) -> Column:
    """Log-softmax of ``logits`` (array<double>) taken at ``target``
    (0-based): x[t] - (max + ln sum exp(x - max))."""
    x = _c(logits)
    mx = F.array_max(x)
    lse = mx + F.ln(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - mx)))
    return F.element_at(x, _c(target).cast("int") + 1) - lse

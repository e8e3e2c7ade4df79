"""Class-distribution operators as Spark column expressions.

A parsed distribution is a Python list of ``Column`` objects, one per class,
aligned to the class list.  The lists are unrolled when the plan is built
(7-20 classes), so every score stays a flat arithmetic expression that
whole-stage codegen compiles; no lambda (higher-order function) is needed.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import _c, jre, py_strip


def kv_arrays(c, pattern: str = K.KV_PATTERN_LOOSE) -> tuple[Column, Column]:
    """All ``key: value`` matches of ``pattern`` as two aligned string arrays."""
    p = F.lit(jre(pattern))
    return F.regexp_extract_all(_c(c), p, 1), F.regexp_extract_all(_c(c), p, 2)


def last_value(keys, vals, cls: str) -> Column:
    """Value of the *last* ``cls`` key as double (NULL when absent / not a number)."""
    pos = F.array_position(F.reverse(_c(keys)), F.lit(cls)).cast("int")  # 1-based from the end, 0 if absent
    return F.try_element_at(_c(vals), F.nullif(-pos, F.lit(0))).try_cast("double")


def reversed_lookup(keys, vals) -> tuple[Column, Column]:
    """Arrays for repeated last-value lookups: keys reversed, and the values
    reversed, cast to double once and shifted by a NULL sentinel so that
    ``element_at(values, array_position(keys, k) + 1)`` is NULL when ``k``
    is absent (position 0).  No lambda, no per-class re-parsing."""
    rk = F.reverse(_c(keys))
    rv = F.concat(F.array(F.lit(None).cast("double")), F.reverse(_c(vals)).try_cast("array<double>"))
    return rk, rv


def lookup_last(rkeys, rvals, cls: str) -> Column:
    """Last value of ``cls`` from the ``reversed_lookup`` arrays."""
    return F.element_at(_c(rvals), F.array_position(_c(rkeys), F.lit(cls)).cast("int") + 1)


def in_unit(v) -> Column:
    """Keep a probability in [0, 1], anything else (or NULL) becomes 0."""
    v = _c(v)
    return F.when(v.between(0.0, 1.0), v).otherwise(F.lit(0.0))


def probs_from_kv(keys, vals, classes: Sequence[str]) -> list[Column]:
    """B1 core.  For each class the *last* matching key wins; the value is
    kept when it lies in [0, 1], otherwise 0; a class never named gets 0."""
    return [in_unit(last_value(keys, vals, cls)) for cls in classes]


def parse_probs(c, classes: Sequence[str], pattern: str = K.KV_PATTERN_LOOSE) -> list[Column]:
    """B1 / B1': probability string -> one double column per class."""
    k, v = kv_arrays(c, pattern)
    return probs_from_kv(k, v, classes)


def _sum(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _normalised(cols: Sequence[Column], eps: float = K.PROB_EPSILON) -> list[Column]:
    clipped = [F.greatest(x, F.lit(eps)) for x in cols]
    total = _sum(clipped)
    return [x / total for x in clipped]


def kl_divergence(p: Sequence[Column], q: Sequence[Column]) -> Column:
    """Clip both at 1e-10, renormalise, sum p * ln(p / q)."""
    pn, qn = _normalised(p), _normalised(q)
    return _sum([a * F.ln(a / b) for a, b in zip(pn, qn)])


def mse(p: Sequence[Column], q: Sequence[Column]) -> Column:
    return _sum([(a - b) * (a - b) for a, b in zip(p, q)]) / F.lit(float(len(p)))


def with_hybrid(df, gt: Sequence[str], pred: Sequence[str], out: str, alpha: float = 0.5,
                beta: float = 0.5, factor: Column | None = None):
    """B4 as staged projections (clip, then sums, then KL and MSE and the
    score, times an optional ``factor`` such as a leak multiplier).

    Each stage references the previous one's columns several times, which
    keeps Catalyst from inlining them into one huge expression; the whole
    chain still compiles into a single whole-stage-codegen function."""
    keep = df.columns
    eps = F.lit(K.PROB_EPSILON)
    n = len(gt)
    d = df.select("*", *[F.greatest(F.col(c), eps).alias(f"_cg{i}") for i, c in enumerate(gt)],
                  *[F.greatest(F.col(c), eps).alias(f"_cp{i}") for i, c in enumerate(pred)])
    d = d.select("*", _sum([F.col(f"_cg{i}") for i in range(n)]).alias("_sg"),
                 _sum([F.col(f"_cp{i}") for i in range(n)]).alias("_sp"))
    ng = [F.col(f"_cg{i}") / F.col("_sg") for i in range(n)]
    npr = [F.col(f"_cp{i}") / F.col("_sp") for i in range(n)]
    kl = _sum([a * (F.ln(a) - F.ln(b)) for a, b in zip(ng, npr)])
    m = mse([F.col(c) for c in gt], [F.col(c) for c in pred])
    score = F.exp(-F.lit(alpha) * kl - F.lit(beta) * m)
    if factor is not None:
        score = score * factor
    return d.select(*keep, score.alias(out))


def hybrid_reward(gt: Sequence[Column], pred: Sequence[Column], alpha: float = 0.5,
                  beta: float = 0.5) -> Column:
    """exp(-alpha * KL(gt || pred) - beta * MSE(gt, pred)); KL on the
    clipped-normalised vectors, MSE on the raw ones."""
    return F.exp(-F.lit(alpha) * kl_divergence(gt, pred) - F.lit(beta) * mse(gt, pred))


def cos_mse_reward(gt: Sequence[Column], pred: Sequence[Column], alpha: float = 0.8,
                   beta: float = 0.2) -> Column:
    """Alpha * |cos(gt, pred)| + beta * exp(-gt . |gt - pred|); cos = 0 when
    either norm is 0."""
    dot = _sum([a * b for a, b in zip(gt, pred)])
    ng = F.sqrt(_sum([a * a for a in gt]))
    npred = F.sqrt(_sum([b * b for b in pred]))
    cos = F.when((ng == 0) | (npred == 0), F.lit(0.0)).otherwise(dot / (ng * npred))
    offline = F.exp(-_sum([a * F.abs(a - b) for a, b in zip(gt, pred)]))
    return F.abs(cos) * F.lit(alpha) + offline * F.lit(beta)


def cos_mse_reward_arrays(gt, pred, alpha: float = 0.8, beta: float = 0.2) -> Column:
    """B5 over array<double> columns of any (equal) length, e.g. embeddings."""
    gt, pred = _c(gt), _c(pred)
    z = F.arrays_zip(gt.alias("a"), pred.alias("b"))
    dot = F.aggregate(z, F.lit(0.0), lambda acc, x: acc + x["a"] * x["b"])
    ng = F.sqrt(F.aggregate(gt, F.lit(0.0), lambda acc, x: acc + x * x))
    npred = F.sqrt(F.aggregate(pred, F.lit(0.0), lambda acc, x: acc + x * x))
    cos = F.when((ng == 0) | (npred == 0), F.lit(0.0)).otherwise(dot / (ng * npred))
    off = F.exp(-F.aggregate(z, F.lit(0.0), lambda acc, x: acc + x["a"] * F.abs(x["a"] - x["b"])))
    return F.abs(cos) * F.lit(alpha) + off * F.lit(beta)


def argmax_class(probs: Sequence[Column], classes: Sequence[str]) -> tuple[Column, Column]:
    """B2: (class, value) of the highest probability; ties go to the first class."""
    best = F.greatest(*probs) if len(probs) > 1 else probs[0]
    name = None
    for cls, p in reversed(list(zip(classes, probs))):
        name = F.when(p == best, F.lit(cls)) if name is None else F.when(p == best, F.lit(cls)).otherwise(name)
    return name, best


def probs_map(probs: Sequence[Column], classes: Sequence[str]) -> Column:
    """Log form of a distribution: map<class, prob> (class order kept)."""
    return F.map_from_arrays(F.array(*[F.lit(x) for x in classes]), F.array(*probs))


def number_leak(think) -> Column:
    """A decimal number in the reasoning."""
    return _c(think).rlike(jre(K.NUMBER_LEAK))


def with_class_format(df, completion: str, classes: Sequence[str], out: str):
    """Full match of think/answer tags (DOTALL); the raw (not normalised)
    answer is parsed; all-zero -> 0, else exp(-|sum(p) - 1|).  Staged
    projections: tag check and answer parse first, score after."""
    keep = df.columns
    c = F.col(completion)
    ans = py_strip(F.regexp_extract(c, jre(r"<answer>(.*?)</answer>", dotall=True), 1))
    k, v = kv_arrays(ans)
    d = df.select("*", c.rlike(jre(K.FORMAT_TAGS, dotall=True, full=True)).alias("_fok"),
                  k.alias("_fk"), v.alias("_fv"))
    rk, rv = reversed_lookup("_fk", "_fv")
    d = d.select(*keep, "_fok", rk.alias("_frk"), rv.alias("_frv"))
    d = d.select(*keep, "_fok", *[lookup_last("_frk", "_frv", cls).alias(f"_fr{i}") for i, cls in enumerate(classes)])
    d = d.select(*keep, "_fok", *[in_unit(f"_fr{i}").alias(f"_fp{i}") for i in range(len(classes))])
    ps = [F.col(f"_fp{i}") for i in range(len(classes))]
    all_zero = reduce(lambda a, b: a & b, [p == 0 for p in ps])
    score = F.when(~F.col("_fok") | all_zero, F.lit(0.0)).otherwise(F.exp(-F.abs(_sum(ps) - F.lit(1.0))))
    return d.select(*keep, score.alias(out))

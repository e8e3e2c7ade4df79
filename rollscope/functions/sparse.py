"""Class distributions over long class lists (B1, B3, B4, B8, B9), kept sparse.

A rollout names a few of hundreds of classes.  A distribution is two aligned
arrays, the classes that have a probability above 0 and these probabilities; all
other classes are 0.  Sums over all classes are sums over the classes that
occur plus one term for those that do not, so neither the plan nor the
work of a row grows with the number of classes (the class list is one literal).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K
from .dist import kv_arrays
from .text import _c


def sparse_probs(keys, values, classes: Sequence[str]) -> Column:
    """B1 on key and value arrays: struct(c, p) of the classes that have a probability, in the
    order of their last mention.  The *last* value of a class counts, if it lies in [0, 1]."""
    keys, values = F.reverse(_c(keys)), F.reverse(_c(values)).try_cast("array<double>")
    # membership in one set of literals, built once: an intersection with the list would build its set for every row
    named = F.array_distinct(F.filter(keys, lambda k: k.isin(list(classes))))
    each = F.transform(named, lambda k: F.struct(k.alias("c"), F.element_at(values, F.array_position(keys, k).cast("int")).alias("p")))
    each = F.filter(each, lambda x: x["p"].between(0.0, 1.0) & (x["p"] > 0))
    return F.struct(F.transform(each, lambda x: x["c"]).alias("c"), F.transform(each, lambda x: x["p"]).alias("p"))


def parse_sparse(c, classes: Sequence[str], pattern: str = K.KV_PATTERN_LOOSE) -> Column:
    """B1 from a probability string."""
    return sparse_probs(*kv_arrays(c, pattern), classes)


def with_sparse_hybrid(df: DataFrame, gt: str, pred: str, n_classes: int, out: str, alpha: float = 0.5, beta: float = 0.5,
                       factor: Column | None = None, kl: str | None = None) -> DataFrame:
    """B3 (as column ``kl``, if named) and B4: exp(-alpha * KL(gt || pred) - beta * MSE(gt, pred)),
    times ``factor``.  KL on the vectors clipped at 1e-10 and normalised, MSE on the raw ones.

    With ``u`` classes in either, each of the ``n - u`` others adds ``e / S_gt * ln(S_pred / S_gt)`` to
    the divergence and nothing to the error; ``S`` are the sums after clipping."""
    eps, n = repr(K.PROB_EPSILON), n_classes
    both = df.withColumn("_u", F.expr(f"array_union({gt}.c, {pred}.c)")).withColumns({
        side: F.expr(f"transform(_u, k -> coalesce(element_at({v}.p, nullif(cast(array_position({v}.c, k) AS int), 0)), 0D))")
        for side, v in (("_g", gt), ("_p", pred))})
    total = {f"_s{s}": F.expr(f"aggregate({s}, 0D, (a, x) -> a + greatest(x, {eps})) + ({n} - size(_u)) * {eps}") for s in ("_g", "_p")}
    both = both.withColumns(total)
    terms = (f"zip_with(_g, _p, (g, p) -> greatest(g, {eps}) / _s_g * (ln(greatest(g, {eps}) / _s_g) - ln(greatest(p, {eps}) / _s_p)))")
    both = both.withColumns({
        "_kl": F.expr(f"aggregate({terms}, 0D, (a, x) -> a + x) + ({n} - size(_u)) * {eps} / _s_g * (ln(_s_p) - ln(_s_g))"),
        "_mse": F.expr(f"aggregate(zip_with(_g, _p, (g, p) -> (g - p) * (g - p)), 0D, (a, x) -> a + x) / {n}D")})
    score = F.exp(-F.lit(alpha) * F.col("_kl") - F.lit(beta) * F.col("_mse"))
    return both.select(*df.columns, *([F.col("_kl").alias(kl)] if kl else []), (score * factor if factor is not None else score).alias(out))


def sparse_format(matches, probs) -> Column:
    """0 without the tags or without a probability, else exp(-|sum - 1|)."""
    total = F.aggregate(_c(probs)["p"], F.lit(0.0), lambda a, x: a + x)
    return F.when(~_c(matches) | (F.size(_c(probs)["p"]) == 0), F.lit(0.0)).otherwise(F.exp(-F.abs(total - F.lit(1.0))))


def score_sparse_rollouts(df: DataFrame, classes: Sequence[str], completion: str = "completion", solution: str = "solution",
                          alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """B8 + B9 + G1 over a long class list: ``pred`` and ``gt`` (sparse distributions), ``think``, ``r_accuracy``,
    ``r_format``, ``reward``; the same scores as ``operators.rewards.score_class_rollouts``."""
    from . import text as T
    from .dist import number_leak
    comp = F.col(completion)
    parsed = df.withColumns({
        "think": T.extract_think(comp, "a"),
        "_pa": F.struct(*[x.alias(k) for x, k in zip(kv_arrays(T.normalize_answer(T.extract_answer(comp, "a"))), "kv")]),
        "_ga": F.struct(*[x.alias(k) for x, k in zip(kv_arrays(T.normalize_answer(T.extract_answer(solution, "a"))), "kv")]),
        "_fa": F.struct(*[x.alias(k) for x, k in zip(kv_arrays(T.py_strip(F.regexp_extract(
            comp, T.jre(r"<answer>(.*?)</answer>", dotall=True), 1))), "kv")]),
        "_ok": comp.rlike(T.jre(K.FORMAT_TAGS, dotall=True, full=True))})
    parsed = parsed.withColumns({"pred": sparse_probs("_pa.k", "_pa.v", classes), "gt": sparse_probs("_ga.k", "_ga.v", classes),
                                 "_f": sparse_probs("_fa.k", "_fa.v", classes)})
    parsed = parsed.withColumn("r_format", sparse_format("_ok", "_f")).drop("_pa", "_ga", "_fa", "_f", "_ok")
    factor = F.when(number_leak("think"), F.lit(K.LEAK_FACTOR)).otherwise(F.lit(1.0))
    out = with_sparse_hybrid(parsed, "gt", "pred", len(classes), "r_accuracy", alpha, beta, factor, kl="kl")
    return out.withColumn("reward", F.col("r_accuracy") + F.col("r_format"))

"""Reward operators: per-rollout scoring (B6-B9) and the reward registry (G1).

A reward is a function ``DataFrame -> DataFrame`` that appends one double
column ``r_<name>``.  ``apply_rewards`` runs a list of them and adds the total
``reward``.  All rewards are map-side column expressions: scoring a table is
one narrow stage with no shuffle.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import constants as K
from ..functions import dist as D
from ..functions import text as T

RewardFn = Callable[[DataFrame], DataFrame]


def class_col(prefix: str, cls: str) -> str:
    return f"{prefix}_{cls.replace(' ', '_')}"


def parse_class_rollouts(df: DataFrame, classes: Sequence[str], completion: str = "completion",
                         solution: str = "solution", pattern: str = K.KV_PATTERN_LOOSE,
                         class_match: str = "reference") -> DataFrame:
    """T8a + T9a + T10 + B1 on both sides.  Adds ``think``, ``pred_<c>`` and
    ``gt_<c>`` columns.  Regex matches are materialised once in their own
    projection so the per-class expressions only index arrays."""
    keep = df.columns
    pk, pv = D.kv_arrays(T.normalize_answer(T.extract_answer(completion, "a")), pattern)
    gk, gv = D.kv_arrays(T.normalize_answer(T.extract_answer(solution, "a")), pattern)
    parsed = df.select("*", T.extract_think(completion, "a").alias("think"),
                       pk.alias("_pk"), pv.alias("_pv"), gk.alias("_gk"), gv.alias("_gv"))
    prk, prv = D.reversed_lookup("_pk", "_pv")
    grk, grv = D.reversed_lookup("_gk", "_gv")
    looked = parsed.select(*keep, "think", prk.alias("_prk"), prv.alias("_prv"), grk.alias("_grk"), grv.alias("_grv"))
    # raw values in their own projection: ``in_unit`` reads each one three times
    raw = looked.select(
        *keep, "think",
        *[D.lookup_last("_prk", "_prv", match_name(c, class_match)).alias(class_col("_rp", c)) for c in classes],
        *[D.lookup_last("_grk", "_grv", match_name(c, class_match)).alias(class_col("_rg", c)) for c in classes])
    return raw.select(
        *keep, "think",
        *[D.in_unit(class_col("_rp", c)).alias(class_col("pred", c)) for c in classes],
        *[D.in_unit(class_col("_rg", c)).alias(class_col("gt", c)) for c in classes],
    )


def pred_cols(classes) -> list[Column]:
    return [F.col(class_col("pred", c)) for c in classes]


def gt_cols(classes) -> list[Column]:
    return [F.col(class_col("gt", c)) for c in classes]


def leak_factor(think: str = "think") -> Column:
    """B7 multiplier: 0.1 when the reasoning holds a decimal number, else 1."""
    return F.when(D.number_leak(think), F.lit(K.LEAK_FACTOR)).otherwise(F.lit(1.0))


def with_class_accuracy(df: DataFrame, classes: Sequence[str], out: str = "r_accuracy",
                        alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """B6 + B7 on parsed columns: hybrid reward, x0.1 when the think leaks a decimal."""
    gts = [class_col("gt", c) for c in classes]
    preds = [class_col("pred", c) for c in classes]
    return D.with_hybrid(df, gts, preds, out, alpha, beta, factor=leak_factor("think"))


def accuracy_reward(classes: Sequence[str] = K.EMOTION_CLASSES) -> RewardFn:
    """B8 as a registry entry (parses, scores, keeps parsed columns for logs)."""
    def fn(df: DataFrame) -> DataFrame:
        if class_col("pred", classes[0]) not in df.columns:
            df = parse_class_rollouts(df, classes)
        return with_class_accuracy(df, classes)
    return fn


def format_reward(classes: Sequence[str] = K.EMOTION_CLASSES) -> RewardFn:
    def fn(df: DataFrame) -> DataFrame:
        return D.with_class_format(df, "completion", classes, "r_format")
    return fn


def apply_rewards(df: DataFrame, fns: dict[str, RewardFn]) -> DataFrame:
    """G1: run each reward, then ``reward`` = sum of the ``r_<name>`` columns."""
    for fn in fns.values():
        df = fn(df)
    total = None
    for name in fns:
        c = F.col(f"r_{name}")
        total = c if total is None else total + c
    return df.withColumn("reward", total)


def class_registry(classes: Sequence[str] = K.EMOTION_CLASSES) -> dict[str, RewardFn]:
    return {"accuracy": accuracy_reward(classes), "format": format_reward(classes)}


_SCORERS: dict[str, Callable] = {}          # of this worker


def _scorer(token: str, load: Callable) -> Callable:
    """The worker's own scorer: ``load`` runs once in it, however many tasks and batches follow."""
    if token not in _SCORERS:
        _SCORERS[token] = load()
    return _SCORERS[token]


def model_reward(name: str, load: Callable[[], Callable], prompt: str = "problem", completion: str = "completion",
                 columns: Sequence[str] | None = None) -> RewardFn:
    """G11 hook: a caller's scorer as reward column ``r_<name>``.

    ``load()`` returns the scorer (and may load a model); it runs once in each Python worker.
    The scorer gets every column of the table (or ``columns``), as Arrow arrays of a batch:
    ``scorer(prompts, completions, **others)`` with the prompt and completion columns as
    its first two arguments and all others -- solution, step, keys, targets -- by their
    names.  It returns one number (or null) a row.  Rows go to it in Arrow batches by an
    iterator, with no shuffle; the table's own columns stay in the JVM.  ``prompt`` must
    be a column: the solution never stands in for the prompt.  No model is shipped."""
    token = uuid.uuid4().hex

    @F.arrow_udf(DoubleType())
    def _score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _scorer(token, load)
        for rows in batches:
            given = {f.name: rows.field(i) for i, f in enumerate(rows.type)}
            got = scorer(given.pop(prompt), given.pop(completion), **given)
            if not isinstance(got, (pa.Array, pa.ChunkedArray)):
                got = pa.array(got, from_pandas=True)
            got = got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got
            if len(got) != len(rows):
                raise ValueError(f"the scorer {name!r} returned {len(got)} numbers for {len(rows)} rows")
            yield got.cast(pa.float64())

    def fn(df: DataFrame) -> DataFrame:
        use = list(columns or df.columns)
        use += [c for c in (prompt, completion) if c not in use]
        missing = [c for c in use if c not in df.columns]
        if missing:
            raise ValueError(f"model_reward needs the columns {missing}")
        return df.withColumn(f"r_{name}", _score(F.struct(*[F.col(_q(c)).alias(c) for c in use])))
    return fn


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _lit(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def match_name(cls: str, class_match: str = "reference") -> str:
    """The key a class is looked up under.  ``reference``: the class name as
    is (so multi-word classes never match a normalised answer, D1);
    ``normalized``: the class name normalised like the answer (no spaces or
    underscores, lower case)."""
    return cls if class_match == "reference" else cls.replace(" ", "").replace("_", "").lower()


def score_class_rollouts(df: DataFrame, classes: Sequence[str] = K.EMOTION_CLASSES, completion: str = "completion",
                         solution: str = "solution", alpha: float = 0.5, beta: float = 0.5,
                         class_match: str = "reference") -> DataFrame:
    """B8 + B9 + G1 fused: the same results as ``apply_rewards(df,
    class_registry(classes))`` in five projections.

    Stage 1 runs every regex once (think, both answers' key/value arrays,
    the format check; patterns passed as literals).  Later stages only index
    arrays and do arithmetic; they are written as SQL expressions (one
    round trip to the JVM each instead of one per operator node), which
    makes building the plan several times cheaper."""
    keep = df.columns
    n = len(classes)
    comp, sol = F.col(completion), F.col(solution)
    pk, pv = D.kv_arrays(T.normalize_answer(T.extract_answer(comp, "a")))
    gk, gv = D.kv_arrays(T.normalize_answer(T.extract_answer(sol, "a")))
    fans = T.py_strip(F.regexp_extract(comp, T.jre(r"<answer>(.*?)</answer>", dotall=True), 1))
    fk, fv = D.kv_arrays(fans)
    prk, prv = D.reversed_lookup(pk, pv)
    grk, grv = D.reversed_lookup(gk, gv)
    frk, frv = D.reversed_lookup(fk, fv)
    a = df.select("*", T.extract_think(comp, "a").alias("think"), prk.alias("_prk"), prv.alias("_prv"),
                  grk.alias("_grk"), grv.alias("_grv"), frk.alias("_frk"), frv.alias("_frv"),
                  comp.rlike(T.jre(K.FORMAT_TAGS, dotall=True, full=True)).alias("_fok"))
    a = a.withColumn("_leak", D.number_leak("think"))
    E = F.expr

    def look(side, c):
        return f"element_at(_{side}v, CAST(array_position(_{side}k, {_lit(c)}) AS INT) + 1)"

    def unit(x):
        return f"CASE WHEN {x} BETWEEN 0.0 AND 1.0 THEN {x} ELSE 0.0 END"

    kq = [_q(k) for k in keep]
    b = a.select(*keep, "think", "_fok", "_leak",
                 *[E(look("pr", match_name(c, class_match))).alias(f"_rp{i}") for i, c in enumerate(classes)],
                 *[E(look("gr", match_name(c, class_match))).alias(f"_rg{i}") for i, c in enumerate(classes)],
                 *[E(look("fr", c)).alias(f"_rf{i}") for i, c in enumerate(classes)])
    preds = [class_col("pred", x) for x in classes]
    gts = [class_col("gt", x) for x in classes]
    eps = repr(K.PROB_EPSILON)
    c = b.selectExpr(*kq, "think", "_fok", "_leak",
                     *[f"{unit(f'_rp{i}')} AS {_q(preds[i])}" for i in range(n)],
                     *[f"{unit(f'_rg{i}')} AS {_q(gts[i])}" for i in range(n)],
                     *[f"{unit(f'_rf{i}')} AS _fp{i}" for i in range(n)],
                     *[f"greatest({unit(f'_rp{i}')}, {eps}) AS _cp{i}" for i in range(n)],
                     *[f"greatest({unit(f'_rg{i}')}, {eps}) AS _cg{i}" for i in range(n)])
    plus = " + ".join
    d = c.selectExpr(*kq, "think", *[_q(x) for x in preds + gts], "_fok", "_leak",
                     *[f"_cp{i}" for i in range(n)], *[f"_cg{i}" for i in range(n)],
                     f"{plus(f'_cp{i}' for i in range(n))} AS _sp", f"{plus(f'_cg{i}' for i in range(n))} AS _sg",
                     f"{plus(f'_fp{i}' for i in range(n))} AS _fsum",
                     f"{' AND '.join(f'_fp{i} = 0' for i in range(n))} AS _fzero")
    kl = plus(f"(_cg{i} / _sg) * (ln(_cg{i} / _sg) - ln(_cp{i} / _sp))" for i in range(n))
    mse = f"({plus(f'({_q(g)} - {_q(p)}) * ({_q(g)} - {_q(p)})' for g, p in zip(gts, preds))}) / {float(n)!r}"
    acc = f"exp(-{alpha!r} * ({kl}) - {beta!r} * {mse}) * CASE WHEN _leak THEN {K.LEAK_FACTOR!r} ELSE 1.0 END"
    fmt = "CASE WHEN NOT _fok OR _fzero THEN 0.0 ELSE exp(-abs(_fsum - 1.0)) END"
    e = d.selectExpr(*kq, "think", *[_q(x) for x in preds + gts], f"{acc} AS r_accuracy", f"{fmt} AS r_format")
    return e.withColumn("reward", F.col("r_accuracy") + F.col("r_format"))

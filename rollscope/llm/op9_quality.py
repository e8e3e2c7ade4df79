"""Operator 9: quality rules with robust multivariate outliers.

Base rules fail a document with too few words or too many repeated ones.  For
the others, a vector of smoothed, transformed statistics (word length, symbol,
duplicate-line and repeated-word density) is held against the minimum
covariance determinant estimate of its language and source: the mean and
covariance of the ``SHARE`` of vectors that makes the smallest determinant.
A document whose squared Mahalanobis distance is above ``CUT`` is rejected.

The estimates cover every document.  They start from the coordinatewise
medians and median deviations; each concentration step is two aggregations by
group over the table of statistics (the distance that holds the share, then the
moments within it), so a language or source with most of the rows is summed by
many tasks.  Groups under ``LEAST`` documents use their language's estimate,
languages under it the estimate of all documents; without that there is no
verdict.  ``FLOOR`` adds a least standard deviation to each statistic: where most
texts share one value, small differences are no outliers.

Cases: a null or word-less text fails the base rules.  Null languages and
sources are groups like others.  Repeated rows count as often as they come.  An
empty table gives no rows.  Columns beside those named are not read by
``verdicts``; ``filtered`` keeps them all.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import cut

SHARE = 0.6
STEPS = 8
CUT = 30.0
LEAST = 50
MIN_WORDS = 10
MOST_REPEATED = 20                      # percent of the words
FLOOR = (0.05, 0.04, 0.10, 0.12)
#: For normal vectors of 4 statistics, the covariance of the nearest 60 % is this much too small:
#: 0.6 over the chi-square distribution (6) at the 0.6 quantile (4.0446) of the chi-square distribution (4).
CONSISTENCY = 0.6 / 0.32936
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VECTOR = (
    "ln((word_chars + 100) / (n_words + 20))",
    "sqrt(n_symbols / (word_chars + 100))",
    "sqrt(n_dup_lines / (n_words / 10 + 10))",
    "sqrt(n_repeat_words / (n_words + 20))",
)
P = len(VECTOR)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
BROADCAST_ROWS = 20_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated_words(h: np.ndarray, n: int, k: int = 5) -> int:
    """Words in windows (hashes ``h``) that are found twice or more in the text."""
    x = np.sort(h)
    twice = x[1:][x[1:] == x[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(h, twice))
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return int((np.cumsum(cover)[:n] > 0).sum())


def text_stats(col, k: int = 5) -> np.ndarray:
    """The statistics (rows x STATS) of an Arrow string column."""
    data, off = W.text_bytes(col)
    out = np.zeros((len(off) - 1, len(STATS)), np.int64)
    for i, j, part, po in W.slices(data, off):
        start, end, first = W.find_words(part, po)
        roll = W.rolling(W.word_hashes(part, start, end, 9), k)
        inside = ~W._SPACE[part] & ((part & 0xC0) != 0x80)
        out[i:j, 0] = np.diff(first)
        for c, mask in ((1, inside), (2, _SYMBOL[part])):
            total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
            out[i:j, c] = total[po[1:]] - total[po[:-1]]
        raw = part.tobytes()
        for r in range(j - i):
            lines = [x for x in raw[po[r]:po[r + 1]].split(b"\n") if x.strip()]
            out[i + r, 3] = len(lines) - len(set(lines))
            a, b = int(first[r]), int(first[r + 1])
            if b - a > k:
                out[i + r, 4] = repeated_words(roll[a:b - k + 1], b - a, k)
    return out


def with_stats(docs: DataFrame) -> DataFrame:
    """(doc, n_words, ...): ``doc`` holds all columns of ``docs``."""
    text = docs.columns.index("text")

    def run(batches):
        for b in batches:
            own = b.column(0)
            got = text_stats(own.flatten()[text])
            yield pa.RecordBatch.from_arrays([own] + [pa.array(got[:, c]) for c in range(len(STATS))],
                                             ["doc", *STATS])
        W.release()

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return packed.mapInArrow(run, T.StructType([*packed.schema.fields, *[T.StructField(c, T.LongType()) for c in STATS]]))


def light_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, ...)."""
    def run(batches):
        for b in batches:
            got = text_stats(b.column(3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2)]
                                             + [pa.array(got[:, c]) for c in range(len(STATS))],
                                             ["doc_id", "lang", "source", *STATS])
        W.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text").mapInArrow(
        run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in STATS))


def base_failed():
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words")


def vector(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.expr(x).alias(f"x{i}") for i, x in enumerate(VECTOR)])


def groups(df: DataFrame) -> DataFrame:
    """Each row once for its language and source, once for its language, once for all."""
    levels = F.array(F.struct(F.lit(2).alias("level"), F.col("lang").alias("l"), F.col("source").alias("s")),
                     F.struct(F.lit(1).alias("level"), F.col("lang").alias("l"), F.lit(None).cast("string").alias("s")),
                     F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("l"), F.lit(None).cast("string").alias("s")))
    return df.select(F.explode(levels).alias("g"), *[f"x{i}" for i in range(P)])


def _fit(mean: np.ndarray, cov: np.ndarray) -> tuple[list[float], float]:
    """Upper triangle of the inverse of the floored covariance, and its log determinant."""
    cov = cov + np.diag(np.square(FLOOR))
    inverse = np.linalg.inv(cov)
    return [float(inverse[i, j] * (1 if i == j else 2)) for i, j in PAIRS], float(np.linalg.slogdet(cov)[1])


FIT = "level int, l string, s string, n long, mean array<double>, inverse array<double>, logdet double"


def distance() -> F.Column:
    """Squared Mahalanobis distance of x0.. to the row's estimate."""
    return F.expr(" + ".join(f"inverse[{q}] * (x{i} - mean[{i}]) * (x{j} - mean[{j}])" for q, (i, j) in enumerate(PAIRS)))


def with_fit(df: DataFrame, fit: DataFrame, few: bool) -> DataFrame:
    """``df`` (with struct ``g``) and its group's estimate; broadcast only when counted few."""
    side = F.broadcast(fit) if few else fit
    return df.join(side, (F.col("g.level") == F.col("level")) & F.col("g.l").eqNullSafe(F.col("l"))
                   & F.col("g.s").eqNullSafe(F.col("s")))


def estimates(stats: DataFrame) -> tuple[DataFrame, bool]:
    """(table FIT, few): the MCD estimate of every group with enough documents."""
    rows = groups(vector(stats.where(~base_failed())))
    key = [F.col("g.level").alias("level"), F.col("g.l").alias("l"), F.col("g.s").alias("s")]
    middle = rows.groupBy(*key).agg(F.count("*").alias("n"), *[F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"m{i}") for i in range(P)])
    middle = cut(middle.where(f"n >= {LEAST}"), "medians")
    few = middle.count() <= BROADCAST_ROWS
    side = F.broadcast(middle) if few else middle
    spread = (rows.join(side, (F.col("g.level") == F.col("level")) & F.col("g.l").eqNullSafe(F.col("l"))
                        & F.col("g.s").eqNullSafe(F.col("s")))
              .groupBy("level", "l", "s").agg(F.first("n").alias("n"), *[F.first(f"m{i}").alias(f"m{i}") for i in range(P)],
                                              *[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}")
                                                for i in range(P)]))

    def begin(frames):
        for f in frames:
            out = f[["level", "l", "s", "n"]].copy()
            got = [(m := f.loc[r, [f"m{i}" for i in range(P)]].to_numpy(float),
                    _fit(m, np.diag(np.square(1.4826 * f.loc[r, [f"d{i}" for i in range(P)]].to_numpy(float)))))
                   for r in f.index]
            out["mean"] = [m.tolist() for m, _ in got]
            out["inverse"] = [x[0] for _, x in got]
            out["logdet"] = [x[1] for _, x in got]
            yield out

    def concentrate(frames):
        for f in frames:
            out = f[["level", "l", "s", "n"]].copy()
            means, inverses, dets = [], [], []
            for r in f.index:
                h = float(f.loc[r, "h"])
                m = np.array([f.loc[r, f"s{i}"] for i in range(P)], float) / h
                c = np.zeros((P, P))
                for i, j in PAIRS:
                    c[i, j] = c[j, i] = f.loc[r, f"s{i}_{j}"] / h - m[i] * m[j]
                inverse, det = _fit(m, c * CONSISTENCY)
                means.append(m.tolist())
                inverses.append(inverse)
                dets.append(det)
            out["mean"], out["inverse"], out["logdet"] = means, inverses, dets
            yield out

    fit = cut(spread.mapInPandas(begin, FIT), "fit")
    for _ in range(STEPS):
        far = with_fit(rows, fit, few).withColumn("d", distance())
        limit = far.groupBy("level", "l", "s").agg(F.percentile_approx("d", SHARE, 10000).alias("most"))
        limit = cut(fit.alias("f").join(limit.alias("m"), (F.col("f.level") == F.col("m.level")) & F.col("f.l").eqNullSafe(F.col("m.l"))
                                        & F.col("f.s").eqNullSafe(F.col("m.s"))).select("f.*", "m.most"), "limits")
        near = with_fit(rows, limit, few).withColumn("d", distance()).where("d <= most")
        sums = near.groupBy("level", "l", "s").agg(
            F.first("n").alias("n"), F.count("*").alias("h"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)],
            *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in PAIRS])
        last = fit.agg(F.sum("logdet")).first()[0]
        fit = cut(sums.mapInPandas(concentrate, FIT), "fit")
        now = fit.agg(F.sum("logdet")).first()[0]
        if last is not None and abs(last - now) < 1e-9 * max(1.0, abs(last)):
            break
    return fit, few


def judge(df: DataFrame, fit: DataFrame, few: bool, lang: str = "lang", source: str = "source") -> DataFrame:
    """``df`` (with the statistics) and ``base_failed``, ``distance``, ``kept``: the
    distance to the finest estimate that there is."""
    out = vector(df)
    wanted = {2: (F.col(lang), F.col(source)), 1: (F.col(lang), F.lit(None)), 0: (F.lit(None), F.lit(None))}
    for level, (a, b) in wanted.items():
        side = fit.where(f"level = {level}").select(F.col("l").alias(f"l{level}"), F.col("s").alias(f"s{level}"),
                                                    F.struct("mean", "inverse").alias(f"f{level}"))
        side = F.broadcast(side) if few else side
        on = F.lit(True)
        if level > 0:
            on = a.eqNullSafe(F.col(f"l{level}"))
        if level > 1:
            on = on & b.eqNullSafe(F.col(f"s{level}"))
        if level == 0:
            # one row at most: read as a constant
            whole = side.select(f"f{level}").first()
            known = F.struct(*[F.array(*[F.lit(float(v)) for v in whole[0][c]]).alias(c) for c in ("mean", "inverse")]) if whole \
                else F.lit(None).cast("struct<mean:array<double>,inverse:array<double>>")
            out = out.withColumn("f0", known)
        else:
            out = out.join(side, on, "left").drop(f"l{level}", f"s{level}")
    out = out.withColumn("__f", F.coalesce("f2", "f1", "f0")).withColumn("mean", F.col("__f.mean")).withColumn("inverse", F.col("__f.inverse"))
    out = out.withColumn("distance", distance()).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT)).drop(
        "f0", "f1", "f2", "__f", "mean", "inverse", *[f"x{i}" for i in range(P)])


def verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, STATS, base_failed, distance, kept) for each document."""
    stats = cut(light_stats(docs), "stats")
    fit, few = estimates(stats)
    return judge(stats, fit, few).select("doc_id", *STATS, "base_failed", "distance", "kept")


def filtered(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs``."""
    fit, few = estimates(cut(light_stats(docs), "stats"))
    full = with_stats(docs).withColumn("__lang", F.col("doc.lang")).withColumn("__source", F.col("doc.source"))
    return judge(full, fit, few, "__lang", "__source").where("kept").select("doc.*")

"""Long lists: class distributions over 500 classes, cleaning with 1,000 names."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import sparse as SP
from ..functions import text as T
from . import sqlgen as S
from .catalog import r6, register
from .fixtures import spread, table
from .q_text import NW, WS, docs, s_rr, s_strip_u

N_CLASSES = 500
CLASSES = [f"c{i}" for i in range(N_CLASSES)]


def _rollouts(dialect: str) -> list[str]:
    """Columns over ``e`` (event_id): three to five of 500 classes a side, some twice, out of range, or of no list."""
    idiv = (lambda a, b: f"({a} div {b})") if dialect == "spark" else (lambda a, b: f"({a} // {b})")
    t = (lambda x: f"CAST({x} AS STRING)") if dialect == "spark" else (lambda x: f"CAST({x} AS VARCHAR)")
    kv = lambda c, v: f"concat('c', {t(c)}, ':', {v})"
    g = idiv("e", 8)
    gt = ", ', ', ".join(kv(f"({g} * {7 + i} + {i}) % {N_CLASSES}", f"concat('0.', {t(f'({g} + {i}) % 7 + 1')})") for i in range(4))
    pred = ", ', ', ".join(kv(f"({g} * {7 + i} + {i} + (e % 3) * {i}) % {N_CLASSES + 20}",
                              f"CASE WHEN e % 17 = {i} THEN '1.5' ELSE concat('0.', {t(f'(e + {i}) % 9')}) END") for i in range(5))
    think = f"CASE WHEN e % 11 = 0 THEN '' ELSE concat('<think>item ', {t('e')}, CASE WHEN e % 7 = 0 THEN ' is 0.5' ELSE '' END, '</think>') END"
    return ["e AS row_id", f"concat({think}, CASE WHEN e % 19 = 0 THEN '' ELSE concat('<answer>{{', {pred}, '}}</answer>') END) AS completion",
            f"concat('<answer>{{', {gt}, '}}</answer>') AS solution"]


def _dense_sql() -> str:
    """The same by vectors of all 500 classes."""
    ans, think = S.norm(S.answer_a("completion")), S.think_a("completion")
    pk, pv = S.kv(ans, K.KV_PATTERN_LOOSE)
    gk, gv = S.kv(S.norm(S.answer_a("solution")), K.KV_PATTERN_LOOSE)
    fk, fv = S.kv(S.strip(f"regexp_extract(completion, {S.q('(?s)<answer>(.*?)</answer>')}, 1)"), K.KV_PATTERN_LOOSE)
    one = lambda k, v: (f"list_transform(range({N_CLASSES}), lambda i: coalesce(list_extract(list_transform(list_filter(list_zip("  # noqa: E731
                        f"list_reverse({k}), list_reverse({v})), lambda z: z[1] = 'c' || i), lambda z: CASE WHEN TRY_CAST(z[2] AS DOUBLE) BETWEEN 0 AND 1 "
                        "THEN TRY_CAST(z[2] AS DOUBLE) ELSE 0.0 END), 1), 0.0))")
    clip = lambda x: f"list_transform({x}, lambda v: greatest(v, 1e-10))"
    return f"""WITH f AS (SELECT {', '.join(_rollouts('duckdb'))} FROM (SELECT event_id AS e FROM events)),
      kv AS (SELECT row_id, {think} AS think, {pk} AS pk, {pv} AS pv, {gk} AS gk, {gv} AS gv, {fk} AS fk, {fv} AS fv,
                    regexp_full_match(completion, {S.q('(?s)' + K.FORMAT_TAGS)}) AS ok FROM f),
      v AS (SELECT row_id, think, ok, {one('pk', 'pv')} AS p, {one('gk', 'gv')} AS g, {one('fk', 'fv')} AS fp FROM kv),
      s AS (SELECT *, list_sum({clip('p')}) AS sp, list_sum({clip('g')}) AS sg, list_sum(fp) AS fs FROM v),
      r AS (SELECT row_id, think, ok, fs, list_sum(list_transform(list_zip({clip('g')}, {clip('p')}),
                   lambda z: z[1] / sg * ln((z[1] / sg) / (z[2] / sp)))) AS kl,
                   list_sum(list_transform(list_zip(g, p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / {N_CLASSES} AS mse FROM s)
      SELECT row_id, {S.r6('kl')} AS kl, {S.r6(f"exp(-0.5 * kl - 0.5 * mse) * CASE WHEN regexp_matches(think, {S.q(K.NUMBER_LEAK)}) THEN 0.1 ELSE 1.0 END")}
      AS r_accuracy, {S.r6("CASE WHEN NOT ok OR fs = 0 THEN 0.0 ELSE exp(-abs(fs - 1.0)) END")} AS r_format FROM r"""


@register("b8_accuracy_500_classes", _dense_sql())
def q_b8_500(spark, sf_dir):
    """B1, B3, B4, B8 and B9 over 500 classes, kept sparse."""
    d = spread(table(spark, sf_dir, "events").selectExpr("event_id AS e")).selectExpr(*_rollouts("spark"))
    d = SP.score_sparse_rollouts(d, CLASSES)
    return d.select("row_id", r6("kl").alias("kl"), r6("r_accuracy").alias("r_accuracy"), r6("r_format").alias("r_format"))


# ------------------------------------------------------------------ 1,000 names
_SYLLABLES = ("th re an on er ti es at in ou nd le de en la qu ie au ei sc un io al ar st ed ha is or to ea ing").split()
#: Names of one and of two syllables, some of which begin others; every third one goes with a further word.
NAMES = [a + b + (" of" if (i + j) % 3 == 0 else "") for i, a in enumerate(_SYLLABLES) for j, b in enumerate(["", *_SYLLABLES[:31]])][:1000]
WORDS = [x + "h" for x in NAMES if " " not in x]


@register("t6_thousand_names", "WITH d AS (SELECT doc_id, unnest(regexp_split_to_array(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL), "
          f"m AS (SELECT doc_id, regexp_extract(line, {S.q('(?i)(?:^|' + NW + ')(' + '|'.join(NAMES) + ')(?:' + NW + '|$)')}, 1) AS name FROM d) "
          "SELECT doc_id, count(*) AS lines, CAST(count(nullif(name, '')) AS BIGINT) AS named, "
          "max(lower(nullif(name, ''))) AS last_name FROM m GROUP BY 1")
def q_t6_names(spark, sf_dir):
    """T6 over 1,000 names, line by line: the first whole name (any case) of each line, and how many lines have one."""
    lines = docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    name = F.regexp_extract(T.extract_first_class("line", NAMES), "<answer>(.*)</answer>", 1)
    return (lines.select("doc_id", F.nullif(name, F.lit("")).alias("name")).groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias("lines"), F.count("name").alias("named"), F.max(F.lower("name")).alias("last_name")))


def _s_sentences(x):
    e = K.SENTENCE_ENDERS.replace(".", r"\.").replace("?", r"\?").replace("!", r"\!")
    pieces = f"regexp_extract_all(replace({x}, chr(10), ' '), {S.q(f'[^{e}]*[{e}]|[^{e}]+\\z')}, 0)"
    keep = f"NOT regexp_matches(s, {S.q(f'[{e}]' + chr(92) + 'z')}) OR NOT regexp_matches(s, {S.q('|'.join(WORDS))})"
    return s_strip_u(s_rr(f"array_to_string(list_filter({pieces}, lambda s: {keep}), '')", rf"{WS}+", "' '"))


@register("t5_thousand_words", f"SELECT doc_id, {_s_sentences('text')} AS cleaned FROM documents")
def q_t5_words(spark, sf_dir):
    """T5 with a long list of words."""
    return docs(spark, sf_dir).select("doc_id", T.remove_sentences_with_words("text", WORDS).alias("cleaned"))

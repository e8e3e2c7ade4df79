"""Free-text cleaning and extraction over ``documents`` / ``conversations`` (F4):
T1-T7, P11, P15.  Whole tables, whole texts."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from . import sqlgen as S
from .catalog import register
from .fixtures import table

BANNED = ["the", "and", "die", "que"]          # T4 / T6 class-like words
SENTENCE_WORDS = ["the", "die"]                 # T5 words (case-sensitive)
P11_OLD = "this distribution."
P11_NEW = "this distribution concisely in under 100 words."

NL2 = "concat(chr(10), chr(10))"
# Java (?U)\s as an RE2 class
WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]"
# word character outside the Unicode word class (emulates Python's \b in RE2)
NW = r"[^\pL\pN\pM_]"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def augmented(spark, sf_dir):
    """F4 text with numbers and a target list appended."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(
        "text", F.lit(" Identified "), (F.col("n_chars") % 9).cast("string"),
        F.lit(" potential targets. Target 1: item "), F.col("doc_id").cast("string"),
        F.lit("\n at [1,2,3,4] 0.5")).alias("text"))


AUG_SQL = ("WITH d AS (SELECT doc_id, concat(text, ' Identified ', CAST(n_chars % 9 AS VARCHAR), "
           "' potential targets. Target 1: item ', CAST(doc_id AS VARCHAR), chr(10), ' at [1,2,3,4] 0.5') AS text "
           "FROM documents) ")


def s_rr(x, pat, rep="''"):
    return f"regexp_replace({x}, {S.q(pat)}, {rep}, 'g')"


def s_strip_u(x):
    return s_rr(x, rf"\A{WS}+|{WS}+\z")


def s_process(x, variant):
    collapse = rf"\n{WS}*\n"
    if variant == "b":
        return s_rr(x, collapse, NL2)
    s = s_rr(x, collapse, NL2)
    s = s_rr(s, rf"(?m)^{WS}+")
    s = s_rr(s, rf"(?m){WS}+$")
    s = s_rr(s, collapse, NL2)
    if variant == "c":
        s = f"replace(replace({s}, chr(10), ''), chr(13), '')"
    return s


@register("t1_process", "SELECT doc_id, " + ", ".join(
    f"{s_process('text', v)} AS processed_{v}" for v in "abc") + " FROM documents")
def q_t1(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *[T.process_text("text", v).alias(f"processed_{v}") for v in "abc"])


@register("t2_remove_floats", AUG_SQL + "SELECT doc_id, "
          + f"{s_rr(s_rr('text', K.COORD_RUN), K.FLOAT_SIMPLE)} AS cleaned_a, {s_rr('text', K.FLOAT_SIMPLE)} AS cleaned_b "
          "FROM d")
def q_t2(spark, sf_dir):
    return augmented(spark, sf_dir).select("doc_id", T.remove_floats("text", "a").alias("cleaned_a"),
                                           T.remove_floats("text", "b").alias("cleaned_b"))


@register("t3_remove_floats_full", AUG_SQL + f"SELECT doc_id, {s_rr('text', K.FLOAT_FULL)} AS cleaned FROM d")
def q_t3(spark, sf_dir):
    return augmented(spark, sf_dir).select("doc_id", T.remove_floats_full("text").alias("cleaned"))


def _s_remove_words(x):
    alt = "|".join(BANNED)
    pat = rf"(?i)(^|{NW})(?:{alt})({NW}|$)"
    once = s_rr(x, pat, r"'\1\2'")
    twice = s_rr(once, pat, r"'\1\2'")          # a removal consumes its boundary: second pass gets neighbours
    return s_strip_u(s_rr(twice, rf"{WS}{{2,}}", "' '"))


@register("t4_remove_class_names", f"SELECT doc_id, {_s_remove_words('text')} AS cleaned FROM documents")
def q_t4(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.remove_class_names("text", BANNED).alias("cleaned"))


def _s_remove_sentences(x):
    e = K.SENTENCE_ENDERS.replace(".", r"\.").replace("?", r"\?").replace("!", r"\!")
    t = f"replace({x}, chr(10), ' ')"
    pieces = f"regexp_extract_all({t}, {S.q(f'[^{e}]*[{e}]|[^{e}]+\\z')}, 0)"
    keep = (f"NOT regexp_matches(s, {S.q(f'[{e}]' + chr(92) + 'z')}) OR ("
            + " AND ".join(f"NOT contains(s, {S.q(w)})" for w in SENTENCE_WORDS) + ")")
    joined = f"array_to_string(list_filter({pieces}, lambda s: {keep}), '')"
    return s_strip_u(s_rr(joined, rf"{WS}+", "' '"))


@register("t5_remove_sentences", f"SELECT doc_id, {_s_remove_sentences('text')} AS cleaned FROM documents")
def q_t5(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.remove_sentences_with_words("text", SENTENCE_WORDS).alias("cleaned"))


def _s_first_class(x):
    pat = S.q(rf"(?i)(?:^|{NW})({'|'.join(BANNED)})(?:{NW}|$)")
    return (f"CASE WHEN regexp_matches({x}, {pat}) THEN concat('<answer>', regexp_extract({x}, {pat}, 1), '</answer>') "
            "ELSE '' END")


@register("t6_first_class", f"SELECT doc_id, {_s_first_class('text')} AS answer FROM documents")
def q_t6(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.extract_first_class("text", BANNED).alias("answer"))


_T7 = (AUG_SQL + "SELECT doc_id, CASE WHEN regexp_matches(text, {c}) THEN regexp_extract(text, {c}, 1) END "
       "AS total_targets, CAST(len(regexp_extract_all(text, {t}, 1)) AS INTEGER) AS num_targets, "
       "array_to_string(list_transform(regexp_extract_all(text, {t}), lambda m: concat('Target ', "
       "regexp_extract(m, {t}, 1), ': ', {s})), '|') AS targets FROM d").format(
    c=S.q(K.TARGET_COUNT), t=S.q(K.TARGET_LINE), s=s_strip_u(f"regexp_extract(m, {S.q(K.TARGET_LINE)}, 2)"))


@register("t7_extract_info", _T7)
def q_t7(spark, sf_dir):
    info = T.extract_info("text")
    return augmented(spark, sf_dir).select("doc_id", info["total_targets"].alias("total_targets"),
                                           info["num_targets"].alias("num_targets"),
                                           F.array_join(info["targets"], "|").alias("targets"))


@register("p11_replace", f"SELECT doc_id, replace(concat(text, ' ', {S.q(P11_OLD)}), {S.q(P11_OLD)}, "
          f"{S.q(P11_NEW)}) AS prompt FROM documents")
def q_p11(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.concat("text", F.lit(" " + P11_OLD)).alias("t"))
    return d.select("doc_id", T.replace_phrase("t", P11_OLD, P11_NEW).alias("prompt"))


_P15_IN = "concat('system', chr(10), 'assistant', chr(10), text)"


@register("p15_assistant", "SELECT conv_id, turn, CASE WHEN regexp_matches({x}, '(?s)assistant\\n(.*)') THEN "
          "{s} END AS assistant FROM conversations".format(
              x=_P15_IN, s=s_strip_u(f"regexp_extract({_P15_IN}, '(?s)assistant\\n(.*)', 1)")))
def q_p15(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    x = F.concat(F.lit("system\nassistant\n"), F.col("text"))
    return c.select("conv_id", "turn", T.extract_assistant(x).alias("assistant"))

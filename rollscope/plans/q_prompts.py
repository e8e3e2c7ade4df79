"""Dataset building and prompts (F5 from ``part``, F4, F1): P1-P16, L1, L2, S3, S9, X14."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import constants as K
from ..functions import text as T
from ..operators import prompts as P
from ..session import checkpoint_path
from ..sources import io as IO
from . import sqlgen as S
from .catalog import register
from .fixtures import f1_rollouts, f1_sql, f5_items, f5_items_sql, table
from .q_text import s_rr, s_strip_u

F5 = f"WITH items AS ({f5_items_sql()}) "
GC = K.GENERATOR_CLASSES


def s_fill(template: str, **exprs) -> str:
    parts = [S.q(v) if k == "lit" else exprs[v] for k, v in P.template_parts(template)]
    return "concat(" + ", ".join(parts) + ")"


S_ONEHOT = "concat('{', concat_ws(', ', " + ", ".join(
    f"concat('''{c}'':', CASE WHEN target = {S.q(c)} THEN '1.0' ELSE '0.0' END)" for c in GC) + "), '}')"


def _items_with_text(spark, sf_dir):
    d = f5_items(spark, sf_dir)
    a = P.one_hot_answer("target", GC)
    return d.select("*", a.alias("answer")).select("*", P.question("answer").alias("problem"),
                                                  P.solution("answer").alias("solution"))


@register("p1_onehot", F5 + f"SELECT row_id, {S_ONEHOT} AS answer FROM items")
def q_p1(spark, sf_dir):
    return f5_items(spark, sf_dir).select("row_id", P.one_hot_answer("target", GC).alias("answer"))


@register("p2_slots", F5 + "SELECT row_id, concat(target, ': {', array_to_string(list_transform(range(20), lambda i: "
          "concat(chr(39), c[i + 1], chr(39), ':prob_', i)), ', '), '}') AS slots FROM items, (SELECT ["
          + ", ".join(S.q(c) for c in GC) + "] AS c)")
def q_p2(spark, sf_dir):
    """P2 in the generator's quoted form, after each item's class."""
    return f5_items(spark, sf_dir).select("row_id", F.concat("target", F.lit(": "), F.lit(P.slot_template(GC))).alias("slots"))


_S_ITEMS_TXT = (F5 + f", t AS (SELECT *, {s_fill(K.GENERATOR_QUESTION, answer='a')} AS problem, "
                "concat('<answer>', a, '</answer>') AS solution FROM (SELECT *, " + S_ONEHOT + " AS a FROM items)) ")


@register("p3_template", _S_ITEMS_TXT + "SELECT row_id, problem, solution FROM t")
def q_p3(spark, sf_dir):
    return _items_with_text(spark, sf_dir).select("row_id", "problem", "solution")


@register("p4_sft", _S_ITEMS_TXT + "SELECT row_id, 'user' AS role_0, concat('<image>', problem) AS content_0, "
          "'assistant' AS role_1, solution AS content_1, image_path AS image_0 FROM t")
def q_p4(spark, sf_dir):
    d = _items_with_text(spark, sf_dir).select("row_id", P.sft_record("problem", "solution", "image_path").alias("r"))
    m = F.col("r.messages")
    return d.select("row_id", m[0]["role"].alias("role_0"), m[0]["content"].alias("content_0"),
                    m[1]["role"].alias("role_1"), m[1]["content"].alias("content_1"),
                    F.col("r.images")[0].alias("image_0"))


@register("p5_text_prompt", _S_ITEMS_TXT + f"SELECT row_id, 2 AS n_messages, 'system' AS role_0, {S.q(K.SYSTEM_PROMPT)} "
          "AS text_0, 'user' AS role_1, problem AS text_1 FROM t")
def q_p5(spark, sf_dir):
    """P5 + P7: a table without an image column gets the text conversation."""
    d = _items_with_text(spark, sf_dir).select("row_id", "problem", F.lit("x").alias("messages"))
    p = P.with_prompt(d).select("row_id", "prompt")
    pr = F.col("prompt")
    return p.select("row_id", F.size(pr).alias("n_messages"), pr[0]["role"].alias("role_0"),
                    pr[0]["content"][0]["text"].alias("text_0"), pr[1]["role"].alias("role_1"),
                    pr[1]["content"][0]["text"].alias("text_1"))


@register("p6_image_prompt", _S_ITEMS_TXT + "SELECT row_id, 'user' AS role_0, 2 AS n_parts, 'image' AS type_0, "
          "'text' AS type_1, problem AS text_1 FROM t")
def q_p6(spark, sf_dir):
    p = P.with_prompt(_items_with_text(spark, sf_dir).withColumn("image", F.col("image_path"))).select("row_id", "prompt")
    c = F.col("prompt")[0]["content"]
    return p.select("row_id", F.col("prompt")[0]["role"].alias("role_0"), F.size(c).alias("n_parts"),
                    c[0]["type"].alias("type_0"), c[1]["type"].alias("type_1"), c[1]["text"].alias("text_1"))


# --------------------------------------------------------------- P8 on documents
def _s_t5(x, words):
    from . import q_text as QT
    saved = QT.SENTENCE_WORDS
    QT.SENTENCE_WORDS = list(words)
    try:
        return QT._s_remove_sentences(x)
    finally:
        QT.SENTENCE_WORDS = saved


def _s_t3(x):
    return s_rr(x, K.FLOAT_FULL)


_CATS = ", ".join(f"'{c}'" for c in K.EMOTION_CLASSES_COT)
_SLOTS = P.slot_template(K.EMOTION_CLASSES_COT, quoted=False)


@register("p8a_emotion_prompt", "SELECT doc_id, " + s_fill(
    K.SECOND_STAGE_EMOTION, categories=S.q(_CATS), description=_s_t5("text", K.EMOTION_CLASSES_COT),
    slots=S.q(_SLOTS)) + " AS problem FROM documents")
def q_p8a(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", P.second_stage_problem("emotion", "text").alias("problem"))


@register("p8b_multibox_prompt", "SELECT doc_id, " + s_fill(
    K.SECOND_STAGE_MULTIBOX, target="lang", description=_s_t3("text")) + " AS problem FROM documents")
def q_p8b(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", P.second_stage_problem("multibox", "text", "lang").alias("problem"))


@register("p8c_onebox_prompt", "SELECT doc_id, " + s_fill(
    K.SECOND_STAGE_ONEBOX, target="lang", description="text") + " AS problem FROM documents")
def q_p8c(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", P.second_stage_problem("onebox", "text", "lang").alias("problem"))


@register("p8d_category_prompt", "SELECT doc_id, " + s_fill(
    K.SECOND_STAGE_CATEGORY, description=_s_t3("text")) + " AS problem FROM documents")
def q_p8d(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", P.second_stage_problem("category", "text").alias("problem"))


@register("p8e_emotion_example_prompt", "SELECT doc_id, " + s_fill(
    K.SECOND_STAGE_EMOTION_EXAMPLE, categories=S.q(K.EXAMPLE_EMOTION_CATEGORIES),
    description=_s_t5("text", K.EMOTION_CLASSES), example=S.q(K.EXAMPLE_EMOTION_OUTPUT)) + " AS problem FROM documents")
def q_p8e(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", P.second_stage_problem("emotion_example", "text").alias("problem"))


# ------------------------------------------------------------------- P9, P10
def _region_text(k, target, size):
    """Region prompt text from F5 (every 7th row has no box, every 11th no 'contains')."""
    return F.concat(
        F.when(k % 7 == 0, F.lit("Region")).otherwise(F.concat(
            F.lit("Region at bounding box ["), size.cast("string"), F.lit(", "), (k % 97).cast("string"), F.lit(", "),
            (size + 50).cast("string"), F.lit(", "), (k % 97 + 40).cast("string"), F.lit("]"))),
        F.when(k % 11 == 0, F.lit(" shows ")).otherwise(F.lit(" contains a ")), target,
        F.lit(", which is visible. You should explain."))


_S_REGION = ("concat(CASE WHEN row_id % 7 = 0 THEN 'Region' ELSE concat('Region at bounding box [', "
             "CAST(p_size AS VARCHAR), ', ', CAST(row_id % 97 AS VARCHAR), ', ', CAST(p_size + 50 AS VARCHAR), ', ', "
             "CAST(row_id % 97 + 40 AS VARCHAR), ']') END, CASE WHEN row_id % 11 = 0 THEN ' shows ' "
             "ELSE ' contains a ' END, target, ', which is visible. You should explain.')")


def _s_region_prompt(t):
    pb, pc = S.q(r"bounding box \[(.*?)\]"), S.q(r"contains (.*?)(?:You|$)")
    box = f"concat('[', regexp_extract({t}, {pb}, 1), ']')"
    contains = s_strip_u(f"regexp_extract({t}, {pc}, 1)")
    obj = f"split_part(split_part({contains}, ', which', 1), '.', 1)"
    return (f"CASE WHEN regexp_matches({t}, {pb}) AND regexp_matches({t}, {pc}) THEN "
            f"{s_fill(K.REGION_PROMPT, box=box, contains=contains, object=obj)} ELSE {t} END")


@register("p9_region_prompt", F5 + f"SELECT row_id, {_s_region_prompt('rt')} AS prompt FROM "
          f"(SELECT row_id, {_S_REGION} AS rt FROM items)")
def q_p9(spark, sf_dir):
    d = f5_items(spark, sf_dir)
    t = _region_text(F.col("row_id"), F.col("target"), F.col("p_size"))
    return d.select("row_id", t.alias("rt")).select("row_id", P.region_prompt("rt").alias("prompt"))


@register("p10_assemble", f"WITH f1 AS ({f1_sql()}) SELECT row_id, concat('<think>', {S.think_a('completion')}, "
          "'</think>', '<answer>', replace(replace(completion, chr(10), ''), chr(13), ''), '</answer>') AS rollout, "
          f"concat('<think>', {S.think_a('completion')}, '</think>', '<answer>', completion, '</answer>') AS rollout_kept FROM f1")
def q_p10(spark, sf_dir):
    d = f1_rollouts(spark, sf_dir)
    think = F.concat(F.lit("<think>"), T.extract_think("completion", "a"), F.lit("</think>"))
    # the completion holds newlines: deleted in the box tasks' form, kept in the other
    return d.select("row_id", P.assemble_rollout(think, "completion").alias("rollout"),
                    P.assemble_rollout(think, "completion", strip_newlines=False).alias("rollout_kept"))


# ------------------------------------------------------------------ P12 - P14
@register("p12_truncate", "SELECT conv_id, CAST(len(t) AS INTEGER) AS n_turns, CAST(len(k) AS INTEGER) AS n_kept, "
          "k[1] AS first_kept_turn, array_to_string(m, '') AS mask FROM (SELECT conv_id, t, t[greatest(1, len(t) - 3 + 1):] AS k, "
          "m[greatest(1, len(m) - 3 + 1):] AS m FROM (SELECT conv_id, list(turn ORDER BY turn) AS t, "
          "list(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END ORDER BY turn) AS m FROM conversations GROUP BY conv_id))")
def q_p12(spark, sf_dir):
    """Ids and their mask are cut together."""
    m = F.struct("turn", (F.col("role") == "assistant").cast("int").alias("m"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("t"))
    c = c.select("conv_id", F.size("t").alias("n_turns"), P.truncate_left(F.col("t.turn"), F.col("t.m"), 3).alias("k"))
    return c.select("conv_id", "n_turns", F.size("k.ids").alias("n_kept"), F.col("k.ids")[0].alias("first_kept_turn"),
                    F.array_join(F.col("k.mask").cast("array<string>"), "").alias("mask"))


@register("p13_fanout", F5 + "SELECT row_id, gen_idx FROM items, range(8) r(gen_idx)")
def q_p13(spark, sf_dir):
    return P.fan_out(f5_items(spark, sf_dir).select("row_id"), 8).select("row_id", "gen_idx")


_P14 = (F5 + f", f1 AS ({f1_sql()}), pr AS (SELECT row_id AS group_id, gen_idx FROM items, range(8) r(gen_idx)) ")


@register("p14_attach", _P14 + "SELECT pr.group_id, pr.gen_idx, f1.row_id AS response_id FROM pr JOIN f1 "
          "ON pr.group_id = f1.group_id AND pr.gen_idx = f1.gen_idx")
def q_p14(spark, sf_dir):
    prompts = P.fan_out(f5_items(spark, sf_dir).select(F.col("row_id").alias("group_id")), 8)
    resp = f1_rollouts(spark, sf_dir).select("group_id", "gen_idx", F.col("row_id").alias("response_id"))
    matched, _, _ = P.attach_responses(prompts, resp)
    return matched.select("group_id", "gen_idx", "response_id")


@register("p14_unmatched", _P14 + "SELECT group_id, gen_idx, 'prompt' AS side FROM pr WHERE NOT EXISTS (SELECT 1 FROM f1 "
          "WHERE f1.group_id = pr.group_id AND f1.gen_idx = pr.gen_idx) UNION ALL SELECT group_id, gen_idx, 'response' FROM f1 "
          "WHERE NOT EXISTS (SELECT 1 FROM pr WHERE f1.group_id = pr.group_id AND f1.gen_idx = pr.gen_idx)")
def q_p14u(spark, sf_dir):
    prompts = P.fan_out(f5_items(spark, sf_dir).select(F.col("row_id").alias("group_id")), 8)
    resp = f1_rollouts(spark, sf_dir).select("group_id", "gen_idx")
    _, prompts, resp = P.attach_responses(prompts, resp)
    return prompts.select("group_id", "gen_idx", F.lit("prompt").alias("side")).unionByName(
        resp.select("group_id", "gen_idx", F.lit("response").alias("side")))


# ------------------------------------------------------------------------ P16
_S_REASON = ("CASE WHEN row_id % 23 = 0 THEN 'bad_type' WHEN row_id % 3 = 0 AND (width = 0 OR height = 0 OR channels = 0) THEN 'empty' "
             "WHEN row_id % 37 = 0 THEN 'bad_ndim' WHEN width IS NULL OR height IS NULL THEN 'missing' WHEN width = 0 OR height = 0 THEN 'zero_size' "
             "WHEN channels NOT IN (1, 3) THEN 'bad_channels' END")


def _reason():
    """Every 23rd item is neither image nor tensor, every third a tensor, every 37th of two dimensions."""
    k = F.col("row_id")
    kind = F.when(k % 23 == 0, F.lit("list")).when(k % 3 == 0, F.lit("tensor")).otherwise(F.lit("image"))
    return P.image_reject_reason("width", "height", "channels", ndim=F.when(k % 37 == 0, 2).otherwise(3), kind=kind)


@register("p16_gate", F5 + f"SELECT row_id, {_S_REASON} AS reject_reason FROM items")
def q_p16(spark, sf_dir):
    return f5_items(spark, sf_dir).select("row_id", _reason().alias("reject_reason"))


@register("p16_summary", F5 + f"SELECT {_S_REASON} AS reject_reason, count(*) AS n FROM items GROUP BY 1")
def q_p16s(spark, sf_dir):
    d = f5_items(spark, sf_dir).select(_reason().alias("reject_reason"))
    return d.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------- L1, L2
@register("l1_fewshot", "SELECT doc_id, lang, fewshot_rank, first_doc FROM (SELECT doc_id, lang, "
          "row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS fewshot_rank, "
          "min(doc_id) OVER (PARTITION BY lang) AS first_doc FROM documents) WHERE fewshot_rank <= 4")
def q_l1(spark, sf_dir):
    d = P.few_shot(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")
    return d.select("doc_id", "lang", F.col("fewshot_rank").cast("long"), F.col("_first").alias("first_doc"))


@register("l2_head", F5 + "SELECT row_id, target FROM items ORDER BY row_id LIMIT 16")
def q_l2(spark, sf_dir):
    return P.head(f5_items(spark, sf_dir).select("row_id", "target"), "row_id")


# --------------------------------------------------------------------- S3, S9
@register("s3_split", F5 + "SELECT row_id, target, split FROM items WHERE split = 'test'")
def q_s3(spark, sf_dir):
    """S3: one split of a saved dataset, by pruning its folders."""
    path = checkpoint_path(spark, "rollscope-io", f"split-{uuid.uuid4().hex}")
    IO.save_dataset(f5_items(spark, sf_dir), path)
    return IO.load_split(spark, path, "test").select("row_id", "target", "split")


@register("s9_summary", F5 + "SELECT target, count(*) AS n FROM items GROUP BY ROLLUP (target)")
def q_s9(spark, sf_dir):
    """Row count per class plus the grand total (target NULL)."""
    return f5_items(spark, sf_dir).rollup("target").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------ X14
def _x14_box():
    k, s = F.col("row_id"), F.col("p_size")
    return B.box(s * 7, (k % 97) * 2, s * 7 + 100.5, (k % 97) * 2 + F.lit(2.5) * (k % 13))


def _s_x14(v, dim, size):  # (NULL stays NULL: greatest and least skip it)
    return f"CASE WHEN {dim} IS NOT NULL THEN CAST(least(greatest(round_even(({v}) * (1000.0 / {dim}), 0), 0), {size - 1}) AS INTEGER)::VARCHAR END"


@register("x14_rescale", F5 + "SELECT row_id, " + ", ".join(
    f"{_s_x14(v, d, 1000)} AS {n}" for v, d, n in [
        ("p_size * 7", "width", "x1"), ("(row_id % 97) * 2", "height", "y1"),
        ("p_size * 7 + 100.5", "width", "x2"), ("(row_id % 97) * 2 + 2.5 * (row_id % 13)", "height", "y2")])
          + " FROM (SELECT * REPLACE (CASE WHEN width > 0 THEN width END AS width) FROM items)")
def q_x14(spark, sf_dir):
    """Items without a usable size have NULL boxes."""
    d = f5_items(spark, sf_dir)
    b = B.rescale_box(_x14_box(), "width", "height")
    return d.select("row_id", *[b[k].cast("string").alias(k) for k in ("x1", "y1", "x2", "y2")])

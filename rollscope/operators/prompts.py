"""Prompt building, fan-out and dataset subsets.

Templates are filled with ``concat`` / ``format_string`` so prompt building is
a projection; fan-out is ``explode(sequence)``; attaching generated
responses is an equi-join on explicit keys (never on row position).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..functions.text import _c


def template_parts(template: str) -> list[tuple[str, str]]:
    """Split a ``str.format``-style template into ("lit", text) / ("slot", name)
    parts; ``{{`` and ``}}`` are literal braces."""
    parts: list[tuple[str, str]] = []
    buf, i = [], 0
    while i < len(template):
        ch = template[i]
        if ch in "{}" and template[i:i + 2] in ("{{", "}}"):
            buf.append(ch)
            i += 2
        elif ch == "{":
            j = template.index("}", i)
            if buf:
                parts.append(("lit", "".join(buf)))
                buf = []
            parts.append(("slot", template[i + 1:j]))
            i = j + 1
        else:
            buf.append(ch)
            i += 1
    if buf:
        parts.append(("lit", "".join(buf)))
    return parts


def fill(template: str, **cols) -> Column:
    """Fill ``{name}`` slots of a fixed template with columns (a ``concat``)."""
    return F.concat(*[F.lit(v) if k == "lit" else _c(cols[v]) for k, v in template_parts(template)])


# ------------------------------------------------------------------ P1 - P4
def one_hot_answer(target, classes: Sequence[str]) -> Column:
    """``{'c1':1.0, 'c2':0.0, ...}`` with 1.0 at the target class."""
    t = _c(target)
    parts = [F.concat(F.lit(f"'{c}':"), F.when(t == c, F.lit("1.0")).otherwise(F.lit("0.0"))) for c in classes]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def slot_template(classes: Sequence[str], quoted: bool = True) -> str:
    """``{'c':prob_0, ...}`` (generator) or ``{c:prob_0,...}`` (prompt)."""
    if quoted:
        return "{" + ", ".join(f"'{c}':prob_{i}" for i, c in enumerate(classes)) + "}"
    return "{" + ",".join(f"{c}:prob_{i}" for i, c in enumerate(classes)) + "}"


def question(answer) -> Column:
    """P3 question text around the one-hot answer."""
    return fill(K.GENERATOR_QUESTION, answer=answer)


def solution(answer) -> Column:
    """P3 solution: ``<answer>...</answer>``."""
    return F.concat(F.lit("<answer>"), _c(answer), F.lit("</answer>"))


def sft_record(question_col, solution_col, path_col) -> Column:
    """struct(messages array<struct<role, content>>, images array<string>)."""
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("<image>"), _c(question_col)).alias("content")),
                   F.struct(F.lit("assistant").alias("role"), _c(solution_col).alias("content")))
    return F.struct(msgs.alias("messages"), F.array(_c(path_col)).alias("images"))


# ------------------------------------------------------------------ P5 - P7
def _part(kind: str, text=None) -> Column:
    return F.struct(F.lit(kind).alias("type"), (F.lit(None).cast("string") if text is None else _c(text)).alias("text"))


def text_conversation(problem, system_prompt: str = K.SYSTEM_PROMPT) -> Column:
    """P5: system + user messages; content is a single text part."""
    return F.array(F.struct(F.lit("system").alias("role"), F.array(_part("text", F.lit(system_prompt))).alias("content")),
                   F.struct(F.lit("user").alias("role"), F.array(_part("text", problem)).alias("content")))


def image_conversation(problem) -> Column:
    """One user message with parts [image, text]."""
    return F.array(F.struct(F.lit("user").alias("role"),
                            F.array(_part("image"), _part("text", problem)).alias("content")))


def with_prompt(df: DataFrame, problem: str = "problem") -> DataFrame:
    """Image conversation when the table has an ``image`` column (a
    path alone does not make it one), else a text conversation and
    ``messages`` dropped (no error if absent)."""
    if "image" in df.columns:
        return df.withColumn("prompt", image_conversation(problem))
    return df.withColumn("prompt", text_conversation(problem)).drop("messages")


# ----------------------------------------------------------------------- P8
def second_stage_problem(task: str, description, target=None, classes: Sequence[str] = K.EMOTION_CLASSES_COT) -> Column:
    """P8a-d: the question that asks the label back from cleaned reasoning.
    The description is cleaned the way each task does it."""
    d = _c(description)
    if task == "emotion":
        cats = ", ".join(f"'{c}'" for c in classes)
        return fill(K.SECOND_STAGE_EMOTION, categories=F.lit(cats),
                    description=T.remove_sentences_with_words(d, classes),
                    slots=F.lit(slot_template(classes, quoted=False)))
    if task == "multibox":
        return fill(K.SECOND_STAGE_MULTIBOX, target=target, description=T.remove_floats_full(d))
    if task == "onebox":
        return fill(K.SECOND_STAGE_ONEBOX, target=target, description=d)
    if task == "category":
        return fill(K.SECOND_STAGE_CATEGORY, description=T.remove_floats_full(d))
    if task == "emotion_example":
        return fill(K.SECOND_STAGE_EMOTION_EXAMPLE, categories=F.lit(K.EXAMPLE_EMOTION_CATEGORIES),
                    description=T.remove_sentences_with_words(d, K.EMOTION_CLASSES),
                    example=F.lit(K.EXAMPLE_EMOTION_OUTPUT))
    raise ValueError(task)


# ----------------------------------------------------------------------- P9
def region_prompt(text) -> Column:
    """Rewrite a region prompt from ``bounding box [..]`` and
    ``contains ... (You|end)``; unchanged if either part is missing."""
    t = _c(text)
    pb = T.jre(r"bounding box \[(.*?)\]")
    pc = T.jre(r"contains (.*?)(?:You|$)")
    box = F.concat(F.lit("["), F.regexp_extract(t, pb, 1), F.lit("]"))
    contains = T.py_strip(F.regexp_extract(t, pc, 1))
    obj = F.split_part(F.split_part(contains, F.lit(", which"), F.lit(1)), F.lit("."), F.lit(1))
    return F.when(t.rlike(pb) & t.rlike(pc), fill(K.REGION_PROMPT, box=box, contains=contains, object=obj)).otherwise(t)


# ---------------------------------------------------------------------- P10
def assemble_rollout(think, completion, strip_newlines: bool = True) -> Column:
    """P10: ``think + <answer> + completion + </answer>`` (box tasks delete
    newlines / carriage returns from the completion first)."""
    c = F.translate(_c(completion), "\n\r", "") if strip_newlines else _c(completion)
    return F.concat(_c(think), F.lit("<answer>"), c, F.lit("</answer>"))


# ---------------------------------------------------------------------- P12
def keep_last(arr, n: int) -> Column:
    """Keep the last ``n`` elements (left truncation); shorter arrays stay whole."""
    a = _c(arr)
    return F.slice(a, F.greatest(F.lit(1), F.size(a) - F.lit(n) + 1), F.lit(n))


def truncate_left(ids, mask, n: int) -> Column:
    """P12 on token ids and their attention mask: both are cut alike."""
    return F.struct(keep_last(ids, n).alias("ids"), keep_last(mask, n).alias("mask"))


# ---------------------------------------------------------------- P13, P14
def fan_out(df: DataFrame, g: int = K.DEFAULT_G, col: str = "gen_idx") -> DataFrame:
    """Every row G times, numbered 0..G-1."""
    return df.withColumn(col, F.explode(F.sequence(F.lit(0), F.lit(g - 1)))).withColumn(col, F.col(col).cast("long"))


def attach_responses(prompts: DataFrame, responses: DataFrame, keys: Sequence[str] = ("group_id", "gen_idx")):
    """Attach generated responses by key; returns (matched, prompts without
    a response, responses without a prompt).  A sort-merge join on the keys, whose
    skewed keys Spark splits at run time; never a broadcast, which would hold a whole
    side in every task (a side packed into few bytes of a file looks small to Spark)."""
    keys = list(keys)
    return (prompts.join(responses.hint("merge"), keys, "inner"), prompts.join(responses.hint("merge"), keys, "left_anti"),
            responses.join(prompts.hint("merge"), keys, "left_anti"))


def attach_in_groups(prompts: DataFrame, responses: DataFrame, keys: Sequence[str] = ("step", "group_id"), gen: str = "gen_idx") -> DataFrame:
    """P14 for tables stored by group (``sources.io.store_by_group``): joined by the group alone, so the buckets
    serve as they are; within a group (G rows a side) a prompt meets the response of its own place."""
    right = responses.withColumnRenamed(gen, "__gen")
    return prompts.join(right.hint("merge"), list(keys)).where(F.col(gen) - F.col("__gen") == 0).drop("__gen")


# ---------------------------------------------------------------------- P16
def image_reject_reason(width, height, channels, ndim=None, kind=None) -> Column:
    """Why an image is unusable (NULL = valid).  ``kind`` is what was
    found in its place (``image`` or ``tensor``; anything else is a wrong
    type), ``ndim`` the number of a tensor's dimensions (3 wanted); a tensor
    without a single value is ``empty``."""
    w, h, c = _c(width), _c(height), _c(channels)
    reasons = [(w.isNull() | h.isNull(), "missing"), ((w == 0) | (h == 0), "zero_size"), (~c.isin(1, 3), "bad_channels")]
    if ndim is not None:
        reasons.insert(0, (_c(ndim) != 3, "bad_ndim"))
    if kind is not None:
        k = _c(kind)
        reasons = [(k.isNull() | ~k.isin("image", "tensor"), "bad_type"),
                   ((k == "tensor") & ((w == 0) | (h == 0) | (c == 0)), "empty"), *reasons]
    r = F.lit(None).cast("string")
    for wrong, reason in reversed(reasons):
        r = F.when(wrong, F.lit(reason)).otherwise(r)
    return r


def split_by_quality(df: DataFrame, width: str = "width", height: str = "height", channels: str = "channels"):
    """P16 with ruling D19: (valid rows, quarantined rows with ``reject_reason``).
    Invalid images are split off instead of being sent on."""
    d = df.withColumn("reject_reason", image_reject_reason(width, height, channels))
    return d.where(F.col("reject_reason").isNull()).drop("reject_reason"), d.where(F.col("reject_reason").isNotNull())


# ------------------------------------------------------------------- L1, L2
def few_shot(df: DataFrame, cls: str, order: str, k: int = K.FEWSHOT_K) -> DataFrame:
    """L1: the first ``k`` rows of every class in ``order``; ``_first`` (the
    class's first ``order`` value) orders classes by first appearance.

    Spark keeps the first ``k`` rows of each class in every task before the
    shuffle (``WindowGroupLimit``), so a hot class is never one big task."""
    w = Window.partitionBy(cls).orderBy(order)
    d = df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k)
    d = d.withColumn("_first", F.min(order).over(Window.partitionBy(cls)))
    return d.withColumn("fewshot_rank", F.col("_rk")).drop("_rk")


def head(df: DataFrame, order: str, n: int = K.HEAD_N) -> DataFrame:
    """L2: the first ``n`` rows by ``order`` (a top-k, not a full sort)."""
    return df.orderBy(order).limit(n)

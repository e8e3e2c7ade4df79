"""Box operators as Spark column expressions.

Boxes are ``struct<x1,y1,x2,y2: double>``; a box list is an array of them
(NULL = "none found").  All per-rollout box work happens inside the row, so
scoring a box table is a narrow stage: no join, no shuffle.  Array math
uses higher-order functions (``transform``/``aggregate``), which Catalyst
evaluates per row in the JVM.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import _c, extract_answer, jre

BOX_TYPE = "array<struct<x1:double,y1:double,x2:double,y2:double>>"

# JSON grammar used to tell valid JSON apart from junk, after spaces and newlines are deleted: tab and CR
# stay and are white space between tokens (and not allowed in strings); NaN and Infinity count as numbers.
_WS = r"[\t\r]*"
_NUM = r"(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|NaN|-?Infinity)"
_STR = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'
_VALUE = f"(?:{_NUM}|{_STR}|true|false|null)"
_PAIR = f"{_WS}{_STR}{_WS}:{_WS}{_VALUE}{_WS}"
# a flat JSON object (no brackets can occur inside a matched bracket)
_OBJ = r"\{(?:" + _PAIR + "(?:," + _PAIR + r")*|" + _WS + r")\}"
_ITEM = f"{_WS}(?:{_VALUE}|{_OBJ}){_WS}"
JSON_FOUR = r"\A\[" + f"{_WS}{_NUM}{_WS}(?:,{_WS}{_NUM}{_WS})" + r"{3}\]\z"
JSON_LIST = r"\A\[(?:" + _ITEM + "(?:," + _ITEM + ")*|" + _WS + r")\]\z"


def box(x1, y1, x2, y2) -> Column:
    return F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"),
                    x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))


def _box_from_strs(a) -> Column:
    return box(a[0].try_cast("double"), a[1].try_cast("double"), a[2].try_cast("double"), a[3].try_cast("double"))


def nonempty_or_null(boxes) -> Column:
    """NULL for an empty box list (``nullif`` evaluates its argument once)."""
    return F.nullif(_c(boxes), F.array().cast(BOX_TYPE))


# ---------------------------------------------------------------------- X1
def parse_brackets(found) -> Column:
    """Each ``[...]`` match -> box or NULL.  After deleting spaces and newlines a
    valid 4-number JSON list is taken as is; any other valid JSON list is
    dropped; text that is not JSON falls back to the numbers inside the raw
    match, kept when there are exactly four.  Staged so that inside the
    (interpreted) lambdas every intermediate -- the cleaned text, the JSON
    split -- is computed once per element, not once per use."""
    staged = F.transform(_c(found), lambda m: F.struct(m.alias("raw"), F.translate(m, "\n ", "").alias("c")))
    staged = F.transform(staged, lambda s: F.struct(
        s["raw"].alias("raw"), s["c"].alias("c"),
        F.when(s["c"].rlike(JSON_FOUR), F.split(F.translate(s["c"], "[]\t\r", ""), ",")).alias("four")))

    def fallback(raw):
        nums = F.regexp_extract_all(raw, F.lit(jre(K.BRACKET_NUMBER)), 0)
        return F.when(F.size(nums) == 4, _box_from_strs(nums))

    parsed = F.transform(staged, lambda s: F.when(s["four"].isNotNull(), _box_from_strs(s["four"]))
                         .when(s["c"].rlike(JSON_LIST), F.lit(None))
                         .otherwise(fallback(s["raw"])))
    return F.filter(parsed, lambda b: b.isNotNull())


def extract_boxes(text) -> Column:
    """X1 ``extract_bbox``: last ``<answer>`` block (DOTALL), every bracket
    without nested brackets, parsed by ``parse_brackets``; NULL when no
    answer or no box."""
    ans = extract_answer(text, "b")
    found = F.regexp_extract_all(ans, F.lit(jre(K.BRACKET)), 0)
    return nonempty_or_null(parse_brackets(found))


# ------------------------------------------------------------------ X2, X3
def extract_first_strict_box(text) -> Column:
    """X2 ``extract_position_list``: first strict ``[n, n, n, n]``; NULL if none.
    Python literal parsing rejects leading-zero integers (``[01, ...]``)."""
    t = _c(text)
    p = jre(K.STRICT_BOX_GROUPS)
    nums = [F.regexp_extract(t, p, i) for i in range(1, 5)]
    # an integer literal with a leading zero (``01``) is a syntax error there
    bad = [n.rlike(r"\A-?0+[1-9][0-9]*\z") for n in nums]
    bad_literal = bad[0] | bad[1] | bad[2] | bad[3]
    return F.when(t.rlike(p) & ~bad_literal, box(*[n.try_cast("double") for n in nums]))


def extract_all_strict_boxes(text) -> Column:
    """X3 ``extract_all_bboxes``: every strict 4-number list anywhere in the
    text (think included), as an array (possibly empty)."""
    t = _c(text)
    p = F.lit(jre(K.STRICT_BOX_GROUPS))
    cols = [F.regexp_extract_all(t, p, i) for i in range(1, 5)]
    z = F.arrays_zip(*[c.alias(f"c{i}") for i, c in enumerate(cols)])
    return F.transform(z, lambda r: box(r["c0"].try_cast("double"), r["c1"].try_cast("double"),
                                        r["c2"].try_cast("double"), r["c3"].try_cast("double")))


# ---------------------------------------------------------------------- X4
def xywh_to_xyxy(boxes) -> Column:
    """``[x, y, w, h]`` -> ``[x, y, x + w, y + h]`` for every box."""
    return F.transform(_c(boxes), lambda b: box(b["x1"], b["y1"], b["x1"] + b["x2"], b["y1"] + b["y2"]))


# ---------------------------------------------------------------------- X5
def center(b) -> Column:
    """struct(cx, cy, w, h)."""
    b = _c(b)
    w = b["x2"] - b["x1"]
    h = b["y2"] - b["y1"]
    return F.struct((b["x1"] + w / 2).alias("cx"), (b["y1"] + h / 2).alias("cy"), w.alias("w"), h.alias("h"))


# ---------------------------------------------------------------------- X6
def _safe_div(a, b) -> Column:
    return a / F.when(b != 0, b)


def iou(a, b, variant: str = "a") -> Column:
    """X6 IoU.  (a) 0 unless the boxes overlap strictly, 0 if union <= 0;
    (b) clamped intersection, 0 only when union == 0 (inverted boxes can
    give negative or odd values, as in the scored task)."""
    a, b = _c(a), _c(b)
    xa = F.greatest(a["x1"], b["x1"])
    ya = F.greatest(a["y1"], b["y1"])
    xb = F.least(a["x2"], b["x2"])
    yb = F.least(a["y2"], b["y2"])
    area_a = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"])
    area_b = (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    if variant == "a":
        inter = (xb - xa) * (yb - ya)
        union = area_a + area_b - inter
        return F.when((xb <= xa) | (yb <= ya), F.lit(0.0)) \
            .when(union > 0, inter / union).otherwise(F.lit(0.0))
    inter = F.greatest(F.lit(0.0), xb - xa) * F.greatest(F.lit(0.0), yb - ya)
    union = area_a + area_b - inter
    return F.when(union == 0, F.lit(0.0)).otherwise(_safe_div(inter, union))


# ---------------------------------------------------------------------- X7
def geometry(gt, pred, image_size=(1000, 1000), alpha=0.5, beta=0.5, gamma=0.0) -> Column:
    """X7 ``compute_reward``: struct(iou, center_score, aspect_score, composite).
    The scored task uses only ``iou`` (variant b); NULL box -> all 0."""
    g, p = _c(gt), _c(pred)
    cg, cp = center(g), center(p)
    dist = F.sqrt((cg["cx"] - cp["cx"]) ** 2 + (cg["cy"] - cp["cy"]) ** 2)
    if image_size:
        cs = F.lit(1.0) - dist / F.lit(float((image_size[0] ** 2 + image_size[1] ** 2) ** 0.5))
    else:
        cs = F.exp(-dist / F.lit(100.0))
    a1 = cg["w"] / (cg["h"] + F.lit(1e-6))
    a2 = cp["w"] / (cp["h"] + F.lit(1e-6))
    ar = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.ln(a1 / a2)) / F.lit(2.302585092994046)))
    ar = F.when((a1 <= 0) | (a2 <= 0) | F.isnan(a1) | F.isnan(a2), F.lit(0.0)).otherwise(ar)
    i = iou(g, p, "b")
    comp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(alpha) * i + F.lit(beta) * cs + F.lit(gamma) * ar))
    none = g.isNull() | p.isNull()
    z = F.lit(0.0)
    return F.struct(F.when(none, z).otherwise(i).alias("iou"), F.when(none, z).otherwise(cs).alias("center_score"),
                    F.when(none, z).otherwise(ar).alias("aspect_score"),
                    F.when(none, z).otherwise(comp).alias("composite"))


# ---------------------------------------------------------------------- X8
def pair_matrix(gt, pred, score=None) -> Column:
    """Gt x pred score matrix (rows = gt), default IoU variant (a)."""
    score = score or (lambda g, p: iou(g, p, "a"))
    return F.transform(_c(gt), lambda g: F.transform(_c(pred), lambda p: score(g, p)))


# --------------------------------------------------------------------- X12
def coord_leak(think, anchored: bool = True) -> Column:
    """The whole reasoning is a coordinate list (anchored pattern).
    ``anchored=False`` (ruling D13 option) fires on a coordinate list anywhere."""
    p = K.COORD_LEAK if anchored else K.COORD_LEAK.lstrip("^").rstrip("$")
    return _c(think).rlike(jre(p))


# --------------------------------------------------------------------- X13
def tags_format(completion) -> Column:
    """1.0 when the completion full-matches think/answer tags."""
    return F.when(_c(completion).rlike(jre(K.FORMAT_TAGS, dotall=True, full=True)), 1.0).otherwise(0.0)


def one_box_format(completion) -> Column:
    """1.0 when the answer is exactly one non-negative 4-number list."""
    return F.when(_c(completion).rlike(jre(K.FORMAT_ONE_BOX, dotall=True, full=True)), 1.0).otherwise(0.0)


# --------------------------------------------------------------------- X14
def rescale(v, scale, size: int) -> Column:
    """X14 one coordinate: round half-even, clamp to [0, size - 1], int."""
    x = F.rint(_c(v) * scale)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(float(size - 1)))).cast("int")


def rescale_box(b, width, height, target=K.RESCALE_TARGET) -> Column:
    """A box on the target size; coordinates are NULL where the image's size is missing or 0."""
    b = _c(b)
    sx = F.lit(float(target[0])) / F.when(_c(width) > 0, _c(width))
    sy = F.lit(float(target[1])) / F.when(_c(height) > 0, _c(height))
    return F.struct(rescale(b["x1"], sx, target[0]).alias("x1"), rescale(b["y1"], sy, target[1]).alias("y1"),
                    rescale(b["x2"], sx, target[0]).alias("x2"), rescale(b["y2"], sy, target[1]).alias("y2"))

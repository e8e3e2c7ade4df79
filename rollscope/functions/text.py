"""Text cleaning and extraction as Spark column expressions.

Every function takes and returns a ``Column``; nothing here runs Python per
row.  Patterns are written in Python syntax and ported to Java syntax by
``jre`` (flag rules below), then passed to Spark as literals.

Port rules (Python ``re`` on ``str`` -> ``java.util.regex``):
  * ``.`` without DOTALL excludes only ``\\n`` in Python -> ``(?d)`` (UNIX_LINES)
  * ``\\w \\d \\s \\b`` are Unicode in Python            -> ``(?U)``
  * ``\\s`` and ``str.strip`` in Python also take U+001C-U+001F, which Java's
    White_Space lacks                                   -> an explicit class
  * ``fullmatch``                                       -> ``\\A(?:...)\\z``
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .trie import alternation

_REGEX_SPECIAL = set("\\.^$|?*+()[]{}")


def _python_space(pattern: str) -> str:
    """Write ``\\s`` and ``\\S`` out so that they take the separators U+001C-U+001F too."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two in ("\\s", "\\S") and (two == "\\s" or not inside):
            span = "\\s\\x1c-\\x1f"
            out.append(span if inside else f"[{span}]" if two == "\\s" else f"[^{span}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


def jre(pattern: str, *, dotall: bool = False, multiline: bool = False,
        icase: bool = False, full: bool = False) -> str:
    """Port a Python regex to an equivalent Java regex string."""
    pattern = _python_space(pattern)
    flags = "dU" + ("s" if dotall else "") + ("m" if multiline else "") + ("i" if icase else "")
    body = f"\\A(?:{pattern})\\z" if full else pattern
    return f"(?{flags}){body}"


def escape(word: str) -> str:
    """Escape a literal for use inside a Java (or RE2) pattern."""
    return "".join("\\" + ch if ch in _REGEX_SPECIAL else ch for ch in word)


def _class_escape(chars: str) -> str:
    """Escape characters for use inside ``[...]``."""
    return "".join("\\" + ch if ch in "\\]^-[" else ch for ch in chars)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: What Python's ``str.strip`` takes away.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.btrim(_c(c), F.lit(SPACES))


# ---------------------------------------------------------------- T8, T9, T10
def extract_think(c, form: str = "a", dotall: bool = False) -> Column:
    """T8.  (a) first ``<think>(.*?)</think>`` without DOTALL, else the whole
    content stripped; (b) ``<think[^>]*>(.*?)</think>`` with DOTALL, else NULL.
    ``dotall=True`` lets form (a) span newlines (ruling D2 option)."""
    c = _c(c)
    if form == "a":
        p = jre(r"<think>(.*?)</think>", dotall=dotall)
        return F.when(c.rlike(p), py_strip(F.regexp_extract(c, p, 1))).otherwise(py_strip(c))
    p = jre(r"<think[^>]*>(.*?)</think>", dotall=True)
    return F.when(c.rlike(p), py_strip(F.regexp_extract(c, p, 1)))


def extract_answer(c, form: str = "a", dotall: bool = False) -> Column:
    """T9.  (a) first ``<answer>`` block, no DOTALL, else ``""``;
    (b) last block, DOTALL, stripped, else NULL; (c) first block stripped,
    else the whole content stripped.  ``dotall=True`` for (a) is the D2 option."""
    c = _c(c)
    if form == "a":
        return F.regexp_extract(c, jre(r"<answer>(.*?)</answer>", dotall=dotall), 1)
    if form == "b":
        p = jre(r"<answer>(.*?)</answer>", dotall=True)
        return py_strip(F.try_element_at(F.regexp_extract_all(c, F.lit(p), 1), F.lit(-1)))
    p = jre(r"<answer>(.*?)</answer>")
    return F.when(c.rlike(p), py_strip(F.regexp_extract(c, p, 1))).otherwise(py_strip(c))


def normalize_answer(c) -> Column:
    """Delete spaces and underscores, lower-case."""
    return F.lower(F.translate(_c(c), " _", ""))


# ---------------------------------------------------------------------- T1
def process_text(c, variant: str = "a") -> Column:
    """T1 blank-line / line-edge cleaner.
    (a) collapse, strip line starts, strip line ends, collapse;
    (b) only the first collapse survives; (c) (a) then delete ``\\n``/``\\r``."""
    c = _c(c)
    collapse = jre(r"\n\s*\n")
    if variant == "b":
        return F.regexp_replace(c, collapse, "\n\n")
    s = F.regexp_replace(c, collapse, "\n\n")
    s = F.regexp_replace(s, jre(r"^\s+", multiline=True), "")
    s = F.regexp_replace(s, jre(r"\s+$", multiline=True), "")
    s = F.regexp_replace(s, collapse, "\n\n")
    if variant == "c":
        s = F.translate(s, "\n\r", "")
    return s


# ---------------------------------------------------------------- T2, T3
def remove_floats(c, variant: str = "a") -> Column:
    """T2. (a) delete 4-number coordinate runs, then decimals; (b) decimals only."""
    c = _c(c)
    if variant == "a":
        c = F.regexp_replace(c, jre(K.COORD_RUN), "")
    return F.regexp_replace(c, jre(K.FLOAT_SIMPLE), "")


def remove_floats_full(c) -> Column:
    """Delete decimals incl. ``.5``, ``2.``, ``1e5``, signed."""
    return F.regexp_replace(_c(c), jre(K.FLOAT_FULL), "")


# ---------------------------------------------------------------- T4, T6
def _class_alt(classes: Sequence[str]) -> str:
    return r"\b(" + alternation(classes, escape, icase=True) + r")\b"


def remove_class_names(c, classes: Sequence[str]) -> Column:
    """T4: whole-word case-insensitive delete, runs of 2+ whitespace -> one space, strip."""
    s = F.regexp_replace(_c(c), jre(_class_alt(classes), icase=True), "")
    s = F.regexp_replace(s, jre(r"\s{2,}"), " ")
    return py_strip(s)


def extract_first_class(c, classes: Sequence[str]) -> Column:
    """First whole-word class (any case) -> ``<answer>X</answer>``, else ``""``."""
    p = jre(_class_alt(classes), icase=True)
    c = _c(c)
    return F.when(c.rlike(p), F.concat(F.lit("<answer>"), F.regexp_extract(c, p, 0), F.lit("</answer>"))) \
        .otherwise(F.lit(""))


# ---------------------------------------------------------------------- T5
def remove_sentences_with_words(c, words: Sequence[str], enders: str = K.SENTENCE_ENDERS) -> Column:
    """T5: newlines -> spaces; drop every sentence (run of non-enders plus its
    ender) that contains any of ``words`` (case-sensitive substring); collapse
    whitespace; strip.  A trailing piece without an ender always stays.

    Deleting sentences word by word is the same as keeping the sentences that
    contain none of the words, as long as no word holds an ender (sentence
    boundaries never move).  If one does (``e.g.``), a match of it runs across
    boundaries, and the words are deleted one after the other.

    One pass matches the sentences one after the other: those without a word (the words as
    one trie, looked for at each letter) and the trailing piece are put back, the others not.
    No step goes back over a sentence, so long texts without enders cost their length, where
    the per-word ``[^E]*word[^E]*[E]`` scan backtracks quadratically.  Texts without any of
    the words are not rewritten.
    """
    e = _class_escape(enders)
    t = F.translate(_c(c), "\n", " ")
    if any(x in enders for w in words for x in w):
        for w in words:
            t = F.regexp_replace(t, f"[^{e}]*{escape(w)}[^{e}]*[{e}]", "")
        return py_strip(F.regexp_replace(t, jre(r"\s+"), " "))
    ws = [w for w in words if w]
    if ws:
        word = alternation(ws, escape)
        clean = f"((?:(?!{word})[^{e}])*+[{e}]|[^{e}]++\\z)|[^{e}]*+[{e}]"
        t = F.when(t.rlike(word), F.regexp_replace(t, clean, "$1")).otherwise(t)
    return py_strip(F.regexp_replace(t, jre(r"\s+"), " "))


# ---------------------------------------------------------------------- T7
def extract_info(c) -> Column:
    """struct(total_targets string|NULL, targets array<string>, num_targets int)."""
    c = _c(c)
    pc = jre(K.TARGET_COUNT)
    pt = jre(K.TARGET_LINE)
    nums = F.regexp_extract_all(c, F.lit(pt), 1)
    descs = F.regexp_extract_all(c, F.lit(pt), 2)
    targets = F.transform(F.arrays_zip(nums.alias("n"), descs.alias("d")),
                          lambda z: F.concat(F.lit("Target "), z["n"], F.lit(": "), py_strip(z["d"])))
    return F.struct(
        F.when(c.rlike(pc), F.regexp_extract(c, pc, 1)).alias("total_targets"),
        targets.alias("targets"),
        F.size(nums).alias("num_targets"),
    )


# --------------------------------------------------------------------- P15
def extract_assistant(c) -> Column:
    """Text after the first ``assistant\\n`` (DOTALL), stripped; else NULL.
    A matched-but-empty tail stays ``""`` (the rlike guard keeps it apart from NULL)."""
    c = _c(c)
    p = jre(r"assistant\n(.*)", dotall=True)
    return F.when(c.rlike(p), py_strip(F.regexp_extract(c, p, 1)))


# --------------------------------------------------------------------- P11
def replace_phrase(c, old: str, new: str) -> Column:
    return F.replace(_c(c), F.lit(old), F.lit(new))

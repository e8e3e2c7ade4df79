"""Operator 5 [native]: chat formatting with a grammar round trip.

A conversation is written as turns ``<|im_start|>role\\ntext<|im_end|>\\n``.  Each
rendered turn is parsed again by the reader's own grammar (split at the control
strings; the role ends at the first newline; texts are unescaped) and compared
to the source.  Where it differs, the text is escaped (one ``~`` more after each
``<`` that begins ``<~*|``), rendered and parsed again; a turn that is still not
identical is an error.  Roles are percent-escaped where they hold ``%``, ``<`` or
a newline.  The loss mask covers the texts of assistant turns.

Everything is DataFrame expressions; turns are rendered row by row, offsets are
running sums within a conversation.

Cases: a null text or role is empty.  Turns with equal or null numbers follow in
the order (turn, role, text), nulls first.  A null conv_id is a conversation of
its own.  Repeated rows are turns of their own.  An empty table gives no rows.
Other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import with_parts

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = r"<\|im_(?:start|end)\|>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(~*)\|", "<~$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<~(~*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    for a, b in (("%", "%25"), ("<", "%3C"), ("\n", "%0A")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in (("\n", "%0A"), ("<", "%3C"), ("%", "%25")):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"), body, F.lit(END + "\n"))


def parse_turn(inner: Column) -> tuple[Column, Column]:
    """(role, text) of what stands between two control strings."""
    role = F.substring_index(inner, "\n", 1)
    return unescape_role(role), unescape(F.substr(inner, F.char_length(role) + 2))


def recovered(rendered: Column, role: Column, text: Column) -> Column:
    """Does the parser read exactly this turn from ``rendered``?"""
    parts = F.split(rendered, CONTROL, -1)
    got_role, got_text = parse_turn(F.get(parts, F.lit(1)))
    return F.coalesce((F.size(parts) == 3) & (F.get(parts, F.lit(0)) == "") & (F.get(parts, F.lit(2)) == "\n")
                      & (got_role == role) & (got_text == text), F.lit(False))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, piece, learned, at, length): each turn's rendered piece,
    and where its text stands in the piece."""
    df = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                      F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("plain", recovered(render(F.col("role"), F.col("text")), F.col("role"), F.col("text")))
    df = df.withColumn("body", F.when(F.col("plain"), F.col("text")).otherwise(escape(F.col("text"))))
    df = df.withColumn("piece", render(F.col("role"), F.col("body")))
    same = F.col("plain") | recovered(F.col("piece"), F.col("role"), F.col("text"))
    df = df.withColumn("piece", F.when(same, F.col("piece")).otherwise(
        F.raise_error(F.concat(F.lit("turn not recovered: "), F.col("piece")))))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return df.select("conv_id", F.row_number().over(order).alias("place"), "piece",
                     (F.col("role") == LEARNED).alias("learned"),
                     (F.char_length(escape_role(F.col("role"))) + len(START) + 1).alias("at"),
                     F.char_length("body").alias("length"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, pieces, mask): the formatted text, its turns and the
    spans (start, length, in code points of ``formatted``) under the loss mask."""
    pieces = format_turns(turns)
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece").cast("long")).over(before), F.lit(0)) + F.col("at")
    df = pieces.select("conv_id", F.struct("place", "piece", "learned", "at", "length", start.alias("start")).alias("t"))
    df = df.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("pieces"))
    return df.select("conv_id", F.array_join("pieces.piece", "").alias("formatted"), "pieces",
                     F.expr("transform(filter(pieces, t -> t.learned), t -> struct(t.start, t.length))").alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the output."""
    df = formatted.withColumn("turns", F.filter(F.split("formatted", CONTROL, -1), lambda x, i: i % 2 == 1))
    said = F.transform("turns", lambda x: F.concat(parse_turn(x)[0], F.lit("\n"), parse_turn(x)[1], F.lit("\n")))
    # the mask's spans of the whole text
    loss = with_parts(F.col("formatted"), lambda part: F.array_join(
        F.transform("mask", lambda m: unescape(part(m["start"].cast("int"), m["length"]))), ""))
    df = df.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(said, "").alias("said"),
                   loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return df.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"),
                     F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                     "formatted_chars")

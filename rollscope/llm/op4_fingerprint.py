"""Operator 4 [native]: one-permutation MinHash fingerprints of documents.

A text's word 5-grams are hashed once.  A hash names one of ``BINS`` bins and a
value; each bin keeps its smallest value.  Empty bins are filled by optimal
densification: each draws hashed bins of the same text until one is not empty
(eight draws, then the non-empty bin of smallest hashed rank, which also is a
uniform draw).  The fingerprint stores ``BITS`` low-order bits of each bin's value,
hashed with the bin's number (else a value that fills many bins would be equal by
chance in all of them at once), as hexadecimal digits.  Equal bins by chance are corrected for:
``(p - 2^-b) / (1 - 2^-b)`` with the share ``p`` of equal digits.

Everything is DataFrame expressions.  To give each document the text of the
next one, documents are dealt to ranges of doc_id (bounds from quantiles), each
range also gets the first document of the next range, and a window within a
range looks one row ahead.

Cases: a null text is empty.  A text without words has the fingerprint '';
two of them are alike (1.0), one of them and another text are not (0.0).  Fewer
than five words are one n-gram.  Rows that repeat a doc_id follow each other in
the order of their texts; null doc_ids come last.  One row is its own next.
Columns beside doc_id and text are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parallel

BINS = 256
BITS = 4
_SHIFT = 55                                   # a packed bin: 8 bits of bin number, 55 of value
_EMPTY = (1 << _SHIFT) - 1
_LAST = (1 << 63) - 1


def add_fingerprint(df: DataFrame, text: str, name: str, k: int = 5) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` (not null) as column ``name``.
    Each step is a projection of its own, so that no step is computed twice."""
    keep = df.columns
    df = df.select("*", F.expr(f"array_remove(split({text}, '[ \\\\t-\\\\r]+'), '')").alias("__w"))
    df = df.select(*keep, F.expr(f"""
        CASE WHEN size(__w) = 0 THEN array()
             WHEN size(__w) < {k} THEN array(xxhash64(__w))
             ELSE transform(sequence(1, size(__w) - {k - 1}), i -> xxhash64(slice(__w, i, {k}))) END""").alias("__h"))
    df = df.select(*keep, F.expr(f"""
        sort_array(concat(transform(__h, h -> shiftleft(h & {BINS - 1}, {_SHIFT}) | shiftrightunsigned(h, {64 - _SHIFT})),
                          transform(sequence(0L, {BINS - 1}L), b -> shiftleft(b, {_SHIFT}) | {_EMPTY}L)))""").alias("__s"))
    df = df.select(*keep, F.expr(f"""
        filter(__s, (v, i) -> i = 0 OR shiftright(v, {_SHIFT}) <> shiftright(__s[i - 1], {_SHIFT}))""").alias("__m"))
    df = df.select(*keep, "__m", F.expr(f"filter(__m, v -> (v & {_EMPTY}L) <> {_EMPTY}L)").alias("__n"))
    draw = f"get(__m, cast(xxhash64(i, t) & {BINS - 1} AS int))"
    return df.select(*keep, F.expr(f"""
        CASE WHEN size(__n) = 0 THEN '' ELSE array_join(transform(__m, (v, i) -> lower(hex({(1 << BITS) - 1} & xxhash64(i,
            CASE WHEN (v & {_EMPTY}L) <> {_EMPTY}L THEN v
                 ELSE coalesce(get(filter(transform(sequence(1, 8), t -> {draw}), u -> (u & {_EMPTY}L) <> {_EMPTY}L), 0),
                               array_min(transform(__n, u -> struct(xxhash64(i, shiftright(u, {_SHIFT})) AS r, u AS u))).u)
            END)))), '') END""").alias(name))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity (0 to 1) of two fingerprint columns."""
    digits = 64 // BITS
    unequal = []
    for i in range(0, BINS, digits):
        x = "(" + " ^ ".join(f"cast(conv(substring({c}, {i + 1}, {digits}), 16, -10) AS bigint)" for c in (a, b)) + ")"
        x = f"({x} | shiftrightunsigned({x}, 1))"
        x = f"({x} | shiftrightunsigned({x}, 2))"
        unequal.append(f"bit_count({x} & {0x1111111111111111}L)")
    p = f"(1 - ({' + '.join(unequal)}) / {BINS}D)"
    chance = 2.0 ** -BITS
    return F.expr(f"CASE WHEN {a} = {b} THEN 1D WHEN {a} = '' OR {b} = '' THEN 0D "
                  f"ELSE greatest(0D, ({p} - {chance}D) / {1 - chance}D) END")


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` (doc_id, ...) with ``next_<column>`` of the row that follows in
    ascending (doc_id, text); the first row follows the last."""
    keyed = df.withColumn("__k", F.coalesce(F.col("doc_id"), F.lit(_LAST)))
    n = 8 * parallel(df.sparkSession)
    ids = keyed.select("__k")
    bounds = ids.agg(F.percentile_approx("__k", [i / n for i in range(1, n)], 20 * n).alias("b")).first()["b"] or [0]
    bounds = sorted(set(bounds))                                     # at most 8 for each shuffle partition
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    listed = f"array({', '.join(f'{b}L' for b in bounds)})"
    bucket = F.expr(f"""aggregate(array({', '.join(map(str, steps))}), 0, (lo, s) ->
        CASE WHEN lo + s <= {len(bounds)} AND get({listed}, lo + s - 1) <= __k THEN lo + s ELSE lo END)""")
    first = {r["b"]: r["k"] for r in ids.select("__k", bucket.alias("b")).groupBy("b").agg(F.min("__k").alias("k")).collect()}
    used = sorted(first) or [0]
    before = {first[b]: used[i - 1] for i, b in enumerate(used)} if first else {}
    # the first row of a range also goes, as a ghost, to the end of the range before
    ghost = (F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("__k")] if before
             else F.lit(None).cast("int"))
    places = F.when(F.col("__k").isin(list(before)), F.array(F.struct(F.lit(0).alias("g"), bucket.alias("b")),
                                                             F.struct(F.lit(1).alias("g"), ghost.alias("b")))) \
        .otherwise(F.array(F.struct(F.lit(0).alias("g"), bucket.alias("b"))))
    dealt = keyed.select(*df.columns, "__k", F.explode(places).alias("__p")).select(
        *df.columns, "__k", F.col("__p.g").alias("__g"), F.col("__p.b").alias("__b"))
    ahead = Window.partitionBy("__b").orderBy("__g", "__k", "text")
    return (dealt.select("*", *[F.lead(c).over(ahead).alias(f"next_{c}") for c in columns])
            .where("__g = 0").drop("__k", "__g", "__b"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fingerprint) for each document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return add_fingerprint(texts, "text", "fingerprint")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to
    each other and to the next document's."""
    df = with_next(fingerprint(docs), ["text", "fingerprint"])
    df = df.withColumn("n_chars", F.char_length("text").cast("long"))
    df = df.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 AS int)), "
                                        "substring(next_text, 1, cast(n_chars div 4 AS int)))"))
    df = df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited",
                   "next_fingerprint")
    df = add_fingerprint(df, "edited", "edited_fingerprint")
    return df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                     likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
                     likeness("fingerprint", "next_fingerprint").alias("near_next"))

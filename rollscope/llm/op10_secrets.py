"""Operator 10 [native]: secret scans with an incremental blob ledger.

Every version of every file (here: every document's text) is addressed by the
SHA-256 of its content.  The ledger holds a row for each pair of blob and rule
version that was scanned, findings or none.  A run scans one copy of each blob
whose pair is not yet in the ledger, appends the new pairs, and joins findings
back to all paths.

Spans come from Spark's own regular expressions: the lengths of the pieces between
the matches (``split``) and of the matches (``regexp_extract_all``), a row a match,
are added up within a blob.  The work is linear in a text's length and matches.

Cases: a null text is the empty blob.  Repeated rows and equal texts are one
blob and each gets its findings.  A null doc_id is a path like others.  Spans
may overlap across rules; ``redact`` takes out their union.  Columns beside
doc_id and text are not read by ``scan``; ``redact`` keeps them all.
"""
from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared, with_parts

#: kind, pattern, group whose length counts, least length.  The first three are the base rules.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 32),
)
BASE = ("assign", "access", "hex")
SPAN = "struct<s:int,k:int,kind:string,e:int>"
MATCH = "struct<k:int,i:int,gap:int,whole:int,counts:int>"


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def matches_of(text: str, k: int, rule) -> Column:
    """The rule's matches in column ``text``, leftmost and not overlapping: number, length
    of the text since the match before, and lengths of the match and of its group."""
    _, pattern, group, _ = rule
    whole = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    counts = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(F.col(text), pattern, -1)
    items = F.filter(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), counts.alias("counts")),
                     lambda x: x["whole"].isNotNull())        # no match follows the last gap
    lengths = F.transform(items, lambda x, i: F.struct(
        F.lit(k).alias("k"), i.alias("i"), *[F.char_length(x[c]).alias(c) for c in ("gap", "whole", "counts")]))
    return F.when(F.col(text).rlike(pattern), lengths).otherwise(F.array().cast(f"array<{MATCH}>"))


def find(df: DataFrame, key: str, text: str, rules=RULES) -> DataFrame:
    """(key, spans): all rules' spans by (start, rule) in the text of each ``key``."""
    found = F.concat(*[matches_of(text, k, r) for k, r in enumerate(rules)])
    found = df.select(key, found.alias("m")).dropDuplicates([key]).select(key, F.explode_outer("m").alias("m")).select(key, "m.*")
    end = F.sum(F.col("gap").cast("long") + F.col("whole")).over(
        Window.partitionBy(key, "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    kind, least = (F.get(F.array(*[F.lit(r[c]) for r in rules]), F.col("k")) for c in (0, 3))
    span = F.struct((F.col("end") - F.col("whole")).alias("s"), "k", kind.alias("kind"), F.col("end").alias("e"))
    found = found.withColumn("end", end).select(key, F.when(F.col("counts") >= least, span).alias("span"))
    return found.groupBy(key).agg(F.sort_array(F.collect_list("span")).alias("spans"))


def scan(versions: DataFrame, ledger_path: str, rules=RULES) -> DataFrame:
    """Bring the ledger up to date with ``versions(doc_id, text, ...)`` and return
    (doc_id, blob, spans) for each of them."""
    spark, version = versions.sparkSession, rule_version(rules)
    texts = versions.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("blob", F.unhex(F.sha2("text", 256)))
    refs = texts.select("doc_id", "blob")
    schema = f"blob binary, rules string, spans array<{SPAN}>"
    store = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    # one path for each blob that the ledger lacks (map-side minimum, then one row a blob)
    unseen = refs.groupBy("blob").agg(F.min(F.struct("doc_id")).alias("p"))
    if store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store):
        ledger = spark.read.schema(schema).parquet(ledger_path).where(F.col("rules") == version)
        unseen = unseen.join(ledger.select("blob"), "blob", "left_anti")
    unseen = unseen.select(F.col("blob").alias("b"), F.col("p.doc_id").alias("d"))
    one = texts.join(unseen, (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    new = find(one, "blob", "text", rules).select("blob", F.lit(version).alias("rules"), "spans")
    new.write.mode("append").parquet(ledger_path)
    # two runs at a time may both have scanned a blob: the ledger's pairs count once
    done = spark.read.schema(schema).parquet(ledger_path).where(F.col("rules") == version).drop("rules").dropDuplicates(["blob"])
    return refs.join(done, "blob", "left")


def fresh_ledger(df: DataFrame) -> str:
    return shared(df.sparkSession, f"ledger-{uuid.uuid4().hex}")


def digest(found: DataFrame, base=BASE) -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans as a string."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")

    own = F.filter("spans", lambda x: x["kind"].isin(*base))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in base], F.sha2(joined(own), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules=RULES, mark: str = "[SECRET]", ledger_path: str | None = None) -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark`` (n_chars follows,
    if there is such a column); texts without findings stay as they are."""
    found = scan(docs, ledger_path or fresh_ledger(docs), rules).where(F.size("spans") > 0)
    hits = found.select(F.col("blob").alias("__blob"), "spans").dropDuplicates(["__blob"])
    # what is kept before each span that begins outside all spans before it, and where the last span ends
    spans = hits.select("__blob", F.explode("spans").alias("x")).select("__blob", "x.*")
    before = Window.partitionBy("__blob").orderBy("s", "k").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("at", F.coalesce(F.max("e").over(before), F.lit(0)))
    kept = F.when(F.col("s") >= F.col("at"), F.struct("at", "s"))
    hits = spans.groupBy("__blob").agg(F.sort_array(F.collect_list(kept)).alias("__kept"), F.max("e").alias("__last"))
    df = docs.withColumn("__blob", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).join(hits, "__blob", "left")

    def clean(part):
        pieces = F.transform("__kept", lambda x: F.concat(part(x["at"], x["s"] - x["at"]), F.lit(mark)))
        return F.concat(F.array_join(pieces, ""), part(F.col("__last"), F.char_length("text") - F.col("__last")))

    out = df.withColumn("text", F.when(F.col("__last").isNotNull(), with_parts(F.col("text"), clean)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__last").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

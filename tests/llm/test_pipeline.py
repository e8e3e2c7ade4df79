"""The pipeline, stage by stage against plain versions, and the registered queries."""
import collections

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from odd_documents import SF, odd_rows
from tokenizers import Tokenizer

from rollscope.llm import op9_quality, op10_secrets
from rollscope.llm.common import cut
from rollscope.llm.queries import ORACLE, QUERIES
from rollscope.llm.tokens import WORD_BPE
from rollscope.plans.check import compare


def as_rows(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.select("doc_id", "text", "lang", "source").collect()]


def test_stages_follow_each_other(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "deduplicate", "secrets", "mixing", "packing"]
    rows, df = as_rows(docs), docs
    stage = dict(corpus_pipeline.STAGES)

    stats = [brute.statistics(r[1]) for r in rows]
    far = brute.mcd_distances([(r[2], r[3], s) for r, s in zip(rows, stats)], op9_quality.SHARE, op9_quality.STEPS,
                              op9_quality.FLOOR, op9_quality.CONSISTENCY, op9_quality.LEAST)
    assert not any(d and abs(d - op9_quality.CUT) < 2 for d in far)          # none near the cut
    rows = [r for r, s, d in zip(rows, stats, far) if not s[5] and (d is None or d <= op9_quality.CUT)]
    df = cut(stage["quality"](spark, df, SF), "t")
    assert df.columns == docs.columns and sorted(as_rows(df)) == sorted(rows)

    keep = {c for _, _, c in brute.jaccard_components([r[:2] for r in rows])}
    rows = [r for r in rows if r[0] in keep]
    df = cut(stage["deduplicate"](spark, df, SF), "t")
    assert df.columns == docs.columns and sorted(as_rows(df)) == sorted(rows)

    def redacted(t):
        # the further kinds do not occur in this table
        out, at = "", 0
        for a, _, _, b in brute.base_spans(t):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        return out + t[at:]

    rows = [(r[0], redacted(r[1]), *r[2:]) for r in rows]
    df = cut(stage["secrets"](spark, df, SF), "t")
    assert df.columns == docs.columns and sorted(as_rows(df)) == sorted(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in df.collect() if "[SECRET]" in r["text"])

    copies = [m[3] for m in brute.mix([(r[0], r[1], r[3]) for r in rows])]
    rows = [r for r, c in zip(rows, copies) for _ in range(c)]
    df = cut(stage["mixing"](spark, df, SF), "t")
    assert df.columns == docs.columns and sorted(as_rows(df)) == sorted(rows)

    t = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    want = collections.Counter()
    for r in rows:
        ids = np.append(np.array(t.encode(r[1], add_special_tokens=False).ids), 1).astype("<u2")
        want.update((r[0], i, ids[i:i + 2048].tobytes()) for i in range(0, len(ids), 2048))
    packed = stage["packing"](spark, df, SF).collect()
    assert collections.Counter((r["doc_id"], r["start"], bytes(r["ids"])) for r in packed) == want
    whole = collections.Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert whole == collections.Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in packed)


def test_stages_on_odd_documents(spark, odd, empty):
    for df in (odd, empty):
        for name, f in corpus_pipeline.STAGES[:-1]:
            df = cut(f(spark, df, SF), "t")
            assert df.columns == odd.columns
        corpus_pipeline.STAGES[-1][1](spark, df, SF).collect()
    assert len(odd_rows()) == odd.count() and op10_secrets.BASE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    ok, info = compare(spark, duck, name, QUERIES[name], ORACLE[name], SF)
    assert ok, info


def test_every_operator_has_a_query():
    """One query for each operator, in order, and one more that counts the links of the first."""
    first = list(dict.fromkeys(n.split("_")[0] for n in QUERIES))
    assert first == [f"op{i}" for i in range(1, 14)] and len(QUERIES) == 14


def test_deduplicate_keeps_other_texts_of_a_doc_id(spark):
    a, b = "one two three four five six seven", "red green blue white black brown pink"
    rows = [(1, a, "x"), (1, b, "y"), (1, b.upper(), "z"), (2, a, "x"), (3, "other words that are like nothing else", "x"), (3, None, "n")]
    docs = cut(spark.createDataFrame(rows, "doc_id bigint, text string, `a b` string"), "t")
    got = dict(corpus_pipeline.STAGES)["deduplicate"](spark, docs, SF)
    assert got.columns == docs.columns
    want = [(1, a, "x"), (1, b.upper(), "z"), (3, "other words that are like nothing else", "x"), (3, None, "n")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_a_blob_twice_in_the_ledger_counts_once(spark, odd):
    path = op10_secrets.fresh_ledger(odd)
    first = op10_secrets.scan(odd, path)
    n = first.count()
    spark.read.parquet(path).coalesce(1).write.mode("append").parquet(path + "-copy")
    spark.read.parquet(path + "-copy").write.mode("append").parquet(path)          # as two concurrent runs leave it
    again = op10_secrets.scan(odd, path)
    assert again.count() == n == odd.count()

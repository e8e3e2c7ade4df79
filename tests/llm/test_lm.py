"""Operator 11 against a model of dictionaries."""
import brute
import numpy as np
import pyarrow as pa
import pytest
from odd_documents import odd_rows, twins

from rollscope.llm import op11_lm as M
from rollscope.llm.queries import QUERIES


def same(got, want):
    got_by = {}
    for r in got:
        got_by.setdefault(r["doc_id"], []).append((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]))
    assert got_by.keys() == want.keys()
    for d in want:
        assert len(got_by[d]) == len(want[d])
        for a, b in zip(sorted(got_by[d]), sorted(want[d])):
            assert a[:4] == b[:4]
            assert a[4:] == pytest.approx(b[4:], rel=1e-9, abs=1e-9)


def test_query_equals_dictionaries(spark, doc_rows):
    rows = QUERIES["op11_lm_scores"](spark, "/root/testdata/sf0.001").collect()
    same(rows, brute.lm_scores([r[:2] for r in doc_rows], 2, M.FALLBACK))
    held = [r for r in rows if r["held_out"] and r["n_tokens"] > 1]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_many_chunks_and_orders(spark, docs, doc_rows, monkeypatch, order):
    """Small chunks: owners, answers and shards of many chunks give the same model."""
    monkeypatch.setattr(M, "CHUNK", 3000)
    monkeypatch.setattr(M, "SHARD", 5000)
    some = docs.where("doc_id < 60").repartition(3)
    rows = [r[:2] for r in doc_rows if r[0] < 60]
    same(M.score(some, ~M.held_out(), order).collect(), brute.lm_scores(rows, order, M.FALLBACK))


def test_odd_documents(spark, odd, empty):
    same(M.score(odd, ~M.held_out()).collect(), brute.lm_scores([r[:2] for r in odd_rows()], 2, M.FALLBACK))
    assert M.score(empty, ~M.held_out()).collect() == []
    from pyspark.sql import functions as F
    assert all(r["score"] == 0 and r["train_tokens"] == 0 for r in M.score(odd, F.lit(False)).collect())


def test_probabilities_sum_to_one():
    model = brute.KneserNey([x.split() + ["</s>"] for x in ("a b a c", "a b b", "c a b a", "d")], 3, M.FALLBACK)
    for context in (("<s>", "<s>"), ("a", "b"), ("q", "a"), ("q", "q")):
        assert sum(model.p((*context, w)) for w in [*model.words, "unknown"]) == pytest.approx(1)


def test_twin_words_are_two(spark):
    a, b = twins()
    rows = [(d, f"{a} x" if d % 2 else f"{b} y") for d in range(40)]
    same(M.score(spark.createDataFrame(rows, "doc_id bigint, text string"), ~M.held_out()).collect(), brute.lm_scores(rows, 2, M.FALLBACK))


def test_packed_numbers():
    for x in ([], [0, 0], [1, 255, 256, 2 ** 47], [-1, 5]):
        x = np.array(x, np.int64)
        assert M.unpacked(pa.scalar(M.packed(x))).tolist() == x.tolist()

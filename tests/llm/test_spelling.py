"""Operator 12 against all pairs of words."""
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from odd_documents import odd_rows

from rollscope.llm import op12_spelling as S
from rollscope.llm import words as W
from rollscope.llm.queries import QUERIES

KEY = lambda r: r[0]


def got(df, **k):
    return sorted((tuple(r) for r in S.variants(df, **k).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=KEY)


def test_query_equals_brute_force(spark, doc_rows):
    rows = sorted((tuple(r) for r in QUERIES["op12_spelling_variants"](spark, "/root/testdata/sf0.001").select(
        "word", "form", "root", "n", "n_near", "form_n").collect()), key=KEY)
    assert rows == sorted(brute.spelling(brute.counted_words([r[:2] for r in doc_rows])), key=KEY)
    assert any(r[1] for r in rows) and any(r[4] for r in rows)


def test_odd_documents(spark, odd, empty):
    rows = [r[:2] for r in odd_rows()]
    assert got(odd) == sorted(brute.spelling(brute.counted_words(rows)), key=KEY)
    assert got(odd, least=1, count=1, every=3) == sorted(brute.spelling(brute.counted_words(rows, 1, 1, 3)), key=KEY)
    assert got(empty) == []


@pytest.mark.parametrize("seed", range(3))
def test_small_alphabet(spark, seed):
    """Runs of equal letters, chains of forms, ties, words that are prefixes of others, several tasks."""
    r = random.Random(seed)
    words = ["".join(r.choice("ab\u00e9" if seed else "ab") for _ in range(r.randint(1, 7))) for _ in range(120)]
    rows = [(d, " ".join(w for w in words for _ in range(r.choice([0, 0, 1, 2, 4])))) for d in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = brute.spelling(brute.counted_words(rows, 1, 2, 97))
    assert got(df, least=1, count=2) == sorted(want, key=KEY)


def test_chain_of_forms(spark):
    n = {"aaaaaa": 3, "aaaaab": 6, "aaaabb": 12, "aaabbb": 24, "aabbbb": 50, "abbbbb": 100, "zzzzzz": 3, "zzzzzzz": 5}
    words = spark.createDataFrame([(i, " ".join([w] * c)) for i, (w, c) in enumerate(n.items())], "doc_id bigint, text string")
    rows = {r[0]: r for r in got(words, every=1 << 32 - 1)}
    assert all(rows[w][2] == "abbbbb" for w in list(n)[:6]) and rows["zzzzzz"][1] is None and rows["zzzzzz"][4] == 1


def test_long_word(spark):
    w = "x" * 3000
    df = spark.createDataFrame([(i, f"{w} {w}y {w[:-1]}") for i in range(9)], "doc_id bigint, text string")
    rows = [(i, f"{w} {w}y {w[:-1]}") for i in range(9)]
    assert got(df) == sorted(brute.spelling(brute.counted_words(rows)), key=KEY)


def test_crc_of_runs():
    texts = ["ab\u00e9 c", "x" * 40 + "1zz", "\u00d7\u00f7 \u0100 \u00ff"]
    data, off = W.text_bytes(pa.array(texts))
    start, end, row = S.find_runs(data, off)
    w = [bytes(data[a:b]) for a, b in zip(start, end)]
    assert [x.decode() for x in w] == ["ab\u00e9", "c", "x" * 40, "zz", "\u00d7\u00f7", "\u00ff"] and row.tolist() == [0, 0, 1, 1, 2, 2]
    state = np.array([zlib.crc32(b"12:")] * len(w), np.uint32)
    assert S.crc_of_runs(data, start, end, state).tolist() == [zlib.crc32(b"12:" + x) for x in w]

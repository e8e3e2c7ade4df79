"""Operators 2 and 8 and the encoder against the tokenizers library itself."""
import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from odd_documents import odd_rows, twins
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rollscope.llm import op2_huffman as H
from rollscope.llm import op8_packing as P
from rollscope.llm.tokens import WORD_BPE, Encoder


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(WORD_BPE))


def ids_of(library, text, end):
    return np.append(np.array(library.encode(text or "", add_special_tokens=False).ids, np.uint32), np.uint32(end)).astype("<u4")


def crc(x):
    return zlib.crc32(x.astype("<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aAbB'sStTdDllvreé²1.,!<|>- \n\t\x0b\x85\xa0́İßµªŉ​\x1c"),
                                           st.characters(exclude_categories=["Cs"])), max_size=40), max_size=8))
def test_encoder_equals_library(texts):
    t = Tokenizer.from_file(public_tokenizers.path(WORD_BPE)) if not hasattr(test_encoder_equals_library, "t") else test_encoder_equals_library.t
    test_encoder_equals_library.t = t
    got = [x.tolist() for _, x in Encoder.of(WORD_BPE).encode(pa.array(texts, pa.string()))]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_encoder_forgets_when_full(library, monkeypatch):
    monkeypatch.setattr("rollscope.llm.tokens.MOST_UNITS", 50)
    texts = [" ".join(f"word{random.Random(i).randrange(200)}" for i in range(k, k + 40)) for k in range(0, 400, 40)]
    got = [x.tolist() for _, x in Encoder(WORD_BPE).encode(pa.array(texts))]
    assert got == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_encoder_tells_words_of_the_same_parts_apart(library):
    a, b = twins()
    texts = [a, b, f"{b} {a}", f"é{a}'s é{b}'s"]
    got = [x.tolist() for _, x in Encoder(WORD_BPE).encode(pa.array(texts))]
    assert got == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_ids_over_sixteen_bits_are_refused():
    from rollscope.llm.tokens import two_bytes
    assert two_bytes(np.array([1, 65535], np.uint32)) == b"\x01\x00\xff\xff"
    with pytest.raises(ValueError):
        two_bytes(np.array([65536], np.uint32))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_files_round_trip(request, library, which, docs, odd, doc_rows):
    df, rows = (docs, doc_rows) if which == "docs" else (odd, odd_rows())
    got = sorted(H.round_trip(df).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    order = [(r["doc_id"] is None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order)
    want = collections.Counter((r[0], len(x), crc(x)) for r in rows for x in [ids_of(library, r[1], 2)])
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_files_of_nothing(empty):
    assert H.round_trip(empty).collect() == []


def test_code_lengths_are_optimal_and_limited():
    import heapq
    rng = np.random.default_rng(3)
    for n, limit in ((2, 4), (5, 4), (40, 12), (300, 30)):
        counts = np.zeros(500, np.int64)
        counts[rng.choice(500, n, replace=False)] = rng.integers(1, 10 ** 6, n) ** 2 if n > 5 else rng.integers(1, 50, n)
        got = H.code_lengths(counts, limit)
        assert (got > 0).sum() == n and got.max() <= max(limit, (n - 1).bit_length())
        assert (2.0 ** -got[got > 0].astype(float)).sum() == 1
        heap, cost = [int(c) for c in counts if c], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            cost += x
            heapq.heappush(heap, x)
        if limit >= 30 or n <= 5:
            assert int((counts * got).sum()) == cost
    tight = H.code_lengths(2 ** np.arange(40, dtype=np.int64), 6)     # the limit binds
    assert tight.max() == 6 and sum(2.0 ** -float(x) for x in tight) <= 1


def test_block_round_trip():
    rng = np.random.default_rng(5)
    for n in (1, 2, 255, 256, 257, 5000):
        ids = np.minimum(rng.geometric(0.01, n), 999).astype(np.uint16)
        lengths = H.code_lengths(np.bincount(ids, minlength=H.IDS))
        bits, marks = H.encode_bits(ids, lengths, H.canonical_codes(lengths))
        table, longest = H.decode_table(lengths)
        (got,) = H.decode_blocks([(bits, marks, n)], table, longest)
        assert (got == ids).all() and len(marks) == 4 * -(-n // H.EVERY)


def check_packing(library, got, rows, window=P.WINDOW):
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert r["doc_tokens"] >= r["length"] > 0
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    want = collections.defaultdict(list)
    for d, t, *_ in rows:
        x = ids_of(library, t, 1)
        want[d] += [(i, len(x[i:i + window]), crc(x[i:i + window]), len(x)) for i in range(0, len(x), window)]
    assert {d: sorted(v) for d, v in pieces.items()} == {d: sorted(v) for d, v in want.items()}
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= window
    return len(seqs), sum(x[1] for v in want.values() for x in v)


def test_packing(library, docs, doc_rows, odd, empty):
    n, total = check_packing(library, P.pack(docs, ids=False).collect(), doc_rows)
    assert n <= 1.02 * total / P.WINDOW + 1
    got = P.pack(odd)
    check_packing(library, got.collect(), odd_rows())
    assert P.pack(empty).collect() == []
    for s in P.sequences(got).collect():
        assert len(s["ids"]) == 2 * s["n"]


def naive_best_fit(lengths, window):
    free = []
    for x in sorted(lengths, reverse=True):
        fit = [f for f in free if f >= x]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - x)
        else:
            free.append(window - x)
    return sorted(free)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.sampled_from([40, 41, 64]))
def test_plan_is_best_fit_decreasing(lengths, window):
    counts = collections.Counter(lengths)
    used = collections.defaultdict(list)
    ranks = collections.defaultdict(list)
    for length, rank, n, seq, off in P.best_fit_decreasing(counts, window):
        for i in range(n):
            used[seq + i].append((off, length))
            ranks[length].append(rank + i)
    for s in used.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= window
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items()}
    assert sorted(used) == list(range(len(used)))
    assert sorted(window - sum(n for _, n in s) for s in used.values()) == naive_best_fit(lengths, window)

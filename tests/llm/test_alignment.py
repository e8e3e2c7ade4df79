"""Operator 13 against the libraries and a merge of two sets of ends."""
import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_documents import odd_rows
from tokenizers import Tokenizer

from rollscope.llm import op13_alignment as A
from rollscope.llm.queries import QUERIES


class Library:
    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path(A.BYTE_BPE))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(A.PIECES))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [x for x in range(256) if x not in plain]
        self.byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(other)}

    def ids(self, text):
        """(A ids, B ids) of a text; none where the joined bytes differ."""
        if not text:
            return [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        whole = (" " + text).encode()
        if b"".join(map(self.a_bytes, a)) != whole or b"".join(map(self.b_bytes, b)) != whole:
            return [], []
        return a, b

    def a_bytes(self, i):
        return bytes(self.byte[c] for c in self.a.id_to_token(i))

    def b_bytes(self, i):
        x = self.b.id_to_piece(i)
        return bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode()

    def groups(self, text):
        a, b = self.ids(text)
        ea, eb = np.cumsum([len(self.a_bytes(i)) for i in a]).tolist(), np.cumsum([len(self.b_bytes(i)) for i in b]).tolist()
        out, at, bt = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            i, j = ea.index(e, at) + 1, eb.index(e, bt) + 1
            out.append((a[at:i], b[bt:j]))
            at, bt = i, j
        return out


def brute(rows, lib):
    found = [(d, lib.groups(t)) for d, t in rows]
    n = collections.Counter((a[-1], b[-1]) for _, g in found for a, b in g)
    best = collections.Counter()
    for (_, b), c in n.items():
        best[b] = max(best[b], c)
    out = []
    for d, g in found:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        links = [(a[-1], b[-1]) for a, b in g]
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(n[x] == best[x[1]] for x in links),
                    sum(n[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


@pytest.fixture(scope="module")
def lib():
    return Library()


KEY = lambda r: tuple((x is None, x) for x in r)


def test_query_equals_libraries(spark, lib, doc_rows):
    got = [tuple(r) for r in QUERIES["op13_tokenizer_alignment"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got, key=KEY) == sorted(brute([r[:2] for r in doc_rows], lib), key=KEY)


def test_odd_documents(spark, lib, odd, empty, monkeypatch):
    rows = [r[:2] for r in odd_rows()]
    got = A.align(odd, groups=True).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=KEY) == sorted(brute(rows, lib), key=KEY)
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] or not r["groups"] for r in got)
    assert A.align(empty).collect() == []


def test_blocks_and_cache_of_any_size(lib, monkeypatch):
    """Texts over many blocks, pieces and caches: the same links."""
    r = random.Random(4)
    texts = [" ".join(r.choice(["the", "été", "中文", "x1", "don't", "▁", "Ü", "\n", ""]) for _ in range(n)) for n in (0, 5, 300, 40)]
    monkeypatch.setattr(A, "UNITS", 7)
    monkeypatch.setattr(A, "MOST_UNITS", 5)
    one = A.Aligner(A.BYTE_BPE, A.PIECES)
    got = collections.defaultdict(list)
    for rows, edge, a, b, left, right in one.blocks(pa.array(texts)):
        cut = np.searchsorted(right, b[1][edge])
        for k, row in enumerate(rows):
            got[row] += [(a[0][i], b[0][j]) for i, j in zip(left[cut[k]:cut[k + 1]], right[cut[k]:cut[k + 1]])]
    for row, t in enumerate(texts):
        assert got[row] == [(x[-1], y[-1]) for x, y in lib.groups(t)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aAbB'stl 1.,<|>-\n\t\x85\xa0  　あ▁é中\U0001F600"),
                                           st.characters(exclude_categories=["Cs"])), max_size=30), max_size=6))
def test_units_equal_whole_texts(texts):
    lib = test_units_equal_whole_texts.__dict__.setdefault("lib", Library())
    one = test_units_equal_whole_texts.__dict__.setdefault("one", A.Aligner(A.BYTE_BPE, A.PIECES))
    got = {}
    for rows, edge, a, b, _, _ in one.blocks(pa.array(texts, pa.string())):
        for k, row in enumerate(rows):
            x, y = got.get(row, ([], []))
            got[row] = (x + a[0][a[1][edge[k]]:a[1][edge[k + 1]]].tolist(), y + b[0][b[1][edge[k]]:b[1][edge[k + 1]]].tolist())
    assert [got.get(i, ([], [])) for i in range(len(texts))] == [tuple(lib.ids(t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)), st.integers(1, 9))
def test_merge_path_pieces(a, b, piece):
    x, y = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    left, right = A.common_ends(x, y, piece)
    assert x[left].tolist() == y[right].tolist() == sorted(a & b)
    at = A.merge_path(x, y, piece)
    assert at[0] == 0 and at[-1] == len(x) and (np.diff(at) >= 0).all()
    order = sorted([(v, 0) for v in a] + [(v, 1) for v in b])
    assert at.tolist() == [sum(s == 0 for _, s in order[:d]) for d in [*range(0, len(order), piece), len(order)]]

"""Operators 1 and 3 against all-pairs and window-by-window versions."""
import random

import brute
import numpy as np
import pytest
from odd_documents import odd_rows, twins
from pyspark.sql import functions as F

from rollscope.llm import op1_jaccard, op3_substring
from rollscope.llm import words as W
from rollscope.llm.common import components, cut

KEY = lambda r: tuple((x is None, x) for x in r)


def members(df):
    got = op1_jaccard.join_sets(df)[0].select("doc_id", "n_shingles", "component_id").collect()
    return sorted((tuple(r) for r in got), key=KEY)


def test_components_of_documents(docs, doc_rows):
    assert members(docs) == sorted(brute.jaccard_components([r[:2] for r in doc_rows]), key=KEY)


def test_components_of_odd_documents(odd, empty):
    assert members(odd) == sorted(brute.jaccard_components([r[:2] for r in odd_rows()]), key=KEY)
    assert members(empty) == []


def near_copies(seed, groups, size, n=120):
    """Groups of texts in which members differ from the first by 1 to 8 changed words:
    chains and pairs just above and just below the threshold."""
    r = random.Random(seed)
    rows, d = [], 0
    for g in range(groups):
        base = [f"w{g}x{r.randrange(10**6)}" for _ in range(n)]
        for _ in range(size):
            t = list(base)
            for _ in range(r.randint(0, 5)):
                t[r.randrange(n)] = f"c{r.randrange(10**6)}"
            if r.random() < 0.3:
                base = t
            rows.append((d, " ".join(t)))
            d += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_at_the_threshold(spark, seed):
    rows = near_copies(seed, 6, 25)
    assert members(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(brute.jaccard_components(rows), key=KEY)


@pytest.mark.parametrize("block", [2048, 7])
def test_links_within_a_component_are_all_counted(spark, odd, empty, block, monkeypatch):
    monkeypatch.setattr(op1_jaccard, "BLOCK_SETS", block)
    # repeated rows, equal texts, a null doc_id and a doc_id with two near texts
    rows = near_copies(3, 2, 30)
    rows += [rows[0], (900, rows[0][1]), (None, rows[0][1]), (rows[1][0], rows[0][1] + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counted = lambda x: sorted((tuple(r) for r in op1_jaccard.link_counts(x).select("doc_id", "n_links").collect()), key=KEY)
    assert counted(df) == sorted(brute.jaccard_links(rows), key=KEY)
    assert counted(odd) == sorted(brute.jaccard_links([r[:2] for r in odd_rows()]), key=KEY)
    assert counted(empty) == []


def test_representatives_keep_one_of_each_component(odd, docs, doc_rows):
    keep = {c for _, n, c in brute.jaccard_components([r[:2] for r in doc_rows]) if n} | \
           {d for d, n, _ in brute.jaccard_components([r[:2] for r in doc_rows]) if not n}
    got = op1_jaccard.representatives(docs)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == keep and got.count() == len(keep)
    left = sorted((r["doc_id"] for r in op1_jaccard.representatives(odd).collect()), key=lambda x: (x is None, x))
    # 5 (twice) repeats 4, 8 and 11 repeat 7 and 9 as near copies, 14 repeats 13; null ids and empty texts stay
    assert left == [x for x in left if x not in (5, 8, 14)] and {1, 2, 3, 4, 7, 13} <= set(left) and left.count(None) == 2


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 9), (9, 7), (50, 51)] + [(1000, i) for i in range(1001, 1100)]
    got = {r["id"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 141)} | {3: 3, 7: 3, 9: 3, 50: 50, 51: 50} | {i: 1000 for i in range(1000, 1100)}
    assert got == want


def test_windows_of_documents(docs, doc_rows):
    got = op3_substring.dedup(docs).collect()
    want = sorted(brute.substring_dedup([r[:2] for r in doc_rows]))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    assert sum(w[2] for w in want) > 0
    assert all(brute.sha(r["kept"]) == r["kept_sha256"] for r in got)


def test_windows_of_odd_documents(odd, empty):
    # rows that repeat a doc_id lie in one or in two partitions: the totals and texts are the same
    got = [tuple(r) for r in op3_substring.dedup(odd, text=False).collect()]
    assert sorted(got, key=KEY) == sorted(brute.substring_dedup([r[:2] for r in odd_rows()]), key=KEY)
    assert op3_substring.dedup(empty).collect() == []


def test_a_window_that_fills_the_table_is_sent_once_a_chunk(spark):
    rows = [(i, "a " * 3000 if i % 3 else " ".join(f"w{(i + j) % 700}" for j in range(900))) for i in range(60)]
    df = cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "hot")
    got = [tuple(r) for r in op3_substring.dedup(df, text=False).collect()]
    assert sorted(got) == sorted(brute.substring_dedup(rows))
    docs = df.withColumn("chunk", F.spark_partition_id().cast("long"))
    chunks = docs.select("chunk").distinct().count()
    cells = op3_substring.repeated_cells(op3_substring.sketch(docs, 20, 8))
    sent = op3_substring.candidate_windows(docs, cells, 20, 8).where("shard >= 0").select("chunk", "c").collect()
    hashes = [(r["chunk"], h) for r in sent for h in np.frombuffer(r["c"], np.uint64).tolist()]
    assert len(set(hashes)) == len(hashes) <= chunks * 701


def test_sorted_numbers_round_trip():
    for x in ([], [0], [0, 0, 3], [65534, 65535, 65536, 5 * 65535, 10 ** 7]):
        x = np.array(x, np.int64)
        assert (op3_substring.unpack_sorted(op3_substring.pack_sorted(x)) == x).all()


def test_word_hashes_depend_on_the_word_alone():
    import pyarrow as pa
    texts = ["aa bb cc", " bb\n", None, "", "x aa\tcc\x0bBB", "é\x85é", "abcdefgh abcdefghi ABCDEFGHI abcdefghabcdefgh",
             "x" * 70 + " " + "x" * 71 + " " + "X" * 70, *twins()]
    data, off = W.text_bytes(pa.array(texts))
    start, end, first = W.find_words(data, off)
    h = W.word_hashes(W.lowered(data), start, end)
    w = [bytes(data[a:b]).decode() for a, b in zip(start, end)]
    assert w == [x for t in texts for x in brute.words(t)]
    by = {}
    for x, v in zip(w, h):
        assert by.setdefault(x.lower(), v) == v
    assert len(set(by.values())) == len(by) and first.tolist()[-1] == len(w)
    assert len(set(W.word_hashes(data, start, end, 5).tolist()) & set(h.tolist())) == 0
    assert W.gathered(data, start, end).to_pylist() == [x.encode() for x in w]


def test_words_of_the_same_parts_are_told_apart(spark):
    """Twin words in windows and sets: nothing is linked or removed that is not the same."""
    a, b = twins()
    rest = [f"w{i}" for i in range(24)]
    rows = [(1, " ".join([a, *rest[:4]])), (2, " ".join([b, *rest[:4]])), (3, " ".join([a, *rest])), (4, " ".join([b, *rest[:19]])),
            (5, a), (6, b), (7, a)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert members(df) == sorted(brute.jaccard_components(rows), key=KEY)
    got = op3_substring.dedup(cut(df.coalesce(1), "twins"), text=False).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute.substring_dedup(rows))
    from rollscope.llm import op9_quality
    import pyarrow as pa
    text = " ".join([a, *rest[:9], b, *rest[:9]])
    assert op9_quality.text_stats(pa.array([text]))[0].tolist() == list(brute.statistics(text)[:5])

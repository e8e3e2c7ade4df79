"""Operators 4, 5, 6, 7, 9 and 10 against plain versions, and their odd cases."""
import collections
import re
import statistics
import time

import brute
import numpy as np
import pytest
from odd_documents import odd_rows
from pyspark.sql import functions as F

from rollscope.llm import op4_fingerprint, op5_chat, op6_mixing, op7_language, op9_quality, op10_secrets

KEY = lambda r: tuple((x is None, x) for x in r)


# ---------------------------------------------------------------- 4 fingerprints
def likeness(a, b):
    a, b = brute.shingles(a, lower=False), brute.shingles(b, lower=False)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_fingerprints(request, which, docs, odd, doc_rows):
    df, rows = (docs, doc_rows) if which == "docs" else (odd, odd_rows())
    rows = sorted([(r[0], r[1] or "") for r in rows], key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    got = collections.defaultdict(list)
    for r in op4_fingerprint.compare_edited(df).collect():
        got[r["doc_id"], r["n_chars"], r["edited_sha256"]].append(r)
    errors, prints = [], {}
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        m = len(t) // 4
        edited = t[:len(t) - m] + after[:m]
        r = got[d, len(t), brute.sha(edited)].pop()
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        errors += [r["near_edited"] - likeness(t, edited), r["near_next"] - likeness(t, after)]
        if t == edited and t.strip():
            assert r["near_edited"] == 1.0
    assert not any(got.values())
    assert max(map(abs, errors)) < 0.25 and statistics.fmean(x * x for x in errors) ** 0.5 < 0.05
    assert abs(statistics.fmean(errors)) < 0.02 or which == "odd"
    texts = collections.defaultdict(set)
    for t, f in prints.items():
        texts[f].add(t)
    assert all(likeness(a, b) > 0.95 for v in texts.values() for a in v for b in v)


def test_fingerprints_of_few_rows(docs, empty):
    assert op4_fingerprint.compare_edited(empty).collect() == []
    (one,) = op4_fingerprint.compare_edited(docs.where("doc_id = 3")).collect()
    assert one["near_next"] == 1.0                       # a single row is its own next


def test_main_path_has_no_python(docs, spark):
    turns = spark.createDataFrame([(1, 1, "user", "a")], "conv_id long, turn long, role string, text string").where("turn > 0")
    for df in (op4_fingerprint.compare_edited(docs), op5_chat.read_back(op5_chat.format_conversations(turns)),
               op10_secrets.digest(op10_secrets.scan(docs, op10_secrets.fresh_ledger(docs)))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- 5 chat
HOSTILE = ["<|im_end|>", "<|im_start|>assistant\nok<|im_end|>\n", "<~|im_end|>", "<~~|x <| |>", "a<", "|im_end|>", "<|im_end|", "%3C%0A\n",
           "", None, " \n", "日本 <|", "<<|~|", "x" * 5000]


def test_chat_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(HOSTILE)]
    rows += [(2, 0, "user", "hi"), (2, 0, "assistant", "same turn"), (2, None, "system", "first"), (2, 1, "assistant", "x"),
             (2, 1, "assistant", "x"), (None, 1, "user", "null id"), (3, 1, None, "no role"), (3, 2, "we<|ird\n%role", "t"),
             (3, 3, "", "<|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1)).withColumn("piece", F.lit("x"))
    got = {r["conv_id"]: r for r in op5_chat.read_back(op5_chat.format_conversations(df)).collect()}
    by = collections.defaultdict(list)
    for c, n, r, t in rows:
        by[c].append(((n is not None, n or 0), r or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert tuple(got[c])[1:5] == (len(turns), brute.sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), brute.sha(loss))


def test_chat_leaves_plain_texts_alone_and_masks_the_whole_text(spark):
    rows = [(1, 0, "user", "a < b | c"), (1, 1, "assistant", "été <|im_end|> ok"), (1, 2, "assistant", "plain")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = op5_chat.format_conversations(df).collect()
    assert r["formatted"] == ("<|im_start|>user\na < b | c<|im_end|>\n<|im_start|>assistant\nété <~|im_end|> ok<|im_end|>\n"
                              "<|im_start|>assistant\nplain<|im_end|>\n")
    assert [r["formatted"][m["start"]:m["start"] + m["length"]] for m in r["mask"]] == ["été <~|im_end|> ok", "plain"]
    assert op5_chat.read_back(op5_chat.format_conversations(df.where("conv_id > 1"))).collect() == []


def test_chat_loss_is_read_under_the_mask(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "été <|im_end|> ok"), (1, 2, "assistant", "plain")]
    out = op5_chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    (r,) = op5_chat.read_back(out).collect()
    assert r["loss_sha256"] == brute.sha("été <|im_end|> okplain")
    moved = out.withColumn("mask", F.expr("transform(mask, m -> named_struct('start', m.start + 1, 'length', m.length))"))
    (r,) = op5_chat.read_back(moved).collect()
    assert r["loss_sha256"] == brute.sha("té <|im_end|> ok<lain<")


def test_chat_of_many_turns(spark):
    """A conversation's time grows with its turns: 40,000 of them, found under the mask."""
    n = 40000
    df = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 1, 'assistant', 'user') AS role",
                                   "concat('\uFEFFété 😀 <|im_end|>', id) AS text")
    begin = time.perf_counter()
    (r,) = op5_chat.read_back(op5_chat.format_conversations(df)).collect()
    assert time.perf_counter() - begin < 30              # reading each span from the text's start took 30 s for 8,000
    loss = "".join(f"\uFEFFété 😀 <|im_end|>{i}" for i in range(1, n, 2))
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (n, len(loss), brute.sha(loss))


# ---------------------------------------------------------------- 6 mixing
@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mixing(which, docs, odd, doc_rows):
    df, rows = (docs, doc_rows) if which == "docs" else (odd, odd_rows())
    got = [(r["doc"]["doc_id"], r["size"], r["source_size"], r["target"], r["copies"]) for r in op6_mixing.plan(df).collect()]
    want = [(r[0], *m) for r, m in zip(rows, brute.mix([(r[0], r[1], r[3]) for r in rows]))]
    rounded = lambda x: sorted([(*r[:3], round(r[3], 6), r[4]) for r in x], key=KEY)
    assert rounded(got) == rounded(want)
    mixed = op6_mixing.mix(df)
    assert mixed.columns == df.columns
    copies = collections.Counter()
    for r in want:
        copies[r[0]] += r[4]
    assert collections.Counter(r["doc_id"] for r in mixed.select("doc_id").collect()) == +copies
    assert max(r[4] for r in want) <= 3


def test_mixing_shares_the_excess_again(spark, empty):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(1, "a"), (100, "b"), (100, "c"), (2, "d"), (0, "e"), (50, None)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc"]["source"]: r["target"] for r in op6_mixing.plan(df).collect()}
    assert got["a"] == 3 and got["d"] == 6 and got["e"] == 0
    left = 253 - 9
    assert got["b"] == pytest.approx(left * 2 / 4) and got["c"] == pytest.approx(left / 4) and got[None] == pytest.approx(left / 4)
    assert op6_mixing.plan(empty).collect() == [] and op6_mixing.mix(empty).collect() == []


# ---------------------------------------------------------------- 7 languages
def test_language_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in op7_language.identify(df).collect()}
    held = [r for r in df.select("doc_id", "lang").collect() if got[r["doc_id"]]["held_out"]]
    assert len(held) > 150 and sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    again = {r["doc_id"]: r for r in op7_language.identify(df.repartition(7)).collect()}
    assert all(again[d]["lang_pred"] == r["lang_pred"] for d, r in got.items())


def test_language_learns_from_whole_texts(spark):
    text = "foreign header " * 2000 + "zzz qqq " * 3000
    df = spark.createDataFrame([(i, text, "xx") for i in range(4)], "doc_id long, text string, lang string")
    rows = op7_language.learning_rows(df, 10).collect()
    assert rows and all((np.frombuffer(r["total"], np.float32) == op7_language.counts(text)).all() for r in rows)


def test_language_sample_has_a_repeated_row_once(spark):
    rows = [(1, "abc def", "xx")] * 30 + [(None, "ghi jkl", "xx")] * 30 + [(i, f"text {chr(97 + i) * 3}", "yy") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = collections.Counter(r["lang"] for r in op7_language.learning_rows(df, 5).collect())
    assert got == {"xx": 2, "yy": 5}


def test_language_of_odd_documents(odd, empty, spark):
    import zlib
    got = op7_language.identify(odd).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3) or (r["doc_id"] is None and r["score"] == 0))
    assert op7_language.identify(empty).collect() == []
    none = spark.createDataFrame([(1, "abc", None), (2, "12 !", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in op7_language.identify(none).collect()} == {"und"}
    one = spark.createDataFrame([(i, "abc def", "xx") for i in range(20)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in op7_language.identify(one).collect()} == {("xx", 1.0)}


def test_code_words_are_apart():
    for n in (2, 3, 4, 6, 9, 40):
        m = op7_language.code_words(n)
        apart = [(a != b).sum() for i, a in enumerate(m) for b in m[:i]]
        assert m.shape[0] == n and min(apart) >= m.shape[1] / 4 and (abs(m.sum(axis=0)) < n).all()


# ---------------------------------------------------------------- 9 quality
@pytest.mark.parametrize("which", ["docs", "odd"])
def test_quality(which, docs, odd, doc_rows):
    df, rows = (docs, doc_rows) if which == "docs" else (odd, odd_rows())
    got = sorted([tuple(r) for r in op9_quality.verdicts(df).select(
        "doc_id", *op9_quality.STATS, "base_failed", "kept", "distance").collect()], key=KEY)
    stats = [brute.statistics(r[1]) for r in rows]
    far = brute.mcd_distances([(r[2], r[3], s) for r, s in zip(rows, stats)], op9_quality.SHARE, op9_quality.STEPS,
                              op9_quality.FLOOR, op9_quality.CONSISTENCY, op9_quality.LEAST)
    want = sorted([(r[0], *s, not s[5] and (d is None or d <= op9_quality.CUT), d) for r, s, d in zip(rows, stats, far)], key=KEY)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    for g, w in zip(got, want):
        assert g[7] == w[7] or abs(w[8] - op9_quality.CUT) < 0.1 * op9_quality.CUT
        if w[8] is not None and not w[6]:
            assert g[8] == pytest.approx(w[8], rel=0.1, abs=0.05)


def test_quality_rejects_planted_outliers(spark, empty):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = df.where("doc_id % 10 = 0").selectExpr("doc_id + 100000 AS doc_id", "regexp_replace(text, ' ', ' ## %% ') AS text", "lang", "source", "n_chars")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    kept = op9_quality.filtered(df.unionByName(junk))
    assert kept.columns == df.columns and kept.where("doc_id >= 100000").count() == 0
    clean = df.join(labels, "doc_id").where("not text rlike '[#*$%&|<>]'")
    stay = kept.join(clean.select("doc_id"), "doc_id", "left_semi").count()
    assert stay >= 0.97 * clean.count()
    assert op9_quality.verdicts(empty).collect() == [] and op9_quality.filtered(empty).collect() == []


# ---------------------------------------------------------------- 10 secrets
def base(r):
    return [x for x in r["spans"] if x["kind"] in op10_secrets.BASE]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_secrets(which, spark, odd):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet") if which == "docs" else odd
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = op10_secrets.digest(op10_secrets.scan(df, op10_secrets.fresh_ledger(df))).collect()
    have = sorted([(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got], key=KEY)
    want = []
    for r in rows:
        s = brute.base_spans(r[1])
        n = collections.Counter(x[2] for x in s)
        want.append((r[0], n["assign"], n["access"], n["hex"], brute.sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in s))))
    assert have == sorted(want, key=KEY)
    assert sum(w[1] + w[2] + w[3] for w in want) > 0


def test_ledger_scans_only_what_is_new(spark):
    key = "secret = abcdef123456"
    df = spark.createDataFrame([(1, key), (2, key), (3, "nothing"), (4, None), (4, "")], "doc_id long, text string")
    path = op10_secrets.fresh_ledger(df)
    rows = lambda: spark.read.parquet(path).count()
    found = {r["doc_id"]: len(r["spans"]) for r in op10_secrets.scan(df, path).collect()}
    assert found == {1: 1, 2: 1, 3: 0, 4: 0} and rows() == 3
    op10_secrets.scan(df, path).collect()
    assert rows() == 3
    more = df.union(spark.createDataFrame([(5, "token: zzzzzz"), (6, key)], df.schema))
    assert {r["doc_id"]: len(r["spans"]) for r in op10_secrets.scan(more, path).collect()} == {**found, 5: 1, 6: 1} and rows() == 4
    assert {len(r["spans"]) for r in op10_secrets.scan(df, path, op10_secrets.RULES[1:]).collect()} == {0} and rows() == 7


def test_more_kinds_and_redaction(odd, empty, spark):
    pem = "-----BEGIN RSA PRIVATE KEY-----\nabc+/=\n-----END RSA PRIVATE KEY-----"
    texts = [f"é {pem} x", "gh" + "p_" + "a1" * 18 + " tail", "my token: xoxb-1234567890-abc", None, "clean <b>"]
    df = spark.createDataFrame([(i, t, 0, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_chars bigint, blob string")
    got = {r["doc_id"]: r for r in op10_secrets.redact(df).collect()}
    assert got[0]["text"] == "é [SECRET] x" and got[0]["n_chars"] == 12
    assert got[1]["text"] == "[SECRET] tail" and got[2]["text"] == "my [SECRET]"
    assert got[3]["text"] is None and got[4]["text"] == "clean <b>" and got[4]["n_chars"] == 0
    out = op10_secrets.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.where("text like '%hunter2%'").count() == 0
    assert op10_secrets.redact(empty).collect() == [] and op10_secrets.scan(empty, op10_secrets.fresh_ledger(empty)).collect() == []


def test_secrets_of_one_text_with_many_matches(spark):
    """Scan and redaction take time that grows with the matches: 80,000 in one text."""
    one = "\uFEFF😀 password = abcdef0123 é "
    df = spark.createDataFrame([(1, one * 80000), (1, one * 80000), (2, "none")], "doc_id long, text string")
    begin = time.perf_counter()
    got = {r["doc_id"]: r["spans"] for r in op10_secrets.scan(df, op10_secrets.fresh_ledger(df)).collect()}
    assert [(x["s"], x["e"]) for x in got[1]] == [m.span() for m in re.finditer("password = [a-f0-9]+", one * 80000)] and got[2] == []
    clean = [r["text"] for r in op10_secrets.redact(df).orderBy("doc_id").collect()]
    assert clean == ["\uFEFF😀 [SECRET] é " * 80000] * 2 + ["none"]
    assert time.perf_counter() - begin < 60


def test_redaction_takes_out_the_union_of_spans(spark):
    rules = (("a", "ab+", 0, 1), ("b", "b+c", 0, 1), ("c", "c+d", 0, 1), ("d", "x", 0, 1))
    texts = ["abbcd", "ab", "-ab-bc-cd-", "xx", "x", "😀abbc😀x", "none", "", "abbccdab x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = []
    for t in texts:
        starts = []
        for s, e in sorted(m.span() for _, p, _, _ in rules for m in re.finditer(p, t)):
            if not starts or s >= starts[-1][1]:
                starts.append([s, e])
            starts[-1][1] = max(starts[-1][1], e)
        out, at = "", 0
        for s, e in starts:
            out, at = out + t[at:s] + "[SECRET]", e
        want.append(out + t[at:])
    assert [r["text"] for r in op10_secrets.redact(df, rules).orderBy("doc_id").collect()] == want

"""Long class and name lists against their plain forms."""
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from testdata_paths import SF001

from rollscope.functions import constants as K
from rollscope.functions import sparse as SP
from rollscope.functions import text as T
from rollscope.functions.trie import alternation
from rollscope.operators import rewards as R
from rollscope.plans import q_lists
from rollscope.plans.fixtures import f1_rollouts


@pytest.mark.parametrize("classes", [K.EMOTION_CLASSES, K.IMAGE_CLASSES])
def test_sparse_scores_equal_the_column_form(spark, classes):
    d = f1_rollouts(spark, SF001, classes)
    cols = ["row_id", "r_accuracy", "r_format", "reward"]
    want = {r[0]: r[1:] for r in R.score_class_rollouts(d, classes).select(*cols).collect()}
    got = {r[0]: r[1:] for r in SP.score_sparse_rollouts(d, classes).select(*cols).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_sparse_probs_by_hand(spark):
    d = spark.createDataFrame([('{"joy": 0.5, fear:1e-3, anger:-0.2, joy:2}',), ("sadness:0.25, sadness:0, joy: 1.0, none:0.3",), (None,), ("",)], "s string")
    got = [r[0] for r in d.select(SP.parse_sparse("s", K.EMOTION_CLASSES)).collect()]
    assert dict(zip(got[0]["c"], got[0]["p"])) == {"fear": 1.0}     # the last joy is out of range, a sign is no value, 1e-3 reads as 1
    assert dict(zip(got[1]["c"], got[1]["p"])) == {"joy": 1.0}
    assert (got[3]["c"], got[3]["p"]) == ([], [])


def test_plan_does_not_grow_with_the_classes(spark):
    def size(n):
        d = spark.createDataFrame([("a", "b")], "completion string, solution string")
        plan = SP.score_sparse_rollouts(d, [f"c{i}" for i in range(n)])._jdf.queryExecution().optimizedPlan().toString()
        return len(re.sub(r"\[c0[^\]]*\]|c\d+,?", "", plan).split("("))
    assert size(20) == size(500)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abA ", min_size=0, max_size=4), min_size=1, max_size=12), st.text("abAB c", max_size=25), st.booleans())
def test_trie_matches_what_the_alternation_matches(names, text, icase):
    flags = re.I if icase else 0
    plain = "|".join(map(re.escape, names))
    trie = alternation(names, re.escape, icase)
    for before, after in ((r"\b(?:", r")\b"), ("(?:", ")")):
        assert [m.span() for m in re.finditer(before + plain + after, text, flags)] == \
            [m.span() for m in re.finditer(before + trie + after, text, flags)]


def test_thousand_names_in_one_pass(spark):
    """Equal to the plain alternation, in the engine that runs it."""
    r = random.Random(3)
    some = [x.title() if i % 2 else x for i, x in enumerate(q_lists.NAMES)]
    texts = [" ".join(r.choice([*some, "zebra", "Xylo.", "the"]) for _ in range(60)) for _ in range(200)]
    d = spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1)
    plain = T.jre(r"\b(" + "|".join(map(T.escape, q_lists.NAMES)) + r")\b", icase=True)
    want = T.py_strip(F.regexp_replace(F.regexp_replace("s", plain, ""), T.jre(r"\s{2,}"), " "))
    at = time.perf_counter()
    a = [x[0] for x in d.select(want).collect()]
    mid = time.perf_counter()
    b = [x[0] for x in d.select(T.remove_class_names("s", q_lists.NAMES)).collect()]
    end = time.perf_counter()
    assert a == b
    print(f"1,000 names: alternation {mid - at:.2f} s, trie {end - mid:.2f} s")


def test_sentences_of_any_length(spark):
    long = "word " * 200_000
    texts = [long, long + ".", "bad. " + long + "bad", "No bad. Good! " * 3, "", " . . bad . ", "a.b.bad"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(T.remove_sentences_with_words("s", ["bad", "worse"])).collect()]

    def plain(t):
        kept = [x for x in re.findall(r"[^。！？.!?]*[。！？.!?]|[^。！？.!?]+\Z", t) if x[-1] not in "。！？.!?" or not ("bad" in x or "worse" in x)]
        return re.sub(r"\s+", " ", "".join(kept)).strip()
    assert got == [plain(t) for t in texts]

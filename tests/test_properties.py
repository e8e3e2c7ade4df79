"""Property tests (hypothesis) on the column functions, evaluated in Spark."""
import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollscope.functions import boxes as B
from rollscope.functions import dist as D
from rollscope.operators import groups as G
from rollscope.operators import tokens as TK

coord = st.integers(min_value=0, max_value=200)


@st.composite
def proper_box(draw):
    x1, y1 = draw(coord), draw(coord)
    return (float(x1), float(y1), float(x1 + draw(st.integers(1, 100))), float(y1 + draw(st.integers(1, 100))))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(proper_box(), proper_box()), min_size=1, max_size=20))
def test_iou_symmetric_bounded_and_reflexive(spark, pairs):
    rows = [a + b for a, b in pairs]
    d = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in "abcdefgh"))
    ba = B.box(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    bb = B.box(F.col("e"), F.col("f"), F.col("g"), F.col("h"))
    for r in d.select(B.iou(ba, bb).alias("ab"), B.iou(bb, ba).alias("ba"), B.iou(ba, ba).alias("aa"),
                      B.iou(ba, bb, "b").alias("vb")).collect():
        assert abs(r["ab"] - r["ba"]) < 1e-12 and 0.0 <= r["ab"] <= 1.0 and abs(r["aa"] - 1.0) < 1e-12
        assert abs(r["vb"] - r["ab"]) < 1e-12        # both variants agree on proper boxes


prob = st.floats(min_value=0.0, max_value=1.0, allow_nan=False)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(*[prob] * 6), min_size=1, max_size=20))
def test_kl_nonnegative_and_hybrid_at_most_one(spark, rows):
    d = spark.createDataFrame(rows, "p0 double, p1 double, p2 double, q0 double, q1 double, q2 double")
    p = [F.col("p0"), F.col("p1"), F.col("p2")]
    q = [F.col("q0"), F.col("q1"), F.col("q2")]
    for r in d.select(D.kl_divergence(p, q).alias("kl"), D.hybrid_reward(p, q).alias("h")).collect():
        assert r["kl"] >= -1e-12 and r["h"] <= 1.0 + 1e-12


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=-5, max_value=5, allow_nan=False), min_size=2, max_size=12))
def test_advantages_sum_to_zero(spark, rewards):
    d = spark.createDataFrame([(0, 0, i, r) for i, r in enumerate(rewards)],
                              "step long, group_id long, gen_idx long, reward double")
    adv = [r["advantage"] for r in G.group_advantages(d, expected_size=None).collect()]
    assert abs(sum(adv)) < 1e-6 * max(1.0, len(adv))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.floats(-5, 0, allow_nan=False), st.floats(-5, 0, allow_nan=False)), min_size=1, max_size=20))
def test_token_kl_nonnegative(spark, rows):
    d = spark.createDataFrame(rows, "logp double, ref_logp double")
    assert all(r["k"] >= -1e-12 for r in d.select(TK.token_kl("logp", "ref_logp").alias("k")).collect())


def test_metamorphic_repartition_same_scores(spark):
    from rollscope.plans.q_class import scored_f1
    from testdata_paths import SF001
    a = scored_f1(spark, SF001).select("row_id", "reward")
    b = scored_f1(spark, SF001).repartition(7, "row_id").select("row_id", "reward")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0

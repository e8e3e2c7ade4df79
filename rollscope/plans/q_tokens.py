"""Token logs (F3 from ``lineitem``), vectors (F6 from ``embeddings``) and the
tolerance diff (F8 from ``supplier``): G4-G7, G10, G12, B5 on vectors."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import dist as D
from ..operators import diff as DF
from ..operators import groups as G
from ..operators import tokens as TK
from . import sqlgen as S
from .catalog import r6, register
from .fixtures import f3_tokens, f3_tokens_sql, table

F3 = f"WITH tok AS ({f3_tokens_sql()}) "
KL_SQL = "(exp(ref_logp - logp) - (ref_logp - logp) - 1)"
SEQ_SQL = (F3 + ", m AS (SELECT *, pos <= coalesce(min(CASE WHEN is_eos THEN pos END) OVER (PARTITION BY seq_id), "
           "max(pos) OVER (PARTITION BY seq_id)) AS mask FROM tok), "
           f"seq AS (SELECT seq_id, step, group_id, sum(CAST(mask AS DOUBLE)) AS length, "
           f"sum({KL_SQL} * CAST(mask AS DOUBLE)) / sum(CAST(mask AS DOUBLE)) AS mean_kl FROM m "
           "GROUP BY seq_id, step, group_id) ")


@register("g4_mask", F3 + "SELECT seq_id, coalesce(min(CASE WHEN is_eos THEN pos END), max(pos)) AS length "
          "FROM tok GROUP BY seq_id")
def q_g4(spark, sf_dir):
    return TK.completion_lengths(f3_tokens(spark, sf_dir))


@register("g5_kl", F3 + f"SELECT seq_id, pos, {S.r6(KL_SQL)} AS kl FROM tok")
def q_g5(spark, sf_dir):
    t = f3_tokens(spark, sf_dir)
    return t.select("seq_id", "pos", r6(TK.token_kl("logp", "ref_logp")).alias("kl"))


def _seq_with_adv(spark, sf_dir):
    st = TK.sequence_stats(f3_tokens(spark, sf_dir))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq_id"),
                                              ((F.col("o_totalprice") % 1000) / 1000).alias("reward"))
    return G.group_advantages(st.join(o, "seq_id"), expected_size=None)


_ADV_SQL = (SEQ_SQL + ", r AS (SELECT seq.*, (o_totalprice % 1000) / 1000 AS reward FROM seq JOIN orders "
            "ON o_orderkey = seq_id), a AS (SELECT *, (reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w "
            "+ 0.0001) AS advantage FROM r WINDOW w AS (PARTITION BY step, group_id)) ")


@register("g6_loss", _ADV_SQL + f"SELECT step, {S.r6('avg(-advantage + ' + repr(K.LOSS_BETA) + ' * mean_kl)')} AS loss, "
          "count(*) FILTER (WHERE advantage IS NULL OR mean_kl IS NULL) AS n_without_loss FROM a GROUP BY step")
def q_g6(spark, sf_dir):
    loss = TK.step_loss(TK.sequence_loss(_seq_with_adv(spark, sf_dir)))
    return loss.select("step", r6("loss").alias("loss"), "n_without_loss")


@register("g7_token_metrics", SEQ_SQL + f"SELECT step, {S.r6('avg(length)')} AS completion_length, "
          f"{S.r6('avg(mean_kl)')} AS kl FROM seq GROUP BY step")
def q_g7t(spark, sf_dir):
    m = TK.token_metrics(TK.sequence_stats(f3_tokens(spark, sf_dir)))
    return m.select("step", r6("completion_length").alias("completion_length"), r6("kl").alias("kl"))


@register("g10_logprob", "SELECT vec_id, " + S.r6(
    "x[label + 1] - (list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))))")
          + " AS logp FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)")
def q_g10(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return e.select("vec_id", r6(TK.gather_logprob("x", "label")).alias("logp"))


_B5V = ("SELECT a.vec_id, {r} AS cos_mse FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) a "
        "JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS y FROM embeddings) b ON b.vec_id = a.vec_id + 1").format(
    r=S.r6("abs(CASE WHEN sqrt(list_sum(list_transform(x, lambda v: v * v))) = 0 OR "
           "sqrt(list_sum(list_transform(y, lambda v: v * v))) = 0 THEN 0.0 ELSE list_dot_product(x, y) / "
           "(sqrt(list_sum(list_transform(x, lambda v: v * v))) * sqrt(list_sum(list_transform(y, lambda v: v * v)))) "
           "END) * 0.8 + exp(-list_sum(list_transform(list_zip(x, y), lambda z: z[1] * abs(z[1] - z[2])))) * 0.2"))


@register("b5_cos_vectors", _B5V)
def q_b5v(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    j = e.join(b, "vec_id")
    return j.select("vec_id", r6(D.cos_mse_reward_arrays("x", "y")).alias("cos_mse"))


_F8 = ("WITH a AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier), "
       "b AS (SELECT s_suppkey AS k, s_acctbal * (1 + CASE WHEN s_suppkey % 3 = 0 THEN 0.002 ELSE 0 END) AS v "
       "FROM supplier WHERE s_suppkey % 50 <> 7) ")
_G12_STATUS = ("CASE WHEN a.k IS NULL THEN 'missing_left' WHEN b.k IS NULL THEN 'missing_right' "
               f"WHEN abs(a.v - b.v) <= {K.ALLCLOSE_ATOL} + {K.ALLCLOSE_RTOL} * abs(b.v) THEN 'close' ELSE 'differs' END")


def _f8(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    a = s.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    b = s.where(F.col("s_suppkey") % 50 != 7).select(
        F.col("s_suppkey").alias("k"),
        (F.col("s_acctbal") * (1 + F.when(F.col("s_suppkey") % 3 == 0, F.lit(0.002)).otherwise(F.lit(0.0)))).alias("v"))
    return a, b


@register("g12_diff", _F8 + f"SELECT coalesce(a.k, b.k) AS k, {_G12_STATUS} AS status FROM a FULL OUTER JOIN b ON a.k = b.k")
def q_g12(spark, sf_dir):
    a, b = _f8(spark, sf_dir)
    return DF.tolerance_diff(a, b, ["k"], ["v"]).select("k", "status")


@register("g12_allclose", _F8 + f"SELECT bool_and({_G12_STATUS} = 'close') AS all_close, count(*) AS n_keys, "
          f"CAST(sum(CASE WHEN {_G12_STATUS} = 'close' THEN 0 ELSE 1 END) AS BIGINT) AS n_bad FROM a FULL OUTER JOIN b ON a.k = b.k")
def q_g12s(spark, sf_dir):
    a, b = _f8(spark, sf_dir)
    return DF.allclose_summary(DF.tolerance_diff(a, b, ["k"], ["v"]))


_G12_B = "o_totalprice * CASE WHEN o_orderkey // 1024 % 7 = 2 THEN 1.0 + 0.002 * (o_orderkey % 3) ELSE 1.0 END"
_G12_IN = "NOT (o_orderkey // 1024 % 7 = 4 AND o_orderkey % 50 = 7)"


@register("g12_blocks", f"WITH a AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DOUBLE) AS v FROM orders), b AS (SELECT o_orderkey AS k, CAST({_G12_B} AS DOUBLE) AS v "
          f"FROM orders WHERE {_G12_IN}) SELECT coalesce(a.k, b.k) AS k, {_G12_STATUS} AS status FROM a FULL OUTER JOIN b ON a.k = b.k")
def q_g12_blocks(spark, sf_dir):
    """G12 over orders in blocks of 1,024 keys, of which two in seven differ: the others are settled by their digests."""
    import uuid
    from ..session import checkpoint_path
    base = checkpoint_path(spark, "rollscope-io", f"blocks-{uuid.uuid4().hex}")
    spelled = lambda x: x.replace("//", "div")
    orders = table(spark, sf_dir, "orders")
    block = F.expr("k div 1024")
    DF.write_blocks(orders.selectExpr("o_orderkey AS k", "CAST(o_totalprice AS DOUBLE) AS v"), f"{base}/a", ["k"], ["v"], block)
    DF.write_blocks(orders.where(spelled(_G12_IN)).selectExpr("o_orderkey AS k", f"CAST({spelled(_G12_B)} AS DOUBLE) AS v"), f"{base}/b", ["k"], ["v"], block)
    return DF.block_diff(f"{base}/a", f"{base}/b", ["k"], ["v"], spark)[0]

"""Deterministic rollout-shaped tables derived from the given parquet tables.

Each fixture exists twice: as a DataFrame plan (what the library runs) and
as DuckDB SQL text (what the oracle runs).  Both read the *whole* source
table, so the work grows with the data.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import compile_scoring


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_PER_TASK = 1 << 15


def spread(df: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` dealt evenly to tasks of about ``rows`` rows, for work that costs far more than reading.  A row
    group of a file is read by one task, however many rows it packs into few bytes.  Give the few
    columns that the work starts from; a table of one such task stays as it is."""
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if tasks > 1 else df


def _s(c):
    return c.cast("string")


# ---------------------------------------------------------------- F1 rollouts
def _f1_exprs(classes, dialect: str) -> list[str]:
    """F1 columns as SQL expressions over ``e`` (= event_id), in either
    dialect: the Spark plan and the DuckDB oracle share one definition."""
    idiv = (lambda a, b: f"({a} div {b})") if dialect == "spark" else (lambda a, b: f"({a} // {b})")
    txt = (lambda x: f"CAST({x} AS STRING)") if dialect == "spark" else (lambda x: f"CAST({x} AS VARCHAR)")
    nl = "char(10)" if dialect == "spark" else "chr(10)"

    def dist(base, mult_off, first_override=None):
        parts = []
        for i, cls in enumerate(classes):
            v = f"concat('0.', {txt(f'({base} * {i + mult_off} + {i}) % 10')})"
            if i == 0 and first_override:
                v = f"(CASE WHEN {first_override} THEN '1.5' ELSE {v} END)"
            parts.append(f"concat('{cls}:', {v})")
        return "concat_ws(', ', " + ", ".join(parts) + ")"

    g = idiv("e", 8)
    think = (f"CASE WHEN e % 11 = 0 THEN '' ELSE concat('<think>the scene shows item ', {txt('e')}, "
             f"CASE WHEN e % 13 = 0 THEN {nl} ELSE ' ' END, 'with soft light.', "
             f"CASE WHEN e % 7 = 0 THEN concat(' score 0.', {txt('e % 10')}) ELSE '' END, '</think>') END")
    answer = (f"CASE WHEN e % 19 = 0 THEN '' ELSE concat('<answer>{{', {dist('e', 3, 'e % 17 = 0')}, "
              "CASE WHEN e % 23 = 0 THEN ', joy:0.1' ELSE '' END, '}</answer>') END")
    return [
        "e AS row_id", f"{g} AS group_id", "e % 8 AS gen_idx", f"{idiv('e', 128)} AS step",
        f"concat('img/', {txt(g)}, '.jpg') AS image_path",
        f"concat({think}, CASE WHEN e % 5 = 0 THEN {nl} ELSE '' END, {answer}) AS completion",
        f"concat('<answer>{{', {dist(g, 2)}, '}}</answer>') AS solution",
    ]


def f1_rollouts(spark: SparkSession, sf_dir: str, classes=K.EMOTION_CLASSES) -> DataFrame:
    """emotion rollouts from ``events`` (G = 8 rollouts per group)."""
    compile_scoring(spark)
    return spread(table(spark, sf_dir, "events").selectExpr("event_id AS e")).selectExpr(*_f1_exprs(classes, "spark"))


def f1_sql(classes=K.EMOTION_CLASSES) -> str:
    """DuckDB form of F1 (a CTE body)."""
    return "SELECT " + ", ".join(_f1_exprs(classes, "duckdb")) + " FROM (SELECT event_id AS e FROM events)"


# ------------------------------------------------------------- F2 box rollouts
F2_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
            "l_discount", "l_tax"]


def f2_box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 long form: one gt box and one predicted box per ``lineitem`` row,
    numbered within the order (``(l_orderkey, l_linenumber)`` is not unique)."""
    from pyspark.sql import Window
    w = Window.partitionBy("l_orderkey").orderBy(*F2_ORDER)
    li = table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(w))
    g = li.selectExpr("l_orderkey AS image_id", "CAST(rn AS BIGINT) AS box_no",
                      "(l_partkey * 37) % 600 AS gx1", "(l_suppkey * 53) % 600 AS gy1",
                      "(l_partkey * 37) % 600 + 50 + 4 * CAST(floor(l_quantity) AS BIGINT) AS gx2",
                      "(l_suppkey * 53) % 600 + 50 + 5 * (l_orderkey % 40) AS gy2")
    return g.selectExpr("image_id", "box_no", "gx1", "gy1", "gx2", "gy2",
                        "gx1 + (7 * image_id + box_no) % 30 AS px1", "gy1 + (11 * image_id) % 25 AS py1",
                        "gx2 + (3 * image_id) % 20 AS px2", "gy2 + box_no AS py2",
                        "(image_id + box_no) % 7 != 0 AS has_gt", "(image_id + box_no) % 5 != 0 AS has_pred")


def f2_box_pairs_sql() -> str:
    return """
    SELECT image_id, box_no, gx1, gy1, gx2, gy2,
           gx1 + (7 * image_id + box_no) % 30 AS px1, gy1 + (11 * image_id) % 25 AS py1,
           gx2 + (3 * image_id) % 20 AS px2, gy2 + box_no AS py2,
           (image_id + box_no) % 7 <> 0 AS has_gt, (image_id + box_no) % 5 <> 0 AS has_pred
    FROM (SELECT l_orderkey AS image_id, rn AS box_no, (l_partkey * 37) % 600 AS gx1, (l_suppkey * 53) % 600 AS gy1,
                 (l_partkey * 37) % 600 + 50 + 4 * CAST(floor(l_quantity) AS BIGINT) AS gx2,
                 (l_suppkey * 53) % 600 + 50 + 5 * (l_orderkey % 40) AS gy2
          FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY """ + ", ".join(F2_ORDER) + """) AS rn
                FROM lineitem))
    """


def _f2_text_exprs(dialect: str) -> list[str]:
    """F2 text columns (``solution``, ``completion``) as SQL over ``gt`` /
    ``pred`` box arrays, in the Spark or the DuckDB dialect."""
    spark = dialect == "spark"
    txt = (lambda x: f"CAST({x} AS STRING)") if spark else (lambda x: f"CAST({x} AS VARCHAR)")
    nl = "char(10)" if spark else "chr(10)"
    lam = (lambda v, body: f"{v} -> {body}") if spark else (lambda v, body: f"lambda {v}: {body}")
    tf, join = ("transform", "array_join") if spark else ("list_transform", "array_to_string")

    def boxes_txt(arr, coord_sep, box_sep):
        one = ("concat('[', " + f", '{coord_sep}', ".join(txt(f"CAST(b.{k} AS BIGINT)")
                                                          for k in ("x1", "y1", "x2", "y2")) + ", ']')")
        return f"concat('[', {join}({tf}({arr}, {lam('b', one)}), {box_sep}), ']')"

    pred_txt = (f"(CASE WHEN image_id % 11 = 0 THEN {boxes_txt('pred', ', ', f'concat(chr(44), {nl})')} "
                f"ELSE {boxes_txt('pred', ',', chr(39) + ',' + chr(39))} END)")
    # JSON white space that survives the deletion of spaces and newlines
    ch = (lambda n: f"char({n})") if spark else (lambda n: f"chr({n})")
    tab1 = f"concat(', [\"a\",', {ch(9)}, '1,2,3,4]')"
    tab2 = f"concat(', [1e2,', {ch(9)}, '2,3,4]')"
    cr = f"concat(', [5,', {ch(13)}, '6,7,', {ch(13)}, '8]')"
    solution = f"concat('<answer>', {boxes_txt('gt', ',', chr(39) + ',' + chr(39))}, '</answer>') AS solution"
    completion = f"""concat(CASE WHEN image_id % 23 = 0 THEN '' ELSE concat('<think>',
                    CASE WHEN image_id % 9 = 0 THEN '[1, 2, 3, 4]'
                         ELSE concat('locating items of order ', {txt('image_id')}) END, '</think>') END,
                  CASE WHEN image_id % 19 = 0 THEN {pred_txt}
                       ELSE concat('<answer>', {pred_txt},
                                   CASE WHEN image_id % 13 = 0 THEN ', [1, 2, 3]' ELSE '' END,
                                   CASE WHEN image_id % 17 = 0 THEN ', [01, 2, 3, 4]' ELSE '' END,
                                   CASE WHEN image_id % 29 = 0 THEN {tab1} ELSE '' END,
                                   CASE WHEN image_id % 31 = 0 THEN {tab2} ELSE '' END,
                                   CASE WHEN image_id % 37 = 0 THEN {cr} ELSE '' END, '</answer>') END)
             AS completion"""
    return [solution, completion]


def f2_box_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 per image: gt / pred box arrays plus their text forms
    (``solution`` and ``completion``), with parser edge cases mixed in."""
    pairs = f2_box_pairs(spark, sf_dir)
    box = lambda p: ("struct(" + ", ".join(f"CAST({p}{k} AS DOUBLE) AS {k}" for k in ("x1", "y1", "x2", "y2")) + ")")
    g = pairs.groupBy("image_id").agg(
        F.expr(f"array_sort(collect_list(CASE WHEN has_gt THEN struct(box_no, {box('g')} AS b) END))").alias("_g"),
        F.expr(f"array_sort(collect_list(CASE WHEN has_pred THEN struct(box_no, {box('p')} AS b) END))").alias("_p"))
    g = g.selectExpr("image_id", "transform(_g, x -> x.b) AS gt", "transform(_p, x -> x.b) AS pred")
    return g.selectExpr("image_id", "gt", "pred", *_f2_text_exprs("spark"))


def f2_box_rollouts_sql() -> str:
    box = lambda p: (f"struct_pack(x1 := CAST({p}x1 AS DOUBLE), y1 := CAST({p}y1 AS DOUBLE), "
                     f"x2 := CAST({p}x2 AS DOUBLE), y2 := CAST({p}y2 AS DOUBLE))")
    return f"""
    SELECT image_id, gt, pred, {", ".join(_f2_text_exprs("duckdb"))}
    FROM (SELECT image_id,
                 coalesce(list({box('g')} ORDER BY box_no) FILTER (WHERE has_gt), []) AS gt,
                 coalesce(list({box('p')} ORDER BY box_no) FILTER (WHERE has_pred), []) AS pred
          FROM ({f2_box_pairs_sql()}) GROUP BY image_id)
    """


# ------------------------------------------------------------ F5 annotation items
def f5_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """catalog rows from ``part`` shaped like the training table."""
    k = F.col("p_partkey")
    cls = F.element_at(F.array(*[F.lit(c) for c in K.GENERATOR_CLASSES]), (k % 20 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        k.alias("row_id"), (k % 20).alias("class_idx"), cls.alias("target"),
        F.concat(F.lit("train/c"), (k % 20).cast("string"), F.lit("/"), k.cast("string"), F.lit(".jpg")).alias("image_path"),
        F.when(k % 17 == 0, F.lit(None)).when(k % 29 == 0, F.lit(0)).otherwise(200 + 10 * F.col("p_size"))
        .cast("int").alias("width"),
        (300 + k % 700).cast("int").alias("height"),
        F.when(k % 31 == 0, F.lit(4)).when(k % 5 == 0, F.lit(1)).otherwise(F.lit(3)).cast("int").alias("channels"),
        F.when(k % 10 == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"),
        F.col("p_size"), F.col("p_retailprice"))


def f5_items_sql() -> str:
    classes = "[" + ", ".join("'" + c + "'" for c in K.GENERATOR_CLASSES) + "]"
    return f"""
    SELECT p_partkey AS row_id, p_partkey % 20 AS class_idx, {classes}[p_partkey % 20 + 1] AS target,
           concat('train/c', CAST(p_partkey % 20 AS VARCHAR), '/', CAST(p_partkey AS VARCHAR), '.jpg') AS image_path,
           CAST(CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN 0 ELSE 200 + 10 * p_size END AS INTEGER)
             AS width,
           CAST(300 + p_partkey % 700 AS INTEGER) AS height,
           CAST(CASE WHEN p_partkey % 31 = 0 THEN 4 WHEN p_partkey % 5 = 0 THEN 1 ELSE 3 END AS INTEGER) AS channels,
           CASE WHEN p_partkey % 10 = 0 THEN 'test' ELSE 'train' END AS split, p_size, p_retailprice
    FROM part
    """


# ------------------------------------------------------------------ F3 token logs
def f3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one token per ``lineitem`` row; sequences are orders (1-7 tokens)."""
    from pyspark.sql import Window
    w = Window.partitionBy("l_orderkey").orderBy(*F2_ORDER)
    li = table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(w))
    o = F.col("l_orderkey")
    return li.select(o.alias("seq_id"), F.col("rn").cast("int").alias("pos"),
                     F.expr("l_orderkey div 8").alias("group_id"), (o % 8).alias("gen_idx"),
                     F.expr("l_orderkey div 1024").alias("step"),
                     (-(10 * F.col("l_discount") + 0.01)).alias("logp"),
                     (-(10 * F.col("l_tax") + 0.02)).alias("ref_logp"),
                     (F.col("l_returnflag") == "R").alias("is_eos"))


def f3_tokens_sql() -> str:
    return """
    SELECT l_orderkey AS seq_id, CAST(rn AS INTEGER) AS pos, l_orderkey // 8 AS group_id, l_orderkey % 8 AS gen_idx,
           l_orderkey // 1024 AS step, -(10 * l_discount + 0.01) AS logp, -(10 * l_tax + 0.02) AS ref_logp,
           l_returnflag = 'R' AS is_eos
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY """ + ", ".join(F2_ORDER) + """) AS rn
          FROM lineitem)
    """

"""Long-form matching against the dense solver; components against union-find."""
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollscope.functions import boxes as B
from rollscope.functions.matching import match_sum
from rollscope.operators.graph import components
from rollscope.operators.long_boxes import match_long, overlapping_pairs


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(700 + i, 700 + (i + 1) % 9) for i in range(9)] + [(3, 3), (2, 1), (1, 2)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    want = {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 540)}, **{700 + i: 700 for i in range(9)}, 1: 1, 2: 1}
    assert got == want
    assert components(spark.createDataFrame([], "a int, b int")).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_long_form_equals_dense(spark, seed):
    r = random.Random(seed)

    def boxes(image, n, span):
        out = []
        for k in range(n):
            x, y = r.uniform(0, span), r.uniform(0, span)
            out.append((image, k, x, y, x + r.choice([0, 5, 40, 300]), y + r.choice([5, 30, 200])))
        return out
    cols = "image_id int, box_no int, x1 double, y1 double, x2 double, y2 double"
    gt = [b for i, n in enumerate([0, 3, 40, 150]) for b in boxes(i, n, 600 + 900 * seed)]
    pred = [b for i, n in enumerate([2, 0, 55, 120]) for b in boxes(i, n, 600 + 900 * seed)]
    g, p = spark.createDataFrame(gt, cols), spark.createDataFrame(pred, cols)
    got = {x["image_id"]: (x["n_gt"], x["n_pred"], x["match_sum"]) for x in match_long(g, p).collect()}
    pack = lambda d, c: d.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("box_no", B.box(*map(F.col, ("x1", "y1", "x2", "y2"))).alias("b")))).alias("l")) \
        .select("image_id", F.transform("l", lambda x: x["b"]).alias(c))
    dense = pack(g, "g").join(pack(p, "p"), "image_id").select("image_id", B.pair_matrix("g", "p").alias("m"))
    want = {x["image_id"]: x["s"] for x in dense.select("image_id", match_sum("m").alias("s")).collect()}
    for i, (n, m, s) in got.items():
        assert s == pytest.approx(want.get(i, 0.0), abs=1e-9)
    assert {i: v[:2] for i, v in got.items()} == {0: (0, 2), 1: (3, 0), 2: (40, 55), 3: (150, 120)}
    pairs = overlapping_pairs(g, p).collect()
    assert len(pairs) == len({(x["image_id"], x["g"], x["p"]) for x in pairs})
    whole = dense.select(F.aggregate(F.flatten("m"), F.lit(0.0), lambda a, x: a + x).alias("t")).agg(F.sum("t")).first()[0]
    assert sum(x["iou"] for x in pairs) == pytest.approx(whole)


def _some_boxes(spark, seed=5):
    r = random.Random(seed)
    cols = "image_id string, box_no string, x1 double, y1 double, x2 double, y2 double"

    def one(image, n, side):
        out = []
        for k in range(n):
            x, y = r.uniform(0, 400), r.uniform(0, 400)
            out.append((image, f"{side}{k}", x, y, x + r.choice([0, 8, 30, 150]), y + r.choice([5, 30])))
        return out
    make = lambda s, sizes: spark.createDataFrame([b for i, n in enumerate(sizes) for b in one(f"im {i}", n, s)], cols)
    return make("g", [3, 60, 0, 25, 1]), make("p", [2, 70, 4, 20, 0])


def test_long_form_of_small_and_large_images_is_the_same(spark, monkeypatch):
    """an image's pairs go to one task at once; images of more pairs than a task takes are solved by rounds, with the same totals."""
    from rollscope.operators import long_boxes as L
    g, p = _some_boxes(spark)
    rounds = []
    monkeypatch.setattr(L, "components", lambda e: rounds.append(1) or components(e))
    rows = lambda: {x["image_id"]: (x["n_gt"], x["n_pred"], round(x["match_sum"], 9)) for x in match_long(g, p).collect()}
    once = rows()
    assert not rounds and len(once) == 5 and once["im 1"][2] > 1
    for n in (30, 0):
        monkeypatch.setattr(L, "PAIRS", n)
        assert rows() == once
    assert len(rounds) == 2


def test_pairs_of_small_and_large_images_are_the_same(spark, monkeypatch):
    """boxes meet within one task, or by cells where the image has more boxes than a task takes; blocks and grids do not matter."""
    from rollscope.operators import long_boxes as L
    g, p = _some_boxes(spark)
    rows = lambda grid=64: sorted(map(tuple, overlapping_pairs(g, p, grid=grid).collect()))
    once = rows()
    assert len(once) > 50 and not any("x0" in c for c in overlapping_pairs(g, p).columns)
    assert "Join" not in overlapping_pairs(g, p)._jdf.queryExecution().executedPlan().toString()
    assert rows(grid=1) == rows(grid=7) == once
    for n in (60, 0):
        monkeypatch.setattr(L, "BOXES", n)
        assert rows() == once
    monkeypatch.undo()
    table = pa.Table.from_pylist([{"i": 1, "of_g": s == "g", "g": k if s == "g" else None, "p": k if s == "p" else None, "x1": float(k % 9), "y1": float(k // 9), "x2": k % 9 + 2.0, "y2": k // 9 + 2.0}
                                  for k in range(81) for s in "gp"], pa.schema([("i", pa.int64()), ("of_g", pa.bool_()), ("g", pa.int64()), ("p", pa.int64()), *[(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")]]))
    found = lambda: sorted(tuple(r.values()) for b in L.pairs_in_order(64)(iter(table.to_batches())) for r in b.to_pylist())
    want = found()
    assert len(want) == (9 + 2 * 8) ** 2
    monkeypatch.setattr(L, "BLOCK", 5)
    monkeypatch.setattr(L, "CELLS", 2)
    assert found() == want

"""Pair scores and optimal matching (X8, X9) for images with thousands of boxes, in long form.

A dense score matrix of such an image is mostly zeros.  Boxes meet in the cells of a
grid over their image; pairs that overlap are the edges of a graph, whose connected
components are matched each on its own: pairs without overlap score 0 (IoU variant
a), so they add nothing to the best total.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import boxes as B
from ..functions.matching import batch_assignment
from .graph import components, table_of

GRID = 64            # cells across an image: a box lies in 65 x 65 at most
BOXES = 1 << 15      # boxes of an image that one task takes whole
CELLS = 8            # cells that a box lies in, on average, where a task has the whole image
BLOCK = 1 << 20      # candidates that are compared at once
PAIRS = 1 << 17      # overlapping pairs of an image that one task takes whole


def by_image(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of whole images, of ``rows`` rows or little more, from rows that come image by image (the first column)."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < rows:
            continue
        i = held.column(0).combine_chunks().dictionary_encode().indices.to_numpy()
        cut = int(np.searchsorted(i, i[-1]))          # the last image may go on
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None:
        yield held


def pairs_in_order(grid: int):
    """(i, g, p, iou) of the overlapping pairs, from rows (i, of_g, g, p, x1, y1, x2, y2) that come image by image."""
    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        i, g, p = (t.column(c).combine_chunks() for c in (0, 2, 3))
        image = i.dictionary_encode().indices.to_numpy().astype(np.int64)
        of_g = t.column(1).to_numpy()
        x1, y1, x2, y2 = (t.column(c).to_numpy() for c in range(4, 8))
        area = (x2 - x1) * (y2 - y1)
        starts = np.flatnonzero(np.diff(image, prepend=-1))
        x0, y0 = np.minimum.reduceat(x1, starts), np.minimum.reduceat(y1, starts)
        w = np.maximum(np.maximum(np.maximum.reduceat(x2, starts) - x0, np.maximum.reduceat(y2, starts) - y0), 1e-9)
        n = grid
        while True:                                   # wide boxes: fewer cells
            ax, bx = (np.floor((v - x0[image]) * n / w[image]).astype(np.int64) for v in (x1, x2))
            ay, by = (np.floor((v - y0[image]) * n / w[image]).astype(np.int64) for v in (y1, y2))
            ny = by - ay + 1
            count = (bx - ax + 1) * ny
            if n == 1 or count.sum() <= CELLS * len(image):
                break
            n //= 2
        row = np.repeat(np.arange(len(image)), count)
        off = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        cx, cy = ax[row] + off // ny[row], ay[row] + off % ny[row]
        key = (image[row] * (n + 1) + cx) * (n + 1) + cy
        left, right = np.flatnonzero(of_g[row]), np.flatnonzero(~of_g[row])
        right = right[np.argsort(key[right], kind="stable")]
        low = np.searchsorted(key[right], key[left], "left")
        met = np.searchsorted(key[right], key[left], "right") - low
        ends = np.cumsum(met)
        s = 0
        while s < len(left):
            done = ends[s - 1] if s else 0
            e = max(s + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
            a = np.repeat(np.arange(s, e), met[s:e])
            c = right[low[a] + np.arange(len(a)) - (ends - met)[a] + done]
            a, s = left[a], e
            u, v = row[a], row[c]
            xa, ya, xb, yb = np.maximum(x1[u], x1[v]), np.maximum(y1[u], y1[v]), np.minimum(x2[u], x2[v]), np.minimum(y2[u], y2[v])
            # the cell where the overlap begins
            ok = (cx[a] == np.maximum(ax[u], ax[v])) & (cy[a] == np.maximum(ay[u], ay[v])) & (xb > xa) & (yb > ya)
            u, v = u[ok], v[ok]
            inter = ((xb - xa) * (yb - ya))[ok]
            union = area[u] + area[v] - inter
            iou = np.divide(inter, union, out=np.zeros(len(u)), where=union > 0)
            u, v, iou = u[iou > 0], v[iou > 0], iou[iou > 0]
            if len(u):
                yield pa.RecordBatch.from_arrays([i.take(pa.array(u)), g.take(pa.array(u)), p.take(pa.array(v)), pa.array(iou)], ["i", "g", "p", "iou"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_image(batches, BOXES):
            yield from pairs(t)
    return go


def overlapping_pairs(gt: DataFrame, pred: DataFrame, image: str = "image_id", box: str = "box_no", grid: int = GRID) -> DataFrame:
    """X8 in long form: (image, g, p, iou) of all pairs of boxes of an image whose IoU is above 0.

    ``gt`` and ``pred`` are (image, box, x1, y1, x2, y2), a row a box.  The cell size is the image's
    extent over ``grid``.  A pair is kept in the one cell that holds the corner where its overlap
    begins, so none comes twice and nothing is removed afterwards.  An image of at most ``BOXES`` boxes is one task's: its boxes
    meet there, after one exchange.  The boxes of a larger one are dealt by cells."""
    spark = gt.sparkSession
    side = lambda d, s: d.select(F.col(image).alias("i"), F.col(box).alias(s), B.box(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).alias(f"{s}b"))
    g, p = side(gt, "g"), side(pred, "p")
    large = table_of(g.select("i").union(p.select("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BOXES).select("i"))
    some = not large.isEmpty()
    kinds = {s: d.schema[s].dataType for d, s in ((g, "g"), (p, "p"))}
    flat = lambda d, s: d.where(F.col("i").isNotNull() & (F.col(f"{s}b.x2") > F.col(f"{s}b.x1")) & (F.col(f"{s}b.y2") > F.col(f"{s}b.y1"))).select(
        "i", F.lit(s == "g").alias("of_g"), *[F.col(c) if c == s else F.lit(None).cast(kinds[c]).alias(c) for c in "gp"], f"{s}b.*")
    few = flat(g, "g").union(flat(p, "p"))
    few = few.join(large, "i", "left_anti").select(few.columns) if some else few
    few = few.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "i").sortWithinPartitions("i")
    schema = StructType([StructField("i", g.schema["i"].dataType), *[StructField(s, kinds[s]) for s in "gp"], StructField("iou", DoubleType())])
    out = few.mapInArrow(pairs_in_order(grid), schema)
    if some:
        out = out.union(_pairs_by_cells(g.join(large, "i", "left_semi"), p.join(large, "i", "left_semi"), grid))
    return out.withColumnRenamed("i", image)


def _pairs_by_cells(g: DataFrame, p: DataFrame, grid: int) -> DataFrame:
    each = g.select("i", F.col("gb").alias("b")).union(p.select("i", F.col("pb").alias("b")))
    size = each.groupBy("i").agg(F.min("b.x1").alias("x0"), F.min("b.y1").alias("y0"),
                                 F.greatest(F.max("b.x2") - F.min("b.x1"), F.max("b.y2") - F.min("b.y1"), F.lit(1e-9)).alias("w"))
    cell = lambda v, low: F.floor((v - low) * F.lit(grid) / F.col("w")).cast("int")

    def in_cells(d, s):
        b = F.col(f"{s}b")
        d = d.where((b["x2"] > b["x1"]) & (b["y2"] > b["y1"])).join(size, "i")
        d = d.withColumns({"fx": cell(b["x1"], F.col("x0")), "fy": cell(b["y1"], F.col("y0"))})
        d = d.withColumn("cx", F.explode(F.sequence("fx", cell(b["x2"], F.col("x0")))))
        d = d.withColumn("cy", F.explode(F.sequence("fy", cell(b["y2"], F.col("y0")))))
        return d.select("i", "cx", "cy", s, f"{s}b", (F.col("cx") == F.col("fx")).alias(f"{s}x"), (F.col("cy") == F.col("fy")).alias(f"{s}y"))

    # the larger of two first cells is the cell of the larger corner
    met = in_cells(g, "g").join(in_cells(p, "p"), ["i", "cx", "cy"]).where("(gx or px) and (gy or py)")
    return met.select("i", "g", "p", B.iou("gb", "pb", "a").alias("iou")).where("iou > 0")


@F.pandas_udf(DoubleType())
def component_total(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The best one-to-one total of components, given as arrays of struct(g, p, iou)."""
    for lists in batches:
        mats = []
        for pairs in lists:
            g, gi = np.unique([x["g"] for x in pairs], return_inverse=True)
            p, pi = np.unique([x["p"] for x in pairs], return_inverse=True)
            m = np.zeros((len(g), len(p)))
            m[gi, pi] = [x["iou"] for x in pairs]
            mats.append(m)
        yield pd.Series(batch_assignment(mats))


def edge_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of the edges (a, b) between nodes 0 .. n - 1 is connected with."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return x
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def image_totals(image: np.ndarray, g: np.ndarray, p: np.ndarray, iou: np.ndarray) -> np.ndarray:
    """The best one-to-one total of images 0, 1, .. whose pairs (image, g, p, iou) are given, by components."""
    gi, a = np.unique(image * (g.max() + 1) + g, return_inverse=True)
    pi, b = np.unique(image * (p.max() + 1) + p, return_inverse=True)
    comp = edge_components(a, b + len(gi), len(gi) + len(pi))
    _, comp = np.unique(comp, return_inverse=True)
    order = np.argsort(comp, kind="stable")
    image, a, b, iou, comp = image[order], a[order], b[order], iou[order], comp[order]
    starts = np.flatnonzero(np.diff(comp, prepend=-1))
    ends = np.append(starts[1:], len(comp))

    def places(node, n):
        """Each edge's place of its node among the nodes of the component, and how many these are."""
        of = np.empty(n, np.int64)
        of[node] = comp
        by = np.argsort(of, kind="stable")
        count = np.bincount(of, minlength=len(starts))
        at = np.empty(n, np.int64)
        at[by] = np.arange(n) - (np.cumsum(count) - count)[of[by]]
        return at[node], count

    (r, rows), (c, columns) = places(a, len(gi)), places(b, len(pi))
    total = np.maximum.reduceat(iou, starts)          # a component of one row or one column
    rest = np.flatnonzero((rows > 1) & (columns > 1))
    mats = []
    for k in rest:
        s = slice(starts[k], ends[k])
        m = np.zeros((rows[k], columns[k]))
        m[r[s], c[s]] = iou[s]
        mats.append(m)
    total[rest] = batch_assignment(mats)
    return np.bincount(image[starts], total)


def totals_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(image, s) of rows (image, g, p, iou) that come image by image; whole images are solved together."""
    def solved(t: pa.Table) -> pa.RecordBatch:
        code = [t.column(c).combine_chunks().dictionary_encode() for c in range(3)]
        num = [x.indices.to_numpy().astype(np.int64) for x in code]
        return pa.RecordBatch.from_arrays([code[0].dictionary, pa.array(image_totals(*num, t.column(3).to_numpy()))], [t.column_names[0], "s"])

    for t in by_image(batches, PAIRS):
        yield solved(t)


def match_long(gt: DataFrame, pred: DataFrame, image: str = "image_id", box: str = "box_no", grid: int = GRID) -> DataFrame:
    """X9 in long form: (image, n_gt, n_pred, match_sum) for every image with a box on either side; equal
    to ``matching.match_sum`` of the dense matrix of variant-a IoUs.

    The pairs are written once to the shared folder.  An image of at most ``PAIRS`` pairs is one task's: its components are found
    and solved there, from one exchange.  A larger one's components are found by rounds and
    spread over tasks; one task solves one component."""
    spark = gt.sparkSession
    pairs = table_of(overlapping_pairs(gt, pred, image, box, grid).where("g is not null and p is not null"))
    large = table_of(pairs.groupBy(image).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PAIRS).select(image))
    some = not large.isEmpty()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = (pairs.join(large, image, "left_anti") if some else pairs).repartition(n, image).sortWithinPartitions(image)
    total = few.select(image, "g", "p", "iou").mapInArrow(totals_in_order, StructType([pairs.schema[image], StructField("s", DoubleType())]))
    if some:
        node = lambda s: F.concat(F.col(image).cast("string"), F.lit(f" {s} "), F.col(s).cast("string"))
        many = pairs.join(large, image, "left_semi").withColumns({"a": node("g"), "b": node("p")})
        label = components(many.select("a", "b"))
        own = many.join(label, many["a"] == label["id"]).groupBy(image, "component").agg(F.collect_list(F.struct("g", "p", "iou")).alias("m"))
        total = total.union(own.select(image, component_total("m").alias("s")).groupBy(image).agg(F.sum("s").alias("s")))
    total = total.withColumnRenamed("s", "match_sum")
    n = (gt.select(image, F.lit(1).alias("g"), F.lit(0).alias("p")).union(pred.select(image, F.lit(0), F.lit(1)))
         .groupBy(image).agg(F.sum("g").alias("n_gt"), F.sum("p").alias("n_pred")))
    return n.join(total, image, "left").select(image, "n_gt", "n_pred", F.coalesce("match_sum", F.lit(0.0)).alias("match_sum"))

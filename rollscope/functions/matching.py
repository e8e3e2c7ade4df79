"""Optimal one-to-one matching (X9): the maximum total of an n x m score matrix
over assignments that pair min(n, m) items.

Spark has no assignment built-in, so ``match_sum`` is an Arrow-batched pandas
UDF over the flattened matrix.  The rows of a batch are solved together by one
exact method for every size: shortest augmenting paths with dual prices, each
numpy step taken for all matrices of a chunk at once.  A matrix that fills a chunk
alone gets its first prices by bids of its rows.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import _c

CHUNK_CELLS = 1 << 18          # cells of the padded matrices that are solved together
BIDS = 16                      # bids of a row, on average, before augmenting paths take over


def _dims(m):
    n = F.size(m)
    k = F.when(n > 0, F.size(F.try_element_at(m, F.lit(1)))).otherwise(F.lit(0))
    return n, k


def solve_padded(cost: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Minimum-cost assignment of the first ``rows[b]`` rows of each matrix
    ``cost[b]`` (n <= m; padded columns cost inf, so they are never used).
    Returns the column of each row (-1 for padded rows)."""
    b, n, m = cost.shape
    all_ = np.arange(b)
    u, v = np.zeros((b, n)), np.zeros((b, m))
    owner = np.full((b, m), -1)                       # row that holds a column
    for i in range(n):
        at = all_[rows > i]                           # matrices with such a row
        k = len(at)
        if not k:
            break
        lane = np.arange(k)
        row = np.full(k, i)
        dist, back = np.full((k, m), np.inf), np.full((k, m), -1)
        seen = np.zeros((k, m), bool)
        total = np.zeros(k)
        end = np.full(k, -1)
        column = np.full(k, -1)                       # column last reached, -1 at the start
        live = lane
        while len(live):
            # shortest step from the row in hand to each column not yet reached
            g = at[live]
            step = total[live][:, None] + cost[g, row[live]] - u[g, row[live]][:, None] - v[g]
            better = ~seen[live] & (step < dist[live])
            dist[live] = np.where(better, step, dist[live])
            back[live] = np.where(better, column[live][:, None], back[live])
            open_ = np.where(seen[live], np.inf, dist[live])
            column[live] = open_.argmin(axis=1)
            total[live] = open_[np.arange(len(live)), column[live]]
            seen[live, column[live]] = True
            row[live] = owner[g, column[live]]
            done = row[live] < 0
            end[live[done]] = column[live[done]]
            live = live[~done]
        # prices: columns reached (but the last) and their rows move by what the path saved
        moved = seen.copy()
        moved[lane, end] = False
        gain = np.where(moved, total[:, None] - np.where(moved, dist, 0.0), 0.0)
        u[at, i] += total
        hit, col = np.nonzero(moved)
        u[at[hit], owner[at[hit], col]] += gain[hit, col]
        v[at] -= gain
        # walk the path back
        live, col = lane, end
        while len(live):
            before = back[live, col]
            start = before < 0
            owner[at[live], col] = np.where(start, i, owner[at[live], before])
            live, col = live[~start], before[~start]
    out = np.full((b, n), -1)
    mat, col = np.nonzero(owner >= 0)
    out[mat, owner[mat, col]] = col
    return out


def solve_one(cost: np.ndarray) -> np.ndarray:
    """The same for one finite n x m matrix (n <= m): the column of each row.

    Rows first bid for their cheapest column at the price of the second cheapest (the row
    reduction of Jonker and Volgenant), ``BIDS`` times the rows at most; a column that is free keeps
    price 0, or, in a square matrix, its lowest cost.  Only the rows left without a column need
    shortest augmenting paths, which start from these prices."""
    n, m = cost.shape
    v = cost.min(axis=0) if n == m else np.zeros(m)
    owner, col = np.full(m, -1), np.full(n, -1)
    free, bids = list(range(n)), 0
    while free and bids < BIDS * n:
        todo, free = free[::-1], []
        while todo:
            i = todo.pop()
            bids += 1
            if bids > BIDS * n:
                free.append(i)
                continue
            net = cost[i] - v
            j = net.argmin()
            low = net[j]
            net[j] = np.inf
            second = net.argmin()
            gap = net[second] - low if m > 1 else 0.0
            if gap > 0:
                v[j] -= gap
            elif owner[j] >= 0 and m > 1:
                j = second
            other = owner[j]
            owner[j], col[i] = i, j
            if other >= 0:
                col[other] = -1
                (todo if gap > 0 else free).append(other)
    u = (cost - v).min(axis=1)
    for i in np.flatnonzero(col < 0):
        dist, back, shut = cost[i] - u[i] - v, np.full(m, i), np.zeros(m)
        seen, far = [], []
        while True:
            j = dist.argmin()
            total = dist[j]
            row = owner[j]
            if row < 0:
                break
            seen.append(j)
            far.append(total)
            shut[j] = dist[j] = np.inf                # reached: not entered again
            step = cost[row] - v + (total - u[row]) + shut
            better = step < dist
            np.copyto(dist, step, where=better)
            back[better] = row
        gain = total - np.array(far)
        v[seen] -= gain
        u[owner[seen]] += gain
        u[i] += total
        while True:                                   # walk the path back
            row = back[j]
            owner[j], col[row], j = row, j, col[row]
            if row == i:
                break
    return col


def batch_assignment(mats: list[np.ndarray]) -> np.ndarray:
    """Exact optima of a list of n x m score matrices of any sizes."""
    out = np.zeros(len(mats))
    wide = [w if w.shape[0] <= w.shape[1] else w.T for w in mats]
    todo = sorted((k for k, w in enumerate(wide) if w.size), key=lambda k: (wide[k].shape[1], wide[k].shape[0]))
    i = 0
    while i < len(todo):                              # neighbours in size share a chunk
        j, n = i, 0
        while j < len(todo):
            n = max(n, wide[todo[j]].shape[0])
            if j > i and (j - i + 1) * n * wide[todo[j]].shape[1] > CHUNK_CELLS:
                break
            j += 1
        part = todo[i:j]
        n, m = max(wide[k].shape[0] for k in part), wide[part[-1]].shape[1]
        cost = np.full((len(part), n, m), np.inf)
        for b, k in enumerate(part):
            cost[b, :wide[k].shape[0], :wide[k].shape[1]] = -wide[k]
        rows = np.array([wide[k].shape[0] for k in part])
        alone = len(part) == 1 and np.isfinite(cost).all()
        col = solve_one(cost[0])[None] if alone else solve_padded(cost, rows)
        picked = np.take_along_axis(cost, np.maximum(col, 0)[:, :, None], axis=2)[:, :, 0]
        out[part] = -np.where(col >= 0, picked, 0.0).sum(axis=1)
        i = j
    return out


@F.pandas_udf(DoubleType())
def assignment_sum(flat: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """X9 over an Arrow batch; NULL matrix -> NULL."""
    valid = (flat.notna() & n.notna() & m.notna()).to_numpy()
    mats = [np.asarray(x, dtype=np.float64).reshape(int(a), int(b))
            for x, a, b in zip(flat[valid], n[valid], m[valid])]
    res = pd.Series(np.full(len(flat), np.nan))
    res[valid] = batch_assignment(mats)
    return res.where(pd.Series(valid), None)


def match_sum(m) -> Column:
    """Exact optimum sum of the score matrix ``m`` (array<array<double>>,
    rows = gt); 0.0 when a side is empty, NULL when ``m`` is NULL.

    ``m`` must be a materialised column, not an expression with lambdas
    (``operators.box_rewards.with_match`` projects the matrix first): Spark
    cannot hand a Python UDF an argument that still contains lambda
    functions.  ``m`` is referenced three times below, which also keeps
    Catalyst from folding the matrix projection back into this one."""
    m = _c(m)
    n, k = _dims(m)
    return assignment_sum(F.flatten(m), n, k)

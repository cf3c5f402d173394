"""Nearest known points in the plane over an adaptive partition into cells of a bounded number of locations.

Known points of one location become one row with its k + 1 smallest ids, which are all that can count. The plane is cut
like a k-d tree: a cell with more than ``bound`` locations is split at the median of its longer side, the first cuts from a bounded
sample, the others round by round from all locations, until no cell is above the bound. The tree, a few numbers a cell, is what
tasks get; it has MOST cells at most (the bound grows beyond that many times the bound). A point meets the locations of its own cell,
whose kth distance (or, where the cell has too few, the farthest corner of the smallest box around with enough) bounds the
search; then only those of the cells that reach into that circle. No join is wider than cells times their bound.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import written

BOUND = 128
MOST = 1 << 17
SAMPLE = 20_000


@dataclass
class Cells:
    """A tree over the plane: for each node its axis (-1: a cell), threshold (x <= it goes left), children, box and locations."""

    axis: np.ndarray
    cut: np.ndarray
    kids: np.ndarray
    box: np.ndarray
    count: np.ndarray

    def of(self, p: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node = np.zeros(len(p), np.int64)
        while True:
            axis = self.axis[node]
            inner = axis >= 0
            if not inner.any():
                return node
            right = p[np.arange(len(p)), np.maximum(axis, 0)] > self.cut[node]
            node = np.where(inner, self.kids[node, right.astype(int)], node)

    def enough(self, p: np.ndarray, least: int) -> np.ndarray:
        """A distance within which at least ``least`` locations lie: to the farthest corner of the smallest box around a point's cell that has them."""
        node, out = np.zeros(len(p), np.int64), np.full(len(p), np.inf)
        going = np.ones(len(p), bool)
        while going.any():
            at = node[going]
            far = np.maximum(np.abs(p[going][:, :, None] - self.box[at].reshape(-1, 2, 2)).max(axis=2), 0)
            d = np.sqrt((far**2).sum(axis=1))
            out[going] = np.where(self.count[at] >= least, np.minimum(out[going], d), out[going])
            axis = self.axis[at]
            right = p[going][np.arange(len(at)), np.maximum(axis, 0)] > self.cut[at]
            step = np.where(axis >= 0, self.kids[at, right.astype(int)], -1)
            rows = np.flatnonzero(going)
            node[rows] = step
            going[rows] = step >= 0
        return out

    def reaching(self, p: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point, cell) of the cells whose box is no farther than the point's radius."""
        q, node, found = np.arange(len(p)), np.zeros(len(p), np.int64), []
        while len(q):
            b = self.box[node].reshape(-1, 2, 2)
            gap = np.maximum(np.maximum(b[:, :, 0] - p[q], p[q] - b[:, :, 1]), 0)
            near = (np.sqrt((gap**2).sum(axis=1)) <= r[q] * (1 + 1e-12)) & (self.count[node] > 0)
            q, node = q[near], node[near]
            leaf = self.axis[node] < 0
            found.append((q[leaf], node[leaf]))
            q, node = np.repeat(q[~leaf], 2), self.kids[node[~leaf]].ravel()
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2


class _Growing:
    """Nodes in lists while the tree grows."""

    def __init__(self):
        self.axis, self.cut, self.kids = [-1], [0.0], [[0, 0]]

    def split(self, node: int, axis: int, cut: float) -> tuple[int, int]:
        a, b = len(self.axis), len(self.axis) + 1
        self.axis[node], self.cut[node], self.kids[node] = axis, cut, [a, b]
        self.axis += [-1, -1]
        self.cut += [0.0, 0.0]
        self.kids += [[0, 0], [0, 0]]
        return a, b

    def cells(self, boxes: dict[int, tuple] | None = None) -> Cells:
        n = len(self.axis)
        box, count = np.tile([np.inf, -np.inf, np.inf, -np.inf], (n, 1)), np.zeros(n, np.int64)
        for k, (b, c) in (boxes or {}).items():
            box[k], count[k] = b, c
        kids = np.array(self.kids)
        for k in range(n - 1, -1, -1):  # children come after their parents
            if self.axis[k] >= 0:
                a, b = kids[k]
                box[k] = [min(box[a][0], box[b][0]), max(box[a][1], box[b][1]), min(box[a][2], box[b][2]), max(box[a][3], box[b][3])]
                count[k] = count[a] + count[b]
        return Cells(np.array(self.axis), np.array(self.cut), kids, box, count)


def _cut(lo: float, hi: float, middle: float) -> float:
    """A threshold with rows on both sides: the median, or half-way where it is the greatest value."""
    return middle if lo <= middle < hi else lo + (hi - lo) / 2 if lo + (hi - lo) / 2 < hi else lo


def _seeded(tree: _Growing, p: np.ndarray, share: float, bound: int) -> dict[int, tuple]:
    """Cuts from a sample, down to what would be about the bound among all locations; boxes and counts of the sample by cell."""
    stack, boxes = [(0, p)], {}
    while stack:
        node, own = stack.pop()
        if len(own) * share <= bound or share > 1 and len(own) < 32:
            boxes[node] = ((own[:, 0].min(), own[:, 0].max(), own[:, 1].min(), own[:, 1].max()), len(own))
            continue
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        v = own[:, axis]
        if v.max() <= v.min():  # one place: locations are distinct, but a sample's cell may be a single one
            boxes[node] = ((own[:, 0].min(), own[:, 0].max(), own[:, 1].min(), own[:, 1].max()), len(own))
            continue
        cut = _cut(v.min(), v.max(), float(np.median(v)))
        a, b = tree.split(node, axis, cut)
        stack += [(a, own[v <= cut]), (b, own[v > cut])]
    return boxes


def _cell_of(spark, tree: Cells, x: str, y: str):
    held = spark.sparkContext.broadcast(tree)

    @F.pandas_udf("int")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(held.value.of(np.stack([a.to_numpy(np.float64), b.to_numpy(np.float64)], axis=1)).astype(np.int32))

    return of(F.col(x), F.col(y))


def partition(locations: DataFrame, bound: int = BOUND) -> Cells:
    """The tree over locations (x, y, each once): no cell has more than ``bound`` of them, or MOST-th parts of all."""
    spark, tree = locations.sparkSession, _Growing()
    sample = locations.orderBy(F.xxhash64("x", "y"), "x", "y").limit(SAMPLE + 1).select("x", "y").toPandas().to_numpy(np.float64)
    if len(sample) <= SAMPLE:  # all of them: no round is needed
        return tree.cells(_seeded(tree, sample, 1, bound) if len(sample) else {})
    n = locations.count()
    bound = max(bound, -(-n // MOST))
    _seeded(tree, sample, n / len(sample), bound)
    while True:
        half = lambda c: F.percentile_approx(c, 0.5, 1000).alias(f"m{c}")
        dealt = locations.withColumn("cell", _cell_of(spark, tree.cells(), "x", "y"))
        rows = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), half("x"), half("y")).collect()  # a row for each cell
        large = [r for r in rows if r["n"] > bound]
        if not large:
            return tree.cells({r["cell"]: ((r["x0"], r["x1"], r["y0"], r["y1"]), r["n"]) for r in rows})
        for r in large:
            axis = 0 if r["x1"] - r["x0"] >= r["y1"] - r["y0"] else 1
            lo, hi, middle = (r["x0"], r["x1"], r["mx"]) if axis == 0 else (r["y0"], r["y1"], r["my"])
            tree.split(r["cell"], axis, _cut(lo, hi, middle))


def nearest_mean(points: DataFrame, known: DataFrame, k: int, id_col: str, bound: int = BOUND) -> DataFrame:
    """id_col, media (mean target) and n of the k nearest known points (x, y, target) of each point, itself left out, equal distances by id.

    Points and known points without both coordinates (null or not finite) take no part; a point without neighbours gives no row; equal rows of points are one.
    """
    from .serving import top_per_group

    spark = points.sparkSession
    whole = lambda d: d.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('infinity')" for c in ("x", "y")))
    real = lambda d: whole(d.withColumns({c: F.col(c).cast("double") + F.lit(0.0) for c in ("x", "y")}))
    some = top_per_group(real(known).select("x", "y", F.col(id_col).alias("_r"), F.col("target").alias("_t")), ["x", "y"], [F.col("_r")], k + 1)
    sites = written(some.groupBy("x", "y").agg(F.collect_list(F.struct("_r", "_t")).alias("_own")), "sites")
    tree = partition(sites.select("x", "y"), bound)
    sites = sites.withColumn("cell", _cell_of(spark, tree, "x", "y")).select(F.col("x").alias("_sx"), F.col("y").alias("_sy"), "_own", "cell")
    asked = real(points).select(F.col(id_col).alias("_q"), "x", "y").distinct().withColumn("cell", _cell_of(spark, tree, "x", "y"))

    def pairs(q: DataFrame) -> DataFrame:
        """The k best known points of each point's listed cells."""
        d = F.sqrt((F.col("x") - F.col("_sx")) * (F.col("x") - F.col("_sx")) + (F.col("y") - F.col("_sy")) * (F.col("y") - F.col("_sy")))
        each = q.join(sites, "cell").withColumn("_d", d).select("_q", "x", "y", "_d", F.explode("_own").alias("_o")).select("_q", "x", "y", "_d", "_o._r", "_o._t")
        return top_per_group(each.where("_q <> _r"), ["_q"], [F.col("_d"), F.col("_r")], k).select("_q", "x", "y", "_d", "_r", "_t")

    first = written(pairs(asked), "nearest")
    held = spark.sparkContext.broadcast(tree)

    @F.pandas_udf("array<int>")
    def others(a: pd.Series, b: pd.Series, kth: pd.Series, own: pd.Series) -> pd.Series:
        t, p = held.value, np.stack([a.to_numpy(np.float64), b.to_numpy(np.float64)], axis=1)
        r = np.minimum(np.nan_to_num(kth.to_numpy(np.float64, na_value=np.inf), nan=np.inf), t.enough(p, k + 1))
        out, mine = [[] for _ in range(len(p))], own.to_numpy()
        for i, c in zip(*(x.tolist() for x in t.reaching(p, r)), strict=True):
            if c != mine[i]:
                out[i].append(c)
        return pd.Series(out, dtype=object)

    kth = first.groupBy("_q").agg(F.when(F.count("*") >= k, F.max("_d")).alias("_kth"))
    rest = asked.join(kth, "_q", "left").withColumn("cell", F.explode(others("x", "y", "_kth", "cell")))
    best = top_per_group(first.unionByName(pairs(rest.select("_q", "x", "y", "cell"))), ["_q"], [F.col("_d"), F.col("_r")], k)
    return best.groupBy(F.col("_q").alias(id_col)).agg(F.avg("_t").alias("media"), F.count("*").alias("n"))

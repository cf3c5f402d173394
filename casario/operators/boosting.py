"""Boosted trees on distributed gradient histograms: squared, absolute and quantile loss, native categories, several fits at once.

Spark ML's boosted trees have neither a quantile loss nor categories without one number's order. Here rows are binned once (numbers
at percentiles of all rows, categories by a level table that the model keeps), sorted by their bins and written to the shared folder
in blocks, where rows of equal bins are one run: trees are applied to runs, and only residuals are taken of rows. All members of a fit, each with its loss and seed, grow in lockstep: one job a level adds up, for every member and open node, the gradients by
feature and bin in its tasks; sums by node meet in a shuffle, and the driver, which sees only sums, picks the splits. Their
size is set by members, nodes, features and bins, not by rows. Absolute and quantile loss set a leaf to the quantile of its
residuals, from a histogram of them. Rows that a hash holds back measure each round; a member stops after ``patience`` rounds
without gain. Every ``refresh`` rounds the runs' predictions so far are written beside the bins, so that a task applies few trees.

A null, NaN or unseen level is bin 0, which each split sends to the better side. Levels beyond the ``levels`` most frequent
ones of a category are unseen. Rows without a target take no part in a fit; a fit without rows is refused.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .training import written

SQUARED, QUANTILE = "squared", "quantile"
#: Bins of a leaf's residuals.
RESIDUAL_BINS = 1024
#: Rows of a block at most.
BLOCK = 1 << 15
#: A block: bins of its runs, rows of each run, targets and hashes of the rows, members' predictions of the runs (empty: the base).
BLOCKS = "x binary, n binary, y binary, h binary, p binary"


@dataclass(frozen=True)
class Member:
    """One sequence of trees. alpha is the quantile (0.5: absolute loss)."""

    name: str
    loss: str = SQUARED
    alpha: float = 0.5
    seed: int = 1000


@dataclass(frozen=True)
class Settings:
    rounds: int = 60
    rate: float = 0.15
    depth: int = 4
    bins: int = 63
    levels: int = 1024
    least: int = 20
    l2: float = 5.0
    rows: float = 0.8
    columns: float = 0.8
    held_back: float = 0.15
    patience: int = 10
    refresh: int = 16


def seeds(name: str, n: int, loss: str = SQUARED, alpha: float = 0.5) -> list[Member]:
    """Members that differ in their seed alone; predicted() gives their mean under one name."""
    return [Member(name, loss, alpha, 1000 + 7 * i) for i in range(n)]


@dataclass
class Bins:
    """How columns become bins, frozen at the fit."""

    numbers: dict[str, list[float]]
    categories: dict[str, list[str]]

    @property
    def columns(self) -> list[str]:
        return [*self.numbers, *self.categories]

    def sizes(self) -> list[int]:
        return [len(v) + (2 if c in self.numbers else 1) for c, v in [*self.numbers.items(), *self.categories.items()]]

    def of(self, columns: list[pd.Series]) -> np.ndarray:
        out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint16)
        for j, (c, values) in enumerate(zip(self.columns, columns, strict=True)):
            if c in self.numbers:
                x = pd.to_numeric(values, errors="coerce").to_numpy(dtype=np.float64, na_value=np.nan)
                out[:, j] = np.where(np.isnan(x), 0, 1 + np.searchsorted(self.numbers[c], x, side="left"))
            else:
                codes = {v: i + 1 for i, v in enumerate(self.categories[c])}
                out[:, j] = values.map(codes).fillna(0).to_numpy(dtype=np.uint16)
        return out


def fit_bins(df: DataFrame, numbers: list[str], categories: list[str], s: Settings) -> Bins:
    """Percentiles of each number, and each category's most frequent levels (ties by name): one job each."""
    cuts, levels = {}, {}
    if numbers:
        clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        row = df.agg(*(F.percentile_approx(clean(c), [i / s.bins for i in range(1, s.bins)], 10_000).alias(c) for c in numbers)).first()
        cuts = {c: sorted(set(row[c] or [])) for c in numbers}
    for c in categories:
        top = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("nivel")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "nivel").limit(s.levels)
        levels[c] = sorted(r["nivel"] for r in top.collect())
    return Bins(cuts, levels)


@dataclass
class Tree:
    """Nodes in heap order: the feature of a split (-1: a leaf), which bins go left, the value of a leaf."""

    feature: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int, bins: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int16), np.zeros((n, bins), bool), np.zeros(n))

    def nodes(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            goes_left = self.left[node, x[rows, np.maximum(f, 0)]]
            node = np.where(inner, 2 * node + 2 - goes_left, node)


@dataclass
class Model:
    bins: Bins
    members: list[Member]
    rate: float
    base: list[float]
    trees: list[list[Tree]] = field(default_factory=list)
    losses: list[list[float]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """A column for each member."""
        out = np.tile(np.array(self.base), (len(x), 1))
        for m, trees in enumerate(self.trees):
            for t in trees:
                out[:, m] += self.rate * t.value[t.nodes(x)]
        return out

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys(m.name for m in self.members))

    def to_json(self) -> str:
        def packed(t: Tree) -> dict:
            inner = np.flatnonzero(t.feature >= 0)
            return {"n": len(t.feature), "f": {int(i): int(t.feature[i]) for i in inner}, "l": {int(i): np.flatnonzero(t.left[i]).tolist() for i in inner}, "v": t.value.tolist()}

        return json.dumps({"numbers": self.bins.numbers, "categories": self.bins.categories, "members": [vars(m) for m in self.members], "rate": self.rate, "base": self.base, "losses": self.losses, "trees": [[packed(t) for t in ts] for ts in self.trees]})

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        bins = Bins(d["numbers"], d["categories"])
        width = max(bins.sizes(), default=1)

        def tree(p: dict) -> Tree:
            t = Tree(np.full(p["n"], -1, np.int16), np.zeros((p["n"], width), bool), np.array(p["v"]))
            for i, f in p["f"].items():
                t.feature[int(i)] = f
                t.left[int(i), p["l"][i]] = True
            return t

        return Model(bins, [Member(**m) for m in d["members"]], d["rate"], d["base"], [[tree(p) for p in ts] for ts in d["trees"]], d["losses"])


def save(model: Model, spark: SparkSession, path: str) -> None:
    """The model as one line of JSON, level table and all."""
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Model:
    return Model.from_json(spark.read.text(path).first()[0])


def _column(df: DataFrame, bins: Bins, c: str):
    return F.col(c).cast("double" if c in bins.numbers else "string")


def binned(df: DataFrame, bins: Bins):
    """A column of bins, two bytes each."""
    if not bins.columns:
        return F.lit(b"")

    @F.pandas_udf("binary")
    def of(d: pd.DataFrame) -> pd.Series:
        return pd.Series(bins.of([d[str(j)] for j in range(len(bins.columns))]).view(f"V{2 * len(bins.columns)}").ravel().tolist(), dtype=object)

    return of(F.struct(*(_column(df, bins, c).alias(str(j)) for j, c in enumerate(bins.columns))))


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from row hashes and a seed."""
    x = (h.view(np.uint64) ^ np.uint64(seed & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _best_split(g: np.ndarray, n: np.ndarray, sizes: list[int], is_number: list[bool], usable: np.ndarray, s: Settings):
    """(gain, feature, bins that go left) of the best split of a node; g and n are features x bins."""
    best = (1e-9, -1, None)
    total_g, total_n = g[0, : sizes[0]].sum(), n[0, : sizes[0]].sum()
    whole = total_g**2 / (total_n + s.l2)
    for f in np.flatnonzero(usable):
        gf, nf = g[f, : sizes[f]], n[f, : sizes[f]]
        order = np.arange(1, sizes[f])
        if not is_number[f]:  # levels by their mean gradient, few rows drawn to nought
            order = order[np.argsort(gf[1:] / (nf[1:] + 10), kind="stable")]
        cg, cn = np.cumsum(gf[order]), np.cumsum(nf[order])
        for with_none in (False, True):
            lg, ln = cg + (gf[0] if with_none else 0), cn + (nf[0] if with_none else 0)
            ok = (ln >= s.least) & (total_n - ln >= s.least)
            if not ok.any():
                continue
            gain = np.where(ok, lg**2 / (ln + s.l2) + (total_g - lg) ** 2 / (total_n - ln + s.l2) - whole, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                left = np.zeros(g.shape[1], bool)
                left[order[: k + 1]] = True
                left[0] = with_none
                best = (float(gain[k]), int(f), left)
    return best


def _quantile(counts: np.ndarray, lo: float, hi: float, alpha: float) -> float:
    """The quantile of residuals counted in equal bins between lo and hi."""
    total = counts.sum()
    if not total:
        return 0.0
    c = np.cumsum(counts)
    k = int(np.searchsorted(c, alpha * total))
    k = min(k, len(counts) - 1)
    before = c[k] - counts[k]
    inside = (alpha * total - before) / counts[k] if counts[k] else 0.5
    return lo + (hi - lo) * (k + inside) / len(counts)


def fit(df: DataFrame, target: str, numbers: list[str], categories: list[str], members: list[Member], id_cols: list[str], settings: Settings | None = None) -> Model:
    """The members' trees for the target; id_cols decide by their hash which rows are held back or drawn in a round."""
    s, spark = settings or Settings(), df.sparkSession
    y = F.col(target).cast("double")
    df = df.where(y.isNotNull() & ~F.isnan(y))
    rows = written(df.select(*dict.fromkeys([*numbers, *categories]), y.alias("_y"), F.xxhash64(*id_cols).alias("_h")), "boosting-rows")  # df's own joins run once
    bins = fit_bins(rows, numbers, categories, s)
    first = rows.agg(F.count("*").alias("n"), F.avg("_y").alias("mean"), *(F.percentile_approx("_y", m.alpha, 10_000).alias(f"q{i}") for i, m in enumerate(members))).first()
    if not first["n"]:
        raise ValueError("no rows to fit")
    table = _blocks(rows.select(binned(rows, bins).alias("x"), F.col("_y").alias("y"), F.col("_h").alias("h")), len(bins.columns))
    model = Model(bins, members, s.rate, [float(first["mean"] if m.loss == SQUARED else first[f"q{i}"]) for i, m in enumerate(members)], [[] for _ in members], [[] for _ in members])
    sizes, is_number, width, n_features = bins.sizes(), [c in bins.numbers for c in bins.columns], max(bins.sizes(), default=1), len(bins.columns)
    done, best_at = [0] * len(members), [0] * len(members)  # trees that the table's p holds; rounds with the least loss
    open_ = set(range(len(members)))

    def job(make, trees: list[list[Tree]], start: list[int], growing: dict[int, Tree], round_: int):
        """make(member, residuals, held back, drawn, runs) -> {node: arrays} of each block, added up by member and node."""
        held = spark.sparkContext.broadcast((trees, start, growing))

        def run(batches):
            trees, start, growing = held.value
            total: dict = {}
            for x, n, y, h, p in _unpacked(batches, n_features, len(members)):
                starts = np.cumsum(n) - n
                back = _mix(h, 77) < s.held_back
                draws: dict = {}  # of each seed: the rows drawn and how many a run has
                for m, tree in growing.items():
                    now = np.full(len(x), model.base[m]) if p is None else p[:, m].copy()
                    for t in trees[m][start[m] :]:
                        now += s.rate * t.value[t.nodes(x)]
                    if (seed := members[m].seed) not in draws:
                        drawn = ~back & (_mix(h, seed * 1_000_003 + round_) < s.rows)
                        draws[seed] = drawn, np.add.reduceat(drawn, starts, dtype=np.int64)
                    runs = Runs(x, tree.nodes(x), n, starts, draws[seed][1])
                    for node, arrays in make(m, y - np.repeat(now, n), back, draws[seed][0], runs):
                        key = (m, node)
                        total[key] = [a + c for a, c in zip(total[key], arrays, strict=True)] if key in total else arrays
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array([np.asarray(total[k][i], np.float64).tobytes() for k in keys], pa.binary()) for i in range(2))], ["m", "node", "a", "b"])

        def added(t: pa.Table) -> pa.Table:
            sums = [np.sum([np.frombuffer(v, np.float64) for v in t.column(c).to_pylist()], axis=0).tobytes() for c in ("a", "b")]
            return pa.table({"m": t.column("m")[:1], "node": t.column("node")[:1], "a": pa.array([sums[0]]), "b": pa.array([sums[1]])})

        kind = "m int, node int, a binary, b binary"
        return {(r["m"], r["node"]): (np.frombuffer(r["a"]), np.frombuffer(r["b"])) for r in table.mapInArrow(run, kind).groupBy("m", "node").applyInArrow(added, kind).collect()}

    def gradient(m: int, r: np.ndarray) -> np.ndarray:
        return r if members[m].loss == SQUARED else np.where(r > 0, members[m].alpha, members[m].alpha - 1)

    def loss(m: int, r: np.ndarray) -> np.ndarray:
        return r * r if members[m].loss == SQUARED else np.maximum(members[m].alpha * r, (members[m].alpha - 1) * r)

    def at_level(level: int):
        lowest = 2**level - 1

        def make(m, r, back, drawn, runs):
            if level == 0:  # what the rows held back say of the rounds before, and how far residuals reach
                yield -1, [np.array([loss(m, r[back]).sum(), back.sum()]), np.zeros(1)]
                if drawn.any():  # in powers of two, which a sum can carry: the widest of the block
                    e = np.clip(int(np.ceil(np.log2(max(np.abs(r[drawn]).max(), 2.0**-30)))) + 31, 0, 63)
                    yield -2, [np.bincount([e], minlength=64).astype(np.float64), np.zeros(1)]
            g = np.add.reduceat(np.where(drawn, gradient(m, r), 0.0), runs.starts)
            for k in range(lowest, 2 * lowest + 1):
                mine = (runs.node == k) & (runs.drawn > 0)
                if mine.any():
                    flat = (runs.x[mine] + np.arange(n_features, dtype=np.int64) * width).ravel()
                    yield k, [np.bincount(flat, np.repeat(v[mine], n_features), n_features * width) for v in (g, runs.drawn)]

        return make

    def leaves(reach: dict[int, float]):
        def make(m, r, back, drawn, runs):
            at = np.clip(((r / reach[m] + 1) / 2 * RESIDUAL_BINS).astype(int), 0, RESIDUAL_BINS - 1) + np.repeat(runs.node * RESIDUAL_BINS, runs.n)
            counts = np.bincount(at[drawn], minlength=RESIDUAL_BINS * (int(runs.node.max()) + 1)).reshape(-1, RESIDUAL_BINS)
            for k in np.unique(runs.node[runs.drawn > 0]):
                yield int(k), [counts[k].astype(np.float64), np.zeros(1)]

        return make

    for round_ in range(s.rounds + 1):
        growing, open_nodes = {m: Tree.empty(s.depth, width) for m in open_}, {m: {0} for m in open_}
        sums: dict = {}
        reach: dict = {}
        for level in range(s.depth):
            if not any(open_nodes[m] for m in open_) or not n_features:
                break
            found = job(at_level(level), model.trees, done, growing, round_)
            if level == 0:
                for m in sorted(open_):
                    total, k = found[m, -1][0] if (m, -1) in found else (0.0, 0)
                    model.losses[m].append(float(total / k) if k else 0.0)
                    best_at[m] = int(np.argmin(model.losses[m])) if k else round_
                    reach[m] = 2.0 ** (int(np.max(np.flatnonzero(found[m, -2][0]))) - 31) if (m, -2) in found else 1.0
                    if round_ - best_at[m] >= s.patience:
                        open_.discard(m)
                        growing.pop(m)
                if not open_ or round_ == s.rounds:
                    break
            for (m, k), (a, b) in sorted(found.items(), key=lambda f: f[0]):
                if m not in open_ or k not in open_nodes[m]:
                    continue
                g, n = a.reshape(n_features, width), b.reshape(n_features, width)
                whole = sums[m, k] = (g[0].sum(), n[0].sum())
                rng = np.random.default_rng([members[m].seed, round_])
                usable = rng.random(n_features) < s.columns
                usable[rng.integers(n_features)] = True
                _, f, left = _best_split(g, n, sizes, is_number, usable, s)
                if f >= 0:
                    growing[m].feature[k], growing[m].left[k] = f, left
                    part = (g[f, left].sum(), n[f, left].sum())
                    sums[m, 2 * k + 1], sums[m, 2 * k + 2] = part, (whole[0] - part[0], whole[1] - part[1])
            for m in open_:
                open_nodes[m] = {c for k in open_nodes[m] if growing[m].feature[k] >= 0 for c in (2 * k + 1, 2 * k + 2)}
        if not open_ or round_ == s.rounds or not n_features:
            break
        for (m, k), (g, n) in sums.items():
            if members[m].loss == SQUARED and growing[m].feature[k] < 0:
                growing[m].value[k] = g / (n + s.l2)
        robust = {m: t for m, t in growing.items() if members[m].loss != SQUARED}
        if robust:
            for (m, k), (counts, _) in job(leaves(reach), model.trees, done, robust, round_).items():
                growing[m].value[k] = _quantile(counts, -reach[m], reach[m], members[m].alpha)
        for m, t in growing.items():
            model.trees[m].append(t)
        if (round_ + 1) % s.refresh == 0:
            table = _refreshed(table, model, done, n_features)
            done = [len(t) for t in model.trees]
    for m in range(len(members)):
        model.trees[m] = model.trees[m][: best_at[m]]
    return model


@dataclass
class Runs:
    """Rows of equal bins in a block: their bins and node, how many there are, where they start, how many are drawn."""

    x: np.ndarray
    node: np.ndarray
    n: np.ndarray
    starts: np.ndarray
    drawn: np.ndarray


def _packed(blocks: list[list[bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*blocks, strict=True)], ["x", "n", "y", "h", "p"])


def _unpacked(batches, n_features: int, n_members: int):
    """x, n, y, h and p (None: the base) of each block."""
    for b in batches:
        for x, n, y, h, p in zip(*(b.column(c) for c in ("x", "n", "y", "h", "p")), strict=True):
            n = np.frombuffer(n.as_py(), np.int64)
            x = np.frombuffer(x.as_py(), np.uint16).reshape(len(n), n_features)
            p = np.frombuffer(p.as_py(), np.float64).reshape(len(n), n_members) if len(p.as_py()) else None
            yield x, n, np.frombuffer(y.as_py(), np.float64), np.frombuffer(h.as_py(), np.int64), p


def _blocks(df: DataFrame, n_features: int) -> DataFrame:
    """Rows of df (x, y, h) in blocks, equal bins together; Spark splits the partition of bins that most rows have."""

    def run(batches):
        def block(t: pa.Table) -> pa.RecordBatch:
            x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.uint16).reshape(t.num_rows, n_features)
            first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(axis=1)])
            n = np.diff(np.r_[first, t.num_rows])
            return _packed([[x[first].tobytes(), n.astype(np.int64).tobytes(), t.column("y").to_numpy().tobytes(), t.column("h").to_numpy().tobytes(), b""]])

        held: list[pa.RecordBatch] = []
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                if held and sum(h.num_rows for h in held) + part.num_rows > BLOCK:
                    yield block(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield block(pa.Table.from_batches(held))

    return written(df.hint("rebalance", "x").sortWithinPartitions("x").mapInArrow(run, BLOCKS), "boosting")


def _refreshed(table: DataFrame, model: Model, done: list[int], n_features: int) -> DataFrame:
    """The table with every member's predictions so far."""
    held = table.sparkSession.sparkContext.broadcast((model.base, model.trees, list(done), model.rate))

    def run(batches):
        base, trees, start, rate = held.value
        for x, n, y, h, p in _unpacked(batches, n_features, len(base)):
            p = np.tile(np.array(base), (len(x), 1)) if p is None else p.copy()
            for m, own in enumerate(trees):
                for t in own[start[m] :]:
                    p[:, m] += rate * t.value[t.nodes(x)]
            yield _packed([[a.tobytes() for a in (x, n, y, h, p)]])

    return written(table.mapInArrow(run, BLOCKS), "boosting")


def predicted(model: Model, df: DataFrame, prefix: str = "") -> DataFrame:
    """df with a column for each name of the members (the mean of those that share it)."""
    names, bins = model.names, model.bins
    groups = [[i for i, m in enumerate(model.members) if m.name == n] for n in names]
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def of(d: pd.DataFrame) -> pd.DataFrame:
        raw = held.value.raw(bins.of([d[str(j)] for j in range(len(bins.columns))])) if bins.columns else np.tile(np.array(held.value.base), (len(d), 1))
        return pd.DataFrame({n: raw[:, g].mean(axis=1) for n, g in zip(names, groups, strict=True)})

    columns = [_column(df, bins, c).alias(str(j)) for j, c in enumerate(bins.columns)] or [F.lit(0).alias("0")]
    return df.withColumn("_p", of(F.struct(*columns))).withColumns({f"{prefix}{n}": F.col("_p")[n] for n in names}).drop("_p")

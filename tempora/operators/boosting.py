"""M2: gradient-boosted trees on histograms, many boosters in one pass.

A booster is one (fit, target) pair: a fit is a set of rows with its own
features (a CV fold or the whole training table), a target one horizon.  All
boosters grow their next tree together.

1. Bin edges per fit and feature: midpoints between distinct values up to
   ``max_bins`` of them, else midpoint percentiles, from at most ``BIN_SAMPLE``
   rows of a fit (the reference's learner bins on a sample of the same size).
2. Rows are binned once, one byte a value, and packed into blocks of at most
   ``BLOCK_ROWS`` rows of one fit.  Blocks and the running predictions stay
   cached on the executors; they are checkpointed every ``CHECKPOINT_ROUNDS``
   rounds, so a lost block is recomputed from that many rounds at most.
3. A fit of several blocks grows by one job a level: every task adds up gradients and
   counts per (booster, node, feature, bin) of its block, and these histograms are
   summed by (fit, run of features) in a shuffle.  Only the best
   split of each node and run of features comes to the driver.  A fit of one block (at
   most ``BLOCK_ROWS`` rows) has nothing to sum: each of its boosters
   is a task of its own that takes the same steps for every round, all in one job.
4. Leaves are expanded by falling gain up to ``max_leaf_nodes``: a level's
   splits are computed for every leaf that may still be expanded, and the final tree is the
   best-first one.  A leaf's value is ``-rate * G / (N + l2)``.

This is the one place of the library that works on an RDD: the state of a block is a
few arrays that every level of every round reads, which a
DataFrame would send between the JVM and Python every time.

Rows with a NULL target take no part in that target's boosters; a target without rows
predicts NULL.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BIN_SAMPLE = 200_000
BLOCK_ROWS = 1 << 16
CHECKPOINT_ROUNDS = 50
MIN_HESSIAN = 1e-3
HIST_CELLS = 1 << 20
EDGE_COLUMNS = 64


@dataclass
class Boosting:
    """Settings; the defaults are those of the reference's learner."""
    learning_rate: float = 0.1
    max_iter: int = 100
    max_depth: int | None = None
    min_samples_leaf: int = 20
    l2_regularization: float = 0.0
    max_leaf_nodes: int = 31
    max_bins: int = 255


# ------------------------------------------------------------------ bins

def column_edges(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Thresholds of one column: bin b holds ``edge[b-1] < x <= edge[b]``."""
    distinct = np.unique(values)
    if len(distinct) <= max_bins:
        return (distinct[:-1] + distinct[1:]) / 2
    return np.unique(np.percentile(values, np.linspace(0, 100, max_bins + 1)[1:-1], method="midpoint"))


def bin_edges(x: DataFrame, sizes: dict, max_bins: int) -> dict:
    """``{fit: [edges of each column]}``; ``x`` has ``fit, x`` (array)."""
    share = F.lit(1.0)
    for fit, n in sizes.items():
        share = F.when(F.col("fit") == fit, F.lit(min(1.0, BIN_SAMPLE / max(1, n)))).otherwise(share)
    some = x.where(F.rand(42) < share)
    width = F.size("x")
    part = F.explode(F.sequence(F.lit(0), F.floor((width - 1) / EDGE_COLUMNS).cast("int"))).alias("part")
    parts = some.where(width > 0).select("fit", "x", part).select("fit", "part", F.slice("x", F.col("part") * EDGE_COLUMNS + 1, EDGE_COLUMNS).alias("v"))

    def run(t: pa.Table) -> pa.Table:
        v = t["v"].combine_chunks()
        v = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        edges = [column_edges(v[:, j], max_bins) for j in range(v.shape[1])]
        return pa.table({"fit": t["fit"][:1], "part": t["part"][:1], "edges": pa.array([edges], pa.list_(pa.list_(pa.float64())))})
    found = parts.groupBy("fit", "part").applyInArrow(run, "fit int, part int, edges array<array<double>>").orderBy("part").collect()
    out: dict = {f: [] for f in sizes}
    for r in found:
        out[r["fit"]] += [np.array(e) for e in r["edges"]]
    return out


# ------------------------------------------------------------------ blocks

@dataclass
class Block:
    fit: int
    bins: np.ndarray            # feature x row, one byte a value
    y: np.ndarray               # target x row; NaN: no part
    pred: np.ndarray            # target x row


def _pack(x: DataFrame, targets: list[str], edges: dict, sizes: dict):
    """RDD of blocks, one to a partition."""
    first, total = {}, 0
    for fit, n in sizes.items():
        first[fit], total = total, total + max(1, -(-n // BLOCK_ROWS))
    count = {f: max(1, -(-n // BLOCK_ROWS)) for f, n in sizes.items()}

    def rows(batches):
        for b in batches:
            fit = b.column(0).to_numpy()
            v, y = b.column(1), b.column(2)
            width = len(targets)
            y = y.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            v = v.flatten().to_numpy(zero_copy_only=False).reshape(len(fit), -1) if len(fit) else np.zeros((0, 0))
            for f in np.unique(fit).tolist():
                mine = fit == f
                binned = np.stack([np.searchsorted(e, v[mine, j], "left") for j, e in enumerate(edges[f])]).astype(np.uint8) \
                    if edges[f] else np.zeros((0, int(mine.sum())), np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int(mine.sum()), f), pa.int32()), pa.array([c.tobytes() for c in binned.T], pa.binary()),
                     pa.array([r.tobytes() for r in y[mine]], pa.binary())], names=["fit", "bins", "y"])
    deal = F.lit(0).cast("long")
    for f, n in count.items():
        deal = F.when(F.col("fit") == f, F.lit(first[f]) + F.pmod(F.xxhash64("bins", "y"), F.lit(n))).otherwise(deal)
    packed = (x.select("fit", "x", F.array(*[F.coalesce(F.col(t).cast("double"), F.lit(float("nan"))) for t in targets]).alias("y"))
              .mapInArrow(rows, "fit int, bins binary, y binary").withColumn("block", deal))

    def block(t: pa.Table) -> pa.Table:
        return pa.table({"block": t["block"][:1], "fit": t["fit"][:1], "rows": pa.array([len(t)], pa.int32()),
                         "bins": pa.array([b"".join(v.as_py() for v in t["bins"])], pa.binary()),
                         "y": pa.array([b"".join(v.as_py() for v in t["y"])], pa.binary())})
    blocks = packed.groupBy("block").applyInArrow(block, "block long, fit int, rows int, bins binary, y binary").checkpoint()
    k = len(targets)

    def state(r):
        n = r["rows"]
        bins = np.ascontiguousarray(np.frombuffer(r["bins"], np.uint8).reshape(n, -1).T)
        y = np.ascontiguousarray(np.frombuffer(r["y"], float).reshape(n, k).T)
        return Block(r["fit"], bins, y, np.zeros_like(y))
    rdd = blocks.rdd.map(lambda r: (r["block"], r)).partitionBy(total, int).map(lambda kv: state(kv[1]))
    return rdd, {f for f, c in count.items() if c == 1}


# ------------------------------------------------------------------ one level

@dataclass
class Tree:
    """A growing tree: arrays by node; ``feature`` -1 is a leaf."""
    feature: list = field(default_factory=lambda: [-1])
    bin: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [0])
    right: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        for c in (self.feature, self.bin, self.left, self.right):
            c.append(0)
        self.feature[-1] = -1
        self.value.append(0.0)
        return len(self.feature) - 1

    def node_of(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of every row of a binned block (feature x row)."""
        at = np.zeros(bins.shape[1], np.int32)
        if self.feature[0] < 0:
            return at
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.bin, self.left, self.right))
        rows = np.arange(bins.shape[1])
        while len(rows):
            f = feature[at[rows]]
            inner = f >= 0
            rows, f = rows[inner], f[inner]
            node = at[rows]
            at[rows] = np.where(bins[f, rows] <= cut[node], left[node], right[node])
        return at


def _step(n_bins: dict):
    """Columns to a run, so that a node's histogram of a run is at most ``HIST_CELLS`` cells."""
    return {f: max(1, HIST_CELLS // max(1, b)) for f, b in n_bins.items()}


def histograms(block: Block, trees: dict, wanted: dict, n_bins: int, step: int):
    """((fit, first column, target, node), gradient and count histograms of a run of columns)."""
    n_columns, gradient = len(block.bins), block.pred - block.y
    for (fit, k), nodes in wanted.items():
        if fit != block.fit or not nodes:
            continue
        node = trees[(fit, k)].node_of(block.bins)
        take = np.isin(node, nodes) & ~np.isnan(block.y[k])
        slot = np.zeros(max(nodes) + 1, np.int64)
        slot[nodes] = np.arange(len(nodes))
        rows = np.flatnonzero(take)
        g, s = gradient[k, rows], slot[node[rows]]
        width = max(1, step // len(nodes))
        for lo in range(0, n_columns, width):
            b = block.bins[lo:lo + width][:, rows] if len(rows) < block.bins.shape[1] else block.bins[lo:lo + width]
            cells = len(nodes) * n_bins
            gs, ns = np.empty((len(b), cells)), np.empty((len(b), cells))
            first = s * n_bins
            for j, column in enumerate(b):          # a column at a time: its keys and cells stay in the cache
                key = first + column
                gs[j], ns[j] = np.bincount(key, g, cells), np.bincount(key, minlength=cells)
            shape = len(b), len(nodes), n_bins
            yield (fit, k, lo), (nodes, gs.reshape(shape), ns.reshape(shape))


def best_splits(key, value, p: Boosting):
    """((fit, target), node) -> best split of a run of columns, with the node's totals."""
    (fit, k, lo), (nodes, gs, ns) = key, value
    left_g, left_n = gs.cumsum(2)[:, :, :-1], ns.cumsum(2)[:, :, :-1]
    g, n = gs[0].sum(1), ns[0].sum(1)
    right_g, right_n = g[None, :, None] - left_g, n[None, :, None] - left_n
    l2, least = p.l2_regularization, max(p.min_samples_leaf, MIN_HESSIAN)
    small = (left_n < least) | (right_n < least)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g ** 2
        gain /= left_n + l2
        right_g *= right_g
        right_g /= np.add(right_n, l2, out=right_n)
        gain += right_g
        gain -= (g ** 2 / (n + l2))[None, :, None]
    gain[small] = -np.inf
    out = []
    for j, node in enumerate(nodes):
        c = gain[:, j]
        at = int(c.argmax()) if c.size else 0
        column, cut = divmod(at, c.shape[1]) if c.size else (0, 0)
        best = float(c.flat[at]) if c.size else -np.inf
        sums = (float(left_g[column, j, cut]), float(left_n[column, j, cut])) if best > 0 else (0.0, 0.0)
        out.append(((fit, k), node, (best, -(lo + column), cut, *sums, float(g[j]), float(n[j]))))
    return out


class _Grower:
    """Best-first growth of one tree from splits that become known level by level."""

    def __init__(self, p: Boosting):
        self.p, self.known, self.found, self.tree, self.depth = p, {}, {}, Tree(), {0: 0}
        self.total: dict = {}

    def wanted(self) -> list[int]:
        """Leaves whose best split must be known; expands the tree by what is known."""
        need = []
        self.known.update(self.found)
        self.found = {}
        if 0 not in self.known:
            return [0]
        # best-first over what is known; leaves yet unknown are asked for
        heap, leaves, self.expanded = [], 1, []
        if self.known[0][0] > 0:
            heap.append((-self.known[0][0], 0))
        while heap and leaves < self.p.max_leaf_nodes:
            _, node = heapq.heappop(heap)
            leaves += 1
            self.expanded.append(node)
            for child in self._children(node):
                if not self._splittable(child):
                    continue
                if child not in self.known:
                    need.append(child)
                elif self.known[child][0] > 0:
                    heapq.heappush(heap, (-self.known[child][0], child))
        return need

    def offer(self, node, split) -> None:
        """A split of a wanted leaf by one run of columns; the best of all runs counts."""
        if node not in self.found or split[:2] > self.found[node][:2]:
            self.found[node] = split

    def _children(self, node):
        t = self.tree
        if t.feature[node] < 0:
            _, column, cut, left_g, left_n, g, n = self.known[node]
            t.feature[node], t.bin[node] = -column, cut
            t.left[node], t.right[node] = t.add(), t.add()
            for child, total in ((t.left[node], (left_g, left_n)), (t.right[node], (g - left_g, n - left_n))):
                self.depth[child], self.total[child] = self.depth[node] + 1, total
        return t.left[node], t.right[node]

    def _splittable(self, node) -> bool:
        deep = self.p.max_depth is not None and self.depth[node] >= self.p.max_depth
        return not deep and self.total[node][1] >= 2 * self.p.min_samples_leaf

    def finished(self) -> Tree:
        """The tree of the expanded nodes, with leaf values."""
        old, new, keep = self.tree, Tree(), set(self.expanded) if 0 in self.known else set()
        total = dict(self.total)
        total[0] = self.known[0][5:7]

        def copy(a, b):
            if a in keep:
                left, right = new.add(), new.add()
                new.feature[b], new.bin[b], new.left[b], new.right[b] = old.feature[a], old.bin[a], left, right
                copy(old.left[a], left)
                copy(old.right[a], right)
            else:
                g, n = total[a]
                new.value[b] = -self.p.learning_rate * g / (n + self.p.l2_regularization) if n else 0.0
        copy(0, 0)
        return new


# ------------------------------------------------------------------ model

class BoostedTrees:
    """Fitted boosters of one fit: per target a start value and trees on raw thresholds."""

    def __init__(self, targets: list[str], start: list, trees: list[list[dict]], features_col: str = "features"):
        self.targets, self.start, self.trees, self.features_col = list(targets), list(start), trees, features_col
        self._flat = None

    def _arrays(self):
        """Per target: arrays (tree x node) of feature, threshold, left, right, value."""
        if self._flat is None:
            self._flat = []
            for trees in self.trees:
                width = max((len(t["feature"]) for t in trees), default=1)
                a = {c: np.zeros((len(trees), width), np.int64 if c != "threshold" and c != "value" else float)
                     for c in ("feature", "threshold", "left", "right", "value")}
                a["feature"][:] = -1
                for i, t in enumerate(trees):
                    for c in a:
                        a[c][i, :len(t[c])] = t[c]
                self._flat.append(a)
        return self._flat

    def predict(self, x: np.ndarray, target: int) -> np.ndarray:
        if self.start[target] is None:
            return np.full(len(x), np.nan)
        a = self._arrays()[target]
        trees = np.arange(len(a["feature"]))
        out = np.full(len(x), self.start[target])
        for lo in range(0, len(x), 512):
            part = x[lo:lo + 512]
            at = np.zeros((len(part), len(trees)), np.int64)
            rows = np.arange(len(part))[:, None]
            while len(trees):
                f = a["feature"][trees, at]
                if (f < 0).all():
                    break
                goes = part[rows, np.maximum(f, 0)] <= a["threshold"][trees, at]
                at = np.where(f < 0, at, np.where(goes, a["left"][trees, at], a["right"][trees, at]))
            # in the order of the rounds, as fitting added them
            out[lo:lo + 512] = np.add.accumulate(np.column_stack((out[lo:lo + 512], a["value"][trees, at])), axis=1)[:, -1]
        return out

    def with_predictions(self, df: DataFrame, names: list[str]) -> DataFrame:
        """Append one prediction column per target (Arrow batches; the model is broadcast)."""
        shared = df.sparkSession.sparkContext.broadcast((self.targets, self.start, self.trees))
        shape = T.StructType([T.StructField(n, T.DoubleType()) for n in names])

        @F.pandas_udf(shape)
        def score(x: pd.Series) -> pd.DataFrame:
            model = BoostedTrees(*shared.value)
            m = np.vstack(x.to_numpy()) if len(x) else np.zeros((0, 1))
            return pd.DataFrame({n: model.predict(m, k) for k, n in enumerate(names)})
        out = df.withColumn("_boosted", score(vector_to_array(self.features_col)))
        return out.select(*[c for c in df.columns], *[F.nanvl(F.col(f"_boosted.{n}"), F.lit(None).cast("double")).alias(n) for n in names])

    def save(self, path: str, spark: SparkSession) -> None:
        """One row per target and tree; the trees' arrays as columns."""
        rows = [(k, i, t["feature"], t["threshold"], t["left"], t["right"], t["value"])
                for k, trees in enumerate(self.trees) for i, t in enumerate(trees)]
        kind = "target int, round int, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>"
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        head = json.dumps(dict(targets=self.targets, start=self.start, features_col=self.features_col))
        spark.createDataFrame([(head,)], "head string").coalesce(1).write.mode("overwrite").json(f"{path}/head")

    @staticmethod
    def load(path: str, spark: SparkSession) -> "BoostedTrees":
        head = json.loads(spark.read.json(f"{path}/head").first()["head"])
        trees: list = [[] for _ in head["targets"]]
        for r in spark.read.parquet(f"{path}/trees").orderBy("target", "round").collect():
            trees[r["target"]].append({c: list(r[c]) for c in ("feature", "threshold", "left", "right", "value")})
        return BoostedTrees(head["targets"], head["start"], trees, head["features_col"])


# ------------------------------------------------------------------ training

def fit_boosters(x: DataFrame, targets: list[str], p: Boosting, fit_col: str | None = None, features_col: str = "features") -> dict:
    """``{fit: BoostedTrees}`` of every value of the integer column ``fit_col`` (None: one fit, 0)."""
    fit = F.col(fit_col).cast("int") if fit_col else F.lit(0)
    rows = x.select(fit.alias("fit"), vector_to_array(features_col).alias("x"), *targets)
    stats = rows.groupBy("fit").agg(F.count(F.lit(1)).alias("_n"), *[F.avg(F.col(t).cast("double")).alias(f"_m{k}") for k, t in enumerate(targets)]).collect()
    sizes = {r["fit"]: r["_n"] for r in sorted(stats, key=lambda r: r["fit"])}
    start = {(r["fit"], k): r[f"_m{k}"] for r in stats for k in range(len(targets))}
    if not sizes:
        return {}
    edges = bin_edges(rows.select("fit", "x"), sizes, p.max_bins)
    blocks, single = _pack(rows, targets, edges, sizes)          # ``single``: the fits of one block
    n_bins = {f: 1 + max((len(e) for e in edges[f]), default=0) for f in sizes}
    step = _step(n_bins)
    boosters = [b for b, s in start.items() if s is not None and edges[b[0]]]
    trees: dict = {b: [] for b in start}

    def begin(block: Block) -> Block:
        first = np.array([start[(block.fit, k)] if start[(block.fit, k)] is not None else np.nan for k in range(len(block.y))])
        return Block(block.fit, block.bins, block.y, np.repeat(first[:, None], block.y.shape[1], 1))

    alone = sorted(b for b in boosters if b[0] in single)
    if alone:
        place = {b: i for i, b in enumerate(alone)}
        apart = blocks.map(begin).flatMap(lambda block: _apart(block, place)).partitionBy(len(alone), place.get)
        for b, grown in apart.mapValues(_Alone(p, n_bins, step)).collect():
            trees[b] = grown
    boosters = [b for b in boosters if b[0] not in single]
    state, old = blocks.map(begin).filter(lambda block: block.fit not in single).persist(StorageLevel.MEMORY_AND_DISK), []
    for turn in range(p.max_iter if boosters else 0):
        growers = {b: _Grower(p) for b in boosters}
        while wanted := {b: w for b, g in growers.items() if (w := g.wanted())}:
            partial = {b: growers[b].tree for b in wanted}
            found = state.flatMap(_Level(partial, wanted, n_bins, step)).reduceByKey(_add).flatMap(_Best(p))
            for b, node, split in found.collect():
                growers[b].offer(node, split)
        done = {b: g.finished() for b, g in growers.items()}
        for b, t in done.items():
            trees[b].append(t)
        before, state = state, state.map(_Update(done)).persist(StorageLevel.MEMORY_AND_DISK)
        if turn % CHECKPOINT_ROUNDS == CHECKPOINT_ROUNDS - 1:
            state.checkpoint()
        # the next round's first job computes the new state from the old one, which can go after that
        old.append(before)
        if len(old) > 1:
            old.pop(0).unpersist()
    for r in (*old, state):
        r.unpersist()

    def raw(fit, t: Tree) -> dict:
        cut = [float(edges[fit][f][b]) if f >= 0 else 0.0 for f, b in zip(t.feature, t.bin)]
        return dict(feature=[int(f) for f in t.feature], threshold=cut, left=t.left, right=t.right, value=[float(v) for v in t.value])
    return {f: BoostedTrees(targets, [start[(f, k)] for k in range(len(targets))],
                            [[raw(f, t) for t in trees[(f, k)]] for k in range(len(targets))], features_col) for f in sizes}


def _add(a, b):
    return a[0], a[1] + b[1], a[2] + b[2]


class _Level:
    """Histograms of a block."""

    def __init__(self, trees, wanted, n_bins, step):
        self.trees, self.wanted, self.n_bins, self.step = trees, wanted, n_bins, step

    def __call__(self, block: Block):
        return histograms(block, self.trees, self.wanted, self.n_bins[block.fit], self.step[block.fit])


class _Best:
    def __init__(self, p):
        self.p = p

    def __call__(self, kv):
        return best_splits(*kv, self.p)


class _Update:
    """Add a round's trees to a block's predictions."""

    def __init__(self, trees):
        self.trees = trees

    def __call__(self, block: Block) -> Block:
        pred = block.pred.copy()
        for (fit, k), t in self.trees.items():
            if fit == block.fit:
                pred[k] += np.array(t.value)[t.node_of(block.bins)]
        return Block(block.fit, block.bins, block.y, pred)


def _apart(block: Block, place: dict):
    """The boosters of a block: ``(fit, target), rows with that target alone``."""
    for k in range(len(block.y)):
        if (block.fit, k) in place:
            yield (block.fit, k), Block(block.fit, block.bins, block.y[k:k + 1], block.pred[k:k + 1])


class _Alone:
    """All trees of a booster whose rows are one block."""

    def __init__(self, p, n_bins, step):
        self.p, self.n_bins, self.step = p, n_bins, step

    def __call__(self, block: Block) -> list:
        own, trees = (block.fit, 0), []
        for _ in range(self.p.max_iter):
            grower = _Grower(self.p)
            while nodes := grower.wanted():
                for key, value in histograms(block, {own: grower.tree}, {own: nodes}, self.n_bins[block.fit], self.step[block.fit]):
                    for _, node, split in best_splits(key, value, self.p):
                        grower.offer(node, split)
            trees.append(grower.finished())
            block = _Update({own: trees[-1]})(block)
        return trees

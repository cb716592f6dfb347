"""Decision trees, forests and boosting, grown level by level for many trees at once.

Feature values become numbers of bins once: one bin a distinct value where there are few, else quantiles, so the candidate
splits never follow the rows. A level is one job: Arrow batches sum the statistics per (node, feature, bin), these partial
histograms are summed, and running sums over the bins of a node's feature give every split's gain. Only the best split of
each node reaches the driver. Without bins every distinct value is a candidate, by a shuffle of (node, feature, value).
"""

from __future__ import annotations

import functools
import math
import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import checkpoints
from .base import Classifier, Regressor, check_X_y, classes_of

#: Candidate splits of a feature, rows that are summed up at once, and boosting rounds between checkpoints of the margin.
MAX_BINS, CHUNK_ROWS, MARGIN_ROUNDS = 256, 100_000, 8


@dataclass
class Node:
    """A leaf has no feature. `gain` is the split's gain, `sums` the sums of the statistics, the first of which is the weight."""

    sums: list[float]
    value: float | None = None
    feature: str | None = None
    threshold: float = 0.0
    gain: float = 0.0
    left: Node | None = None
    right: Node | None = None
    bin: int = 0
    extra: list | None = None

    @property
    def n_samples(self) -> float:
        return self.sums[0]

    def expression(self, value=lambda n: float(n.value)) -> Column:
        if self.feature is None:
            return F.lit(value(self))
        return F.when(F.col(self.feature) <= self.threshold, self.left.expression(value)).otherwise(self.right.expression(value))

    def leaves(self) -> list[Node]:
        return [self] if self.feature is None else self.left.leaves() + self.right.leaves()

    def depth(self) -> int:
        return 0 if self.feature is None else 1 + max(self.left.depth(), self.right.depth())


def _impurity(sums: list[Column], criterion: str) -> Column:
    """Of a group with the given sums: weight and class weights, or weight, sum and sum of squares."""
    n = sums[0]
    if criterion == "mse":
        return sums[2] / n - (sums[1] / n) * (sums[1] / n)
    p = [s / n for s in sums[1:]]
    if criterion == "entropy":
        return functools.reduce(lambda a, b: a + b, [F.when(q > 0, -q * F.log2(q)).otherwise(0.0) for q in p])
    return 1 - functools.reduce(lambda a, b: a + b, [q * q for q in p])


def _tagged(df: DataFrame, roots: list[Node], number: dict[int, int], weights: list[Column]) -> DataFrame:
    """(tree, node, weight, ...): one row for each tree that a row has weight in and whose node is still open."""
    tags = F.array(*(F.struct(F.lit(t).alias("tree"), root.expression(lambda n: number.get(id(n), -1)).alias("node"), w.alias("weight")) for t, (root, w) in enumerate(zip(roots, weights, strict=True))))
    return df.withColumn("_t", F.explode(tags)).filter("_t.node >= 0 and _t.weight > 0").select("*", "_t.node", "_t.weight").drop("_t")


def bins_of(df: DataFrame, features: list[str], max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Upper ends of each feature's bins, all observed values: every one where there are about max_bins at most, else quantiles."""
    cols = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features]
    few = [n <= max_bins for n in df.agg(*(F.approx_count_distinct(c, 0.02) for c in cols)).first()]
    cuts = [(i + 1) / max_bins for i in range(max_bins)]
    found = df.agg(*(F.collect_set(c) if small else F.percentile_approx(c, cuts, 20 * max_bins) for c, small in zip(cols, few, strict=True))).first()
    return [np.unique(np.array(x or [], float)) for x in found]


def _binned(df: DataFrame, features: list[str], bins: list[np.ndarray], rest: list[str]) -> DataFrame:
    """The rest columns and `codes`: the number of each feature's bin as 16-bit integers; a missing value lies beyond the last."""

    def run(batches):
        for batch in batches:
            codes = np.empty((batch.num_rows, len(bins)), "<i2")
            for j, edge in enumerate(bins):
                x = batch.column(j).to_numpy(zero_copy_only=False).astype(float)
                codes[:, j] = np.where(np.isnan(x), edge.size, np.searchsorted(edge, x))
            flat = pa.py_buffer(codes.tobytes())
            told = pa.Array.from_buffers(pa.binary(2 * len(bins)), batch.num_rows, [None, flat]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[len(bins) :], told], names=[*rest, "codes"])

    kinds = dict(df.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in rest) + "codes binary"
    return df.select(*(F.col(f).cast("double").alias(f"_x{j}") for j, f in enumerate(features)), *rest).mapInArrow(run, schema)


def _flat(root: Node, number: dict[int, int], at: dict[str, int]) -> np.ndarray:
    """Rows of (feature, bin, left, right, number of an open leaf): feature is -1 in a leaf, number is -1 in a closed one."""
    rows: list[list[int]] = []

    def add(n: Node) -> int:
        rows.append([-1, 0, 0, 0, number.get(id(n), -1)])
        i = len(rows) - 1
        if n.feature is not None:
            rows[i][:4] = at[n.feature], n.bin, add(n.left), add(n.right)
        return i

    add(root)
    return np.array(rows, np.int64)


def _histogram(trees: list[np.ndarray], bins: list[np.ndarray], k: int, may: np.ndarray | None):
    """Batches of (codes, statistics, weight of each tree) to partial sums by (node, feature, upper end of a bin)."""
    p, size = len(bins), max((x.size for x in bins), default=0) + 1
    values = np.full((p, size), np.nan)
    for j, x in enumerate(bins):
        values[j, : x.size] = x

    def told(codes, stats, weights):
        for t, nodes in enumerate(trees):
            at = np.zeros(len(codes), np.int64)
            while True:
                inner = np.flatnonzero(nodes[at, 0] >= 0)
                if not inner.size:
                    break
                here = nodes[at[inner]]
                at[inner] = np.where(codes[inner, here[:, 0]] <= here[:, 1], here[:, 2], here[:, 3])
            node, w = nodes[at, 4], weights[t]
            rows = np.flatnonzero((node >= 0) & (w > 0))
            if not rows.size:
                continue
            first = int(node[rows].min())
            span = int(node[rows].max()) - first + 1
            key = (((node[rows] - first)[:, None] * p + np.arange(p)) * size + codes[rows]).ravel()
            seen = np.bincount(key, minlength=span * p * size)
            cells = np.flatnonzero(seen)
            n, j, code = cells // (p * size) + first, cells // size % p, cells % size
            keep = code < np.array([x.size for x in bins])[j]
            if may is not None:
                keep &= may[n, j]
            cells, n, j, code = cells[keep], n[keep], j[keep], code[keep]
            sums = [np.bincount(key, np.repeat(s[rows] * w[rows], p), span * p * size)[cells] for s in stats]
            yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(values[j, code]), *map(pa.array, sums)], names=["node", "j", "x", *(f"s{i}" for i in range(k))])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i2").reshape(-1, p).astype(np.int64)
            held.append((codes, *(c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:])))
            n += batch.num_rows
            if n >= CHUNK_ROWS:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                yield from told(cols[0], cols[1 : 1 + k], cols[1 + k :])
                held, n = [], 0
        if n:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            yield from told(cols[0], cols[1 : 1 + k], cols[1 + k :])

    return run


def grow(df: DataFrame, features: list[str], stats: list[Column], gain, allowed, *, trees: int = 1, weights=None, max_depth=None, midpoint=False, pick=None, done=lambda n: False, least_gain=None, bins: list[np.ndarray] | None = None, total: list[Column] | None = None) -> list[Node]:
    """Trees over df. stats: columns whose weighted sums describe a node, the first constantly 1. gain(left, right, all) and
    allowed(left, right) judge a split by sums. Ties go to the first feature, then the lowest threshold. pick(tree): the
    features of a node. With bins, df holds `codes`, the features' bins. total: further sums over df; they go into .extra of the first root."""
    k, weights, extra = len(stats), weights or [F.lit(1.0)] * trees, total or []
    names = [f"s{i}" for i in range(k)]
    data = df.select(*(["codes"] if bins is not None else features), *(s.cast("double").alias(n) for s, n in zip(stats, names, strict=True)), *(w.cast("tinyint").alias(f"w{i}") for i, w in enumerate(weights)), *(e.alias(f"e{i}") for i, e in enumerate(extra))).persist()
    weights = [F.col(f"w{i}") for i in range(trees)]
    whole = data.agg(*(F.sum(F.col(n) * w) for w in weights for n in names), *(F.sum(f"e{i}") for i in range(len(extra)))).first()
    roots = [Node([float(x or 0) for x in whole[t * k : (t + 1) * k]]) for t in range(trees)]
    roots[0].extra = list(whole[trees * k :])
    open_, depth, at = [(t, r) for t, r in enumerate(roots)], 0, {f: j for j, f in enumerate(features)}
    while open_ and (max_depth is None or depth < max_depth):
        open_ = [(t, n) for t, n in open_ if not done(n)]
        if not open_:
            break
        number = {id(n): i for i, (_, n) in enumerate(open_)}
        chosen = [sorted(pick(t)) if pick else list(range(len(features))) for t, _ in open_]
        if bins is not None:
            may = None
            if pick:
                may = np.zeros((len(open_), len(features)), bool)
                for i, c in enumerate(chosen):
                    may[i, c] = True
            rows = data.select("codes", *names, *(f"w{i}" for i in range(trees))).mapInArrow(_histogram([_flat(r, number, at) for r in roots], bins, k, may), "node int, j int, x double, " + ", ".join(f"{n} double" for n in names))
            sums = rows.groupBy("node", "j", "x").agg(*(F.sum(n).alias(n) for n in names))
        else:
            rows = _tagged(data, roots, number, weights).select("node", "weight", *names, F.posexplode(F.array(*(F.col(f).cast("double") for f in features))).alias("j", "x")).filter("x is not null")
            if pick:
                may = F.create_map(*(v for i, c in enumerate(chosen) for v in (F.lit(i), F.array(*map(F.lit, c)))))
                rows = rows.filter(F.array_contains(may[F.col("node")], F.col("j")))
            sums = rows.groupBy("node", "j", "x").agg(*(F.sum(F.col(n) * F.col("weight")).alias(n) for n in names))
        order = Window.partitionBy("node", "j").orderBy("x")
        run = sums.select("node", "j", "x", F.lead("x").over(order).alias("next"), *(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(f"l{i}") for i, n in enumerate(names)))
        known = data.sparkSession.createDataFrame([(i, n.sums) for i, (_, n) in enumerate(open_)], "node int, _all array<double>")
        run = run.filter(F.col("next").isNotNull()).join(F.broadcast(known), "node")
        left, all_ = [F.col(f"l{i}") for i in range(k)], [F.col("_all")[i] for i in range(k)]
        right = [a - b for a, b in zip(all_, left, strict=True)]
        cut = (F.col("x") + F.col("next")) / 2 if midpoint else F.col("x")
        split = run.filter(allowed(left, right)).select("node", F.struct(gain(left, right, all_).alias("gain"), (-F.col("j")).alias("j"), (-F.col("x")).alias("x"), cut.alias("cut"), F.array(*left).alias("left")).alias("best"))
        best = split.groupBy("node").agg(F.max("best").alias("best")).collect()
        new = []
        for r in sorted(best, key=lambda r: r.node):
            if least_gain is not None and not r.best.gain > least_gain:
                continue
            t, n = open_[r.node]
            n.feature, n.threshold, n.gain = features[-r.best.j], r.best.cut, r.best.gain
            n.bin = int(np.searchsorted(bins[-r.best.j], -r.best.x)) if bins is not None else 0
            n.left, n.right = Node(list(r.best.left)), Node([a - b for a, b in zip(n.sums, r.best.left, strict=True)])
            new += [(t, n.left), (t, n.right)]
        open_, depth = new, depth + 1
    data.unpersist()
    return roots


class _Tree:
    """Shared by single trees and forests."""

    def _stats(self, df: DataFrame) -> list[Column]:
        y = F.col(self.label)
        if self.task == "classification":
            self.classes_ = classes_of(df, self.label)
            return [F.lit(1.0), *((y == c).cast("double") for c in self.classes_)]
        return [F.lit(1.0), y, y * y]

    def _criterion(self) -> str:
        return "mse" if self.task != "classification" else getattr(self, "criterion", None) or "gini"

    def _grow(self, df, **how) -> list[Node]:
        df = check_X_y(df, self.features, self.label)
        stats, criterion, rng = self._stats(df), self._criterion(), random.Random(getattr(self, "random_state", 0) or 0)
        weigh = lambda left, right, all_: _impurity(all_, criterion) - (left[0] * _impurity(left, criterion) + right[0] * _impurity(right, criterion)) / all_[0]
        allowed = lambda left, right: (left[0] >= self.min_samples_leaf) & (right[0] >= self.min_samples_leaf)
        m = self._width()
        pick = (lambda _: rng.sample(range(len(self.features)), m)) if m < len(self.features) else None
        done = lambda n: n.n_samples < self.min_samples_split or self._pure(n.sums)
        weights, bins = how.pop("weights", None), None
        if self.max_bins:
            bins, k = bins_of(df, self.features, self.max_bins), len(stats)
            every = [*stats, *(weights or [])]
            df = _binned(df.select(*self.features, *(c.alias(f"_c{i}") for i, c in enumerate(every))), self.features, bins, [f"_c{i}" for i in range(len(every))])
            stats, weights = [F.col(f"_c{i}") for i in range(k)], [F.col(f"_c{i}") for i in range(k, len(every))] or None
        roots = grow(df, self.features, stats, weigh, allowed, max_depth=self.max_depth, pick=pick, done=done, weights=weights, bins=bins, **how)
        for leaf in (x for r in roots for x in r.leaves()):
            leaf.value = self._value(leaf.sums)
        return roots

    def _pure(self, s) -> bool:
        return max(s[1:]) >= s[0] - 1e-9 if self.task == "classification" else s[2] / max(s[0], 1e-12) - (s[1] / max(s[0], 1e-12)) ** 2 <= 1e-12

    def _value(self, s):
        return self.classes_[int(np.argmax(s[1:]))] if self.task == "classification" else s[1] / s[0] if s[0] else 0.0

    def _width(self) -> int:
        p, m = len(self.features), self.max_features
        m = p if m is None else math.sqrt(p) if m == "sqrt" else math.log2(p) if m == "log2" else m * p if isinstance(m, float) else m
        return max(1, min(p, int(m)))

    def _importances(self, root: Node) -> np.ndarray:
        out, stack = np.zeros(len(self.features)), [root]
        while stack:
            n = stack.pop()
            if n.feature is not None:
                out[self.features.index(n.feature)] += n.gain * n.n_samples
                stack += [n.left, n.right]
        return out / (out.sum() + 1e-15)

    @property
    def kind(self):
        return "classifier" if self.task == "classification" else "regressor"

    def score(self, df):
        return (Classifier if self.task == "classification" else Regressor).score(self, df)


class DecisionTree(_Tree, Classifier):
    """CART. max_bins bounds a feature's candidate splits; None takes every value. The threshold is an observed value, `<=` goes left, zero-gain splits are taken, leaves hold the majority (lowest on ties) or mean."""

    def __init__(self, features, label, task="classification", criterion=None, max_depth=None, min_samples_split=2, min_samples_leaf=1, max_features=None, random_state=0, max_bins=MAX_BINS):
        self.features, self.label, self.task, self.criterion, self.max_depth, self.max_bins = features, label, task, criterion, max_depth, max_bins
        self.min_samples_split, self.min_samples_leaf, self.max_features, self.random_state = min_samples_split, min_samples_leaf, max_features, random_state

    def fit(self, df):
        self.tree_ = self._grow(df)[0]
        self.feature_importances_ = self._importances(self.tree_)
        return self

    def predict(self, df):
        self._check("tree_")
        return df.withColumn("prediction", self.tree_.expression(lambda n: n.value))


class RandomForest(_Tree, Classifier):
    """All trees grow in the same jobs. A row's multiplicity in a bag is Poisson(1), drawn from a hash of row_id, tree and seed; more than 12 copies, one in 10^10 draws, count as 12."""

    def __init__(self, features, label, row_id, n_estimators=100, task="classification", max_depth=None, min_samples_split=2, min_samples_leaf=1, max_features="sqrt", bootstrap=True, oob_score=False, random_state=0, max_bins=MAX_BINS):
        self.features, self.label, self.row_id, self.n_estimators, self.task, self.max_depth, self.max_bins = features, label, row_id, n_estimators, task, max_depth, max_bins
        self.min_samples_split, self.min_samples_leaf, self.max_features, self.bootstrap, self.oob_score, self.random_state = min_samples_split, min_samples_leaf, max_features, bootstrap, oob_score, random_state

    def _bag(self, tree: int) -> Column:
        if not self.bootstrap:
            return F.lit(1.0)
        u = F.pmod(F.xxhash64(self.row_id, F.lit(tree), F.lit(self.random_state or 0)), F.lit(1 << 50)) / F.lit(float(1 << 50))
        out, edge, term = F.lit(0.0), 0.0, math.exp(-1)
        for k in range(12):
            edge, term = edge + term, term / (k + 1)
            out = out + (u >= edge).cast("double")
        return out

    def fit(self, df):
        bags = [self._bag(t) for t in range(self.n_estimators)]
        self.trees_ = self._grow(df, trees=self.n_estimators, weights=bags)
        self.feature_importances_ = np.mean([self._importances(r) for r in self.trees_], axis=0)
        if self.oob_score:
            seen = self._vote(df, [F.when(b == 0, t.expression(lambda n: n.value)) for b, t in zip(bags, self.trees_, strict=True)])
            seen = seen.filter(F.col("prediction").isNotNull())
            self.oob_score_ = seen.agg(F.avg((F.col("prediction") == F.col(self.label)).cast("double"))).first()[0] if self.kind == "classifier" else Regressor.score(_Fixed(self.label), seen)
        return self

    def _vote(self, df, told: list[Column]) -> DataFrame:
        """Null votes do not count; ties go to the lowest class."""
        df = df.withColumn("_v", F.filter(F.array(*told), lambda x: x.isNotNull()))
        if self.task != "classification":
            return df.withColumn("prediction", F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("_v"), F.lit(0))).drop("_v")
        votes = lambda c: F.size(F.filter("_v", lambda x: x == c))
        share = F.array(*(votes(c) / F.nullif(F.size("_v"), F.lit(0)) for c in self.classes_))
        df = df.withColumn("probability", share).drop("_v")
        p = F.col("probability")
        return df.withColumn("prediction", F.element_at(F.array(*map(F.lit, self.classes_)), F.array_position(p, F.array_max(p)).cast("int")))

    def predict(self, df):
        self._check("trees_")
        return self._vote(df, [t.expression(lambda n: n.value) for t in self.trees_])

    def predict_proba(self, df):
        """Shares of the trees' hard votes."""
        return self.predict(df)


class _Fixed:
    """Lets score() see a frame that is already predicted."""

    def __init__(self, label):
        self.label = label

    def predict(self, df):
        return df


class _Boosted:
    def _margin(self) -> Column:
        return functools.reduce(lambda a, t: a + self.learning_rate * t.expression(), self.trees_, F.lit(self.init_))

    def _rounds(self, df, stats, gain, allowed, value, loss, **how):
        """stats(margin): the columns of a round. The margin is a column to which a round adds one tree; it is written every MARGIN_ROUNDS rounds, so plans stay short."""
        checkpoints(df.sparkSession)
        df = check_X_y(df, self.features, self.label)
        bins = bins_of(df, self.features, self.max_bins) if self.max_bins else None
        data = df.select(*self.features, self.label).withColumns({"_row": F.monotonically_increasing_id(), "_m": F.lit(self.init_)})
        if bins is not None:
            data = _binned(data.withColumns({f"_f{j}": F.col(f) for j, f in enumerate(self.features)}), [f"_f{j}" for j in range(len(bins))], bins, [*self.features, self.label, "_row", "_m"])
        data, m = data.checkpoint(), F.col("_m")
        self.trees_, self.train_losses_ = [], []
        n = data.count()
        for i in range(self.n_estimators):
            keep = F.lit(1.0)
            if self.subsample < 1:
                keep = (F.pmod(F.xxhash64("_row", F.lit(i), F.lit(self.random_state or 0)), F.lit(1 << 20)) < self.subsample * (1 << 20)).cast("double")
            tree = grow(data, self.features, stats(m), gain, allowed, max_depth=self.max_depth, weights=[keep], bins=bins, total=[loss(m)], **how)[0]
            if i:
                self.train_losses_.append(tree.extra[0] / n)
            for leaf in tree.leaves():
                leaf.value = value(leaf.sums)
            self.trees_.append(tree)
            data = data.withColumn("_m", m + self.learning_rate * tree.expression())
            if (i + 1) % MARGIN_ROUNDS == 0:
                data = data.checkpoint()
        if self.trees_:
            self.train_losses_.append(data.agg(F.avg(loss(m))).first()[0])
        return self


class GradientBoostingRegressor(_Boosted, Regressor):
    """From the mean; each tree fits the residuals; the learning rate damps every tree."""

    def __init__(self, features, label, n_estimators=100, learning_rate=0.1, max_depth=3, min_samples_split=2, subsample=1.0, random_state=0, max_bins=MAX_BINS):
        self.features, self.label, self.n_estimators, self.learning_rate, self.max_depth, self.min_samples_split, self.subsample, self.random_state, self.max_bins = features, label, n_estimators, learning_rate, max_depth, min_samples_split, subsample, random_state, max_bins

    _drop = staticmethod(lambda left, right, all_: _impurity(all_, "mse") - (left[0] * _impurity(left, "mse") + right[0] * _impurity(right, "mse")) / all_[0])
    _some = staticmethod(lambda left, right: (left[0] >= 1) & (right[0] >= 1))

    def _fit(self, df, residual, loss):
        stats = lambda f: [F.lit(1.0), residual(f), residual(f) * residual(f)]
        done = lambda n: n.n_samples < self.min_samples_split or n.sums[2] / n.sums[0] - (n.sums[1] / n.sums[0]) ** 2 <= 1e-12
        return self._rounds(df, stats, self._drop, self._some, lambda s: s[1] / s[0] if s[0] else 0.0, loss, done=done)

    def fit(self, df):
        y = F.col(self.label).cast("double")
        self.init_ = float(df.agg(F.avg(self.label)).first()[0])
        return self._fit(df, lambda f: y - f, lambda f: (y - f) * (y - f))

    def predict(self, df):
        self._check("trees_")
        return df.withColumn("prediction", self._margin())


def _logit_start(df, label) -> float:
    p = min(max(float(df.agg(F.avg(F.col(label).cast("double"))).first()[0]), 1e-7), 1 - 1e-7)
    return math.log(p / (1 - p))


def _bernoulli(y: Column, f: Column) -> Column:
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), 1 / (1 + F.exp(-f))))
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


class _BinaryBoosted(Classifier):
    def decision_function(self, df):
        self._check("trees_")
        return df.withColumn("score", self._margin())

    def predict_proba(self, df):
        p = 1 / (1 + F.exp(-F.col("score")))
        return self.decision_function(df).withColumn("probability", F.array(1 - p, p))

    def predict(self, df):
        return self.predict_proba(df).withColumn("prediction", (F.col("probability")[1] >= 0.5).cast("int"))


class GradientBoostingClassifier(_BinaryBoosted, GradientBoostingRegressor):
    """Labels 0 and 1, from the log-odds; leaves hold the mean residual."""

    kind = "classifier"

    def fit(self, df):
        y = F.col(self.label).cast("double")
        self.init_ = _logit_start(df, self.label)
        return self._fit(df, lambda f: y - 1 / (1 + F.exp(-f)), lambda f: _bernoulli(y, f))


class XGBoostClassifier(_BinaryBoosted, _Boosted):
    """Second-order boosting: leaf -G/(H+lambda), thresholds half way between neighbouring values, only splits of positive gain."""

    def __init__(self, features, label, n_estimators=100, learning_rate=0.1, max_depth=6, min_child_weight=1.0, reg_lambda=1.0, gamma=0.0, subsample=1.0, colsample=1.0, random_state=0, max_bins=MAX_BINS):
        self.features, self.label, self.n_estimators, self.learning_rate, self.max_depth, self.min_child_weight, self.max_bins = features, label, n_estimators, learning_rate, max_depth, min_child_weight, max_bins
        self.reg_lambda, self.gamma, self.subsample, self.colsample, self.random_state = reg_lambda, gamma, subsample, colsample, random_state

    def fit(self, df):
        y, rng, p = F.col(self.label).cast("double"), random.Random(self.random_state or 0), len(self.features)
        self.init_ = _logit_start(df, self.label)
        part = lambda s: s[1] * s[1] / (s[2] + self.reg_lambda)
        m = max(1, int(self.colsample * p))
        prob = lambda f: 1 / (1 + F.exp(-f))
        return self._rounds(
            df,
            lambda f: [F.lit(1.0), prob(f) - y, prob(f) * (1 - prob(f))],
            lambda left, right, all_: 0.5 * (part(left) + part(right) - part(all_)) - self.gamma,
            lambda left, right: (left[2] >= self.min_child_weight) & (right[2] >= self.min_child_weight),
            lambda s: -s[1] / (s[2] + self.reg_lambda),
            lambda f: _bernoulli(y, f),
            midpoint=True,
            least_gain=0.0,
            pick=(lambda _: rng.sample(range(p), m)) if m < p else None,
        )


def xgb_tree(df, features, g: Column, h: Column, max_depth=6, min_child_weight=1.0, reg_lambda=1.0, gamma=0.0, colsample=1.0, random_state=0, max_bins=MAX_BINS) -> Node:
    """A single tree on given gradients and curvatures; each node sees a random part colsample of the features."""
    part = lambda s: s[1] * s[1] / (s[2] + reg_lambda)
    rng, p, bins = random.Random(random_state or 0), len(features), None
    m = max(1, int(colsample * p))
    df = df.select(*features, g.cast("double").alias("_g"), h.cast("double").alias("_h"))
    if max_bins:
        bins = bins_of(df, features, max_bins)
        df = _binned(df, features, bins, ["_g", "_h"])
    root = grow(
        df, features, [F.lit(1.0), F.col("_g"), F.col("_h")], lambda a, b, c: 0.5 * (part(a) + part(b) - part(c)) - gamma, lambda a, b: (a[2] >= min_child_weight) & (b[2] >= min_child_weight),
        max_depth=max_depth, midpoint=True, least_gain=0.0, bins=bins, pick=(lambda _: rng.sample(range(p), m)) if m < p else None,
    )[0]
    for leaf in root.leaves():
        leaf.value = -leaf.sums[1] / (leaf.sums[2] + reg_lambda)
    return root

"""Scalers, encoders, imputers, feature selection and resampling. Fitting is an aggregate, transforming a projection."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import checkpoints
from .base import Operator, gram, numbered

#: Rows of a dictionary that is broadcast, columns that a category may become, and rows of a block of all-against-all searches.
BROADCAST_ROWS, MOST_CATEGORIES, BLOCK_ROWS = 500_000, 5000, 20_000


class _Scaler(Operator):
    """(x - shift) / scale for each feature."""

    def transform(self, df):
        self._check("scale_")
        return df.withColumns({f: (F.col(f) - float(a)) / float(b) for f, a, b in zip(self.features, self.shift_, self.scale_, strict=True)})

    def inverse_transform(self, df):
        self._check("scale_")
        return df.withColumns({f: F.col(f) * float(b) + float(a) for f, a, b in zip(self.features, self.shift_, self.scale_, strict=True)})

    def _stats(self, df, *fns):
        row = df.agg(*(fn(f) for f in self.features for fn in fns)).first()
        return np.array(row, float).reshape(len(self.features), len(fns)).T


class StandardScaler(_Scaler):
    """Population deviation; a zero one counts as 1."""

    def __init__(self, features, with_mean=True, with_std=True):
        self.features, self.with_mean, self.with_std = features, with_mean, with_std

    def fit(self, df):
        self.mean_, std = self._stats(df, F.avg, F.stddev_pop)
        self.shift_ = self.mean_ * self.with_mean
        self.scale_ = np.where(std == 0, 1.0, std) if self.with_std else np.ones_like(std)
        return self


class MinMaxScaler(_Scaler):
    """A constant column maps to the lower end."""

    def __init__(self, features, feature_range=(0.0, 1.0)):
        self.features, self.feature_range = features, feature_range

    def fit(self, df):
        lo, hi = self._stats(df, F.min, F.max)
        a, b = self.feature_range
        span = np.where(hi == lo, 1.0, hi - lo)
        self.scale_ = span / (b - a)
        self.shift_ = lo - a * self.scale_
        return self


class RobustScaler(_Scaler):
    """Exact median and interpolated quantiles; a zero range counts as 1."""

    def __init__(self, features, with_centering=True, with_scaling=True, quantile_range=(25.0, 75.0)):
        self.features, self.with_centering, self.with_scaling, self.quantile_range = features, with_centering, with_scaling, quantile_range

    def fit(self, df):
        lo, hi = (q / 100 for q in self.quantile_range)
        mid, a, b = self._stats(df, F.median, lambda f: F.percentile(f, lo), lambda f: F.percentile(f, hi))
        self.shift_ = mid * self.with_centering
        self.scale_ = np.where(b == a, 1.0, b - a) if self.with_scaling else np.ones_like(mid)
        return self


class Normalizer(Operator):
    """Rows to norm 1 (l2, l1, or else the largest absolute value); a zero row stays."""

    def __init__(self, features, norm="l2"):
        self.features, self.norm = features, norm

    def fit(self, df):
        return self

    def transform(self, df):
        x = F.array(*(F.col(f).cast("double") for f in self.features))
        fold = lambda g: F.aggregate(x, F.lit(0.0), lambda a, v: a + g(v))
        n = F.sqrt(fold(lambda v: v * v)) if self.norm == "l2" else fold(F.abs) if self.norm == "l1" else F.array_max(F.transform(x, F.abs))
        out = df.withColumn("_n", n)
        return out.withColumns({f: F.col(f) / F.when(F.col("_n") == 0, 1.0).otherwise(F.col("_n")) for f in self.features}).drop("_n")


def _categories(df: DataFrame, c: str) -> DataFrame:
    """(category, code): rank among the sorted distinct values, numbered range by range and written once."""
    known = df.select(F.col(c).alias("category")).filter(F.col(c).isNotNull()).distinct()
    return numbered(known, ["category"], "code").withColumn("code", F.col("code").cast("int")).checkpoint()


def _small(df: DataFrame) -> DataFrame:
    """A dictionary is broadcast if it is counted to be small, else joined by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class LabelEncoder(Operator):
    """Code = place among the sorted distinct labels; an unseen label is an error. The dictionary is a table, joined back."""

    def __init__(self, column, output=None):
        self.column, self.output = column, output

    def fit(self, df):
        self.classes_ = _categories(df, self.column)
        return self

    def _join(self, df, key, value, out):
        self._check("classes_")
        return df.join(_small(self.classes_.select(F.col(key).alias(self.column if key == "category" else self.output or "code"), F.col(value).alias(out))), self.column if key == "category" else self.output or "code", "left")

    def transform(self, df):
        out = self._join(df, "category", "code", self.output or "code")
        return out.withColumn(self.output or "code", F.when(F.col(self.output or "code").isNull() & F.col(self.column).isNotNull(), F.raise_error(F.concat(F.lit("unseen label "), F.col(self.column).cast("string"))).cast("int")).otherwise(F.col(self.output or "code")))

    def inverse_transform(self, df):
        return self._join(df, "code", "category", "label")


class OrdinalEncoder(Operator):
    """Codes for each column; an unknown value is -1."""

    def __init__(self, features):
        self.features = features

    def fit(self, df):
        self.categories_ = {f: _categories(df, f) for f in self.features}
        return self

    def transform(self, df):
        self._check("categories_")
        for f in self.features:
            df = df.join(_small(self.categories_[f].withColumnsRenamed({"category": f, "code": "_code"})), f, "left").withColumn(f, F.coalesce(F.col("_code").cast("double"), F.lit(-1.0))).drop("_code")
        return df


class OneHotEncoder(Operator):
    """A 0/1 column for each category, named column_category; unknown: an error when the row is computed, or all zero if ignored.

    With sparse, one column `column_onehot` instead: the number of the category's column, null for none. A column of more
    than MOST_CATEGORIES categories is an error unless sparse.
    """

    def __init__(self, features, drop=None, handle_unknown="error", sparse=False):
        self.features, self.drop, self.handle_unknown, self.sparse = features, drop, handle_unknown, sparse

    def fit(self, df):
        self.tables_ = {f: _categories(df, f) for f in self.features}
        self.categories_ = {}
        for f, t in self.tables_.items():
            cats = [r[0] for r in t.orderBy("code").limit(MOST_CATEGORIES + 1).collect()] if not self.sparse else []
            if len(cats) > MOST_CATEGORIES:
                raise ValueError(f"{f!r} has more than {MOST_CATEGORIES} categories; use sparse=True")
            self.categories_[f] = cats
        return self

    def _known(self, f, found):
        """The value, or an error where it is unknown and that is not ignored."""
        if self.handle_unknown != "error":
            return F.col(f)
        bad = F.raise_error(F.concat(F.lit(f"unknown category in {f!r}: "), F.col(f).cast("string")))
        return F.when(F.col(f).isNull() | found, F.col(f)).otherwise(bad)

    def transform(self, df):
        self._check("categories_")
        skip = int(self.drop == "first")
        for f, cats in self.categories_.items():
            if self.sparse:
                df = df.join(_small(self.tables_[f].withColumnsRenamed({"category": f, "code": "_code"})), f, "left")
                place = F.when(self._known(f, F.col("_code").isNotNull()).isNotNull() & (F.col("_code") >= skip), F.col("_code") - skip)
                df = df.withColumn(f"{f}_onehot", place).drop("_code")
            else:
                value = self._known(f, F.col(f).isin(cats))
                df = df.withColumns({f"{f}_{c}": F.coalesce((value == c).cast("double"), F.lit(0.0)) for c in cats[skip:]})
        return df


class TargetEncoder(Operator):
    """n/(n+s) of the category's mean and the rest of the global mean; unseen: the global mean."""

    def __init__(self, column, label, smoothing=10.0, output=None):
        self.column, self.label, self.smoothing, self.output = column, label, smoothing, output

    def fit(self, df):
        self.global_mean_ = df.agg(F.avg(self.label)).first()[0]
        share = F.count("*") / (F.count("*") + self.smoothing)
        self.encoding_ = df.groupBy(self.column).agg((share * F.avg(self.label) + (1 - share) * F.lit(self.global_mean_)).alias("_e"))
        return self

    def transform(self, df):
        self._check("encoding_")
        return df.join(self.encoding_, self.column, "left").withColumn(self.output or f"{self.column}_target", F.coalesce("_e", F.lit(self.global_mean_))).drop("_e")


class SimpleImputer(Operator):
    """mean, exact median, most_frequent (smallest on ties) or a constant; a column without values is filled with 0."""

    def __init__(self, features, strategy="mean", fill_value=0.0):
        self.features, self.strategy, self.fill_value = features, strategy, fill_value

    def fit(self, df):
        fn = {"mean": F.avg, "median": F.median, "most_frequent": lambda f: F.mode(f, True)}.get(self.strategy)
        row = df.agg(*(fn(f).cast("double") for f in self.features)).first() if fn else [self.fill_value] * len(self.features)
        self.statistics_ = [0.0 if v is None else float(v) for v in row]
        return self

    def transform(self, df):
        self._check("statistics_")
        return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(v)) for f, v in zip(self.features, self.statistics_, strict=True)})


def nearest(queries: DataFrame, points: DataFrame, key: str, n_features: int, k: int) -> DataFrame:
    """(key, rank, point, d): the k points nearest to each query, by (distance, point id), over the coordinates that both have.

    queries are (key, x) and points (id, x), x arrays of doubles with nulls; d is the sum of squares, and a point that shares
    no coordinate is infinitely far. Points and queries are dealt to blocks; every block of queries meets every block of points
    in a task of its own, which returns k rows a query, never a row a pair; then the best of each block meet by query.
    """
    blocks, slices = (max(1, -(-df.count() // BLOCK_ROWS)) for df in (points, queries))
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    spread = points.withColumn("_b", own("id", blocks)).withColumn("_s", all_(slices))
    asked = queries.withColumn("_b", all_(blocks)).withColumn("_s", own(key, slices))

    def matrix(column):
        flat = [[np.nan if v is None else v for v in row] for row in column]
        return np.array(flat, float).reshape(len(flat), n_features)

    def best(ask: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if ask.empty or there.empty:
            return pd.DataFrame({"key": [], "point": [], "d": []})
        there = there.sort_values("id")
        q, p, ids, out = matrix(ask["x"]), matrix(there["x"]), there["id"].to_numpy(), []
        gap = np.isnan(p)
        p0 = np.where(gap, 0.0, p)
        for i in range(0, len(q), 256):
            part = q[i : i + 256]
            hole = np.isnan(part)
            x = np.where(hole, 0.0, part)
            d, shared = np.zeros((len(part), len(p))), np.zeros((len(part), len(p)), bool)
            for j in range(n_features):
                both = ~hole[:, j, None] & ~gap[None, :, j]
                d += np.where(both, (x[:, j, None] - p0[None, :, j]) ** 2, 0.0)
                shared |= both
            d[~shared] = np.inf
            top = np.argsort(d, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(part)), top.shape[1])
            out.append(pd.DataFrame({"key": ask["key"].to_numpy()[i : i + 256][rows], "point": ids[top.ravel()], "d": d[rows, top.ravel()]}))
        return pd.concat(out)

    asked = asked.select("_b", "_s", F.col(key).alias("key"), "x")
    found = asked.groupBy("_b", "_s").cogroup(spread.select("_b", "_s", "id", "x").groupBy("_b", "_s")).applyInPandas(best, "key long, point long, d double")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("d", "point"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).withColumnRenamed("key", key)


#: Distinct points of a cell, and rows from which the bounds of cells are taken at most.
CELL_ROWS, BOUND_ROWS = 2000, 200_000


def _split(x: np.ndarray, cells: int) -> list[tuple]:
    """A tree over space: (feature, value, node below it, node from it on), or (cell,) where it ends. Points only tell where to halve."""
    nodes = []

    def grow(x, cells):
        at = len(nodes)
        nodes.append(None)
        wide = np.ptp(x, axis=0) if len(x) > 1 and cells > 1 else np.zeros(1)
        if not wide.max() > 0:
            nodes[at] = (at,)
            return at
        f = int(wide.argmax())
        v = np.sort(x[:, f])
        cut = v[len(v) // 2]
        cut = v[np.searchsorted(v, cut, "right")] if cut == v[0] else cut
        below = x[:, f] < cut
        nodes[at] = (f, float(cut), grow(x[below], cells // 2), grow(x[~below], cells - cells // 2))
        return at

    grow(x, cells)
    return nodes


def _cells(nodes: list[tuple], x: np.ndarray, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): the cell of each row, or all that may hold a point whose squared distance is within the row's."""
    rows, cells, todo = [], [], [(0, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        if len(nodes[node]) == 1:
            rows.append(at)
            cells.append(np.full(len(at), node))
            continue
        f, cut, below, above = nodes[node]
        v = x[at, f]
        near = (v - cut) ** 2 <= within[at] if within is not None else np.zeros(len(at), bool)
        todo += [(n, at[m]) for n, m in ((below, (v < cut) | near), (above, (v >= cut) | near)) if m.any()]
    return np.concatenate(rows), np.concatenate(cells)


def _gaps(ask: np.ndarray, there: np.ndarray):
    """Squared distances of 256 rows at a time to all points, with the place of the first of these rows."""
    for i in range(0, len(ask), 256):
        d = np.zeros((len(ask[i : i + 256]), len(there)))
        for f in range(there.shape[1]):
            d += (ask[i : i + 256, f, None] - there[:, f]) ** 2
        yield i, d


def nearest_in_cells(queries: DataFrame, points: DataFrame, n_features: int, k: int) -> DataFrame:
    """(x, near): for each distinct x of the queries the k points nearest by (distance, point id), as (d, point, y), in that order.

    queries are (x), points (id, x), x arrays of n_features finite doubles. Copies count as one site that keeps its k least ids.
    Sites are dealt to cells of about CELL_ROWS; the k nearest of a query's own cell bound how far away its nearest can be, and
    it then meets the cells within that bound, which hold all of them. Work follows the sites, not their square, where
    features are few; with many, balls reach into most cells.
    """
    line = Window.partitionBy("x").orderBy("id")
    sites = points.withColumn("_r", F.row_number().over(line)).filter(F.col("_r") <= k).groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids")).checkpoint()
    asked = queries.groupBy("x").agg(F.count("*").alias("_n")).select("x", F.monotonically_increasing_id().alias("key")).checkpoint()
    cells = -(-sites.count() // CELL_ROWS)
    some = sites.select("x").orderBy(F.xxhash64("x")).limit(min(BOUND_ROWS, 50 * cells)) if cells > 1 else sites.select("x").limit(1)
    nodes = _split(np.array([r[0] for r in some.collect()], float).reshape(-1, n_features), cells)
    tree = queries.sparkSession.sparkContext.broadcast(nodes)
    matrix = lambda column: np.array(column.tolist(), float).reshape(len(column), n_features)

    @F.pandas_udf("int")
    def cell(x: pd.Series) -> pd.Series:
        rows, found = _cells(tree.value, matrix(x))
        return pd.Series(found[np.argsort(rows)])

    def bound(ask: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        far = np.full(len(ask), np.inf)
        if len(ask) and len(there):
            held, few = there["ids"].map(len).to_numpy(), min(k, len(there))
            for i, d in _gaps(matrix(ask["x"]), matrix(there["x"])):
                top = np.argpartition(d, few - 1, axis=1)[:, :few]
                d = np.take_along_axis(d, top, axis=1)
                order = np.argsort(d, axis=1)
                upto = np.cumsum(np.take_along_axis(held[top], order, axis=1), axis=1) >= k
                last = np.take_along_axis(d, order, axis=1)[np.arange(len(d)), upto.argmax(axis=1)]
                far[i : i + 256] = np.where(upto.any(axis=1), last, np.inf)
        return pd.DataFrame({"key": ask["key"], "x": ask["x"], "far": far})

    def reach(frames):
        for pdf in frames:
            rows, found = _cells(tree.value, matrix(pdf["x"]), pdf["far"].to_numpy())
            yield pdf.iloc[rows].assign(c=found)

    def best(ask: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"key": [], "d": [], "point": [], "y": []})]
        if len(ask) and len(there):
            ids, held, far, keys = np.concatenate(there["ids"].to_numpy()), there["ids"].map(len).to_numpy(), ask["far"].to_numpy(), ask["key"].to_numpy()
            first, y = np.cumsum(held) - held, there["x"].to_numpy()
            for i, d in _gaps(matrix(ask["x"]), matrix(there["x"])):
                q, site = np.nonzero(d <= far[i : i + 256, None])
                gap, n = d[q, site], held[site]
                q, site, gap = np.repeat(q, n), np.repeat(site, n), np.repeat(gap, n)
                point = ids[first[site] + np.arange(len(site)) - np.repeat(np.cumsum(n) - n, n)]
                order = np.lexsort((point, gap, q))
                q, site, gap, point = q[order], site[order], gap[order], point[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                out.append(pd.DataFrame({"key": keys[i + q[keep]], "d": gap[keep], "point": point[keep], "y": y[site[keep]]}))
        return pd.concat(out)

    there = sites.withColumn("c", cell("x")).checkpoint()
    far = asked.withColumn("c", cell("x")).groupBy("c").cogroup(there.groupBy("c")).applyInPandas(bound, "key long, x array<double>, far double")
    routed = far.mapInPandas(reach, "key long, x array<double>, far double, c int").checkpoint()
    # a cell that many queries reach into is dealt over several tasks
    busy = routed.groupBy("c").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_parts"))
    sliced = routed.join(F.broadcast(busy), "c").withColumn("s", F.pmod(F.xxhash64("key"), F.col("_parts")).cast("int")).drop("_parts")
    spread = there.join(F.broadcast(busy), "c").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    found = sliced.groupBy("c", "s").cogroup(spread.groupBy("c", "s")).applyInPandas(best, "key long, d double, point long, y array<double>")
    near = found.groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "point", "y"))), 1, k).alias("near"))
    return asked.join(near, "key").select("x", "near")


class KNNImputer(Operator):
    """Mean of the k nearest training rows, by the distance over shared observed columns.

    The k are chosen before those without the value are left out; none left gives 0. Only rows with a gap are compared, in
    blocks: the work grows with gaps times training rows, memory with neither. row_id must be a distinct integer.
    """

    def __init__(self, features, row_id, n_neighbors=5):
        self.features, self.row_id, self.n_neighbors = features, row_id, n_neighbors

    def fit(self, df):
        self.train_ = df.select(F.col(self.row_id).cast("long").alias("id"), _numbers(self.features).alias("x"))
        return self

    def transform(self, df):
        self._check("train_")
        gap = F.greatest(*(F.col(f).isNull() for f in self.features), F.lit(False))
        asked = df.filter(gap).select(F.col(self.row_id).cast("long").alias("_key"), _numbers(self.features).alias("x"))
        near = nearest(asked, self.train_, "_key", len(self.features), self.n_neighbors).join(self.train_, F.col("point") == F.col("id"))
        near = near.groupBy("_key").agg(*(F.avg(F.col("x")[i]).alias(f"_{f}") for i, f in enumerate(self.features)))
        out = df.join(near, F.col(self.row_id).cast("long") == F.col("_key"), "left")
        return out.withColumns({f: F.coalesce(F.col(f).cast("double"), F.col(f"_{f}"), F.lit(0.0)) for f in self.features}).select(*df.columns)


class _Selector(Operator):
    def get_support(self) -> list[str]:
        self._check("support_")
        return self.support_

    def transform(self, df):
        gone = [f for f in self.features if f not in self.get_support()]
        return df.drop(*gone)


class VarianceThreshold(_Selector):
    def __init__(self, features, threshold=0.0):
        self.features, self.threshold = features, threshold

    def fit(self, df):
        self.variances_ = list(df.agg(*(F.var_pop(f) for f in self.features)).first())
        self.support_ = [f for f, v in zip(self.features, self.variances_, strict=True) if (v or 0.0) > self.threshold]
        return self


def f_classif(df: DataFrame, features: list[str], label: str) -> list[float]:
    """One-way ANOVA F of each feature; 1e-10 is added to the mean square within."""
    rows = df.groupBy(label).agg(F.count("*").alias("n"), *(a for f in features for a in (F.sum(f).alias(f"s_{f}"), F.var_pop(f).alias(f"v_{f}")))).collect()
    n = np.array([r["n"] for r in rows], float)
    out = []
    for f in features:
        s, v = (np.array([r[f"{c}_{f}"] for r in rows], float) for c in "sv")
        between = (n * (s / n - s.sum() / n.sum()) ** 2).sum() / (len(n) - 1)
        out.append(float(between / ((n * v).sum() / (n.sum() - len(n)) + 1e-10)))
    return out


def mutual_info_classif(df: DataFrame, features: list[str], label: str, n_bins: int = 10) -> list[float]:
    """Natural-log mutual information with equal-width bins, the last closed."""
    ends = df.agg(*(g(f) for f in features for g in (F.min, F.max))).first()
    out = []
    for i, f in enumerate(features):
        lo, hi = float(ends[2 * i]), float(ends[2 * i + 1])
        width = (hi - lo) / n_bins or 1.0
        rows = df.groupBy(F.least(F.lit(n_bins - 1), F.floor((F.col(f) - lo) / width)).alias("b"), label).count().collect()
        total = sum(r["count"] for r in rows)
        px, py = {}, {}
        for r in rows:
            px[r.b] = px.get(r.b, 0) + r["count"] / total
            py[r[label]] = py.get(r[label], 0) + r["count"] / total
        out.append(max(0.0, sum(p * math.log(p / (px[r.b] * py[r[label]] + 1e-12)) for r in rows for p in [r["count"] / total])))
    return out


class SelectKBest(_Selector):
    """The k features of highest score, in their own order; ties to the earlier one, k = 0 keeps none."""

    def __init__(self, features, label, score_func=f_classif, k=10):
        self.features, self.label, self.score_func, self.k = features, label, score_func, k

    def fit(self, df):
        self.scores_ = self.score_func(df, self.features, self.label)
        k = len(self.features) if self.k == "all" else self.k
        best = sorted(range(len(self.features)), key=lambda i: (-self.scores_[i], i))[:k]
        self.support_ = [f for i, f in enumerate(self.features) if i in best]
        return self


class RFE(_Selector):
    """Drops the least important features step by step; several rows of coefficients count by their mean size."""

    def __init__(self, estimator, n_features_to_select=0.5, step=1):
        self.estimator, self.n_features_to_select, self.step = estimator, n_features_to_select, step

    def fit(self, df):
        self.features = left = list(self.estimator.features)
        want = self.n_features_to_select
        want = max(1, int(want * len(left))) if isinstance(want, float) else want
        self.ranking_ = dict.fromkeys(left, 1)
        while True:
            self.estimator_ = self.estimator.clone().set_params(features=left).fit(df)
            if len(left) <= want:
                break
            w = getattr(self.estimator_, "feature_importances_", None)
            w = np.asarray(w) if w is not None else np.abs(np.atleast_2d(self.estimator_.coef_)).mean(axis=0)
            gone = [left[i] for i in np.argsort(w, kind="stable")[: min(self.step, len(left) - want)]]
            left = [f for f in left if f not in gone]
            self.ranking_ |= dict.fromkeys(gone, len(left) + 1)
        self.support_ = left
        return self


def _shares(df: DataFrame, label: str) -> dict:
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def _numbers(features: list[str]) -> Column:
    return F.array(*(F.col(f).cast("double") for f in features))


def _numbered(df: DataFrame, label: str, row_id: str, seed: int) -> DataFrame:
    """Place from 1 of each row in a random order of its class, fixed by row_id and seed; numbered range by range."""
    first = df.groupBy(label).agg(F.count("*").alias("_c")).orderBy(label).collect()
    before = dict(zip((r[0] for r in first), np.cumsum([0, *(r["_c"] for r in first)]).tolist()))
    told = df.sparkSession.createDataFrame(list(before.items()), df.select(F.col(label).alias("_l")).schema.add("_b", "long"))
    out = numbered(df, [label, F.xxhash64(row_id, F.lit(seed)), row_id], "_place")
    return out.join(F.broadcast(told), F.col(label).eqNullSafe(F.col("_l"))).withColumn("_place", F.col("_place") - F.col("_b") + 1).drop("_l", "_b")


class RandomUnderSampler(Operator):
    """As many rows of each class as the smallest has, without replacement."""

    def __init__(self, label, row_id, random_state=0):
        self.label, self.row_id, self.random_state = label, row_id, random_state

    def fit_resample(self, df):
        least = min(_shares(df, self.label).values())
        return _numbered(df, self.label, self.row_id, self.random_state).filter(F.col("_place") <= least).drop("_place")


class RandomOverSampler(Operator):
    """All rows, and draws with replacement until each class is as large as the largest."""

    def __init__(self, label, row_id, random_state=0):
        self.label, self.row_id, self.random_state = label, row_id, random_state

    def fit_resample(self, df):
        n = _shares(df, self.label)
        most, spark = max(n.values()), df.sparkSession
        out, rows = df, _numbered(df, self.label, self.row_id, self.random_state)
        for c, k in sorted(n.items(), key=str):
            if k < most:
                draws = spark.range(most - k).select(F.lit(c).alias("_c"), (F.pmod(F.xxhash64("id", F.lit(self.random_state)), F.lit(k)) + 1).cast("int").alias("_p"))
                out = out.unionByName(rows.join(draws, (rows[self.label] == draws["_c"]) & (rows["_place"] == draws["_p"])).select(*df.columns))
        return out


class SMOTE(Operator):
    """New minority rows on the line from a random row to one of its k nearest of the class (self excluded), by (distance, place).

    Neighbours are looked for in cells, for the rows drawn only; in a class with a missing or infinite feature block by block.
    """

    def __init__(self, features, label, row_id, k_neighbors=5, random_state=0):
        self.features, self.label, self.row_id, self.k_neighbors, self.random_state = features, label, row_id, k_neighbors, random_state

    def fit_resample(self, df):
        checkpoints(df.sparkSession)
        n = _shares(df, self.label)
        most, spark = max(n.values()), df.sparkSession
        out = df.select(*self.features, self.label)
        for c, size in sorted(n.items(), key=str):
            if size == most:
                continue
            if size < 2:
                raise ValueError(f"class {c!r} has one row, which has no neighbour")
            k = min(self.k_neighbors, size - 1)
            rows = _numbered(df.filter(F.col(self.label) == c), self.label, self.row_id, 0).select(F.col("_place").cast("long").alias("id"), _numbers(self.features).alias("x")).checkpoint()
            luck = lambda i: F.xxhash64("id", F.lit(self.random_state), F.lit(i))
            draws = spark.range(most - size).select((F.pmod(luck(1), F.lit(size)) + 1).alias("_key"), (F.pmod(luck(2), F.lit(k)) + 1).alias("rank"), (F.pmod(luck(3), F.lit(1 << 24)) / F.lit(float(1 << 24))).alias("u"))
            starts = draws.join(rows.select(F.col("id").alias("_key"), "x"), "_key")
            # one more than k, as a row is its own nearest, or ties with copies that are
            if rows.filter(F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))).isEmpty():
                near = nearest_in_cells(starts.select("x"), rows, len(self.features), k + 1)
                others = F.filter("near", lambda p: p["point"] != F.col("_key"))
                ends = starts.join(near, "x").select("x", "u", F.element_at(others, F.col("rank").cast("int"))["y"].alias("y"))
            else:
                near = nearest(starts.groupBy("_key").agg(F.first("x").alias("x")), rows, "_key", len(self.features), k + 1).filter("_key != point")
                near = near.withColumn("rank", F.row_number().over(Window.partitionBy("_key").orderBy("d", "point")))
                ends = starts.join(near, ["_key", "rank"]).join(rows.select(F.col("id").alias("point"), F.col("x").alias("y")), "point")
            new = ends.select(F.zip_with("x", "y", lambda a, b: a + F.col("u") * (b - a)).alias("z"))
            out = out.unionByName(new.select(*(F.col("z")[i].alias(f) for i, f in enumerate(self.features)), F.lit(c).alias(self.label)))
        return out


__all__ = [n for n, v in globals().items() if isinstance(v, type) and issubclass(v, Operator)] + ["f_classif", "mutual_info_classif", "gram"]

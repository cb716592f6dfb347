"""Splitters, search, calibration and statistical tests."""

from __future__ import annotations

import itertools
import math
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from . import metrics
from .base import Operator, numbered, r2, running


class _Folds:
    def get_n_splits(self, df=None) -> int:
        return self.n_splits

    def split(self, df):
        """(train, test) frames; the cached folds are released when the last pair has been taken."""
        df = self.assign(df).persist()
        try:
            for k in range(self.get_n_splits(df)):
                yield df.filter(F.col("fold") != k).drop("fold"), df.filter(F.col("fold") == k).drop("fold")
        finally:
            df.unpersist()

    def _order(self):
        return [F.xxhash64(self.row_id, F.lit(self.random_state or 0)), self.row_id] if self.shuffle else [self.row_id]


def _slice(place, n, k):
    """Number of the one of k contiguous slices of n rows that holds a place (from 0); the first n mod k slices are one larger."""
    small, large = F.floor(n / k), n % k
    edge = large * (small + 1)
    return F.when(place < edge, F.floor(place / (small + 1))).otherwise(large + F.floor((place - edge) / F.greatest(small, F.lit(1)))).cast("int")


class KFold(_Folds):
    """Adds `fold`: contiguous by row_id, the first n mod k folds one larger. Rows are numbered range by range, in many tasks."""

    def __init__(self, row_id, n_splits=5, shuffle=False, random_state=None):
        self.row_id, self.n_splits, self.shuffle, self.random_state = row_id, n_splits, shuffle, random_state

    def assign(self, df):
        n = df.count()
        return numbered(df, self._order(), "_place").withColumn("fold", _slice(F.col("_place"), F.lit(n), self.n_splits)).drop("_place")


class StratifiedKFold(KFold):
    """The same inside each class."""

    def __init__(self, row_id, label, n_splits=5, shuffle=False, random_state=None):
        super().__init__(row_id, n_splits, shuffle, random_state)
        self.label = label

    def assign(self, df):
        # numbered by (class, order): a row's place in its class is its place less the rows of the classes before
        counts = {r[0]: r[1] for r in df.groupBy(self.label).count().orderBy(self.label).collect()}
        before = dict(zip(counts, np.cumsum([0, *counts.values()]).tolist()))
        told = df.sparkSession.createDataFrame([(k, v, before[k]) for k, v in counts.items()], df.select(F.col(self.label).alias("_c")).schema.add("_n", "long").add("_b", "long"))
        out = numbered(df, [self.label, *self._order()], "_place").join(F.broadcast(told), F.col(self.label).eqNullSafe(F.col("_c")))
        return out.withColumn("fold", _slice(F.col("_place") - F.col("_b"), F.col("_n"), self.n_splits)).drop("_place", "_c", "_n", "_b")


class LeaveOneOut(_Folds):
    def __init__(self, row_id):
        self.row_id = row_id

    def get_n_splits(self, df):
        return df.count()

    def assign(self, df):
        return numbered(df, [self.row_id], "fold").withColumn("fold", F.col("fold").cast("int"))


def compute_score(model, df: DataFrame, scoring: str) -> float:
    label = model.label
    if scoring == "r2":
        return r2(model.predict(df), label, "prediction")
    if scoring == "neg_mse":
        return -metrics.mean_squared_error(model.predict(df), label, "prediction")
    if scoring == "f1":
        return metrics.f1_score(model.predict(df), label, "prediction")
    if scoring == "roc_auc":
        return metrics.roc_auc_score(model.predict_proba(df).withColumn("_p", F.element_at("probability", 2)), label, "_p")
    if scoring == "accuracy":
        return metrics.accuracy_score(model.predict(df), label, "prediction")
    return model.score(df)


def _splitter(estimator, cv, row_id):
    if not isinstance(cv, int):
        return cv
    return StratifiedKFold(row_id, estimator.label, cv) if estimator.kind == "classifier" else KFold(row_id, cv)


def cross_validate(estimator, df, row_id, cv=5, scoring=None, parallelism=4) -> DataFrame:
    """(fold, metric, score, fit_time, score_time); folds are jobs of several driver threads over one cached frame."""
    scoring = [scoring] if isinstance(scoring, str) else scoring or ["accuracy" if estimator.kind == "classifier" else "r2"]

    def one(k, train, test):
        t = time.time()
        model = estimator.clone().fit(train)
        u = time.time()
        return [(k, m, float(compute_score(model, test, m)), u - t, time.time() - u) for m in scoring]

    with ThreadPoolExecutor(parallelism) as pool:
        rows = [x for part in pool.map(lambda a: one(a[0], *a[1]), enumerate(_splitter(estimator, cv, row_id).split(df))) for x in part]
    return df.sparkSession.createDataFrame(rows, "fold int, metric string, score double, fit_time double, score_time double")


def cross_val_score(estimator, df, row_id, cv=5, scoring="accuracy") -> list[float]:
    return [r.score for r in cross_validate(estimator, df, row_id, cv, scoring).orderBy("fold").collect()]


class GridSearchCV(Operator):
    """Every combination in key order, over the same cached folds; the first best wins. step__param reaches into a pipeline."""

    def __init__(self, estimator, param_grid, row_id, cv=5, scoring=None, refit=True):
        self.estimator, self.param_grid, self.row_id, self.cv, self.scoring, self.refit = estimator, param_grid, row_id, cv, scoring, refit

    @property
    def label(self):
        return self.estimator.label

    @property
    def kind(self):
        return self.estimator.kind

    def fit(self, df):
        self.cv_results_ = []
        scoring = self.scoring or ("accuracy" if self.kind == "classifier" else "r2")
        grid = [dict(zip(self.param_grid, values, strict=True)) for values in itertools.product(*self.param_grid.values())]
        scores: list[list[float]] = [[] for _ in grid]
        for train, test in _splitter(self.estimator, self.cv, self.row_id).split(df):
            with ThreadPoolExecutor(4) as pool:
                told = list(pool.map(lambda p: float(compute_score(self.estimator.clone().set_params(**p).fit(train), test, scoring)), grid))  # noqa: B023
            for s, x in zip(scores, told, strict=True):
                s.append(x)
        self.cv_results_ = [{"params": p, "mean": float(np.mean(s)), "std": float(np.std(s))} for p, s in zip(grid, scores, strict=True)]
        best = max(self.cv_results_, key=lambda r: r["mean"])
        self.best_params_, self.best_score_ = best["params"], best["mean"]
        if self.refit:
            self.best_estimator_ = self.estimator.clone().set_params(**self.best_params_).fit(df)
        return self

    def predict(self, df):
        return self.best_estimator_.predict(df)

    def score(self, df):
        return compute_score(self.best_estimator_, df, self.scoring or ("accuracy" if self.kind == "classifier" else "r2"))


class PlattScaler(Operator):
    """p = 1/(1+exp(A s + B)) with smoothed targets; each Newton step is five sums."""

    def __init__(self, score="score", label="label", n_iter=100):
        self.score, self.label, self.n_iter = score, label, n_iter

    def fit(self, df):
        s, y = F.col(self.score), F.col(self.label)
        pos, neg = df.agg(F.sum(y.cast("double")), F.sum(1 - y.cast("double"))).first()
        data = df.groupBy(s.alias("s"), y.alias("y")).agg(F.count("*").cast("double").alias("n")).persist()
        t = F.when(F.col("y") == 1, (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2))
        a, b = 0.0, math.log((neg + 1) / (pos + 1))
        for _ in range(self.n_iter):
            p = 1 / (1 + F.exp(F.col("s") * a + b))
            w = F.col("n") * p * (1 - p)
            g1, g2, h11, h22, h12 = data.agg(F.sum(F.col("n") * F.col("s") * (t - p)), F.sum(F.col("n") * (t - p)), F.sum(w * F.col("s") ** 2), F.sum(w), F.sum(w * F.col("s"))).first()
            det = h11 * h22 - h12 * h12 + 1e-10
            da, db = (h22 * g1 - h12 * g2) / det, (h11 * g2 - h12 * g1) / det
            a, b = a - da, b - db
            if abs(da) + abs(db) < 1e-10:
                break
        data.unpersist()
        self.a_, self.b_ = a, b
        return self

    def predict_proba(self, df):
        self._check("a_")
        return df.withColumn("calibrated", 1 / (1 + F.exp(F.col(self.score) * self.a_ + self.b_)))


def _pooled(rows: list[list[float]]) -> list[list[float]]:
    """Pool-adjacent-violators over blocks (first score, last score, mean, weight) in order."""
    out: list[list[float]] = []
    for row in rows:
        out.append(list(row))
        while len(out) > 1 and out[-2][2] > out[-1][2]:
            _, hi, y, n = out.pop()
            a = out[-1]
            a[1], a[2], a[3] = hi, (a[2] * a[3] + y * n) / (a[3] + n), a[3] + n
    return out


class IsotonicCalibrator(Operator):
    """Pool-adjacent-violators over distinct scores, interpolated between them.

    Distinct scores are summed up and range-partitioned; each range pools its own violators, which any solution pools too,
    and the driver pools the blocks that are left: so many as the fitted function has steps in each range, not rows.
    """

    def __init__(self, score="score", label="label"):
        self.score, self.label = score, label

    def fit(self, df):
        by = df.groupBy(F.col(self.score).cast("double").alias("s")).agg(F.avg(F.col(self.label).cast("double")).alias("y"), F.count("*").alias("n"))

        def part(frames):
            rows: list[list[float]] = []
            for pdf in frames:
                rows = _pooled(rows + [[s, s, y, n] for s, y, n in zip(pdf["s"].tolist(), pdf["y"].tolist(), pdf["n"].tolist(), strict=True)])
            yield pd.DataFrame(rows, columns=["a", "b", "y", "n"])

        rows = by.repartitionByRange("s").sortWithinPartitions("s").mapInPandas(part, "a double, b double, y double, n double").collect()
        blocks = _pooled(sorted(list(r) for r in rows))
        ends = [(x, y) for a, b, y, _ in blocks for x in ((a, b) if a < b else (a,))]
        self.x_, self.y_ = [x for x, _ in ends], [y for _, y in ends]
        return self

    def predict_proba(self, df):
        self._check("x_")
        told = df.sparkSession.sparkContext.broadcast((np.array(self.x_), np.array(self.y_)))

        @F.pandas_udf("double")
        def at(s: pd.Series) -> pd.Series:
            return pd.Series(np.interp(s, *told.value))

        return df.withColumn("calibrated", at(F.col(self.score).cast("double")))


class CalibratedClassifier(Operator):
    """Out-of-fold scores train the calibrator; the base is refitted on all rows."""

    kind = "classifier"

    def __init__(self, base_estimator, row_id, method="platt", cv=5):
        self.base_estimator, self.row_id, self.method, self.cv = base_estimator, row_id, method, cv

    @property
    def label(self):
        return self.base_estimator.label

    def _scored(self, model, df):
        if hasattr(model, "decision_function"):
            return model.decision_function(df)
        return model.predict_proba(df).withColumn("score", F.element_at("probability", 2))

    def fit(self, df):
        parts = [self._scored(self.base_estimator.clone().fit(a), b).select("score", self.label) for a, b in StratifiedKFold(self.row_id, self.label, self.cv).split(df)]
        pooled = parts[0]
        for p in parts[1:]:
            pooled = pooled.union(p)
        self.calibrator_ = (PlattScaler if self.method == "platt" else IsotonicCalibrator)("score", self.label).fit(pooled)
        self.base_ = self.base_estimator.clone().fit(df)
        return self

    def predict_proba(self, df):
        return self.calibrator_.predict_proba(self._scored(self.base_, df)).withColumn("probability", F.array(1 - F.col("calibrated"), F.col("calibrated")))

    def predict(self, df):
        return self.predict_proba(df).withColumn("prediction", (F.col("calibrated") >= 0.5).cast("int"))


def calibration_curve(df, true, prob, n_bins=10, closed_last=False) -> DataFrame:
    """(bin, mean_true, mean_prob, n) over equal half-open bins; 1.0 is in none unless closed_last."""
    p = F.col(prob)
    b = F.floor(p * n_bins)
    b = F.least(F.lit(n_bins - 1), b) if closed_last else b
    return df.withColumn("bin", b).filter((F.col("bin") >= 0) & (F.col("bin") < n_bins)).groupBy("bin").agg(F.avg(F.col(true).cast("double")).alias("mean_true"), F.avg(p).alias("mean_prob"), F.count("*").alias("n"))


def expected_calibration_error(df, true, prob, n_bins=10, closed_last=False) -> float:
    n = df.count()
    c = calibration_curve(df, true, prob, n_bins, closed_last)
    return c.agg(F.sum(F.col("n") / n * F.abs(F.col("mean_true") - F.col("mean_prob")))).first()[0] or 0.0


def _told(stat: float, p: float, alpha: float) -> dict:
    return {"statistic": stat, "p_value": p, "significant": p < alpha}


def paired_ttest(df, a, b, alpha=0.05) -> dict:
    n, mean, sd = df.select((F.col(a) - F.col(b)).alias("d")).agg(F.count("d"), F.avg("d"), F.stddev_samp("d")).first()
    t = mean / (sd / math.sqrt(n) + 1e-15)
    return _told(t, special.t_two_sided(t, n - 1), alpha) | {"mean_difference": mean}


def fivex2cv_ttest(est_a, est_b, df, row_id, alpha=0.05, random_state=0) -> dict:
    """Five repetitions of two folds, paired within a repetition."""
    first, spread = None, 0.0
    for i in range(5):
        cv = StratifiedKFold(row_id, est_a.label, 2, True, random_state + i)
        d = [x - y for x, y in zip(cross_val_score(est_a, df, row_id, cv), cross_val_score(est_b, df, row_id, cv), strict=True)]
        first = d[0] if first is None else first
        m = sum(d) / 2
        spread += sum((x - m) ** 2 for x in d)
    t = first / (math.sqrt(spread / 5) + 1e-15)
    return _told(t, special.t_two_sided(t, 5), alpha)


def _ranks(df, keys, value):
    """Average ranks by value inside keys."""
    same = Window.partitionBy(*keys, value)
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(same) - 1) / 2)


def wilcoxon_test(df, a, b, alpha=0.05) -> dict:
    """Signed ranks, zero differences left out; exact for up to 50 pairs without ties, else the normal approximation.

    Differences are counted per size first; the sizes are then numbered range by range, so no task holds them all.
    """
    d = df.select((F.col(a) - F.col(b)).alias("d")).filter("d != 0")
    by = d.groupBy(F.abs("d").alias("m")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("ups"))
    rank = F.col("before") + (F.col("c") + 1) / 2
    n, distinct, up, down = running(by, ["m"], {"before": F.col("c")}).agg(F.sum("c"), F.count("*"), F.sum(rank * F.col("ups")), F.sum(rank * (F.col("c") - F.col("ups")))).first()
    if not n:
        return _told(0.0, 1.0, alpha)
    stat = min(up, down)
    if n <= 50 and n == distinct:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for k in range(1, n + 1):
            for s in range(len(ways) - 1, k - 1, -1):
                ways[s] += ways[s - k]
        return _told(stat, min(1.0, 2 * sum(ways[: int(stat) + 1]) / 2**n), alpha)
    ties = by.agg(F.sum(F.pow("c", F.lit(3)) - F.col("c"))).first()[0]
    z = (stat - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return _told(stat, special.normal_two_sided(z), alpha)


def mcnemar_test(df, true, pred_a, pred_b, alpha=0.05) -> dict:
    ok = lambda p: F.col(p) == F.col(true)
    b, c = df.agg(F.sum((ok(pred_a) & ~ok(pred_b)).cast("long")), F.sum((~ok(pred_a) & ok(pred_b)).cast("long"))).first()
    stat = (abs(b - c) - 1) ** 2 / (b + c + 1e-10) if b + c else 0.0
    return _told(stat, math.erfc(math.sqrt(stat / 2)), alpha) | {"b": b, "c": c}


def friedman_test(df, columns, row_id, alpha=0.05) -> dict:
    """Average ranks of the scores in each row, the highest first; no correction for ties."""
    long = df.select(row_id, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (-F.col(c)).alias("v")) for i, c in enumerate(columns)))).alias("x")).select(row_id, "x.*")
    rows = _ranks(long, [row_id], "v").groupBy("i").agg(F.avg("rank").alias("r"), F.count("*").alias("n")).collect()
    k, n = len(columns), rows[0].n
    stat = 12 * n / (k * (k + 1)) * sum((r.r - (k + 1) / 2) ** 2 for r in rows)
    return _told(stat, special.chi2_tail(stat, k - 1), alpha) | {"mean_ranks": [r.r for r in sorted(rows, key=lambda r: r.i)]}

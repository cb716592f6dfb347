"""Linear models. The least-squares family needs a single pass: everything follows from the matrix of sums of products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from .base import Classifier, Regressor, check_X_y, classes_of, gram


class _Linear(Regressor):
    def _sums(self, df: DataFrame) -> tuple[int, np.ndarray, np.ndarray, float]:
        """n, G of [1, X] (of X without an intercept), c = [1, X]'y, y'y."""
        n, g = gram(check_X_y(df, self.features, self.label), [*self.features, self.label])
        lo = 0 if self.fit_intercept else 1
        return n, g[lo:-1, lo:-1], g[lo:-1, -1], g[-1, -1]

    def _set(self, theta: np.ndarray):
        self.intercept_, self.coef_ = (float(theta[0]), theta[1:]) if self.fit_intercept else (0.0, theta)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        self._check("coef_")
        return df.withColumn("prediction", expr.linear(self.features, self.coef_, self.intercept_))


class LinearRegression(_Linear):
    """Least squares by the normal equations (minimum norm if rank deficient) or by full-batch gradient descent from zero.

    The descent runs on the sums of products, so its number of steps costs no further pass; losses_ holds each step's MSE.
    """

    def __init__(self, features, label, method="normal", lr=1e-3, n_iter=1000, fit_intercept=True):
        self.features, self.label, self.method, self.lr, self.n_iter, self.fit_intercept = features, label, method, lr, n_iter, fit_intercept

    def fit(self, df):
        n, g, c, yy = self._sums(df)
        self.losses_ = []
        if self.method == "normal":
            return self._set(np.linalg.lstsq(g, c, rcond=None)[0])
        theta = np.zeros(len(c))
        for _ in range(self.n_iter):
            self.losses_.append(float((theta @ g @ theta - 2 * c @ theta + yy) / n))
            theta = theta - self.lr * (g @ theta - c) / n
        return self._set(theta)


class RidgeRegression(_Linear):
    """The intercept is not penalised and alpha is not divided by the number of rows."""

    def __init__(self, features, label, alpha=1.0, fit_intercept=True):
        self.features, self.label, self.alpha, self.fit_intercept = features, label, alpha, fit_intercept

    def fit(self, df):
        _, g, c, _ = self._sums(df)
        penalty = self.alpha * np.eye(len(c))
        if self.fit_intercept:
            penalty[0, 0] = 0
        return self._set(np.linalg.solve(g + penalty, c))


class ElasticNet(_Linear):
    """Cyclic coordinate descent on the sums of products. Only y is centred; a constant zero column keeps coefficient 0."""

    def __init__(self, features, label, alpha=1.0, l1_ratio=0.5, n_iter=1000, tol=1e-4, fit_intercept=True):
        self.features, self.label, self.alpha, self.l1_ratio, self.n_iter, self.tol, self.fit_intercept = features, label, alpha, l1_ratio, n_iter, tol, fit_intercept

    def fit(self, df):
        n, g = gram(check_X_y(df, self.features, self.label), [*self.features, self.label])
        mean = g[0, -1] / n if self.fit_intercept else 0.0
        c, q = (g[1:-1, -1] - mean * g[1:-1, 0]) / n, g[1:-1, 1:-1] / n
        l1, l2, w = self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio), np.zeros(len(c))
        for self.n_iter_ in range(1, self.n_iter + 1):
            moved = 0.0
            for j in range(len(w)):
                if q[j, j] + l2 == 0:
                    continue
                z = c[j] - q[j] @ w + q[j, j] * w[j]
                new = np.sign(z) * max(abs(z) - l1, 0.0) / (q[j, j] + l2)
                moved, w[j] = max(moved, abs(new - w[j])), new
            if moved < self.tol:
                break
        self.intercept_, self.coef_ = float(mean), w
        return self


class LassoRegression(ElasticNet):
    def __init__(self, features, label, alpha=1.0, n_iter=1000, tol=1e-4, fit_intercept=True):
        self.features, self.label, self.alpha, self.n_iter, self.tol, self.fit_intercept = features, label, alpha, n_iter, tol, fit_intercept
        self.l1_ratio = 1.0


class LogisticRegression(Classifier):
    """Full-batch gradient descent from zero; one aggregate over all classes a step.

    `ovr`: sigmoid problems (one for two classes), gradients clipped at norm 5. `softmax`: one joint problem. The penalty w/C
    covers the bias and is not divided by the number of rows. Several one-against-rest scores give a softmax probability.
    """

    def __init__(self, features, label, C=1.0, multi_class="ovr", lr=0.1, n_iter=1000, tol=1e-4, fit_intercept=True):
        self.features, self.label, self.C, self.multi_class, self.lr, self.n_iter, self.tol, self.fit_intercept = features, label, C, multi_class, lr, n_iter, tol, fit_intercept

    def fit(self, df):
        df = check_X_y(df, self.features, self.label)
        self.classes_ = classes_of(df, self.label)
        k, bias = len(self.classes_), self.fit_intercept
        joint = self.multi_class == "softmax" and k > 2
        targets = self.classes_ if k > 2 else self.classes_[1:]
        data = df.select(*self.features, F.col(self.label).alias("_y")).persist()
        n, p = data.count(), len(self.features) + bias
        w, live = np.zeros((len(targets), p)), np.ones(len(targets), bool)

        def part(frames):
            total = np.zeros((len(targets), p))
            for pdf in frames:
                x = pdf[self.features].to_numpy(float)
                x = np.column_stack([np.ones(len(x)), x]) if bias else x
                z = x @ w.T
                hot = np.column_stack([(pdf["_y"] == t).to_numpy(float) for t in targets])
                if joint:
                    e = np.exp(z - z.max(axis=1, keepdims=True))
                    q = e / e.sum(axis=1, keepdims=True)
                else:
                    q = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
                total += (q - hot).T @ x
            yield pd.DataFrame({"g": [total.ravel()]})

        for self.n_iter_ in range(1, self.n_iter + 1):
            parts = data.mapInPandas(part, "g array<double>").select(F.posexplode("g").alias("i", "g")).groupBy("i").agg(F.sum("g").alias("g")).collect()
            grad = np.zeros(w.size)
            for r in parts:
                grad[r.i] = r.g
            grad = grad.reshape(w.shape) / n + w / self.C
            if not joint:
                grad = np.array([expr.clip_gradients(g) for g in grad])
            w = w - self.lr * grad * live[:, None]
            norms = np.linalg.norm(grad, axis=1)
            live &= (np.full(len(norms), np.linalg.norm(grad)) if joint else norms) >= self.tol
            if not live.any():
                break
        data.unpersist()
        self.intercept_, self.coef_ = (w[:, 0], w[:, 1:]) if bias else (np.zeros(len(w)), w)
        return self

    def decision_function(self, df):
        """One score for two classes, else an array with one for each."""
        self._check("coef_")
        z = [expr.linear(self.features, w, b) for w, b in zip(self.coef_, self.intercept_, strict=True)]
        return df.withColumn("score", z[0] if len(z) == 1 else F.array(*z))

    def predict_proba(self, df):
        """probability: an array in the order of classes_."""
        out, s = self.decision_function(df), F.col("score")
        p = F.array(1 - expr.sigmoid(s), expr.sigmoid(s)) if len(self.coef_) == 1 else expr.softmax(s)
        return out.withColumn("probability", p)

    def predict(self, df):
        """The likeliest class, the lowest on ties."""
        p = F.col("probability")
        place = F.array_position(p, F.array_max(p))
        return self.predict_proba(df).withColumn("prediction", F.element_at(F.array(*map(F.lit, self.classes_)), place.cast("int")))


class EarlyStopping:
    """Called with a score; True once `patience` calls in a row have not improved on the best by min_delta."""

    def __init__(self, patience=10, min_delta=1e-4, mode="min"):
        self.patience, self.min_delta, self.sign, self.best, self.misses = patience, min_delta, 1 if mode == "min" else -1, None, 0

    def __call__(self, score: float) -> bool:
        if self.best is None or self.sign * score < self.sign * self.best - self.min_delta:
            self.best, self.misses = score, 0
        else:
            self.misses += 1
        return self.misses >= self.patience

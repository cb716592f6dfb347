"""Naive Bayes: one grouped aggregate to fit, an expression over the classes to score."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from .base import Classifier


class _Bayes(Classifier):
    def _joint(self) -> list[Column]:
        raise NotImplementedError

    def _counts(self, df: DataFrame, *aggs: Column) -> list:
        rows = df.filter(F.col(self.label).isNotNull()).groupBy(self.label).agg(F.count("*").alias("_n"), *aggs).orderBy(self.label).collect()
        self.classes_ = [r[0] for r in rows]
        n = np.array([r["_n"] for r in rows], float)
        self.class_count_, self.class_log_prior_ = n, np.log(n / n.sum())
        return rows

    def predict_log_proba(self, df: DataFrame) -> DataFrame:
        """log_proba: joint log-likelihood of each class (normalised for Gaussian)."""
        self._check("class_log_prior_")
        return df.withColumn("log_proba", F.array(*self._joint()))

    def predict(self, df: DataFrame) -> DataFrame:
        p = F.col("log_proba")
        place = F.array_position(p, F.array_max(p)).cast("int")
        return self.predict_log_proba(df).withColumn("prediction", F.element_at(F.array(*map(F.lit, self.classes_)), place))


class GaussianNB(_Bayes):
    """Population variance plus an absolute smoothing. partial_fit merges counts and moments of further batches."""

    def __init__(self, features, label, var_smoothing=1e-9):
        self.features, self.label, self.var_smoothing = features, label, var_smoothing

    def _moments(self, df):
        rows = self._counts(df, *(a for f in self.features for a in (F.avg(f).alias(f"m_{f}"), F.var_pop(f).alias(f"v_{f}"))))
        return {r[0]: (r["_n"], np.array([r[f"m_{f}"] for f in self.features]), np.array([r[f"v_{f}"] for f in self.features])) for r in rows}

    def _set(self):
        self.classes_ = sorted(self.moments_)
        n = np.array([self.moments_[c][0] for c in self.classes_], float)
        self.class_count_, self.class_log_prior_ = n, np.log(n / n.sum())
        self.theta_ = np.array([self.moments_[c][1] for c in self.classes_])
        self.var_ = np.array([self.moments_[c][2] for c in self.classes_]) + self.var_smoothing
        return self

    def fit(self, df):
        self.moments_ = self._moments(df)
        return self._set()

    def partial_fit(self, df):
        old = getattr(self, "moments_", {})
        for c, (n, m, v) in self._moments(df).items():
            if c in old:
                n0, m0, v0 = old[c]
                both, d = n0 + n, m - m0
                old[c] = (both, m0 + d * n / both, (n0 * v0 + n * v) / both + d * d * n0 * n / both**2)
            else:
                old[c] = (n, m, v)
        self.moments_ = old
        return self._set()

    def _joint(self):
        return [F.lit(float(p - 0.5 * np.log(2 * np.pi * v).sum())) - expr.total([(F.col(f) - float(a)) ** 2 / float(2 * b) for f, a, b in zip(self.features, m, v, strict=True)]) for p, m, v in zip(self.class_log_prior_, self.theta_, self.var_, strict=True)]

    def predict_log_proba(self, df):
        return super().predict_log_proba(df).withColumn("log_proba", expr.log_softmax(F.col("log_proba")))

    def predict_proba(self, df):
        return self.predict_log_proba(df).withColumn("probability", F.transform("log_proba", F.exp))


class MultinomialNB(_Bayes):
    def __init__(self, features, label, alpha=1.0):
        self.features, self.label, self.alpha = features, label, alpha

    def fit(self, df):
        rows = self._counts(df, *(F.sum(f).alias(f"s_{f}") for f in self.features))
        c = np.array([[r[f"s_{f}"] for f in self.features] for r in rows], float) + self.alpha
        self.feature_log_prob_ = np.log(c / c.sum(axis=1, keepdims=True))
        return self

    def _joint(self):
        return [expr.linear(self.features, w, p) for w, p in zip(self.feature_log_prob_, self.class_log_prior_, strict=True)]


class BernoulliNB(_Bayes):
    def __init__(self, features, label, alpha=1.0, binarize=0.0):
        self.features, self.label, self.alpha, self.binarize = features, label, alpha, binarize

    def _bit(self, f: str) -> Column:
        return F.col(f).cast("double") if self.binarize is None else (F.col(f) > self.binarize).cast("double")

    def fit(self, df):
        rows = self._counts(df, *(F.sum(self._bit(f)).alias(f"s_{f}") for f in self.features))
        c = np.array([[r[f"s_{f}"] for f in self.features] for r in rows], float)
        self.feature_prob_ = (c + self.alpha) / (self.class_count_[:, None] + 2 * self.alpha)
        return self

    def _joint(self):
        return [expr.total([F.lit(float(p)), *(self._bit(f) * float(np.log(q)) + (1 - self._bit(f)) * float(np.log(1 - q)) for f, q in zip(self.features, row, strict=True))]) for row, p in zip(self.feature_prob_, self.class_log_prior_, strict=True)]

"""Metrics as aggregates. Each takes a frame and column names; curves and tables are frames again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import running

#: Labels of a confusion matrix, which has a cell for each pair.
MOST_LABELS = 2000


def _one(df: DataFrame, c: Column) -> float:
    return df.agg(c).first()[0]


def accuracy_score(df, true, pred) -> float:
    return _one(df, F.avg((F.col(true) == F.col(pred)).cast("double")))


def confusion_matrix(df, true, pred) -> DataFrame:
    """(true, pred, n) for every pair of labels, zeros included."""
    n = df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    labels = n.select(F.col("true").alias("label")).union(n.select("pred")).filter("label is not null").distinct()
    if (k := labels.count()) > MOST_LABELS:
        raise ValueError(f"{k} labels make {k * k} cells; count the pairs that occur instead")
    grid = labels.select(F.col("label").alias("true")).crossJoin(F.broadcast(labels.select(F.col("label").alias("pred"))))
    return grid.join(n, ["true", "pred"], "left").select("true", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_scores(df, true, pred, zero_division=0.0) -> DataFrame:
    """(label, precision, recall, f1, support)."""
    m = confusion_matrix(df, true, pred)
    tp = F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0))
    by_true = m.groupBy(F.col("true").alias("label")).agg(tp.alias("tp"), F.sum("n").alias("support"))
    by_pred = m.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("told"))
    rate = lambda of: F.when(F.col(of) == 0, F.lit(float(zero_division))).otherwise(F.col("tp") / (F.col(of) + 1e-15))
    out = by_true.join(by_pred, "label").withColumns({"precision": rate("told"), "recall": rate("support")})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", 2 * p * r / (p + r + 1e-15)).select("label", "precision", "recall", "f1", "support")


def _averaged(df, true, pred, which, average, zero_division):
    if average == "micro":
        return accuracy_score(df, true, pred)
    rows = class_scores(df, true, pred, zero_division).orderBy("label").collect()
    if average is None or average == "none":
        return [r[which] for r in rows]
    if average == "macro":
        return sum(r[which] for r in rows) / len(rows)
    if average == "weighted":
        return sum(r[which] * r.support for r in rows) / sum(r.support for r in rows)
    return rows[-1][which]  # binary: the largest label


def precision_score(df, true, pred, average="binary", zero_division=0.0):
    return _averaged(df, true, pred, "precision", average, zero_division)


def recall_score(df, true, pred, average="binary", zero_division=0.0):
    return _averaged(df, true, pred, "recall", average, zero_division)


def f1_score(df, true, pred, average="binary", zero_division=0.0):
    return _averaged(df, true, pred, "f1", average, zero_division)


def classification_report(df, true, pred, text=False) -> DataFrame | str:
    out = class_scores(df, true, pred)
    if not text:
        return out
    lines = [f"{'':>12} {'precision':>10} {'recall':>10} {'f1':>10} {'support':>9}"]
    lines += [f"{r.label!s:>12} {r.precision:>10.3f} {r.recall:>10.3f} {r.f1:>10.3f} {r.support:>9}" for r in out.orderBy("label").collect()]
    return "\n".join([*lines, f"{'accuracy':>12} {accuracy_score(df, true, pred):>10.3f}"])


def _cumulative(df, true, score) -> DataFrame:
    """(score, p, n, tp, fp, pos, neg) after each distinct score, from the highest down. Tied rows count together, so sums run over distinct scores only, range by range."""
    y = F.col(true).cast("double")
    by = df.groupBy(F.col(score).alias("score")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n"))
    by = running(by, [-F.col("score").cast("double")], {"tp": F.col("p"), "fp": F.col("n")})
    pos, neg = by.agg(F.sum("p"), F.sum("n")).first()
    return by.select("score", "p", "n", (F.col("tp") + F.col("p")).alias("tp"), (F.col("fp") + F.col("n")).alias("fp"), F.lit(pos).alias("pos"), F.lit(neg).alias("neg"))


def roc_curve(df, true, score) -> DataFrame:
    """(fpr, tpr, threshold), opened by (0, 0) at the largest score plus 1."""
    c = _cumulative(df, true, score)
    first = c.agg(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), (F.max("score") + 1).cast("double").alias("threshold"))
    return first.union(c.select(F.col("fp") / F.col("neg"), F.col("tp") / F.col("pos"), F.col("score").cast("double")))


def roc_auc_score(df, true, score) -> float:
    """Trapezoids between distinct scores, which ties cannot reorder."""
    area = F.sum(F.col("n") * (2 * F.col("tp") - F.col("p")) / 2)
    return _one(_cumulative(df, true, score), area / F.max(F.col("pos") * F.col("neg")))


def precision_recall_curve(df, true, score) -> DataFrame:
    """(precision, recall, threshold) by falling threshold, closed by (1, 0)."""
    c = _cumulative(df, true, score)
    last = c.agg(F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(None).cast("double").alias("threshold"))
    return c.select((F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("pos")).alias("recall"), F.col("score").cast("double").alias("threshold")).union(last)


def log_loss(df, true, prob, eps=1e-15) -> float:
    """prob: the probability of 1, or an array over the labels 0..K-1."""
    p = F.element_at(prob, F.col(true).cast("int") + 1) if dict(df.dtypes)[prob].startswith("array") else F.when(F.col(true) == 1, F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(prob)))).otherwise(1 - F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(prob))))
    return _one(df, F.avg(-F.log(F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p)))))


def matthews_corrcoef(df, true, pred) -> float:
    n = lambda t, p: F.sum(((F.col(true) == t) & (F.col(pred) == p)).cast("double"))
    tp, tn, fp, fn = n(1, 1), n(0, 0), n(0, 1), n(1, 0)
    return _one(df, (tp * tn - fp * fn) / (F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) + 1e-15))


def mean_squared_error(df, true, pred, squared=True) -> float:
    v = F.avg((F.col(true) - F.col(pred)) ** 2)
    return _one(df, v if squared else F.sqrt(v))


def root_mean_squared_error(df, true, pred) -> float:
    return mean_squared_error(df, true, pred, squared=False)


def mean_absolute_error(df, true, pred) -> float:
    return _one(df, F.avg(F.abs(F.col(true) - F.col(pred))))


def r2_score(df, true, pred) -> float:
    res = F.sum((F.col(true) - F.col(pred)) ** 2)
    return _one(df, 1 - res / (F.var_pop(true) * F.count(true) + 1e-15))


def mean_absolute_percentage_error(df, true, pred, eps=1e-8) -> float:
    return _one(df, F.avg(F.abs(F.col(true) - F.col(pred)) / (F.abs(F.col(true)) + eps)))


def median_absolute_error(df, true, pred) -> float:
    return _one(df, F.median(F.abs(F.col(true) - F.col(pred))))


def huber_loss(df, true, pred, delta=1.0) -> float:
    e = F.abs(F.col(true) - F.col(pred))
    return _one(df, F.avg(F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))))


def explained_variance_score(df, true, pred) -> float:
    return _one(df, 1 - F.var_pop(F.col(true) - F.col(pred)) / (F.var_pop(true) + 1e-15))


def max_error(df, true, pred) -> float:
    return _one(df, F.max(F.abs(F.col(true) - F.col(pred))))


def mean_squared_log_error(df, true, pred) -> float:
    low, v = df.agg(F.min(F.least(true, pred)), F.avg((F.log1p(true) - F.log1p(pred)) ** 2)).first()
    if low < 0:
        raise ValueError("values must not be negative")
    return v

"""What all estimators and transformers share."""

from __future__ import annotations

import copy
import inspect

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import checkpoints


def running(df: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """Adds, under each name, the sum of its column over the rows before in the order given (ascending; rows that tie are in any order).

    Rows are range-partitioned and written with their range; sums per range, a row each on the driver, give the offsets, so
    no task holds all rows. The number of ranges follows spark.sql.shuffle.partitions.
    """
    checkpoints(df.sparkSession)
    names, terms = [f"_o{i}" for i in range(len(order))], [f"_t{i}" for i in range(len(sums))]
    ranged = df.withColumns({n: c if isinstance(c, Column) else F.col(c) for n, c in [*zip(names, order, strict=True), *zip(terms, sums.values(), strict=True)]})
    ranged = ranged.repartitionByRange(*names).withColumn("_range", F.spark_partition_id()).checkpoint()
    rows = sorted(ranged.groupBy("_range").agg(*(F.sum(t).alias(t) for t in terms)).collect(), key=lambda r: r["_range"])
    line = Window.partitionBy("_range").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    for out, t in zip(sums, terms, strict=True):
        upto, start = 0, []
        for r in rows:
            start += [F.lit(r["_range"]), F.lit(upto)]
            upto += r[t] or 0
        here = F.coalesce(F.sum(t).over(line), F.lit(0))
        ranged = ranged.withColumn(out, here + F.create_map(*start)[F.col("_range")] if start else here)
    return ranged.drop("_range", *names, *terms)


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """Adds each row's place from 0 in the order given."""
    return running(df, order, {out: F.lit(1)})


class Operator:
    """Parameters are the constructor's arguments and are kept under their names; fitted state ends in an underscore."""

    kind = "transformer"

    @classmethod
    def _names(cls) -> list[str]:
        return [n for n in inspect.signature(cls.__init__).parameters if n != "self"]

    def get_params(self) -> dict:
        return {n: getattr(self, n) for n in self._names()}

    def set_params(self, **params):
        for k, v in params.items():
            if k not in self._names():
                raise ValueError(f"{type(self).__name__} has no parameter {k!r}")
            setattr(self, k, v)
        return self

    def clone(self):
        return type(self)(**copy.deepcopy(self.get_params()))

    def _check(self, attribute: str) -> None:
        check_is_fitted(self, attribute)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class Classifier(Operator):
    kind = "classifier"

    def score(self, df: DataFrame) -> float:
        """Accuracy."""
        return self.predict(df).agg(F.avg((F.col("prediction") == F.col(self.label)).cast("double"))).first()[0]


class Regressor(Operator):
    kind = "regressor"

    def score(self, df: DataFrame) -> float:
        """R squared."""
        return r2(self.predict(df), self.label, "prediction")


def r2(df: DataFrame, true: str, pred: str) -> float:
    mean = df.agg(F.avg(true)).first()[0]
    res, tot = df.agg(F.sum((F.col(true) - F.col(pred)) ** 2), F.sum((F.col(true) - mean) ** 2)).first()
    return 1 - res / (tot + 1e-15)


def add_bias(df: DataFrame, features: list[str], name: str = "bias") -> tuple[DataFrame, list[str]]:
    """df with a column of ones, and the features with it in front."""
    return df.withColumn(name, F.lit(1.0)), [name, *features]


def classes_of(df: DataFrame, label: str) -> list:
    """Sorted distinct labels."""
    return [r[0] for r in df.select(label).filter(F.col(label).isNotNull()).distinct().orderBy(label).collect()]


def check_array(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles; a missing or non-numeric column is an error."""
    kinds = dict(df.dtypes)
    for f in features:
        if f not in kinds:
            raise ValueError(f"no column {f!r}")
        if kinds[f] in ("string", "binary") or kinds[f].startswith(("array", "map", "struct")):
            raise ValueError(f"column {f!r} is {kinds[f]}")
    return df.withColumns({f: F.col(f).cast("double") for f in features})


def check_X_y(df: DataFrame, features: list[str], label: str) -> DataFrame:
    if label not in df.columns:
        raise ValueError(f"no column {label!r}")
    return check_array(df, features)


def check_is_fitted(op: object, attribute: str) -> None:
    if getattr(op, attribute, None) is None:
        raise RuntimeError(f"{type(op).__name__} is not fitted")


check_classification_targets = classes_of


def validate_sample_weights(df: DataFrame, weight: str) -> DataFrame:
    """Weights rescaled to sum to the number of rows; negative or all-zero ones are an error."""
    n, low, s = df.agg(F.count("*"), F.min(weight), F.sum(weight)).first()
    if low is None or low < 0 or not s:
        raise ValueError("weights must be non-negative and not all zero")
    return df.withColumn(weight, F.col(weight) * F.lit(n / s))


def gram(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray]:
    """Row count and the matrix of sums of products of [1, cols]: one pass, partial sums on the executors.

    Few columns are summed in generated code; more are multiplied in Arrow batches, whose partial matrices are then summed.
    """
    p = len(cols) + 1
    at = [(i, j) for i in range(p) for j in range(i, p)]
    v = [F.lit(1.0), *(F.col(c).cast("double") for c in cols)]
    out = np.zeros((p, p))
    if p <= 24:
        row = df.agg(*(F.sum(v[i] * v[j]).alias(f"s{k}") for k, (i, j) in enumerate(at))).first()
        for k, (i, j) in enumerate(at):
            out[i, j] = out[j, i] = row[k] or 0.0
        return int(out[0, 0]), out

    def part(frames):
        import pandas as pd

        g = np.zeros((p, p))
        for pdf in frames:
            x = np.column_stack([np.ones(len(pdf)), pdf.to_numpy(float)])
            g += x.T @ x
        yield pd.DataFrame({"i": np.arange(p), "g": list(g)})

    rows = df.select(*v[1:]).mapInPandas(part, "i int, g array<double>").select("i", F.posexplode("g").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    for r in rows.collect():
        out[r.i, r.j] = r.x
    return int(out[0, 0]), out

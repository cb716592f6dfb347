"""The data behind charts; drawing is left to whoever has a plotting library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import confusion_matrix, roc_curve
from .selection import cross_val_score

confusion_matrix_data, roc_curve_data = confusion_matrix, roc_curve


def decision_boundary_data(model, df: DataFrame, x: str, y: str, steps: int = 100, pad: float = 0.5) -> DataFrame:
    """A steps x steps mesh over two features with the model's prediction."""
    a, b, c, d = df.agg(F.min(x) - pad, F.max(x) + pad, F.min(y) - pad, F.max(y) + pad).first()
    i = F.col("id")
    grid = df.sparkSession.range(steps * steps).select((F.lit(a) + (i % steps) * ((b - a) / (steps - 1))).alias(x), (F.lit(c) + F.floor(i / steps) * ((d - c) / (steps - 1))).alias(y))
    return model.predict(grid)


def learning_curve_data(model, df: DataFrame, row_id: str, shares=(0.1, 0.3, 0.5, 0.75, 1.0), cv=3, scoring="accuracy") -> DataFrame:
    """(share, score): cross-validated on growing shares of the rows, by a hash of row_id."""
    luck = F.pmod(F.xxhash64(row_id), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = [(float(s), float(v)) for s in shares for v in cross_val_score(model, df.filter(luck < s), row_id, cv, scoring)]
    return df.sparkSession.createDataFrame(rows, "share double, score double")

import numpy as np
import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def _frame(spark, x, y, kind):
    cols = ", ".join(f"x{i} double" for i in range(x.shape[1]))
    return spark.createDataFrame([(i, *map(float, r), kind(v)) for i, (r, v) in enumerate(zip(x, y))], f"row_id long, {cols}, label {'int' if kind is int else 'double'}")


@pytest.fixture(scope="session")
def binary(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 200)
    x = rng.standard_normal((200, 4)) + np.outer(y, [2.0, 1.5, 0, 0])
    return _frame(spark, x, y, int).cache()


@pytest.fixture(scope="session")
def blobs(spark):
    rng = np.random.default_rng(2)
    y = np.arange(150) % 3
    x = rng.standard_normal((150, 2)) * 0.5 + np.array([[0, 0], [6, 0], [0, 6]])[y]
    return _frame(spark, x, y, int).cache()


@pytest.fixture(scope="session")
def regression(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 4))
    return _frame(spark, x, x @ [1.0, -2.0, 0.5, 0.0] + 3 + 0.1 * rng.standard_normal(200), float).cache()

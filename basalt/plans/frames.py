"""The frames that the queries share, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

LINES_SQL = "SELECT l_quantity AS x0, l_extendedprice / 10000 AS x1, l_discount * 10 AS x2, l_tax * 10 AS x3, l_linestatus AS status, l_returnflag AS flag, CAST(l_linestatus = 'O' AS INT) AS y FROM lineitem"
ORDERS_SQL = """SELECT o_orderkey AS id, CAST(o_orderkey % 3 AS INT) AS t, CAST(o_custkey % 3 AS INT) AS p, CAST(o_orderkey % 2 AS INT) AS b, CAST(o_custkey % 2 AS INT) AS q,
 CAST((o_orderkey // 2) % 2 AS INT) AS q2, (o_custkey % 97) / 97.0::DOUBLE AS s, o_totalprice / 1000 AS y, (o_totalprice + (o_custkey % 50) * 100 - 2000) / 1000 AS yhat, o_orderpriority AS priority FROM orders"""
PARTS_SQL = "SELECT p_partkey AS id, p_brand AS brand, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS gap, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS gap2, CAST(p_size % 3 AS INT) AS label FROM part"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_quantity").alias("x0"), (F.col("l_extendedprice") / 10000).alias("x1"), (F.col("l_discount") * 10).alias("x2"), (F.col("l_tax") * 10).alias("x3"), F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag"), (F.col("l_linestatus") == "O").cast("int").alias("y"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    i = lambda x: x.cast("int")
    return table(spark, d, "orders").select(o.alias("id"), i(o % 3).alias("t"), i(c % 3).alias("p"), i(o % 2).alias("b"), i(c % 2).alias("q"), i(F.floor(o / 2) % 2).alias("q2"), ((c % 97) / F.lit(97.0)).alias("s"), (F.col("o_totalprice") / 1000).alias("y"), ((F.col("o_totalprice") + (c % 50) * 100 - 2000) / 1000).alias("yhat"), F.col("o_orderpriority").alias("priority"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    k, size, price = F.col("p_partkey"), F.col("p_size").cast("double"), F.col("p_retailprice")
    return table(spark, d, "part").select(k.alias("id"), F.col("p_brand").alias("brand"), size.alias("size"), price.alias("price"), F.when(k % 7 != 0, price).alias("gap"), F.when(k % 5 != 0, size).alias("gap2"), (F.col("p_size") % 3).cast("int").alias("label"))


def row(spark: SparkSession, digits: int = 6, **values) -> DataFrame:
    """One row; floats rounded."""
    kinds = {k: "long" if isinstance(v, (int,)) and not isinstance(v, bool) else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "double" for k, v in values.items()}
    df = spark.createDataFrame([tuple(float(v) if kinds[k] == "double" else v for k, v in values.items())], ", ".join(f"`{k}` {t}" for k, t in kinds.items()))
    return df.withColumns({k: F.round(k, digits) for k, t in kinds.items() if t == "double"})


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})

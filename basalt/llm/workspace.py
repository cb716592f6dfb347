"""Shared tables between the jobs of one operator, and joins that bound what is broadcast and what meets in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_IDS = 500_000
#: A key with fewer rows than this is never dealt over several tasks.
HOT_ROWS = 20_000

#: Rows of text that go to a Python worker at once; a worker's memory follows them.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for the rest of this session, as a text is much larger than the rows that the default is made for. A plan reads the setting when it runs, so it can't be taken back here."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a local one in local mode (tests) and else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir()
    if not isinstance(named, str):
        named = named.get() if named is not None and named.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="basalt-")
        spark.sparkContext.setCheckpointDir(named)
    return named


_ROOTS: list[str] = []


def clear(spark: SparkSession) -> None:
    """Removes the tables that operators of this driver have saved. Results that were not written before can't be read any more."""
    jvm = spark._jvm
    while _ROOTS:
        path = jvm.org.apache.hadoop.fs.Path(_ROOTS.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Workspace:
    """Written tables that cut lineage; they outlive lost executors because the folder is shared."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
        self.n = 0
        _ROOTS.append(self.root)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._basalt_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a saved table that no later plan reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._basalt_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_ids(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """Joins a list of ids (or rows keyed by id) to documents; the list is broadcast only if counted to be small."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, key, how)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "left") -> DataFrame:
    """left joined to right, which holds each key once; weight is a column of right, about the number of left rows with its key.

    A key whose weight is above the bar is dealt over several tasks: its left rows by their place, its right row to each. The
    bar is a BROADCAST_IDS-th of all weight at least, so at most BROADCAST_IDS keys are above it, and only these are
    broadcast. right should be a saved table, as it is read twice.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    bar = max(HOT_ROWS, -(-total // BROADCAST_IDS))
    hot = right.filter(F.col(weight) > bar).select(*keys, F.ceil(F.col(weight) / bar).cast("int").alias("_parts"))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_parts", F.lit(1))).cast("int")
    left = left.join(F.broadcast(hot), keys, "left").withColumn("_part", place).drop("_parts")
    parts = F.when(F.col(weight) > bar, F.ceil(F.col(weight) / bar).cast("int")).otherwise(1)
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(weight)
    return left.join(right, [*keys, "_part"], how).drop("_part")

"""Range sharding by sampled splitters.

Rows are ordered by (text hash, doc_id), so copies lie side by side. A size-weighted sample of keys gives the quantile
boundaries of many fine ranges; ranges that turn out overfull, as a hot text makes them, get splitters of their own. Exact
byte and row totals of the fine ranges then place every row on a line of bytes, which is cut into equal shards.
"""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace

SHARDS = 24
#: Fine ranges per shard, and sampled keys per fine range: what the driver collects has this bound whatever the input.
FINE, SAMPLES = 64, 16
#: A fine range is overfull beyond so many times its share, and is divided again until it is not or one row is left of it.
OVERFULL = 4
#: Copies of a text stay in one shard if together they have at most this part of a shard's bytes, or the bytes of the largest
#: text, which no law can divide either.
WHOLE_GROUP = 0.02
_LEAST = -(1 << 63)


def _sample(slim: DataFrame, total: int, want: int, turn: int) -> list[tuple[int, int, int, float]]:
    """Keys drawn with a chance in proportion to size, and the bytes that each stands for; about `want` at most."""
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(want / max(1, total)))
    luck = F.pmod(F.xxhash64("rid", "h", F.lit(turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = slim.withColumn("p", chance).filter(luck < F.col("p")).select("h", "id", "rid", (F.col("size") / F.col("p")).alias("w")).collect()
    return sorted((r.h, r.id, r.rid, r.w) for r in rows)


def _splitters(sample: list[tuple[int, int, int, float]], ranges: int) -> list[tuple[int, int, int]]:
    """Quantiles of the sample; one inside a text's copies moves to their start unless several fall there."""
    if not sample:
        return []
    upto = np.cumsum([s[3] for s in sample])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)
    keys = sorted({sample[i][:3] for i in at.tolist()})
    return sorted({k if (i and keys[i - 1][0] == k[0]) or (i + 1 < len(keys) and keys[i + 1][0] == k[0]) else (k[0], _LEAST, _LEAST) for i, k in enumerate(keys)})


def _ranged(spark: SparkSession, slim: DataFrame, splitters: list[tuple[int, int, int]]) -> DataFrame:
    told = spark.sparkContext.broadcast(splitters)

    @F.pandas_udf("long")
    def range_of(h: pd.Series, id_: pd.Series, rid: pd.Series) -> pd.Series:
        keys = told.value
        first = np.array([k[0] for k in keys], np.int64)
        lo, hi = np.searchsorted(first, h, "left"), np.searchsorted(first, h, "right")
        for i in np.flatnonzero(lo != hi).tolist():  # a text with splitters of its own
            lo[i] = bisect.bisect_right(keys, (int(h.iloc[i]), int(id_.iloc[i]), int(rid.iloc[i])), int(lo[i]), int(hi[i]))
        return pd.Series(lo)

    return slim.withColumn("range", range_of("h", "id", "rid"))


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, row: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, and the column named by row (distinct longs).

    The law is `bytes`: shards differ by about one document or one small group of copies, however the sizes or copies are spread. size is the text's
    UTF-8 bytes plus 8; null counts as empty. slot numbers a shard's rows in key order without gaps. A null doc_id sorts
    first among equal texts, and repeated rows are told apart by their place. An empty table gives no rows, a table of
    few rows leaves shards empty, and a single long text is never divided. Other columns are ignored.
    """
    work = Workspace(spark)
    text = F.coalesce("text", F.lit(""))
    slim = work.save(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.coalesce("doc_id", F.lit(_LEAST)).alias("id"), (F.col(row) if row else F.monotonically_increasing_id()).alias("rid")))
    total, largest = (x or 0 for x in slim.agg(F.sum("size"), F.max("size")).first())
    fine = shards * FINE
    splitters = _splitters(_sample(slim, total, fine * SAMPLES, 0), fine)
    for turn in itertools.count(1):
        ranged = _ranged(spark, slim, splitters)
        held = {r["range"]: (r.bytes, r.n) for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        over = {k: b for k, (b, n) in held.items() if n > 1 and b > OVERFULL * max(largest, total / fine)}
        if not over:
            break
        part = ranged.filter(F.col("range").isin(list(over)))
        bytes_ = sum(over.values())
        more = _splitters(_sample(part, bytes_, 4 * fine * SAMPLES, turn), max(2, int(2 * fine * bytes_ / total)))
        if set(more) <= set(splitters):
            break
        splitters = sorted({*splitters, *more})
    order = sorted(held)
    before = spark.createDataFrame([(r, int(b), int(n)) for r, b, n in zip(order, np.cumsum([0, *(held[r][0] for r in order)]), np.cumsum([0, *(held[r][1] for r in order)]))], "range long, bytes_before long, rows_before long")
    line = Window.partitionBy("range").orderBy("h", "id", "rid")
    group = Window.partitionBy("range", "h")
    placed = ranged.join(F.broadcast(before), "range")
    placed = placed.withColumns({"upto": F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)), "slot": F.row_number().over(line) - 1, "mass": F.sum("size").over(group)})
    start = F.col("upto") - F.col("size")
    middle = F.when(F.col("mass") <= max(largest, WHOLE_GROUP * total / shards), F.min(start).over(group) + F.col("mass") / 2).otherwise(start + F.col("size") / 2)
    number = F.floor((F.col("bytes_before") + middle) * shards / F.lit(float(max(1, total))))
    placed = work.save(placed.select("doc_id", "rid", "size", "text_crc32", F.least(F.lit(shards - 1), number).cast("int").alias("shard"), (F.col("rows_before") + F.col("slot")).alias("row")))
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    out = placed.join(F.broadcast(first), "shard").withColumns({"law": F.lit("bytes"), "slot": F.col("row") - F.col("first"), "grown_shard": F.lit(None).cast("int")})
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", *([F.col("rid").alias(row)] if row else []))


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes every row of docs into one folder per shard, in slot order inside each task; shard and slot replace columns of these names.

    Rows get a number that is written with them, so null and repeated doc_ids lose and multiply nothing.
    """
    row = "_own_row"
    rows = Workspace(spark).save(docs.drop("shard", "slot").withColumn(row, F.monotonically_increasing_id()))
    placed = rows.join(shard(spark, rows, shards, row).select(row, "shard", "slot"), row).drop(row)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents; nulls, ties and repeats as in shard()."""
    return shard(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))

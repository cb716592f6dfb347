"""Exact deduplication against immutable snapshots screened by binary-fuse filters.

A snapshot is a table of distinct digests with one static three-wise binary-fuse filter per digest shard. An incoming batch
is grouped by itself first; its distinct digests are screened by the filter of their shard, and only positives join the
snapshot's exact buckets, where the bytes of the two texts are compared. write_snapshot() and screen() do this for a table
and those that come after it; exact_duplicates() does it for the two halves of one table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import mix
from .workspace import Workspace, spread_join, with_ids

#: Distinct digests a shard holds on average, and the least number of shards. Digests are uniform, so no shard runs hot.
SHARD_KEYS, LEAST_SHARDS = 8192, 64
ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


class FuseFilter:
    """A static set of 64-bit keys: no false negatives, about 1 in 256 false positives, some 9 bits a key."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    def slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Three slots of each key, in neighbouring segments, and its fingerprint."""
        h = mix(keys + np.uint64(self.seed))
        at = ((h >> np.uint64(32)) * np.uint64(self.segments * self.segment)) >> np.uint64(32)
        mask = np.uint64(self.segment - 1)
        one = (at + np.uint64(self.segment)) ^ ((h >> np.uint64(18)) & mask)
        two = (at + np.uint64(2 * self.segment)) ^ (h & mask)
        return np.stack([at, one, two]).astype(np.int64), mix(h).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Peels slots that a single key uses, round by round, then fills them in reverse; another seed if peeling stalls."""
        keys = np.unique(keys.astype(np.uint64))
        n = max(2, keys.size)
        segment = 1 << min(18, int(math.log(n) / math.log(3.33) + 2.25))
        room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        segments = max(1, math.ceil(room / segment) - 2)
        for seed in range(1, 100):
            self = cls(seed * 0x2545F4914F6CDD1D % (1 << 64), segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            slots, prints = self.slots(keys)
            size = self.prints.size
            count = np.bincount(slots.ravel(), minlength=size)
            total = np.bincount(slots.ravel(), np.tile(np.arange(keys.size, dtype=np.float64), 3), size).astype(np.int64)
            rounds, open_ = [], np.flatnonzero(count == 1)
            while open_.size:
                key, first = np.unique(total[open_], return_index=True)
                rounds.append((key, open_[first]))
                touched = slots[:, key].ravel()
                np.subtract.at(count, touched, 1)
                np.subtract.at(total, touched, np.tile(key, 3))
                touched = np.unique(touched)
                open_ = touched[count[touched] == 1]
            if sum(k.size for k, _ in rounds) == keys.size:
                for key, slot in reversed(rounds):
                    self.prints[slot] = prints[key] ^ np.bitwise_xor.reduce(self.prints[slots[:, key]], axis=0)
                return self
        raise RuntimeError("no seed peels these keys")

    def __contains__(self, key: int) -> bool:
        return bool(self.holds(np.array([key], np.uint64))[0])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = self.slots(keys.astype(np.uint64))
        return np.bitwise_xor.reduce(self.prints[slots], axis=0) == prints

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], np.uint64).tobytes() + self.prints.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> FuseFilter:
        seed, segment, segments = np.frombuffer(data[:24], np.uint64).tolist()
        return cls(seed, segment, segments, np.frombuffer(data[24:], np.uint8))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _groups(rows: DataFrame) -> DataFrame:
    """One row per distinct digest: the row that stays, its text if it has no id to find it by, and how many there are."""
    place = F.struct("doc_id", "rid")
    return rows.groupBy("digest", "bytes").agg(F.max(place).alias("keep"), F.max_by("loose", place).alias("loose"), F.count("*").alias("n"))


def _shards(n: int) -> int:
    return max(LEAST_SHARDS, math.ceil(n / SHARD_KEYS))


def _keyed(groups: DataFrame, shards: int) -> DataFrame:
    key = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    return groups.withColumn("key", key).withColumn("shard", F.pmod("key", F.lit(shards)))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "filter": [FuseFilter.build(pdf["key"].to_numpy().view(np.uint64)).to_bytes()]})


def _filters(keyed: DataFrame) -> DataFrame:
    """(shard, filter): a binary-fuse filter over each shard's keys."""
    return keyed.select("shard", "key").groupBy("shard").applyInPandas(_build, "shard long, filter binary")


def _screen(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """The digests of a batch that the snapshot may hold."""
    if batch.empty or filters.empty:
        return batch[["digest", "bytes"]].iloc[:0]
    return batch.loc[FuseFilter.from_bytes(filters["filter"].iloc[0]).holds(batch["key"].to_numpy().view(np.uint64)), ["digest", "bytes"]]


def _positives(keyed: DataFrame, filters: DataFrame) -> DataFrame:
    """(digest, bytes) of a batch's keyed digests that pass the filter of their shard."""
    return keyed.select("digest", "bytes", "key", "shard").groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(_screen, "digest binary, bytes int")


def _same_bytes(docs: DataFrame, pairs: DataFrame, work: Workspace) -> DataFrame:
    """(digest, bytes) of the pairs whose two texts are equal byte by byte."""
    ids = work.save(pairs.select(F.col("old.doc_id").alias("doc_id")).union(pairs.select("new.doc_id")).filter("doc_id is not null").distinct())
    texts = with_ids(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ids, "inner")
    texts = texts.select("doc_id", "text", digest(F.col("text")).alias("digest")).dropDuplicates(["doc_id", "digest"])
    side = lambda n: texts.select(F.col("doc_id").alias(f"{n}_id"), "digest", F.col("text").alias(f"{n}_text"))
    both = pairs.select("digest", "bytes", F.col("old.doc_id").alias("old_id"), F.col("new.doc_id").alias("new_id"), "old_loose", "new_loose")
    checked = both.join(side("old"), ["old_id", "digest"], "left").join(side("new"), ["new_id", "digest"], "left")
    return checked.filter(F.coalesce("old_text", "old_loose") == F.coalesce("new_text", "new_loose")).select("digest", "bytes")


def exact_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. The row with the largest doc_id stays; among rows that repeat it,
    one of them does. A null doc_id sorts below every id. The half of the rows whose hashed id is even is the snapshot, the
    other half the incoming batch; each is grouped separately, with partial sums before the shuffle, and the rows of a text
    with many copies are dealt over several tasks when they learn their group. An empty table gives no rows. Other columns
    are ignored. For a table that comes after another one see write_snapshot() and screen().
    """
    work = Workspace(spark)
    docs = docs.select("doc_id", "text")
    loose = F.when(F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))
    slim = work.save(docs.select("doc_id", digest(F.col("text")).alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("batch"), F.monotonically_increasing_id().alias("rid"), loose.alias("loose")))
    old, new = (work.save(_groups(slim.filter(F.col("batch") == b))) for b in (0, 1))
    shards = _shards(max(old.count(), new.count()))
    maybe = _positives(_keyed(new, shards), work.save(_filters(_keyed(old, shards))))
    side = lambda df, n: df.select("digest", "bytes", F.col("keep").alias(n), F.col("n").alias(f"{n}_n"), F.col("loose").alias(f"{n}_loose"))
    pairs = work.save(maybe.join(side(new, "new"), ["digest", "bytes"]).join(side(old, "old"), ["digest", "bytes"]))
    merged = pairs.join(_same_bytes(docs, pairs, work), ["digest", "bytes"]).select("digest", "bytes", F.greatest("old", "new").alias("both"), (F.col("old_n") + F.col("new_n")).alias("sum"))
    every = old.withColumn("batch", F.lit(0)).union(new.withColumn("batch", F.lit(1))).join(merged, ["digest", "bytes"], "left")
    every = work.save(every.select("digest", "bytes", "batch", F.coalesce("both", "keep").alias("keep"), F.coalesce("sum", "n").alias("group_size"), "n"))
    out = spread_join(slim.drop("loose"), every, ["digest", "bytes", "batch"], "n", "inner")
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def write_snapshot(spark: SparkSession, docs: DataFrame, path: str) -> None:
    """Writes a snapshot of docs to a new folder, never to be changed: `buckets`, one row per different text (shard, key,
    digest, bytes, text, doc_id of the largest id, n), and `filters`, one binary-fuse filter a shard.

    Null texts count as empty; a null doc_id is below every id. An empty table makes a snapshot that holds nothing.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"digest": digest(F.col("text")), "bytes": F.octet_length("text")})
    groups = rows.groupBy("digest", "bytes").agg(F.max("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("n"))
    shards = _shards(rows.count())
    _keyed(groups, shards).withColumn("shards", F.lit(shards)).write.parquet(f"{path}/buckets")
    buckets = spark.read.parquet(f"{path}/buckets")
    _filters(buckets).withColumn("shards", F.lit(shards)).write.parquet(f"{path}/filters")


def screen(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """One row per row of docs, an incoming batch held against the snapshot at path: doc_id, text_sha256, snapshot_id (the
    doc_id there of the same text), in_snapshot, keep_id (the batch's row that stays of its equal texts), group_size (in the
    batch), kept (not in the snapshot, and the row that stays).

    Nulls, ties and repeats as in exact_duplicates(); equality with the snapshot is decided by the bytes of the texts, which
    only digests that pass a filter are fetched for. The snapshot is only read.
    """
    work = Workspace(spark)
    filters = spark.read.parquet(f"{path}/filters")
    shards = (filters.select("shards").first() or [LEAST_SHARDS])[0]
    rows = work.save(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("rid")))
    slim = rows.select("doc_id", digest(F.col("text")).alias("digest"), F.octet_length("text").alias("bytes"), "rid", F.lit(None).cast("string").alias("loose"))
    groups = work.save(_groups(slim).drop("loose"))
    maybe = _positives(_keyed(groups, shards), filters.select("shard", "filter")).join(groups, ["digest", "bytes"])
    there = work.save(maybe.join(spark.read.parquet(f"{path}/buckets").select("digest", "bytes", F.col("doc_id").alias("snapshot_id"), F.col("text").alias("old_text")), ["digest", "bytes"]))
    mine = with_ids(rows.select("rid", "text"), there.select(F.col("keep.rid").alias("rid"), "digest", "bytes", "snapshot_id", "old_text"), "inner", "rid")
    found = mine.filter("text = old_text").select("digest", "bytes", "snapshot_id", F.lit(True).alias("in_snapshot"))
    told = work.save(groups.join(found, ["digest", "bytes"], "left").withColumn("in_snapshot", F.coalesce("in_snapshot", F.lit(False))).withColumn("group_size", F.col("n")))
    out = spread_join(slim.drop("loose"), told, ["digest", "bytes"], "n", "inner")
    return out.select("doc_id", F.lower(F.hex("digest")).alias("text_sha256"), "snapshot_id", "in_snapshot", F.col("keep.doc_id").alias("keep_id"), "group_size", (~F.col("in_snapshot") & (F.col("rid") == F.col("keep.rid"))).alias("kept"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents; nulls, ties and repeats as in exact_duplicates()."""
    return exact_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))

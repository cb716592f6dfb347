"""MinHash near-duplicate detection with circulant permutations.

A document is the set of its distinct five-word shingles. One permutation scatters the shingles over a ring, a second
one, shifted circularly by k, gives the k-th signature coordinate. Coordinates are banded; documents that share a band
are candidates; a candidate pair is a link only after its full shingle sets are compared. Groups are never expanded into
all pairs: texts with equal sets collapse first, a round then links the members of each bucket to one hub, and only
members still in different components are held against their bucket, in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .workspace import BROADCAST_IDS, Workspace, bound_batches, spread_join, with_ids

SHINGLE = 5
BANDS, ROWS = 40, 5
COORDS = BANDS * ROWS
RING = 1 << 21
PERCENT = 75
#: A pair whose share of equal coordinates is below this is dropped before its sets are compared: more than six standard errors under the threshold.
LEAST_ESTIMATE = 0.55
#: Members of a bucket that are still apart after the round of hubs are compared in blocks of so many rows.
BLOCK_ROWS = 256
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
 c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * p.n >= 75 * (x.n + y.n - p.n)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
 m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT doc_id, coalesce(c.n, 0) AS n_shingles, least(doc_id, coalesce(m.b, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m.b, doc_id)) AS kept FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN m ON m.a = doc_id
"""
_MUL = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def rings() -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and windows of the second: row p holds its values at p, p+1, ... around the ring."""
    return tk.kept("rings", _made_rings)


def _made_rings() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_24)
    scatter, second = rng.permutation(RING).astype(np.uint32), rng.permutation(RING).astype(np.uint32)
    return scatter, sliding_window_view(np.concatenate([second, second[:COORDS]]), COORDS)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingle hashes) for every text."""
    for lo, hi, buf, offs in tk.blocks(column):
        starts, _, at = tk.words(buf, offs)
        h = tk.word_hashes(buf, starts, lower=True)
        n = max(0, h.size - SHINGLE + 1)
        s = np.zeros(n, np.uint64)
        for j in range(SHINGLE):
            s += h[j : j + n] * _MUL[j]
        s = tk.mix(s)
        for d in range(hi - lo):
            a, b = int(at[d]), int(at[d + 1])
            if b - a >= SHINGLE:
                yield lo + d, np.unique(s[a : b - SHINGLE + 1])
            elif b > a:
                short = (h[a:b] * _MUL[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield lo + d, tk.mix(np.array([short], np.uint64))
            else:
                yield lo + d, np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates of a non-empty set, from two permutations."""
    scatter, windows = rings()
    at = scatter[shingles & np.uint64(RING - 1)]
    least = np.full(COORDS, RING, np.uint32)
    for k in range(0, at.size, 4096):
        np.minimum(least, windows[at[k : k + 4096]].min(axis=0), out=least)
    return least


def _node(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seed = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    mul = _MUL[:ROWS]
    for batch in batches:
        count, node, sig, keys = [], [], [], []
        for _, s in shingle_sets(batch.column(2)):
            count.append(s.size)
            if s.size:
                c = signature(s)
                key = tk.mix((c.reshape(BANDS, ROWS).astype(np.uint64) * mul).sum(axis=1, dtype=np.uint64) + seed)
                node.append(_node(s))
                sig.append(c.astype(np.uint8).tobytes())
                keys.append(key.view(np.int64))
            else:
                node.append(None)
                sig.append(None)
                keys.append(None)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(count, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "row", "n_shingles", "node", "sig", "bands"],
        )


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sig_a, sig_b) to (a, b, estimate), without the hopeless."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, COORDS) for i in (2, 3))
        share = (x == y).mean(axis=1)
        keep = np.flatnonzero(share >= LEAST_ESTIMATE)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(share[keep], pa.float64())], ["a", "b", "estimate"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, node) to (node, shingles); another text under the same id is skipped by its own set's digest."""
    for batch in batches:
        wanted, node, data = batch.column(1).to_pylist(), [], []
        for row, s in shingle_sets(batch.column(0)):
            if _node(s) == wanted[row]:
                node.append(wanted[row])
                data.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(data, pa.binary())], ["node", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
            both = np.intersect1d(u, v, assume_unique=True).size
            keep.append(100 * both >= PERCENT * (u.size + v.size - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (node, comp) to (node, comp, new): each node below the least node that the partition's edges join it to; new marks rows that did not come in."""
    over: dict[bytes, bytes] = {}
    came: set[tuple[bytes, bytes]] = set()

    def root(x: bytes) -> bytes:
        top = x
        while over.get(top, top) != top:
            top = over[top]
        while over.get(x, x) != top:
            over[x], x = top, over[x]
        return top

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            came.add((x, y))
            a, b = root(x), root(y)
            over.setdefault(x, a)
            over.setdefault(y, b)
            if a != b:
                over[max(a, b)] = min(a, b)
    rows = [(x, root(x)) for x in over]
    rows = [r for r in rows if r[0] != r[1]]
    for i in range(0, len(rows), 50_000):
        part = rows[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.binary()), pa.array([r[1] for r in part], pa.binary()), pa.array([r not in came for r in part], pa.bool_())], ["node", "comp", "new"])


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, comp) for every node of the edges (a, b) but each component's least one: comp is the least node reachable.

    Each partition joins what its own edges join; nodes then meet their other parents by a shuffle on the node, so that no
    hub and no component goes to one task, and parents that got a parent are followed, until neither changes a row.
    """
    contracted = lambda df: df.mapInArrow(tk.tidy(_contract), "node binary, comp binary, new boolean")
    up, read = contracted(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("comp"))).select("node", "comp"), []
    while True:
        now = work.save(contracted(up.repartition("node")))
        for df in read:
            work.drop(df)
        higher = work.save(now.join(now.select(F.col("comp").alias("node")).distinct(), "node", "left_semi").groupBy(F.col("node").alias("comp")).agg(F.min("comp").alias("far")))
        n = higher.count()
        if not n and not now.filter("new").limit(1).count():
            work.drop(higher)
            return now.select("node", "comp")
        read = [now, higher]
        far = F.broadcast(higher) if n <= BROADCAST_IDS else higher
        up = now.join(far, "comp", "left").select("node", F.coalesce("far", "comp").alias("comp"))


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, band, part, slice, node, comp, query, asks, sig, bands), sorted by the first four, to the nodes of a group that
    are worth comparing: (key, part, slice, node, comp, others), others of a query being the nodes to hold it against.

    A group holds at most some BLOCK_ROWS queries and as many rows to hold them against. A pair is told in the first band
    that it shares and no other; the keys of the bands tell it, as a signature's coordinates are cut to 8 bits.
    """
    was, rows = None, []

    def told():
        ask, all_ = [r for r in rows if r[3]], [r for r in rows if not r[3]]
        if not ask or not all_:
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in _TOLD.types], schema=_TOLD)
        code: dict[bytes, int] = {}
        x, y = (np.frombuffer(b"".join(r[4] for r in part), np.uint8).reshape(-1, COORDS) for part in (ask, all_))
        kx, ky = (np.array([r[5] for r in part]) for part in (ask, all_))
        cx, cy = (np.array([code.setdefault(r[1], len(code)) for r in part]) for part in (ask, all_))
        qy, out, used = np.array([r[2] for r in all_]), [], set()
        for i in range(len(ask)):
            equal = y == x[i]
            good = np.flatnonzero((equal.mean(axis=1) >= LEAST_ESTIMATE) & (cy != cx[i]))
            if good.size:
                good = good[(ky[good] == kx[i]).argmax(axis=1) == was[1]]
            others = [j for j in good.tolist() if not qy[j] or ask[i][0] < all_[j][0]]
            if others:
                used.update(others)
                out.append((*ask[i][:2], [all_[j][0] for j in others]))
        out += [(*all_[j][:2], None) for j in sorted(used)]
        where = [pa.array([k] * len(out), t) for k, t in zip((was[0], was[2], was[3]), _TOLD.types, strict=False)]
        return pa.RecordBatch.from_arrays([*where, *(pa.array([r[i] for r in out], t) for i, t in enumerate(_TOLD.types[3:]))], schema=_TOLD)

    for batch in batches:
        key = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        bands = batch.column(9).flatten().to_numpy().reshape(-1, BANDS)
        for k, row in zip(key, zip(*(batch.column(i).to_pylist() for i in range(4, 9)), bands, strict=True), strict=True):
            if k != was:
                if rows:
                    yield told()
                was, rows = k, []
            rows.append(row)
    if rows:
        yield told()


_TOLD = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("slice", pa.int32()), ("node", pa.binary()), ("comp", pa.binary()), ("others", pa.list_(pa.binary()))])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, part, slice, node, comp, others, shingles), sorted by the first three, to links of components; those that the group's links join need no other link."""
    was, rows = None, []

    def links():
        there = {r[0]: (r[1], np.frombuffer(r[3], np.uint64)) for r in rows if r[2] is None}
        left, right, over = [], [], {}  # components, not nodes

        def root(c: bytes) -> bytes:
            while c in over:
                c = over[c]
            return c

        for _, mine, others, data in (r for r in rows if r[2] is not None):
            u = np.frombuffer(data, np.uint64)
            for o in others:
                comp, v = there[o]
                a, b = root(mine), root(comp)
                if a == b or 100 * min(u.size, v.size) < PERCENT * max(u.size, v.size):
                    continue
                both = np.intersect1d(u, v, assume_unique=True).size
                if 100 * both >= PERCENT * (u.size + v.size - both):
                    over[max(a, b)] = min(a, b)
                    left.append(mine)
                    right.append(comp)
        return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(7)]
        for k, row in zip(zip(*columns[:3], strict=True), zip(*columns[3:], strict=True), strict=True):
            if k != was:
                if rows:
                    yield links()
                was, rows = k, []
            rows.append(row)
    if rows:
        yield links()


def _cross_links(mixed: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of components that share a bucket, from (key, band, node, comp): every member outside a bucket's largest component is held against all members, in blocks; signatures sieve, sets decide. No pair is a row."""
    per = mixed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    per = per.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("big"), F.sum("c").alias("m"), F.max("c").alias("top"))
    rows = mixed.join(per, "key").join(sigs.select("node", "sig", "bands"), "node").withColumn("query", F.col("comp") != F.col("big"))
    parts, slices = (F.greatest(F.lit(1), F.ceil(c / BLOCK_ROWS)).cast("int") for c in (F.col("m") - F.col("top"), F.col("m")))
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    asks = F.transform(upto(slices), lambda x: F.struct(own(parts).alias("part"), x.cast("int").alias("slice"), F.lit(True).alias("asks")))
    rest = F.transform(upto(parts), lambda x: F.struct(x.cast("int").alias("part"), own(slices).alias("slice"), F.lit(False).alias("asks")))
    both = rows.withColumn("at", F.explode(F.concat(F.when(F.col("query"), asks).otherwise(F.slice(asks, 1, 0)), rest)))
    both = both.select("key", "band", "at.part", "at.slice", "node", "comp", "query", "at.asks", "sig", "bands")
    both = both.repartition("key", "band", "part", "slice").sortWithinPartitions("key", "band", "part", "slice")
    told = both.mapInArrow(tk.tidy(_crossed), "key long, part int, slice int, node binary, comp binary, others array<binary>")
    full = told.join(sets, "node").select("key", "part", "slice", "node", "comp", "others", "shingles")
    return full.repartition("key", "part", "slice").sortWithinPartitions("key", "part", "slice").mapInArrow(tk.tidy(_compared), "a binary, b binary")


def _hub_links(shared: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of nodes with that hub, of those of their buckets, whose signature is nearest, if their sets are similar enough."""
    side = lambda df, n, c: df.select(F.col("node").alias(n), F.col(c).alias(f"s{n}"))
    star = shared.filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).repartition("a").distinct()
    star = star.join(side(sigs, "a", "sig"), "a").join(side(sigs, "b", "sig"), "b").select("a", "b", "sa", "sb")
    near = star.mapInArrow(tk.tidy(_estimate), "a binary, b binary, estimate double").groupBy("a").agg(F.max_by("b", F.struct("estimate", "b")).alias("b"))
    return near.join(side(sets, "a", "shingles"), "a").join(side(sets, "b", "shingles"), "b").select("a", "b", "sa", "sb").mapInArrow(tk.tidy(_linked), "a binary, b binary")


def near_duplicates(spark: SparkSession, docs: DataFrame, row: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, and the column named by row.

    Null or blank text: no shingles, linked with nothing, kept. Fewer than five words: the whole sequence is one shingle.
    Equal shingle sets (repeated rows, copies) always share a component. component_id is the component's smallest doc_id.
    Without row, kept means that doc_id is component_id: rows that repeat a doc_id get that id's smallest component and are
    kept or not together, and a null doc_id takes part in no link: its component_id is null and the row is kept. With row,
    a column of distinct longs that every read of docs gives alike, rows with a null doc_id take part too, and of each
    component one row is kept, that with the smallest (doc_id, row), nulls last. Other columns are ignored.
    """
    work = Workspace(spark)
    bound_batches(spark)
    key = row or "doc_id"
    docs = docs.select("doc_id", F.col(key).alias("row"), "text")
    signed = work.save(docs.mapInArrow(tk.tidy(_sign), "doc_id long, row long, n_shingles long, node binary, sig binary, bands array<long>"))
    full = signed.filter(F.col("node").isNotNull() & F.col("row").isNotNull())
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = work.save(full.groupBy("node").agg(F.min(first).alias("first"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.count("*").alias("n")))
    every = classes.select(F.posexplode("bands").alias("band", "key"), "node")
    # each bucket's hub: another one in each bucket, so that a node has many to choose from
    hubs = every.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", "key"), "node")).alias("hub")).filter("n > 1")
    hubs = work.save(hubs.select("key", F.col("hub.node").alias("hub"), "n"))
    shared = work.save(spread_join(every, hubs, ["key"], "n", "inner").select("key", "band", "node", "hub"))
    sigs = work.save(classes.join(shared.select("node").distinct(), "node", "left_semi"))
    wanted = sigs.select(F.col("first.row").alias("row"), "node")
    sets = work.save(with_ids(docs, wanted, "inner", "row").select("text", "node").mapInArrow(tk.tidy(_sets), "node binary, shingles binary").dropDuplicates(["node"]))
    comps = work.save(components(work.save(_hub_links(shared, sigs, sets)), work))
    named = shared.join(comps, "node", "left").select("key", "band", "node", F.coalesce("comp", "node").alias("comp"))
    unlike = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key")
    mixed = work.save(named.join(unlike, "key", "left_semi"))
    work.drop(shared)
    more = components(work.save(_cross_links(mixed, sigs, sets)), work).select(F.col("node").alias("comp"), F.col("comp").alias("far"))
    nodes = sigs.select("node", "first").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    nodes = work.save(nodes.join(more, "comp", "left").select("node", "first", F.coalesce("far", "comp").alias("comp")))
    least = nodes.groupBy("comp").agg(F.min("first").alias("least"))
    named = nodes.join(least, "comp").select("node", "least")
    named = work.save(classes.select("node", "first", "n").join(named, "node", "left").select("node", F.coalesce("least", "first").alias("least"), "n"))
    out = spread_join(signed, named, ["node"], "n")
    if row is None:
        own = F.when(F.col("doc_id").isNotNull(), F.coalesce("least.doc_id", "doc_id"))
        return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
    own = F.when(F.col("node").isNotNull(), F.col("least.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("row") == F.col("least.row"), F.lit(True)).alias("kept"), F.col("row").alias(row))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents; nulls, ties and repeats as in near_duplicates()."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))

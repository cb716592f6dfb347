"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; windows of WINDOW template words are hashed and looked up among those
of the benchmark. Along each alignment of a document with an item, the slots must agree: one value of the item always
stands for one value of the document and the other way round, so a re-parameterised question is still caught; windows that
hold a contradicting slot are left out. Windows of the case-folded words themselves are looked up in the same index, shorter
ones for short items, so a verbatim copy is caught whatever its words are and however they are capitalised.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .workspace import bound_batches

WINDOW = 8
#: A window with fewer plain words than this says too little to be looked up.
LEAST_PLAIN = 4
#: An item of fewer words says too little to be looked up by its words.
LEAST_WORDS = 3
#: An item is found if so much of its words lies in windows that match with consistent slots.
LEAST_COVER = 0.5
#: Bytes of benchmark text that are broadcast at once; a larger benchmark is taken in blocks.
BLOCK_BYTES = 32 << 20
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "second seconds minute minutes hour hours day days week weeks month months year years ml l litre litres liter liters gallon gallons "
    "dollar dollars cent cents euro euros usd eur percent degree degrees mph kmh km/h".split()
)
NUMBER, NAME, UNIT = b"\x00number", b"\x00name", b"\x00unit"
_EDGE = ".,;:!?\"'()[]{}<>|*%$&#~`“”‘’«»"
_mul = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(WINDOW)], np.uint64)


class Canon:
    """Words to template codes. Which capitalised word is a name depends on the word before, so both forms are kept."""

    def __init__(self):
        self.memo = tk.WordMemo(self.learn, 200_000)
        self.learn(None)

    def learn(self, new: list[bytes] | None) -> None:
        if new is None:
            self.code, self.exact, self.kind, self.upper, self.closes = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool), np.zeros(0, bool)
            return
        codes, exact, kinds, upper, closes = [], [], [], [], []
        for w in new:
            t = w.decode()
            bare = t.strip(_EDGE)
            low = bare.lower()
            kind = 1 if re.search(r"\d", bare) else 3 if low in UNITS else 0 if bare else -1
            codes.append({1: NUMBER, 3: UNIT}.get(kind, low.encode()))
            exact.append(bare.casefold().encode())
            kinds.append(kind)
            upper.append(kind == 0 and bare[:1].isupper())
            closes.append(t.rstrip("\"')]”’»")[-1:] in (".", "!", "?", ":"))
        for name, all_ in (("code", codes), ("exact", exact)):
            buf = np.frombuffer(b"".join(c + b" " for c in all_), np.uint8)
            starts, _, at = tk.words(buf, np.array([0, buf.size]))
            h = np.zeros(len(all_), np.uint64)
            h[[i for i, c in enumerate(all_) if c]] = tk.word_hashes(buf, starts)
            setattr(self, name, np.concatenate([getattr(self, name), h]))
        self.kind = np.concatenate([self.kind, np.array(kinds, np.int8)])
        self.upper = np.concatenate([self.upper, np.array(upper, bool)])
        self.closes = np.concatenate([self.closes, np.array(closes, bool)])

    def __call__(self, column: pa.Array) -> Iterator[tuple]:
        """(first row, template codes, codes of the words themselves, kinds, first template word of each text, start and end byte of each word, bytes)."""
        for lo, hi, buf, offs in tk.blocks(column):
            starts, ends, at = tk.words(buf, offs)
            w = self.memo(buf, starts, ends)
            code, kind = self.code[w], self.kind[w].copy()
            inner = np.ones(w.size, bool)
            inner[1:] = ~self.closes[w][:-1]
            inner[at[:-1][at[:-1] < w.size]] = False
            name = self.upper[w] & inner
            kind[name] = 2
            code = np.where(name, _NAME_CODE, code)
            real = kind >= 0
            yield lo, code[real], self.exact[w][real], kind[real], np.concatenate([[0], np.cumsum(real)])[at], starts[real], ends[real], buf


_NAME_CODE = tk.word_hashes(np.frombuffer(NAME, np.uint8), np.zeros(1, np.int64))[0]


def window_hashes(code: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window that begins at each word, and whether it has enough plain words."""
    n = max(0, code.size - WINDOW + 1)
    h, plain = np.zeros(n, np.uint64), np.zeros(n, np.int16)
    for j in range(WINDOW):
        h += code[j : j + n] * _mul[j]
        plain += kind[j : j + n] == 0
    return tk.mix(h), plain >= LEAST_PLAIN


def exact_hashes(exact: np.ndarray, size: int) -> np.ndarray:
    """Hash of the case-folded words of the window of the given size that begins at each word."""
    n = max(0, exact.size - size + 1)
    h = np.full(n, size, np.uint64) * np.uint64(0xD1342543DE82EF95)
    for j in range(size):
        h += exact[j : j + n] * _mul[j]
    return tk.mix(h)


def _slots(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    data = buf.tobytes()
    return [data[a:b].decode().strip(_EDGE).casefold() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


@dataclass
class Index:
    """Windows of a block of items: sorted hashes with (item, place, size), each item's words, and the sizes of windows of the words themselves."""

    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    size: np.ndarray
    ids: list[int]
    words: list[list[str]]
    kinds: list[np.ndarray]
    sizes: list[int]

    @classmethod
    def build(cls, ids: list[int], texts: list[str]) -> Index:
        canon, hashes, item, place, size, words, kinds = Canon(), [], [], [], [], [], []
        for k, t in enumerate(texts):
            words.append([])
            kinds.append(np.zeros(0, np.int8))
            for _, code, exact, kind, _, s, e, buf in canon(pa.array([t])):
                words[k], kinds[k] = _slots(buf, s, e), kind
                h, good = window_hashes(code, kind)
                n = min(WINDOW, exact.size)
                own = exact_hashes(exact, n) if n >= LEAST_WORDS else np.zeros(0, np.uint64)
                for h, at, n in ((h, np.flatnonzero(good), WINDOW), (own, np.arange(own.size), n)):
                    hashes.append(h[at])
                    item.append(np.full(at.size, k))
                    place.append(at)
                    size.append(np.full(at.size, n))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        hashes, item, place, size = cat(hashes, np.uint64), cat(item, np.int64), cat(place, np.int64), cat(size, np.int64)
        order = np.lexsort((place, item, hashes))
        return cls(hashes[order], item[order], place[order], size[order], ids, words, kinds, sorted({min(WINDOW, len(w)) for w in words if len(w) >= LEAST_WORDS}))

    def sieve(self) -> np.ndarray:
        bits = np.zeros(1 << 22, bool)
        bits[(self.hashes & np.uint64(bits.size - 1)).astype(np.int64)] = True
        return bits


def _cover(index: Index, item: int, hits: list[tuple[int, int, int]], words: list[str], kinds: np.ndarray) -> float:
    """Part of the item's words in matching windows of a document, after windows that hold a contradicting slot are left out.

    Equal values never contradict; of the others, those that stand at the most places are taken first.
    """
    lines = defaultdict(set)
    for at, place, size in hits:
        lines[at - place].add((place, size))
    covered: set[int] = set()
    there: dict[tuple[int, str], str] = {}
    back: dict[tuple[int, str], str] = {}
    for shift, places in sorted(lines.items(), key=lambda x: (-len(x[1]), x[0])):
        mine = sorted({p + j for p, n in places for j in range(n)})
        pairs = {p: (int(index.kinds[item][p]), index.words[item][p], words[p + shift]) for p in mine if index.kinds[item][p] > 0}
        to, fro, bad = dict(there), dict(back), set()
        for (k, a, b), _ in sorted(Counter(pairs.values()).items(), key=lambda x: (x[0][1] != x[0][2], -x[1])):
            if a != b and (to.get((k, a), b) != b or fro.get((k, b), a) != a):
                bad.add((k, a, b))
            else:
                to.setdefault((k, a), b)
                fro.setdefault((k, b), a)
        good = {p + j for p, n in places if not any(pairs.get(p + j) in bad for j in range(n)) for j in range(n)}
        for k, a, b in (pairs[p] for p in sorted(good) if p in pairs):
            there.setdefault((k, a), b)
            back.setdefault((k, b), a)
        covered |= good
    return len(covered) / max(1, len(index.words[item]))


def _search(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, canon = told.value, Canon()
        sieve = index.sieve()
        mask = np.uint64(sieve.size - 1)
        for batch in batches:
            found: list[list[int]] = [[] for _ in range(batch.num_rows)]
            most = [0.0] * batch.num_rows
            for lo, code, exact, kind, first, s, e, buf in canon(batch.column(1)):
                h, good = window_hashes(code, kind)
                hits = defaultdict(lambda: defaultdict(list))
                for h, good in ((h, good), *((exact_hashes(exact, n), True) for n in index.sizes)):
                    maybe = np.flatnonzero(sieve[(h & mask).astype(np.int64)] & good)
                    left = np.searchsorted(index.hashes, h[maybe], "left")
                    right = np.searchsorted(index.hashes, h[maybe], "right")
                    doc = np.searchsorted(first, maybe, "right") - 1
                    for at, d, a, b in zip(maybe.tolist(), doc.tolist(), left.tolist(), right.tolist(), strict=True):
                        for x in range(a, b):
                            if at + index.size[x] <= first[d + 1]:
                                hits[d][int(index.item[x])].append((at - int(first[d]), int(index.place[x]), int(index.size[x])))
                for d, items in hits.items():
                    a, b = int(first[d]), int(first[d + 1])
                    words, kinds = _slots(buf, s[a:b], e[a:b]), kind[a:b]
                    for item, at in items.items():
                        c = _cover(index, item, at, words, kinds)
                        most[lo + d] = max(most[lo + d], c)
                        if c >= LEAST_COVER:
                            found[lo + d].append(index.ids[item])
            found = [sorted({*x, *was}) for x, was in zip(found, batch.column(2).to_pylist(), strict=True)]
            most = [max(x, was) for x, was in zip(most, batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int64())), pa.array(most, pa.float64()), *batch.columns[4:]], batch.schema.names)

    return run


def _searched(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, names: list[str]) -> DataFrame:
    """_text, _items, _cover, and the columns named but text, as _c0, _c1, ..."""
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    bound_batches(spark)
    out = docs.select(F.lit(0).alias("_none"), F.col("text").alias("_text"), F.array().cast("array<long>").alias("_items"), F.lit(0.0).alias("_cover"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(names) if c != "text"))
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        told = spark.sparkContext.broadcast(Index.build([r.item_id for r in rows], [r.text for r in rows]))
        out = out.mapInArrow(tk.tidy(_search(told)), out.schema)
    return out


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, contaminated, items (ids found, ascending), cover (the largest part of an item found).

    Items of fewer than LEAST_WORDS words, null items and items with a null id hold no window and are never found. A null or
    empty text is clean. Rows with a null or repeated doc_id are judged like any other, each by its own text. Every window of
    a text is looked up. A benchmark beyond BLOCK_BYTES is taken in blocks, each of which passes over the documents once; an
    empty one leaves all clean. Other columns are ignored.
    """
    out = _searched(spark, docs, benchmark, ["doc_id"])
    return out.select(F.col("_c0").alias("doc_id"), (F.size("_items") > 0).alias("contaminated"), F.col("_items").alias("items"), F.col("_cover").alias("cover"))


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, judged as in find_leaks(), with the columns that came."""
    out = _searched(spark, docs, benchmark, docs.columns).filter(F.size("_items") == 0)
    return out.select(*(F.col("_text" if c == "text" else f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents, searched for all of benchmark; nulls, ties and repeats as in find_leaks()."""
    return find_leaks(spark, *(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))

"""Words of Arrow string batches as NumPy arrays: no Python object per word."""

from __future__ import annotations

import ctypes
import gc
import itertools
import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
BLOCK = 1 << 18
#: A worker without work for so many seconds drops its caches.
IDLE_S = 3.0
_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[SPACES] = 0
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_power: dict[str, list[np.ndarray]] = {}
_LIBC = ctypes.CDLL(None)


_kept: dict[object, object] = {}
_lock, _waits = threading.RLock(), []


def release() -> None:
    """Gives freed memory back to the system, as workers outlive their tasks and stages; caches that hold their own methods are freed by the collector only."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def forget() -> None:
    with _lock:
        _kept.clear()
        _power.clear()
    release()


def busy() -> None:
    """Work begins: the caches stay."""
    with _lock:
        while _waits:
            _waits.pop().cancel()


def idle() -> None:
    """Work ends: the caches go unless more of it begins within IDLE_S, so that they do not lie beside stages that run without Python."""
    with _lock:
        busy()
        wait = threading.Timer(IDLE_S, forget)
        wait.daemon = True
        wait.start()
        _waits.append(wait)


def kept(key, make):
    """What a worker keeps from task to task, made at first use: one thing, so that an operator's caches end when another's begin."""
    busy()
    with _lock:
        if key not in _kept:
            _kept.clear()
            release()
            _kept[key] = make()
        return _kept[key]


def tidy(run):
    """The function for mapInArrow, followed by release(), and by forget() when the worker stays idle."""

    def tidied(batches):
        busy()
        try:
            yield from run(batches)
        finally:
            release()
            idle()

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = _power.get("both")
    if made is None or made[0].size < n:
        size, made = max(n, BLOCK + (BLOCK >> 1)), []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _power["both"] = made
    return made[0], made[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column, "").cast(pa.large_string())
    _, offs, data = a.buffers()
    offs = np.frombuffer(offs, np.int64)[a.offset : a.offset + len(a) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets from 0): runs of whole texts of about `size` bytes; a longer text stands alone."""
    buf, offs = utf8(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        hi = min(hi, n, lo + 20_000)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and each text's first word (one more entry than texts)."""
    n = buf.size
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~SPACES[buf]
    first, last = np.ones(n, bool), np.ones(n, bool)
    np.logical_not(solid[:-1], out=first[1:])
    np.logical_not(solid[1:], out=last[:-1])
    first[offs[:-1][offs[:-1] < n]] = True
    last[offs[1:][offs[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(first & solid), np.flatnonzero(last & solid) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit polynomial hash of each word; `lower` folds A-Z only."""
    if not starts.size:
        return np.zeros(0, np.uint64)
    up, down = _powers(buf.size)
    vals = (_BYTE_LOWER if lower else _BYTE)[buf]
    vals *= up[: buf.size]
    return mix(np.add.reduceat(vals, starts) * down[starts])


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first occurrence of each distinct hash, and each occurrence's place among them."""
    told = pa.array(hashes).dictionary_encode()
    place = told.indices.to_numpy()
    first = np.empty(len(told.dictionary), np.int64)
    first[place[::-1]] = np.arange(hashes.size - 1, -1, -1)
    return first, place


class WordMemo:
    """Per-worker cache from a word's bytes to a small integer; `learn` is called on unseen words in bulk."""

    def __init__(self, learn, limit: int = 400_000):
        self.learn, self.limit, self.index = learn, limit, {}

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """The integer of every occurrence. The cache empties when it is full; its size never follows the corpus."""
        first, inverse = distinct(word_hashes(buf, starts, lower))
        data = buf.tobytes()
        pick = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if lower:
            pick = [w.lower() for w in pick]
        if len(self.index) + len(pick) > self.limit:
            self.index = {}
            self.learn(None)
        index = self.index
        found = np.fromiter(map(index.get, pick, itertools.repeat(-1)), np.int64, len(pick))
        missing = np.flatnonzero(found < 0)
        if missing.size:
            new = [pick[i] for i in missing.tolist()]
            found[missing] = np.arange(len(index), len(index) + len(new))
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            self.learn(new)
        return found[inverse]

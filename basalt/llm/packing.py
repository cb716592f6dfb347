"""Order-preserving packing of token streams into training windows by dynamic programming.

Rows are taken in the order of their input partition, in blocks of whole documents. Inside a block the cut positions are
document ends (free), sentence ends and, in long stretches without either, token positions; both of the latter cost a
penalty, as the cut truncates a context. The least sum of padding and penalties is found exactly: the padding of a window
(i, j] is capacity - (p[j] - p[i]), so the best i is the least f[i] + p[i] among the starts in reach, kept in a monotone queue.
A window whose length is a power of two needs no padding and is a separate transition.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import textkit as tk
from .workspace import bound_batches

CAPACITY = 4096
END_ID = 2
#: Penalties in tokens of padding: cutting at a sentence end, cutting inside a sentence.
SENTENCE_CUT, HARD_CUT = 12.0, 96.0
LEAST_POWER = 6
#: A block closes with the document that brings it to so many tokens.
BLOCK_TOKENS = 1 << 20
HARD_EVERY = 1024
#: Distinct units a worker keeps in mind (some 250 MB), and bytes of text encoded at once.
MEMO_UNITS, ENCODE_BYTES = 1_500_000, 1 << 20
TOKENIZER = "word_bpe_49k.json"


def units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, each text's first unit): words, cut again between ASCII letters or digits and punctuation.

    The pre-tokenizer cuts there too. Apostrophes (of contractions) and the signs of special tokens are left in place, and
    A-Z are folded as the normaliser would, unless a special token may occur.
    """
    starts, ends, at = tk.words(buf, offs)
    if not starts.size:
        return buf, starts, ends, at
    kind = _KIND[buf]
    opens, closes = np.zeros(buf.size + 1, bool), np.zeros(buf.size + 1, bool)
    opens[1:-1] = (kind[1:] | kind[:-1]) == 3
    opens[offs[1:-1]] = False
    closes[:] = opens
    opens[starts], closes[ends] = True, True
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    return (buf if b"<|" in buf.tobytes() else _FOLD[buf]), starts, ends, np.searchsorted(starts, offs)


_KIND = np.zeros(256, np.uint8)
_KIND[[c for c in range(128) if chr(c).isalnum()]] = 1
_KIND[[ord(c) for c in "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


#: Units of these letters alone are one word to every normaliser and pre-tokenizer that the Encoder is valid for.
_LATIN = re.compile("[a-zß-öø-ÿ]+")
#: A byte-level alphabet shows a byte as the character of its number, but for those that do not print: of a Latin letter's, these three.
_BYTE_SIGN = {0x9F: 0x141, 0xA0: 0x142, 0xAD: 0x143}


def _signs(words: list[str]) -> list[str]:
    """Words without line ends in the byte-level alphabet, right for Latin letters."""
    text = "\n".join(words).encode().decode("latin-1")
    for byte, sign in _BYTE_SIGN.items():
        text = text.replace(chr(byte), chr(sign))
    return text.split("\n")


class Encoder:
    """Token ids of whole texts through a per-worker cache of words.

    Valid for tokenizers whose pre-tokenizer drops white space, cuts as units() does, and whose normaliser folds case: a
    text's ids are then its units' ids in turn.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        ends = {i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>") and set(t[:-4]) & set(".!?") and not any(c.isalnum() for c in t[:-4])}
        self.sentence_end = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.sentence_end[list(ends)] = True
        letters = [chr(c) for c in range(97, 256) if _LATIN.fullmatch(chr(c))]
        probes = [*letters, *(a + b + a for a in letters for b in letters)]
        self.model = self.tokenizer.model
        self.direct = [[t.id for t in self.model.tokenize(w)] for w in _signs(probes)] == self.whole(probes)
        self.reset()
        self.memo = tk.WordMemo(self.learn, MEMO_UNITS)

    def reset(self) -> None:
        self.flat, self.at, self.len = np.array([END_ID], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def whole(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, each unit's first id, each unit's number of ids). Units of Latin letters go straight to the model if the tokenizer's other steps only fold them (probed)."""
        ids, ends, place, rest = [], [], [], range(len(units))
        if self.direct:
            tokenize, words = self.model.tokenize, "\n".join(units).lower().split("\n")
            told = list(map(bool, map(_LATIN.fullmatch, words)))
            place, rest = np.flatnonzero(told).tolist(), np.flatnonzero(np.logical_not(told)).tolist()
            for word in itertools.compress(_signs(words), told):
                ids += [t.id for t in tokenize(word)]
                ends.append(len(ids))
        for x in self.whole([units[i] for i in rest]):
            ids += x
            ends.append(len(ids))
        first, size = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
        place = np.array([*place, *rest], np.int64)
        first[place] = [0, *ends[:-1]] if ends else []
        size[place] = np.diff(ends, prepend=0)
        return np.array(ids, np.uint32), first, size

    def learn(self, new: list[bytes] | None) -> None:
        if new is None:
            self.reset()
            return
        ids, first, size = self.encode(b"\n".join(new).decode().split("\n"))
        self.at = np.concatenate([self.at, self.flat.size + first])
        self.len = np.concatenate([self.len, size])
        self.flat = np.concatenate([self.flat, ids])

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row, ids, each text's first id): every text closed by END_ID."""
        for lo, hi, buf, offs in tk.blocks(column, ENCODE_BYTES):
            buf, starts, ends, at = units(buf, offs)
            word = np.insert(self.memo(buf, starts, ends) + 1, at[1:], 0)
            n = self.len[word]
            upto = np.cumsum(n)
            ids = self.flat[np.repeat(self.at[word] - upto + n, n) + np.arange(upto[-1])]
            yield lo, hi, ids, np.concatenate([[0], upto[at[1:] + np.arange(hi - lo)]])


def cut_points(ends: np.ndarray, penalty: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """The chosen cuts, ascending, of a stream whose allowed cuts are `ends` (ascending, the last one its length)."""
    p = np.concatenate([[0], ends]).astype(np.int64)
    jumps: list[list[int] | None] = [None] * len(p)
    for k in range(LEAST_POWER, capacity.bit_length() - 1):
        i = np.searchsorted(p, p - (1 << k))
        m = np.flatnonzero((p[i] == p - (1 << k)) & (p >= 1 << k))
        for b, a in zip(m.tolist(), i[m].tolist(), strict=True):
            if jumps[b] is None:
                jumps[b] = [a]
            else:
                jumps[b].append(a)
    pos, pen, n = p.tolist(), [0.0, *penalty.tolist()], len(p)
    f, back, key = [0.0] * n, [0] * n, [0.0] * n
    queue, head, v = [0] * n, 0, 0.0
    end = 0  # of the queue: ascending starts with ascending keys
    for j in range(1, n):
        while end > head and key[queue[end - 1]] >= v:
            end -= 1
        queue[end] = j - 1
        end += 1
        at = pos[j]
        while at - pos[queue[head]] > capacity:
            head += 1
        i = queue[head]
        best = key[i] + capacity - at
        if jumps[j] is not None:
            for a in jumps[j]:
                if f[a] < best:
                    best, i = f[a], a
        best += pen[j]
        f[j], back[j] = best, i
        key[j] = v = best + at
    out, j = [], n - 1
    while j:
        out.append(pos[j])
        j = back[j]
    return out[::-1]


def allowed_cuts(ids: np.ndarray, first: np.ndarray, sentence_end: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a block may be cut, and their penalties."""
    kind = np.zeros(ids.size + 1, np.int8)  # 1 sentence end, 2 document end, 3 inside a sentence
    kind[1:][sentence_end[ids]] = 1
    kind[first[1:]] = 2
    points = np.concatenate([[0], np.flatnonzero(kind)])
    gaps = np.flatnonzero(np.diff(points) > HARD_EVERY)
    hard = [np.arange(a + HARD_EVERY, b, HARD_EVERY) for a, b in zip(points[gaps], points[gaps + 1], strict=True)]
    powers = 1 << np.arange(LEAST_POWER, capacity.bit_length())
    tail = ids.size - np.concatenate([powers, (powers[:, None] + powers).ravel()])
    more = np.concatenate([*hard, tail[tail > 0]]).astype(np.int64)
    kind[more[kind[more] == 0]] = 3
    every = np.flatnonzero(kind)
    return every, np.array([0.0, SENTENCE_CUT, 0.0, HARD_CUT])[kind[every]]


def _pack(spec, ids_too: bool, memo_units: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = spec.value
        encoder = tk.kept(("encoder", text), lambda: Encoder(text))
        encoder.memo.limit = memo_units
        sequence = TaskContext.get().partitionId() << 32
        docs, parts, held = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal sequence, docs, parts, held
            ids = np.concatenate([x for x, _ in parts])
            shift = np.cumsum([0, *(x.size for x, _ in parts)])
            first = np.concatenate([[0], *(f[1:] + s for (_, f), s in zip(parts, shift[:-1], strict=True))])
            cuts = np.array([0, *cut_points(*allowed_cuts(ids, first, encoder.sentence_end))])
            opens = np.zeros(ids.size + 1, bool)
            opens[cuts[:-1]] = opens[first[:-1]] = True
            a = np.flatnonzero(opens)
            b = np.concatenate([a[1:], [ids.size]])
            doc, seq = np.searchsorted(first, a, "right") - 1, np.searchsorted(cuts, a, "right") - 1
            raw = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            used = np.diff(cuts)[seq]
            padded = np.where(used & (used - 1), CAPACITY, used)
            cols = [pa.array(docs, pa.int64()).take(pa.array(doc)), a - first[doc], b - a, pa.array(crc, pa.int64()), np.diff(first)[doc], seq + sequence, a - cuts[seq], used, padded]
            if ids_too:
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(a, ids.size).astype(np.int32)), pa.array(ids.astype(np.int32))))
            sequence += len(cuts) - 1
            docs, parts, held = [], [], 0
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in cols], NAMES + ["ids"] * ids_too)

        for batch in batches:
            key = batch.column(0)
            for lo, hi, ids, first in encoder(batch.column(1)):
                docs += key[lo:hi].to_pylist()
                parts.append((ids, first))
                held += ids.size
                if held >= BLOCK_TOKENS:
                    yield close()
        if parts:
            yield close()

    return run


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "sequence_length"]


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, ids_too: bool = False, memo_units: int = MEMO_UNITS) -> DataFrame:
    """One row per piece of a document: where it lies in its document and in its sequence; with ids_too, its token ids.

    Each id lies in exactly one piece. A null or empty text is the closing id alone. Rows that repeat a doc_id, and rows
    with a null one, are packed as documents of their own. A text longer than a window is cut at its sentences. An empty
    table gives no rows. tokenizer is a path on the driver; the file (some MB) is broadcast. memo_units bounds a worker's word cache. Other columns are ignored.
    A block is packed by itself, so memory follows BLOCK_TOKENS and the longest document, and a lost task repeats alone.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    schema = ", ".join(f"{n} long" for n in NAMES) + ", ids array<int>" * ids_too
    bound_batches(spark)
    return docs.select("doc_id", "text").mapInArrow(tk.tidy(_pack(spec, ids_too, memo_units)), schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of the rows of documents; nulls, ties and repeats as in pack()."""
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())

"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Every word is framed as `<word>` and cut into byte n-grams of three to five, each hashed to a row of an embedding table; a
text is the average over all n-grams of all its words. Table and softmax are trained together by stochastic gradient
descent in NumPy on a bounded sample. A temperature fitted on held-back rows turns the scores into probabilities, and the
thresholds of rejection are low quantiles of what held-back rows reach, one for each class of lengths, as short texts are
less sure than long ones.
"""

from __future__ import annotations

import copy
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .workspace import bound_batches

GRAMS = (3, 4, 5)
BUCKETS, WIDTH = 1 << 15, 16
#: The classifier sees at most about so many labelled rows of a language, and from each so many runs of words: of random length up to RUN_WORDS,
#: and of those longer than RUN_CHARS a random stretch of so many characters.
ROWS_PER_LANG, RUNS, RUN_WORDS, RUN_CHARS = 400, 6, 60, 1200
#: A bound on the sample as well: languages are taken in order of their counts, up to so many.
MOST_LANGS = 500
EPOCHS, RATE = 4, 0.5
#: Of held-back runs of a length (in words, up to each end) at most this part may be rejected, and none whose probability is above the bound.
REJECTED, LENGTHS, LEAST_SURE = 0.002, (3, 15, 47), (0.5, 0.5, 0.7, 0.85)
UNKNOWN = "und"
#: Words whose logits a worker keeps in mind.
MEMO_WORDS = 150_000


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of the framed words."""
    buf = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    whose, where = [], []
    for n in GRAMS:
        if buf.size < n:
            continue
        h = np.full(buf.size - n + 1, n, np.uint32)
        for j in range(n):
            h = h * np.uint32(0x01000193) ^ buf[j : j + h.size] * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        inside = owner[: h.size] == owner[n - 1 :]
        whose.append(owner[: h.size][inside])
        where.append((h[inside] & np.uint32(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(whose), np.concatenate(where)


@dataclass
class LanguageModel:
    langs: list[str]
    #: A row of logits for each bucket: embedding times softmax weights.
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    #: Least probability that is accepted, by class of lengths.
    thresholds: list[float]
    _sums: np.ndarray = field(default=None, repr=False)
    _memo: object = field(default=None, repr=False)

    def _learn(self, new: list[bytes] | None) -> None:
        k = len(self.langs)
        if new is None:
            self._sums = np.zeros((0, k + 1))
            return
        whose, where = grams(new)
        sums = np.stack([np.bincount(whose, self.logits[where, c], len(new)) for c in range(k)] + [np.bincount(whose, minlength=len(new))], axis=1)
        self._sums = np.concatenate([self._sums, sums])

    def probabilities(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities of every text, and its number of words; a text without words gets those of the bias."""
        if self._memo is None:
            self._learn(None)
            self._memo = tk.WordMemo(self._learn, MEMO_WORDS)
        out, size = [], []
        for lo, hi, buf, offs in tk.blocks(column):
            starts, ends, at = tk.words(buf, offs)
            word = self._memo(buf, starts, ends, lower=True)
            sums = self._sums[word]
            upto = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0)])
            total = upto[at[1:]] - upto[at[:-1]]
            z = (total[:, :-1] / np.maximum(total[:, -1:], 1) + self.bias) / self.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(p / p.sum(axis=1, keepdims=True))
            size.append(np.diff(at))
        return (np.concatenate(out), np.concatenate(size)) if out else (np.zeros((0, len(self.langs))), np.zeros(0, np.int64))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], held: list[bool], seed: int = 5) -> LanguageModel:
    """Trains on the runs that are not held back, then fits temperature and thresholds on the others."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], np.int64)
    bags, size = [], []
    for t in texts:
        w = t.encode().lower().split()
        size.append(len(w))
        bags.append(np.unique(grams(w)[1], return_counts=True) if w else (np.zeros(0, np.int64), np.zeros(0)))
    bags = [(i, (c / c.sum()).astype(np.float32)) for i, c in bags]
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((BUCKETS, WIDTH)) / WIDTH).astype(np.float32)
    soft, bias = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    train = np.array([i for i, h in enumerate(held) if not h and bags[i][0].size], np.int64)
    steps, done = EPOCHS * max(1, train.size), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            ids, c = bags[i]
            rate = RATE * (1 - done / steps) + 0.01
            done += 1
            x = c @ emb[ids]
            g = _softmax(x @ soft + bias)
            g[y[i]] -= 1
            back = soft @ g
            soft -= rate * np.outer(x, g)
            bias -= 0.1 * rate * g
            emb[ids] -= rate * 8 * c[:, None] * back
    table = emb @ soft
    z = np.array([c @ table[i] + bias if i.size else bias for i, c in bags]).reshape(len(bags), len(names))
    check = np.array(held, bool) if any(held) else np.ones(len(held), bool)
    heats = np.geomspace(0.05, 5, 60)
    loss = [-np.log(np.maximum(_softmax(z[check] / t)[np.arange(check.sum()), y[check]], 1e-12)).mean() if check.any() else t for t in heats]
    heat = float(heats[int(np.argmin(loss))])
    sure = _softmax(z[check] / heat).max(axis=1) if check.any() else np.ones(1)
    kind = np.searchsorted(LENGTHS, np.array(size)[check]) if check.any() else np.zeros(1, np.int64)
    least = [float(min(bound, np.quantile(sure[kind == c], REJECTED))) if (kind == c).any() else bound for c, bound in enumerate(LEAST_SURE)]
    return LanguageModel(names, table, bias, heat, least)


def _remainder(n: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(-1))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Random runs of words of a sampled text."""
    for batch in batches:
        text, lang, held = [], [], []
        for d, t, la in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seed = zlib.crc32(str(d).encode())
            rng, w = np.random.default_rng(seed), t.split()
            for k in range(RUNS):
                n = int(rng.integers(1, RUN_WORDS + 1)) if k else RUN_WORDS
                at = int(rng.integers(0, max(1, len(w) - n + 1)))
                run = " ".join(w[at : at + n])
                cut = int(rng.integers(0, max(1, len(run) - RUN_CHARS + 1)))
                text.append(run[cut : cut + RUN_CHARS])
                lang.append(la)
                held.append(seed // 7 % 5 == 0)
        yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(lang, pa.string()), pa.array(held, pa.bool_())], ["text", "lang", "held"])


def train(docs: DataFrame, fold: int = 4, left_out: int = 2) -> LanguageModel | None:
    """Learns from text and lang of rows with both and an id, outside the left-out fold; None if there are none.

    Languages with equal counts come in the order of their names. Rows that repeat a doc_id are drawn or not together, each
    with its own text and lang; copies count as often as they come. Blank texts teach nothing.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (_remainder(fold) != left_out))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()
    if not counts:
        return None
    chance = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, ROWS_PER_LANG / r["count"])))))
    luck = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.filter(luck < chance[F.col("lang")]).select("doc_id", "text", "lang").mapInArrow(_runs, "text string, lang string, held boolean").collect()
    return fit([r.text for r in sample], [r.lang for r in sample], [r.held for r in sample])


def identify(spark: SparkSession, docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """docs with lang_pred, score and accepted added (they replace columns of these names).

    A null text or one without a letter, and any text if there is no model, is `und` with score 0 and not accepted. Any
    other text gets the likeliest learned language, the first by name on ties, and is accepted unless its calibrated
    probability is under the threshold of its length. Every word of a text counts, however long the text.
    """
    docs = docs.drop("lang_pred", "score", "accepted")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "accepted": F.lit(False)})
    told, tag = spark.sparkContext.broadcast(model), ("language", uuid.uuid4().hex)
    bound_batches(spark)

    @F.arrow_udf("struct<lang_pred: string, score: double, sure: boolean>")
    def guess(text: pa.Array) -> pa.Array:
        # a copy, whose word cache ends when another operator's begins or the worker is idle
        p, size = tk.kept(tag, lambda: copy.copy(told.value)).probabilities(text)
        best = p.argmax(axis=1)
        score = p[np.arange(len(p)), best]
        sure = score >= np.array(told.value.thresholds)[np.searchsorted(LENGTHS, size)]
        tk.idle()
        return pa.StructArray.from_arrays([pa.array(told.value.langs, pa.string()).take(pa.array(best)), pa.array(score), pa.array(sure)], ["lang_pred", "score", "sure"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = docs.withColumn("_g", guess("text"))
    out = out.withColumns({"lang_pred": F.when(lettered, F.col("_g.lang_pred")).otherwise(UNKNOWN), "score": F.when(lettered, F.col("_g.score")).otherwise(0.0)})
    return out.withColumn("accepted", lettered & F.col("_g.sure")).drop("_g")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents; nulls, ties and repeats as in train() and identify()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(spark, docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "accepted")

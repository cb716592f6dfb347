"""Toxicity: a bidirectional gated recurrent network with attention pooling, over character and word inputs.

A word's input is the embedding of its hashed form beside the mean embedding of its character trigrams. Windows of
WINDOW words that overlap by half are read in both directions, pooled by attention and scored; a text's score is that of its
worst window. Training is NumPy on a bounded labelled sample: first on random windows under their text's label, then on the
worst window of each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .workspace import bound_batches

WINDOW, STRIDE = 64, 32
WORD_BUCKETS, CHAR_BUCKETS = 1 << 14, 1 << 13
WORD_WIDTH, CHAR_WIDTH, HIDDEN = 12, 12, 8
#: The classifier sees at most about so many labelled rows of each class, and so many windows of each.
POSITIVE_ROWS, NEGATIVE_ROWS, WINDOWS_PER_ROW = 900, 1400, 12
WARM_EPOCHS, WORST_EPOCHS, BATCH, RATE = 2, 12, 128, 8e-3
CUT = 0.7
F32 = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    x = _sigmoid(2 * x)
    x *= 2
    x -= 1
    return x


def word_inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's bucket, and (word, bucket) of all its trigrams. Punctuation at a word's ends is cut off."""
    bare = [w.strip(b".,;:!?\"'()[]{}*%$&#|-_") or w for w in words]
    buf = np.frombuffer(b"".join(b"<" + w + b">" for w in bare), np.uint8).astype(np.uint32)
    size = np.array([len(w) + 2 for w in bare], np.int64)
    owner, first = np.repeat(np.arange(len(bare)), size), np.cumsum(size) - size
    x = buf * np.uint32(0x9E3779B1)
    tri = (x[:-2] * np.uint32(31) + x[1:-1]) * np.uint32(37) + x[2:]
    tri ^= tri >> np.uint32(13)
    inside = owner[:-2] == owner[2:]
    place = (np.arange(buf.size) - first[owner]).astype(np.uint32)
    whole = np.add.reduceat(tk.mix((buf.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place), first)
    return (whole % np.uint64(WORD_BUCKETS)).astype(np.int64), owner[:-2][inside], (tri[inside] % np.uint32(CHAR_BUCKETS)).astype(np.int64)


class Reader:
    """The network's weights, its forward pass and its gradients. Word 0 of a vocabulary is padding."""

    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        d, h = WORD_WIDTH + CHAR_WIDTH, HIDDEN
        norm = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(F32)
        self.w = {"word": norm(WORD_BUCKETS, WORD_WIDTH, k=0.15), "char": norm(CHAR_BUCKETS, CHAR_WIDTH, k=0.15), "att": norm(2 * h, k=0.1), "out": norm(2 * h, k=0.3), "bias": np.zeros(1, F32)}
        for way in "fb":
            self.w |= {f"in{way}": norm(d, 3 * h, k=d**-0.5), f"u{way}": norm(h, 3 * h, k=h**-0.5), f"c{way}": np.zeros(3 * h, F32)}

    def embed(self, inputs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        whole, owner, tri = inputs
        n = np.maximum(1, np.bincount(owner, minlength=whole.size)).astype(F32)
        chars = np.stack([np.bincount(owner, self.w["char"][tri, c], whole.size) for c in range(CHAR_WIDTH)], axis=1).astype(F32)
        return np.concatenate([self.w["word"][whole], chars / n[:, None]], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """The gates' share of the input, both directions side by side: once per distinct word."""
        return np.concatenate([x @ self.w["inf"] + self.w["cf"], x @ self.w["inb"] + self.w["cb"]], axis=1)

    def forward(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: `at` (steps, windows) points into the rows of gates."""
        steps, n = at.shape
        h = HIDDEN
        states, tape = np.zeros((steps, n, 2 * h), F32), []
        for way, u in enumerate((self.w["uf"], self.w["ub"])):
            s, cols = np.zeros((n, h), F32), slice(way * 3 * h, (way + 1) * 3 * h)
            own = np.ascontiguousarray(gates[:, cols])
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                x, g = own[at[t]], s @ u
                zr = _sigmoid(x[:, : 2 * h] + g[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = _tanh(x[:, 2 * h :] + r * g[:, 2 * h :])
                if keep:
                    tape.append((way, t, s, z, r, g[:, 2 * h :], new))
                s = (new + z * (s - new)) * mask[t][:, None]
                states[t, :, way * h : (way + 1) * h] = s
        a = states @ self.w["att"]
        a = np.exp(a - a.max(axis=0)) * mask
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", a, states)
        logit = pooled @ self.w["out"] + self.w["bias"]
        return (logit, (states, a, pooled, tape)) if keep else logit

    def backward(self, dlogit: np.ndarray, saved, x: np.ndarray, at: np.ndarray, mask: np.ndarray, inputs) -> dict[str, np.ndarray]:
        """Gradients of sum(dlogit * logit); those of the tables as (rows, values)."""
        states, a, pooled, tape = saved
        h, w = HIDDEN, self.w
        grad = {"out": pooled.T @ dlogit, "bias": dlogit.sum(keepdims=True)}
        dpool = dlogit[:, None] * w["out"]
        da = np.einsum("nh,tnh->tn", dpool, states)
        dscore = a * (da - (a * da).sum(axis=0))
        grad["att"] = np.einsum("tn,tnh->h", dscore, states)
        dstates = a[:, :, None] * dpool + dscore[:, :, None] * w["att"]
        dgates = np.zeros((x.shape[0], 6 * h), F32)
        for way, name in enumerate("fb"):
            u, du, ds = w[f"u{name}"], np.zeros_like(w[f"u{name}"]), np.zeros((at.shape[1], h), F32)
            for _, t, s, z, r, gn, new in reversed([e for e in tape if e[0] == way]):
                ds = (ds + dstates[t, :, way * h : (way + 1) * h]) * mask[t][:, None]
                dn = ds * (1 - z) * (1 - new * new)
                dz = ds * (s - new) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(dgates[:, way * 3 * h : (way + 1) * 3 * h], at[t], np.concatenate([dz, dr, dn], axis=1))
                du += s.T @ dg
                ds = ds * z + dg @ u.T
            part = dgates[:, way * 3 * h : (way + 1) * 3 * h]
            grad |= {f"u{name}": du, f"in{name}": x.T @ part, f"c{name}": part.sum(axis=0)}
        dx = dgates[:, : 3 * h] @ w["inf"].T + dgates[:, 3 * h :] @ w["inb"].T
        whole, owner, tri = inputs
        n = np.maximum(1, np.bincount(owner, minlength=whole.size)).astype(F32)
        grad["word"] = (whole, dx[:, :WORD_WIDTH])
        grad["char"] = (tri, (dx[:, WORD_WIDTH:] / n[:, None])[owner])
        return grad


class Adam:
    def __init__(self, w: dict[str, np.ndarray], rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def step(self, w: dict[str, np.ndarray], grad: dict) -> None:
        self.t += 1
        rate = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, g in grad.items():
            rows = slice(None)
            if isinstance(g, tuple):
                rows, back = np.unique(g[0], return_inverse=True)
                total = np.zeros((rows.size, g[1].shape[1]), F32)
                np.add.at(total, back, g[1])
                g = total
            self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * g
            self.v[k][rows] = 0.999 * self.v[k][rows] + 0.001 * g * g
            w[k][rows] -= rate * self.m[k][rows] / (np.sqrt(self.v[k][rows]) + 1e-6)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of every window, from each text's first word (one more entry than texts); an empty text has one of length 0."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - STRIDE) // STRIDE))
    text = np.repeat(np.arange(n.size), count)
    start = (np.arange(text.size) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return text, first[text] + start, np.minimum(WINDOW, n[text] - start)


def unrepeated(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one word read as one: the codes that differ from the one before in their text, and each text's first."""
    new = np.ones(code.size, bool)
    new[1:] = code[1:] != code[:-1]
    new[first[:-1][first[:-1] < code.size]] = True
    return code[new], np.concatenate([[0], np.cumsum(new)])[first]


def _padded(code: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, windows) codes with 0 for padding, and the mask."""
    steps = np.arange(max(1, int(size.max(initial=0))))[:, None]
    mask = steps < size
    return np.where(mask, code[np.minimum(start + steps, max(0, code.size - 1))] if code.size else 0, 0), mask.astype(F32)


def fit(texts: list[bytes], labels: list[int], seed: int = 9) -> Reader:
    """Trains on sampled texts. At the end the bias moves so that CUT is the score which parts the classes best on a held-back fifth."""
    rng, net = np.random.default_rng(seed), Reader(seed)
    vocab: dict[bytes, int] = {b"": 0}
    code, first = [], [0]
    for t in texts:
        code += [vocab.setdefault(w, len(vocab)) for w in t.lower().split()]
        first.append(len(code))
    code, first = unrepeated(np.array(code, np.int64), np.array(first))
    inputs = word_inputs(list(vocab))
    text, start, size = windows(first)
    y, adam = np.array(labels, F32), Adam(net.w, RATE)
    held = rng.random(y.size) < 0.2
    if y.size < 100 or not 0 < y[held].mean() < 1:
        held[:] = False
    weight = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean())).astype(F32) if y.size else y

    def learn(chosen: np.ndarray, clean: np.ndarray) -> None:
        """On whole windows, and on short stretches of clean ones: a few plain words alone are no sign of anything."""
        short = np.minimum(rng.integers(1, 9, clean.size), size[clean])
        every = np.concatenate([chosen, clean])
        long = np.concatenate([size[chosen], short])
        begin = np.concatenate([start[chosen], start[clean] + rng.integers(0, np.maximum(1, size[clean] - short + 1))])
        for pick in np.array_split(rng.permutation(every.size), max(1, every.size // int(np.clip(every.size // 16, 16, BATCH)))):
            part = every[pick]
            at, mask = _padded(code, begin[pick], long[pick])
            used, at = np.unique(at, return_inverse=True)
            at = at.reshape(mask.shape)
            _, owner, tri = inputs
            mine = np.isin(owner, used)
            sub = (inputs[0][used], np.searchsorted(used, owner[mine]), tri[mine])
            x = net.embed(sub)
            logit, saved = net.forward(net.project(x), at, mask, keep=True)
            d = (1 / (1 + np.exp(-logit)) - y[text[part]]) * weight[text[part]] / part.size
            adam.step(net.w, net.backward(d.astype(F32), saved, x, at, mask, sub))

    def worst() -> tuple[np.ndarray, np.ndarray]:
        """Each text's worst window, and its logit."""
        gates = net.project(net.embed(inputs))
        logit = np.concatenate([net.forward(gates, *_padded(code, start[i], size[i])) for i in np.array_split(np.arange(text.size), max(1, text.size // 2048))])
        order = np.lexsort((-logit, text))
        order = order[np.concatenate([[True], np.diff(text[order]) > 0])]
        return order, logit[order]

    clean = np.flatnonzero((y[text] == 0) & ~held[text])
    if y.size and 0 < y.mean() < 1:
        for _ in range(WARM_EPOCHS):
            learn(rng.permutation(np.flatnonzero(~held[text]))[: 8 * y.size], rng.permutation(clean)[: 2 * y.size])
        rounds = WORST_EPOCHS * max(1, min(4, 1200 // y.size))  # a small sample is read more often
        for _ in range(rounds):
            top = worst()[0]
            learn(np.concatenate([top[~held], rng.permutation(clean)[: y.size // 4]]), rng.permutation(clean)[: y.size // 2])
            adam.rate *= 0.1 ** (1 / rounds)
        logit, true = worst()[1], y
        if held.any():
            logit, true = logit[held], y[held]
        up = np.argsort(logit)
        wrong = np.cumsum(true[up]) + (true == 0).sum() - np.cumsum(true[up] == 0)
        at = np.flatnonzero(wrong == wrong.min())
        at = int(at[at.size // 2])
        edge = (logit[up[at]] + logit[up[min(at + 1, up.size - 1)]]) / 2
        net.w["bias"] += F32(np.log(CUT / (1 - CUT)) - edge)
    return net


def _fold() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(-1))


def _parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A sampled row's text, or from a long one so many random stretches of whole windows."""
    most = WINDOWS_PER_ROW * STRIDE
    for pdf in frames:
        out = []
        for t, d in zip(pdf["text"], pdf["doc_id"], strict=True):
            w = t.split()
            at = int(np.random.default_rng(abs(int(d))).integers(0, len(w) - most + 1)) if len(w) > most else 0
            out.append(" ".join(w[at : at + most]))
        yield pd.DataFrame({"text": out, "toxic": pdf["toxic"].to_numpy()})


def train(docs: DataFrame, labels: DataFrame) -> Reader:
    """Learns from a bounded sample of labelled rows outside the held-out third; an untrained network scores if there are none of a class.

    Null texts, null ids and other labels than 0 and 1 teach nothing; an id labelled both ways is toxic. Rows that repeat a
    doc_id all carry its label. Ties are broken by the text.
    """
    known = labels.select("doc_id", "toxic").filter((_fold() != 1) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    most = {1: POSITIVE_ROWS, 0: NEGATIVE_ROWS}
    luck = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    pick = F.when(F.col("toxic") == 1, luck < most[1] / max(1, counts.get(1, 0))).otherwise(luck < most[0] / max(1, counts.get(0, 0)))
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(known.filter(pick)), "doc_id")
    sample = rows.mapInPandas(_parts, "text string, toxic int").toPandas()
    sample = sample.sort_values(["toxic", "text"])
    return fit([t.encode() for t in sample["text"]], sample["toxic"].astype(int).tolist())


class Scorer:
    """Scores Arrow batches of whole texts; caches the input gates of the words it has met."""

    def __init__(self, net: Reader):
        self.net, self.memo = net, tk.WordMemo(self.learn, 150_000)
        self.learn(None)

    def learn(self, new: list[bytes] | None) -> None:
        if new is None:
            self.parts = [np.zeros((1, 6 * HIDDEN), F32)]
        else:
            self.parts.append(self.net.project(self.net.embed(word_inputs(new))))

    def __call__(self, column: pa.Array) -> np.ndarray:
        out = []
        for lo, hi, buf, offs in tk.blocks(column):
            starts, ends, at = tk.words(buf, offs)
            code = self.memo(buf, starts, ends, lower=True) + 1 if starts.size else np.zeros(0, np.int64)
            code, at = unrepeated(code, at)
            self.parts = [np.concatenate(self.parts)] if len(self.parts) > 1 else self.parts
            used, code = np.unique(code, return_inverse=True)
            gates = np.concatenate([np.zeros((1, 6 * HIDDEN), F32), self.parts[0][used]])
            text, start, size = windows(at)
            best = np.full(hi - lo, -np.inf)
            for i in range(0, text.size, 1024):
                part = slice(i, i + 1024)
                np.maximum.at(best, text[part], self.net.forward(gates, *_padded(code + 1, start[part], size[part])))
            out.append(1 / (1 + np.exp(-np.clip(best, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def score(spark: SparkSession, docs: DataFrame, net: Reader) -> DataFrame:
    """docs with score and predicted added (they replace columns of these names).

    Every word of a text lies in a window, however long the text. A null, empty or blank text is read as one empty window
    and gets the score of the bias. Repeated rows and copies score alike. An empty table gives no rows.
    """
    told = spark.sparkContext.broadcast(net)
    bound_batches(spark)
    held: list[Scorer] = []

    @F.pandas_udf("double")
    def toxic(text: pd.Series) -> pd.Series:
        if not held:
            held.append(Scorer(told.value))
        return pd.Series(held[0](pa.array(text, pa.string(), from_pandas=True)))

    return docs.drop("score", "predicted").withColumn("score", toxic("text")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents; nulls, ties and repeats as in train() and score()."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(spark, docs.select("doc_id", "text"), train(docs, labels)).select("doc_id", (_fold() == 1).alias("held_out"), "score", "predicted")

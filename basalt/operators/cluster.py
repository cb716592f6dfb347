"""Clustering: k-means, density clustering and Gaussian mixtures."""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..sources.workspace import checkpoints
from .base import Operator, numbered

#: Points of a slice of a dense grid cell at least, and cells that may be cut into slices.
SLICE_POINTS, SLICED_CELLS = 2000, 500_000


def _point(features):
    return F.array(*(F.col(f).cast("double") for f in features))


class _Centred(Operator):
    kind = "clusterer"

    def _nearest(self, centers):
        d = F.array(*(expr.total([(F.col(f) - float(c)) ** 2 for f, c in zip(self.features, row, strict=True)]) for row in centers))
        return F.struct((F.array_position(d, F.array_min(d)) - 1).cast("int").alias("cluster"), F.array_min(d).alias("d"))

    def predict(self, df):
        """prediction: number of the nearest centre, the lowest on ties."""
        self._check("cluster_centers_")
        return df.withColumn("prediction", self._nearest(self.cluster_centers_)["cluster"])

    transform = predict

    def fit_predict(self, df):
        return self.fit(df).predict(df)

    def score(self, df=None):
        return -self.inertia_


class KMeans(_Centred):
    """Lloyd's steps, one aggregate each; an empty cluster keeps its centre; the best of n_init starts. init may be given centres."""

    def __init__(self, features, n_clusters=8, init="kmeans++", n_init=10, max_iter=300, tol=1e-4, random_state=0):
        self.features, self.n_clusters, self.init, self.n_init, self.max_iter, self.tol, self.random_state = features, n_clusters, init, n_init, max_iter, tol, random_state

    def _points(self, df):
        """(features, _n): each distinct point once, with its number of rows; a start drawn from these never holds a point twice."""
        return df.groupBy(*self.features).agg(F.count("*").alias("_n"))

    def _wait(self, seed):
        """Exponential waiting time at the rate of a point's rows: the k least are k rows' points drawn without replacement."""
        u = (F.pmod(F.xxhash64(*self.features, F.lit(seed)), F.lit(1 << 50)) + 1) / F.lit(float((1 << 50) + 2))
        return -F.log(u) / F.col("_n")

    def _start(self, points, seed):
        if not isinstance(self.init, str):
            return np.array(self.init, float)
        pick = lambda key, n: np.array([list(r) for r in points.orderBy(key, *self.features).select(*self.features).limit(n).collect()], float)
        if self.init == "random":
            return pick(self._wait(seed), self.n_clusters)
        c = pick(self._wait(seed), 1)
        while len(c) < self.n_clusters:  # weighted by rows and squared distance; a point that is a centre never comes
            more = pick(F.coalesce(self._wait(seed + 7919 * len(c)) / F.nullif(self._nearest(c)["d"], F.lit(0.0)), F.lit(float("inf"))), 1)
            c = np.vstack([c, more])
        return c

    def fit(self, df):
        df, best = df.persist(), None
        points = self._points(df).persist() if isinstance(self.init, str) else None
        for start in range(self.n_init if points is not None else 1):
            c = self._start(points, (self.random_state or 0) * 1000 + start)
            for n_iter in range(1, self.max_iter + 1):
                rows = df.withColumn("_n", self._nearest(c)["cluster"]).groupBy("_n").agg(*(F.avg(f).alias(f) for f in self.features)).collect()
                new = c.copy()
                for r in rows:
                    new[r["_n"]] = [r[f] for f in self.features]
                shift, c = np.linalg.norm(new - c), new
                if shift < self.tol:
                    break
            inertia = df.agg(F.sum(self._nearest(c)["d"])).first()[0]
            if best is None or inertia < best[0]:
                best = (inertia, c, n_iter)
        df.unpersist()
        if points is not None:
            points.unpersist()
        self.inertia_, self.cluster_centers_, self.n_iter_ = best
        return self


class MiniBatchKMeans(_Centred):
    """Each step takes batch_size rows without replacement (all, if there are fewer); counts start at 1. partial_fit takes one batch."""

    def __init__(self, features, n_clusters=8, batch_size=256, max_iter=100, random_state=0):
        self.features, self.n_clusters, self.batch_size, self.max_iter, self.random_state = features, n_clusters, batch_size, max_iter, random_state

    def partial_fit(self, batch):
        if getattr(self, "cluster_centers_", None) is None:
            start = KMeans(self.features, self.n_clusters, random_state=self.random_state)
            self.cluster_centers_ = start._start(start._points(batch), self.random_state or 0)
            self.counts_ = np.ones(len(self.cluster_centers_))
        rows = batch.withColumn("_n", self._nearest(self.cluster_centers_)["cluster"]).groupBy("_n").agg(F.count("*").alias("_k"), *(F.avg(f).alias(f) for f in self.features)).collect()
        for r in rows:
            i = r["_n"]
            self.counts_[i] += r["_k"]
            self.cluster_centers_[i] += (np.array([r[f] for f in self.features]) - self.cluster_centers_[i]) / self.counts_[i]
        return self

    def fit(self, df):
        checkpoints(df.sparkSession)
        # rows are told apart by a number that is written with them, so copies of a point are drawn one by one
        self.cluster_centers_, df = None, df.select(*self.features, F.monotonically_increasing_id().alias("_row")).checkpoint()
        luck = lambda i: F.pmod(F.xxhash64("_row", F.lit(i), F.lit(self.random_state or 0)), F.lit(1 << 50)) / F.lit(float(1 << 50))
        share = min(1.0, 4 * self.batch_size / max(1, df.count()))
        for i in range(self.max_iter):
            self.partial_fit(df.filter(luck(i) <= share).orderBy(luck(i)).limit(self.batch_size))
        self.inertia_ = df.agg(F.sum(self._nearest(self.cluster_centers_)["d"])).first()[0]
        return self


def _components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, comp): least node reachable over the edges (a, b) both ways; checkpointed rounds with pointer jumps."""
    e = edges.union(edges.select("b", "a")).distinct().checkpoint()
    lab = nodes.select("node", F.col("node").alias("comp")).checkpoint()
    while True:
        near = e.join(lab.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        new = lab.join(near, "node", "left").select("node", F.least("comp", F.coalesce("m", "comp")).alias("comp"), F.col("comp").alias("was"))
        new = new.join(new.select(F.col("node").alias("comp"), F.col("comp").alias("far")), "comp").select("node", F.col("far").alias("comp"), "was").checkpoint()
        if not new.filter("comp != was").limit(1).count():
            return new.select("node", "comp")
        lab = new.select("node", "comp")


def _met(pts: DataFrame, cells: list, n: int, found, schema: str, extra: list[str]) -> DataFrame:
    """found(a, b, same) over blocks of points (id, x, cell, extra) of equal or adjacent cells; same tells that both are one cell.

    A cell of many points is cut into slices, each pair of which is a block of its own, so no task holds a dense cell and no
    pair is a row. Slices hold so many points that at most SLICED_CELLS cells need them, which are broadcast.
    """
    bar = max(SLICE_POINTS, -(-n // SLICED_CELLS))
    hot = pts.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > bar).select("cell", F.ceil(F.col("n") / bar).cast("int").alias("parts"))
    steps = F.array(*(F.array(*map(F.lit, s)) for s in itertools.product((-1, 0, 1), repeat=len(cells))))
    near = pts.withColumn("other", F.explode(F.transform(steps, lambda s: F.zip_with("cell", s, lambda a, b: a + b))))
    near = near.join(F.broadcast(hot), "cell", "left").join(F.broadcast(hot.select(F.col("cell").alias("other"), F.col("parts").alias("theirs"))), "other", "left")
    own = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("theirs", F.lit(1)) - 1))
    side = lambda k, first, second, i, j: near.filter(F.col(first) <= F.col(second)).select(F.lit(k).alias("side"), F.col(first).alias("ca"), F.col(second).alias("cb"), i.alias("i"), j.alias("j"), "id", "x", *extra)
    both = side(0, "cell", "other", own, each).union(side(1, "other", "cell", each, own))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        return found(a, b, list(pdf["ca"].iloc[0]) == list(pdf["cb"].iloc[0]))

    return both.groupBy("ca", "cb", "i", "j").applyInPandas(run, schema)


def _within(a: pd.DataFrame, b: pd.DataFrame, eps: float):
    """(rows of a, whether each point of b lies within eps of them), some rows at a time."""
    if len(a) and len(b):
        x, y = (np.array(c["x"].tolist(), float) for c in (a, b))
        for k in range(0, len(x), 256):
            yield slice(k, k + 256), ((x[k : k + 256, None] - y[None]) ** 2).sum(axis=2) <= eps * eps * (1 + 1e-12)


class DBSCAN(Operator):
    """Neighbours within eps, found between points of equal or adjacent grid cells of that width (up to three dimensions of the grid).

    A point counts itself; clusters are numbered by their first core's row_id; a border point joins the cluster with the
    smallest number; noise is -1. The cosine metric compares unit vectors at the equivalent Euclidean radius. row_id must be
    distinct integers.
    """

    kind = "clusterer"

    def __init__(self, features, row_id, eps=0.5, min_samples=5, metric="euclidean"):
        self.features, self.row_id, self.eps, self.min_samples, self.metric = features, row_id, eps, min_samples, metric

    def fit_predict(self, df):
        checkpoints(df.sparkSession)
        x = _point(self.features)
        eps = self.eps
        if self.metric == "cosine":
            norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)) + 1e-10
            x, eps = F.transform(x, lambda v: v / norm), (2 * self.eps) ** 0.5
        cells = list(range(min(3, len(self.features))))
        pts = df.select(F.col(self.row_id).cast("long").alias("id"), x.alias("x"))
        pts = pts.withColumn("cell", F.array(*(F.floor(F.col("x")[i] / eps) for i in cells))).checkpoint()
        n = pts.count()

        def counted(a, b, same):
            up, down = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            for part, ok in _within(a, b, eps):
                up[part] = ok.sum(axis=1)
                down += ok.sum(axis=0)
            out = [pd.DataFrame({"id": a["id"], "n": up})] + ([] if same else [pd.DataFrame({"id": b["id"], "n": down})])
            return pd.concat(out)

        def linked(a, b, same):
            """Links that join the block's cores: no more than there are points."""
            top, out = {}, []

            def root(i):
                while top.get(i, i) != i:
                    top[i] = top.get(top[i], top[i])
                    i = top[i]
                return i

            ids, others = a["id"].tolist(), b["id"].to_numpy()
            for part, ok in _within(a, b, eps):
                for i, near in zip(ids[part], ok, strict=True):
                    for j in others[near].tolist():
                        u, v = root(i), root(j)
                        if u != v:
                            top[max(u, v)] = min(u, v)
                            out.append((i, j))
            return pd.DataFrame(out, columns=["a", "b"])

        def reached(a, b, same):
            """The least cluster among the cores near each point."""
            none = np.iinfo(np.int64).max
            least = lambda c: c["number"].fillna(-1).astype(np.int64).replace(-1, none).to_numpy()
            up, down, na, nb = np.full(len(a), none), np.full(len(b), none), least(a), least(b)
            for part, ok in _within(a, b, eps):
                up[part] = np.where(ok, nb[None], none).min(axis=1)
                down = np.minimum(down, np.where(ok, na[part, None], none).min(axis=0))
            out = pd.concat([pd.DataFrame({"id": a["id"], "number": up})] + ([] if same else [pd.DataFrame({"id": b["id"], "number": down})]))
            return out[out["number"] < none]

        counts = _met(pts, cells, n, counted, "id long, n long", []).groupBy("id").agg(F.sum("n").alias("n"))
        core = counts.filter(F.col("n") >= self.min_samples).select("id").checkpoint()
        links = _met(pts.join(core, "id").checkpoint(), cells, n, linked, "a long, b long", [])
        comps = _components(links, core.withColumnRenamed("id", "node"))
        number = numbered(comps.select("comp").distinct(), ["comp"], "number").checkpoint()
        self.n_clusters_, self.core_sample_indices_ = number.count(), core
        cores = comps.join(number, "comp").select(F.col("node").alias("id"), "number").checkpoint()
        told = _met(pts.join(cores, "id", "left").checkpoint(), cells, n, reached, "id long, number long", ["number"]).groupBy("id").agg(F.min("number").alias("least"))
        told = told.join(cores, "id", "left").select(F.col("id").alias("_id"), F.coalesce("number", "least").cast("int").alias("prediction"))
        return df.join(told, F.col(self.row_id).cast("long") == F.col("_id"), "left").withColumn("prediction", F.coalesce("prediction", F.lit(-1))).drop("_id")

    def fit(self, df):
        self.labels_ = self.fit_predict(df)
        return self


class GaussianMixture(Operator):
    """EM; each iteration is one pass of Arrow batches that sums responsibilities and moments. full, diag or spherical.

    init_means fixes the start; else distinct points of random rows. Stops when the total log-likelihood moves less than tol.
    """

    kind = "clusterer"

    def __init__(self, features, n_components=1, covariance_type="full", max_iter=100, tol=1e-3, reg_covar=1e-6, n_init=1, random_state=0, init_means=None):
        self.features, self.n_components, self.covariance_type, self.max_iter, self.tol, self.reg_covar, self.n_init, self.random_state, self.init_means = features, n_components, covariance_type, max_iter, tol, reg_covar, n_init, random_state, init_means

    @staticmethod
    def _log_joint(x, w, means, covs):
        out = []
        for a, m, c in zip(w, means, covs, strict=True):
            chol = np.linalg.cholesky(c)
            z = np.linalg.solve(chol, (x - m).T)
            out.append(np.log(a) - 0.5 * (x.shape[1] * np.log(2 * np.pi) + (z * z).sum(axis=0)) - np.log(np.diag(chol)).sum())
        return np.array(out).T

    def _pass(self, df, params):
        k, p = self.n_components, len(self.features)

        def part(frames):
            n, s, q, ll, rows = np.zeros(k), np.zeros((k, p)), np.zeros((k, p, p)), 0.0, 0
            for pdf in frames:
                x = pdf.to_numpy(float)
                j = GaussianMixture._log_joint(x, *params)
                top = j.max(axis=1, keepdims=True)
                lse = top[:, 0] + np.log(np.exp(j - top).sum(axis=1))
                r = np.exp(j - lse[:, None])
                n, s, ll, rows = n + r.sum(axis=0), s + r.T @ x, ll + lse.sum(), rows + len(x)
                q += np.einsum("nk,ni,nj->kij", r, x, x)
            yield pd.DataFrame({"v": [np.concatenate([[ll, rows], n, s.ravel(), q.ravel()])]})

        sums = df.select(*self.features).mapInPandas(part, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        v = np.zeros(2 + k + k * p + k * p * p)
        for r in sums:
            v[r.i] = r.v
        return v[0], v[1], v[2 : 2 + k], v[2 + k : 2 + k + k * p].reshape(k, p), v[2 + k + k * p :].reshape(k, p, p)

    def fit(self, df):
        df, p, best = df.persist(), len(self.features), None
        seeds = KMeans(self.features, self.n_components, "random")
        points = seeds._points(df).persist() if self.init_means is None else None
        for start in range(self.n_init if self.init_means is None else 1):
            means = np.array(self.init_means, float) if self.init_means is not None else seeds._start(points, (self.random_state or 0) * 1000 + start)
            params, was = (np.full(self.n_components, 1 / self.n_components), means, np.array([np.eye(p)] * self.n_components)), None
            for n_iter in range(1, self.max_iter + 1):
                ll, rows, n, s, q = self._pass(df, params)
                if was is not None and abs(ll - was) < self.tol:
                    break
                was, n = ll, n + 1e-10
                means = s / n[:, None]
                cov = q / n[:, None, None] - np.einsum("ki,kj->kij", means, means)
                if self.covariance_type != "full":
                    d = np.array([np.diag(c) for c in cov])
                    d = d if self.covariance_type == "diag" else np.repeat(d.mean(axis=1, keepdims=True), p, axis=1)
                    cov = np.array([np.diag(x) for x in d])
                params = (n / n.sum(), means, cov + self.reg_covar * np.eye(p))
            if best is None or ll > best[0]:
                best = (ll, params, n_iter, rows)
        df.unpersist()
        if points is not None:
            points.unpersist()
        self.lower_bound_, (self.weights_, self.means_, self.covariances_), self.n_iter_, _ = best
        return self

    def predict_proba(self, df):
        self._check("weights_")
        params = (self.weights_, self.means_, self.covariances_)

        @F.pandas_udf("array<double>")
        def share(x: pd.Series) -> pd.Series:
            j = GaussianMixture._log_joint(np.array(x.tolist(), float), *params)
            e = np.exp(j - j.max(axis=1, keepdims=True))
            return pd.Series(list(e / e.sum(axis=1, keepdims=True)))

        return df.withColumn("probability", share(_point(self.features)))

    def predict(self, df):
        p = F.col("probability")
        return self.predict_proba(df).withColumn("prediction", (F.array_position(p, F.array_max(p)) - 1).cast("int"))

    def score(self, df):
        """Mean log-likelihood."""
        ll, rows, *_ = self._pass(df, (self.weights_, self.means_, self.covariances_))
        return ll / rows

    def sample(self, spark, n, seed=0):
        """(features..., component), grouped by component."""
        rng = np.random.default_rng(seed)
        counts, parts = rng.multinomial(n, self.weights_), []
        for k, size in enumerate(counts):
            chol = np.linalg.cholesky(self.covariances_[k])
            z = F.array(*(F.randn(seed + 31 * k + i) for i in range(len(self.features))))
            x = spark.range(int(size)).select(z.alias("z"))
            cols = [float(self.means_[k][i]) + functools.reduce(lambda a, b: a + b, [F.col("z")[j] * float(chol[i, j]) for j in range(i + 1)]) for i in range(len(self.features))]
            parts.append(x.select(*(c.alias(f) for c, f in zip(cols, self.features, strict=True)), F.lit(k).alias("component")))
        return functools.reduce(lambda a, b: a.union(b), parts)

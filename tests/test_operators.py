"""The reference's kinds of assertions: quality floors, invariants, hand-computed values."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from conftest import _frame
from pyspark.sql import functions as F

from basalt.functions import special
from basalt.operators import base, cluster, decomposition, linear, metrics, optim, pipeline, selection, svm, trees
from basalt.operators import preprocess as pre
from basalt.operators.bayes import BernoulliNB, GaussianNB, MultinomialNB

X = ["x0", "x1", "x2", "x3"]


def design(df, cols=X):
    p = df.orderBy("row_id").toPandas()
    return p[cols].to_numpy(float), p["label"].to_numpy(float)


def test_least_squares_family(regression):
    x, y = design(regression)
    a = np.column_stack([np.ones(len(x)), x])
    m = linear.LinearRegression(X, "label").fit(regression)
    assert np.allclose([m.intercept_, *m.coef_], np.linalg.lstsq(a, y, rcond=None)[0])
    assert m.score(regression) > 0.9
    r = linear.RidgeRegression(X, "label", 5.0).fit(regression)
    assert np.allclose([r.intercept_, *r.coef_], np.linalg.solve(a.T @ a + np.diag([0, 5, 5, 5, 5]), a.T @ y))
    gd = linear.LinearRegression(X, "label", "gd", 0.1, 300).fit(regression)
    assert gd.losses_[-1] < gd.losses_[0] and np.allclose(gd.coef_, m.coef_, atol=1e-3)
    sparse = linear.LassoRegression(X, "label", 0.4).fit(regression)
    assert sparse.coef_[3] == 0 and abs(sparse.coef_[1]) < abs(m.coef_[1])


def test_wide_gram_equals_narrow(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((50, 30))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"c{i}" for i in range(30)]).repartition(3)
    n, g = base.gram(df, df.columns)
    a = np.column_stack([np.ones(50), x])
    assert n == 50 and np.allclose(g, a.T @ a)


def test_logistic(binary, blobs):
    m = linear.LogisticRegression(X, "label", n_iter=40).fit(binary)
    assert m.score(binary) > 0.75
    s = linear.LogisticRegression(["x0", "x1"], "label", multi_class="softmax", n_iter=25).fit(blobs)
    p = s.predict_proba(blobs).select(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b)).first()[0]
    assert abs(p - 1) < 1e-9 and s.score(blobs) > 0.9


def test_bayes(binary, blobs):
    g = GaussianNB(X, "label").fit(binary)
    assert g.score(binary) > 0.8
    parts = GaussianNB(X, "label")
    for k in range(3):
        parts.partial_fit(binary.filter(F.col("row_id") % 3 == k))
    assert np.allclose(parts.theta_, g.theta_) and np.allclose(parts.var_, g.var_)
    counts = blobs.withColumns({c: F.greatest(F.lit(0.0), F.round(c)) for c in ("x0", "x1")})
    assert MultinomialNB(["x0", "x1"], "label").fit(counts).score(counts) > 0.5
    assert BernoulliNB(["x0", "x1"], "label", binarize=3.0).fit(blobs).score(blobs) > 0.9


def brute_stump(x, y):
    best = None
    for j in range(x.shape[1]):
        for t in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= t
            g = y.var() - (left.mean() * y[left].var() + (~left).mean() * y[~left].var())
            if best is None or g > best[0] + 1e-12:
                best = (g, j, t)
    return best


def test_trees(binary, regression):
    x, y = design(regression)
    t = trees.DecisionTree(X, "label", "regression", max_depth=1).fit(regression)
    gain, j, cut = brute_stump(x, y)
    assert t.tree_.feature == f"x{j}" and t.tree_.threshold == pytest.approx(cut) and t.tree_.gain == pytest.approx(gain)
    c = trees.DecisionTree(X, "label", max_depth=4).fit(binary)
    assert c.score(binary) > 0.9 and c.feature_importances_.sum() == pytest.approx(1)
    f = trees.RandomForest(X, "label", "row_id", 6, max_depth=3, oob_score=True, random_state=1).fit(binary)
    assert f.score(binary) > 0.8 and 0 < f.oob_score_ <= 1
    assert trees.DecisionTree(X, "label", max_depth=0).fit(binary).predict(binary).select("prediction").distinct().count() == 1


def test_binned_trees_are_the_exact_ones(binary, regression):
    coarse = regression.withColumns({x: F.round(x, 1) for x in X})
    bounds = trees.bins_of(coarse, X)
    assert [b.tolist() for b in bounds] == [sorted(r[0] for r in coarse.select(x).distinct().collect()) for x in X]
    ours, exact = (trees.DecisionTree(X, "label", "regression", max_depth=3, max_bins=b).fit(coarse).tree_ for b in (256, None))
    shape = lambda n: (n.feature, n.threshold, round(n.value or 0, 9), n.left and shape(n.left), n.right and shape(n.right))
    assert shape(ours) == shape(exact)
    few = trees.DecisionTree(X, "label", "regression", max_depth=4, max_bins=16).fit(regression)
    assert few.score(regression) > 0.7
    holes = binary.withColumn("x0", F.when(F.col("row_id") % 5 > 0, F.col("x0")))
    assert trees.RandomForest(X, "label", "row_id", 5, max_depth=4).fit(holes).score(holes) > 0.8
    g = regression.withColumns({"g": F.col("x0"), "h": F.lit(1.0)})
    assert trees.xgb_tree(g, X, F.col("g"), F.col("h"), 2, colsample=0.5, random_state=3).depth() <= 2


def test_many_boosting_rounds(regression):
    g = trees.GradientBoostingRegressor(X, "label", 20, 0.3, 2, subsample=0.7).fit(regression)
    assert len(g.train_losses_) == 20 and g.train_losses_[-1] < 0.3 * g.train_losses_[0] and g.score(regression) > 0.85


def test_boosting(binary, regression):
    g = trees.GradientBoostingRegressor(X, "label", 5, 0.3, 2).fit(regression)
    assert g.train_losses_ == sorted(g.train_losses_, reverse=True)
    assert trees.GradientBoostingClassifier(X, "label", 4, 0.5, 2).fit(binary).score(binary) > 0.8
    assert trees.XGBoostClassifier(X, "label", 4, 0.5, 2).fit(binary).score(binary) > 0.8


def test_svm(binary, regression):
    signed = binary.limit(80).withColumn("label", 2 * F.col("label") - 1)
    for kernel in ("rbf", "linear"):
        m = svm.SVC(X, "label", kernel=kernel, gamma=0.3, tol=1e-6).fit(signed)
        assert m.score(signed) > 0.7 and m.gap_ <= 1e-6
        x, y = (signed.toPandas()[c].to_numpy(float) for c in (X, "label"))
        f = svm.kernel_matrix(x, m.support_vectors_, kernel, 0.3) @ m.dual_coef_ + m.b_
        # strong duality: the margin's loss and the dual's value meet at the optimum
        norm = m.dual_coef_ @ svm.kernel_matrix(m.support_vectors_, m.support_vectors_, kernel, 0.3) @ m.dual_coef_
        assert norm / 2 + np.maximum(0, 1 - y * f).sum() == pytest.approx(np.abs(m.dual_coef_).sum() - norm / 2, rel=1e-4)
    with pytest.raises(ValueError):
        svm.SVC(X, "label").fit(binary)
    assert svm.SVR(X, "label", C=10, kernel="linear").fit(regression).score(regression) > 0.9


def _duality(m, x, y, kernel, gamma):
    """Loss of the primal, value of the dual: they meet at the optimum."""
    f = svm.kernel_matrix(x, m.support_vectors_, kernel, gamma) @ m.dual_coef_ + m.b_
    norm = m.dual_coef_ @ svm.kernel_matrix(m.support_vectors_, m.support_vectors_, kernel, gamma) @ m.dual_coef_
    return norm / 2 + m.C * np.maximum(0, 1 - y * f).sum(), (m.dual_coef_ * y[[np.flatnonzero((x == v).all(1))[0] for v in m.support_vectors_]]).sum() - norm / 2


def test_svc_linear_on_many_rows(spark):
    # 200 distinct rows, 30 copies of each: more than were taken before
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((200, 2)), 3)
    y = np.where(x @ [1.0, 0.5] + 0.3 * rng.standard_normal(200) > 0, 1, -1)
    df = _frame(spark, np.tile(x, (30, 1)), np.tile(y, 30), int)
    m = svm.SVC(["x0", "x1"], "label", kernel="linear", tol=1e-6).fit(df)
    primal, dual = _duality(m, np.tile(x, (30, 1)), np.tile(y, 30), "linear", 1.0)
    assert primal == pytest.approx(dual, rel=1e-4) and m.gap_ <= 1e-6 and m.score(df) > 0.85


def test_svc_without_the_whole_kernel_matrix(binary):
    signed = binary.withColumn("label", 2 * F.col("label") - 1)
    whole, some = (svm.SVC(X, "label", gamma=0.3, tol=1e-6, max_rows=n).fit(signed) for n in (200, 20))
    x, y = (signed.toPandas()[c].to_numpy(float) for c in (X, "label"))
    primal, dual = _duality(some, x, y, "rbf", 0.3)
    assert primal == pytest.approx(dual, rel=1e-4) and some.gap_ <= 1e-6
    a, b = (m.decision_function(signed).orderBy("row_id").toPandas()["score"] for m in (whole, some))
    assert np.allclose(a, b, atol=1e-5)


def test_svr_on_many_rows(spark):
    # 150 distinct rows, 40 copies of each: more than were taken before; max_rows=10 asks for columns of the kernel one by one
    rng = np.random.default_rng(6)
    x = np.linspace(0, 5, 150).round(3)[:, None]
    y = np.round(np.sin(x[:, 0]) + 0.2 * rng.standard_normal(150), 3)
    df = _frame(spark, np.tile(x, (40, 1)), np.tile(y, 40), float)
    for max_rows in (150, 10):
        m = svm.SVR(["x0"], "label", C=0.02, tol=1e-7, max_rows=max_rows).fit(df)
        k, at = svm.kernel_matrix(x, m.support_vectors_) + 1.0, np.searchsorted(x[:, 0], m.support_vectors_[:, 0])
        norm, target = m.dual_coef_ @ k[at] @ m.dual_coef_, y - y.mean()
        primal = norm / 2 + m.C * 40 * np.maximum(0, np.abs(target - k @ m.dual_coef_) - m.epsilon).sum()
        dual = target[at] @ m.dual_coef_ - m.epsilon * np.abs(m.dual_coef_).sum() - norm / 2
        assert primal == pytest.approx(dual, rel=1e-4) and m.gap_ < 1e-7
        assert np.abs(m.dual_coef_).max() <= m.C * 40 + 1e-12 and m.score(df) > 0.8


def test_clustering(spark, blobs):
    f = ["x0", "x1"]
    k = cluster.KMeans(f, 3, n_init=2, max_iter=20).fit(blobs)
    t = k.predict(blobs).groupBy("label").agg(F.count_distinct("prediction").alias("n")).agg(F.max("n")).first()[0]
    assert t == 1 and k.score() == -k.inertia_
    assert cluster.MiniBatchKMeans(f, 3, 64, 5).fit(blobs).inertia_ > 0
    d = cluster.DBSCAN(f, "row_id", 1.0, 4)
    assert d.fit_predict(blobs).filter("prediction >= 0").select("prediction").distinct().count() == d.n_clusters_ == 3
    pts = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.1), (2, 100.0, 100.0)], "row_id long, x0 double, x1 double")
    assert [r[0] for r in cluster.DBSCAN(f, "row_id", 0.5, 2).fit_predict(pts).orderBy("row_id").select("prediction").collect()] == [0, 0, -1]
    g = cluster.GaussianMixture(f, 3, max_iter=20, init_means=[[0, 0], [6, 0], [0, 6]]).fit(blobs)
    assert g.weights_.sum() == pytest.approx(1) and g.sample(spark, 30).count() == 30
    assert np.allclose(np.sort(g.means_[:, 0])[-1], 6, atol=0.3)


def test_dbscan_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cluster, "SLICE_POINTS", 15)
    rng = np.random.default_rng(15)
    x = np.concatenate([rng.normal(0, 0.3, (60, 2)), rng.normal(3, 0.4, (50, 2)), rng.uniform(-2, 6, (40, 2)), np.zeros((20, 2))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, x0 double, x1 double").repartition(3)
    got = {r.row_id: r.prediction for r in cluster.DBSCAN(["x0", "x1"], "row_id", 0.4, 5).fit_predict(df).collect()}
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= 0.16
    core, want, number = near.sum(1) >= 5, [-1] * len(x), 0
    for i in range(len(x)):
        if core[i] and want[i] < 0:
            stack, want[i] = [i], number
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core):
                    if want[j] < 0:
                        want[j] = number
                        stack.append(j)
            number += 1
    want = [want[i] if core[i] else min((want[j] for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(x))]
    assert [got[i] for i in range(len(x))] == want


def test_starts_on_repeated_points(spark):
    f = ["x0", "x1"]
    four = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 2 * 10.0).alias("x0"), (F.floor(F.col("id") / 2) % 2 * 10.0).alias("x1"))
    for init in ("random", "kmeans++"):
        k = cluster.KMeans(f, 4, init, n_init=1).fit(four)
        assert k.inertia_ == 0 and len({tuple(c) for c in k.cluster_centers_.tolist()}) == 4
    two = cluster.GaussianMixture(f, 2, max_iter=3, reg_covar=1e-2).fit(four)
    assert not np.allclose(two.means_[0], two.means_[1])
    assert cluster.MiniBatchKMeans(f, 4, 50, 5).fit(four).inertia_ < 4000


def test_smote_points_lie_between_neighbours(spark, blobs):
    few = blobs.filter("label > 0 or row_id < 36").withColumn("label", (F.col("label") > 0).cast("int"))
    base = few.filter("label = 0").toPandas()[["x0", "x1"]].to_numpy()
    out = pre.SMOTE(["x0", "x1"], "label", "row_id", 3).fit_resample(few).filter("label = 0").toPandas()[["x0", "x1"]].to_numpy()
    d = ((base[:, None] - base[None]) ** 2).sum(-1)
    near = np.argsort(d + np.eye(len(base)) * 1e9, axis=1)[:, :3]
    ends = [(base[i], base[j]) for i in range(len(base)) for j in near[i]]
    for p in out:
        best = min(np.linalg.norm(p - a - np.clip((p - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1) * (b - a)) for a, b in ends)
        assert best < 1e-9
    assert len(out) == 100


def test_numbering_in_ranges(spark, binary):
    from basalt.operators import optim
    from basalt.operators.base import add_bias, numbered, running

    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    assert [r.n for r in numbered(df, ["k"], "n").orderBy("k").collect()] == list(range(1000))
    assert [r.s for r in running(df, [-F.col("k")], {"s": F.col("k")}).orderBy(F.desc("k")).limit(3).collect()] == [0, 999, 1997]
    assert running(df.limit(0), ["k"], {"s": F.col("k")}).count() == 0
    batches = optim.mini_batches(binary, "row_id", 30, seed=1).groupBy("batch").count().collect()
    assert sorted(r[1] for r in batches) == [20, 30, 30, 30, 30, 30, 30]
    folds = selection.StratifiedKFold("row_id", "label", 4).assign(binary).groupBy("label", "fold").count().collect()
    assert max(r[2] for r in folds if r[0] == 0) - min(r[2] for r in folds if r[0] == 0) <= 1 and len(folds) == 8
    plan = selection.KFold("row_id", 3).assign(binary)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    assert [r.bias for r in add_bias(binary, X)[0].limit(2).collect()] == [1.0, 1.0]


def test_isotonic_and_wilcoxon_by_brute_force(spark):
    rng = np.random.default_rng(12)
    s, y = np.round(rng.random(400), 2), (rng.random(400) < 0.5).astype(int)
    iso = selection.IsotonicCalibrator().fit(spark.createDataFrame(list(zip(s.tolist(), y.tolist())), "score double, label int").repartition(6))
    blocks = []
    for v in np.unique(s):
        blocks.append([y[s == v].mean(), (s == v).sum(), [v]])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]]
    want = {v: m for m, _, vs in blocks for v in vs}
    assert np.allclose(np.interp(sorted(want), iso.x_, iso.y_), [want[v] for v in sorted(want)])
    d = np.round(rng.normal(0.2, 1, 300), 1)
    got = selection.wilcoxon_test(spark.createDataFrame([(float(x), 0.0) for x in d], "a double, b double"), "a", "b")
    d = d[d != 0]
    size = np.abs(d)
    rank = np.array([(size < v).sum() + ((size == v).sum() + 1) / 2 for v in size])
    assert got["statistic"] == pytest.approx(min(rank[d > 0].sum(), rank[d < 0].sum()))


def test_blocked_neighbours(spark, monkeypatch):
    monkeypatch.setattr(pre, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(13)
    x = rng.integers(0, 6, (150, 3)).astype(float)
    gaps = [[None if rng.random() < 0.2 else v for v in r] for r in x.tolist()]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(gaps)], "id long, x array<double>")
    got = {}
    for r in pre.nearest(df.select(F.col("id").alias("k"), "x"), df, "k", 3, 4).collect():
        got.setdefault(r.k, []).append((r["rank"], r.point))

    def dist(a, b):
        both = [(p - q) ** 2 for p, q in zip(a, b) if p is not None and q is not None]
        return sum(both) if both else float("inf")

    for i, a in enumerate(gaps):
        want = sorted(range(150), key=lambda j: (dist(a, gaps[j]), j))[:4]
        assert [p for _, p in sorted(got[i])] == want


def test_tables_and_models(spark, tmp_path, binary):
    from basalt.sources import tables

    for kind in ("parquet", "csv", "json", "orc"):
        tables.write(binary, str(tmp_path / kind), kind, mode="overwrite")
        assert tables.read(spark, str(tmp_path / kind), kind, schema=binary.schema).count() == 200
    m = GaussianNB(X, "label").fit(binary)
    tables.save_model(spark, m, str(tmp_path / "model"))
    assert tables.load_model(spark, str(tmp_path / "model")).score(binary) == m.score(binary)
    assert tables.missing_to_null(spark.createDataFrame([(float("nan"), -1.0), (2.0, 3.0)], "a double, b double"), ["a", "b"], -1.0).filter("a is null and b is null").count() == 1


def test_checks(spark, binary):
    from basalt.operators import base

    with pytest.raises(ValueError, match="no column"):
        base.check_array(binary, ["gone"])
    with pytest.raises(ValueError, match="no column"):
        base.check_X_y(binary, X, "gone")
    with pytest.raises(ValueError, match="string"):
        base.check_array(spark.createDataFrame([("a",)], "x0 string"), ["x0"])
    with pytest.raises(RuntimeError, match="not fitted"):
        base.check_is_fitted(GaussianNB(X, "label"), "theta_")
    assert selection.GridSearchCV(linear.RidgeRegression(X, "label"), {"alpha": [0.1]}, "row_id").kind == "regressor"


@pytest.mark.parametrize("kind", ["copies", "ties", "one site", "skewed"])
def test_neighbours_in_cells(spark, monkeypatch, kind):
    rng, k = np.random.default_rng(11), 4
    x = {"copies": np.tile(rng.standard_normal((60, 3)), (5, 1)), "ties": rng.integers(0, 6, (300, 2)) * 1.0, "one site": np.ones((40, 2)), "skewed": np.exp(4 * rng.standard_normal((300, 2)))}[kind]
    monkeypatch.setattr(pre, "CELL_ROWS", 7)
    monkeypatch.setattr(pre, "BLOCK_ROWS", 20)
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    got = pre.nearest_in_cells(points.filter("id % 2 = 0").select("x"), points, x.shape[1], k).collect()
    assert len(got) == len(np.unique(x[::2], axis=0))
    for r in got:
        d = sum((x[:, f] - r.x[f]) ** 2 for f in range(x.shape[1]))
        best = np.lexsort((np.arange(len(x)), d))[:k]
        assert [(p.d, p.point, p.y) for p in r.near] == [(d[i], i, x[i].tolist()) for i in best]


def test_smote_meets_no_block_of_all_rows(spark, blobs, monkeypatch):
    """Only rows drawn look for neighbours, and not among all rows of the class, unless a feature is missing there."""
    asked = []
    monkeypatch.setattr(pre, "nearest", lambda queries, *rest, run=pre.nearest: asked.append(queries.count()) or run(queries, *rest))
    few = blobs.filter("label > 0 or row_id < 36").withColumn("label", (F.col("label") > 0).cast("int")).filter("label = 0 or row_id < 40")
    rows = few.groupBy("label").count().orderBy("count").collect()
    out = pre.SMOTE(["x0", "x1"], "label", "row_id", 3).fit_resample(few)
    assert out.filter(f"label = {rows[0].label}").count() == rows[1]["count"] and not asked
    hole = few.withColumn("x1", F.when(F.col("row_id") != 3, F.col("x1")))
    out = pre.SMOTE(["x0", "x1"], "label", "row_id", 3).fit_resample(hole)
    assert out.filter(f"label = {rows[0].label}").count() == rows[1]["count"] and asked and asked[0] <= rows[0]["count"]


def test_decomposition(blobs, regression):
    p = decomposition.PCA(X).fit(regression)
    x, _ = design(regression)
    assert np.allclose(np.sort(p.explained_variance_), np.sort(np.linalg.eigvalsh(np.cov(x.T)))) and p.cumulative_variance_ratio_[-1] == pytest.approx(1)
    back = p.inverse_transform(p.transform(regression)).orderBy("row_id").toPandas()[X].to_numpy()
    assert np.allclose(back, x)
    assert np.allclose(p.components_ @ p.components_.T, np.eye(4))
    assert np.allclose(decomposition.TruncatedSVD(X, 2).fit(regression).singular_values_, np.linalg.svd(x)[1][:2])
    pos = blobs.withColumns({c: F.abs(c) for c in ("x0", "x1")})
    n = decomposition.NMF(["x0", "x1"], "row_id", 2, 30).fit(pos)
    assert (n.components_ >= 0).all() and n.reconstruction_err_ < 5
    t = decomposition.TSNE(["x0", "x1"], "row_id", perplexity=10, n_iter=120, n_iter_early_exag=50)
    assert t.fit_transform(blobs.filter("row_id < 50")).count() == 50 and t.kl_[-1] < t.kl_[1]


def test_tsne_of_more_rows_than_the_driver_pairs(spark, blobs):
    """Against the plain formulas over the whole matrix of pairs; copies among the rows, pairs below the floor, and jobs on the executors."""
    rng = np.random.default_rng(7)
    x = np.concatenate([np.tile(rng.standard_normal((5, 2)), (4, 1)), rng.standard_normal((280, 2)) * 5])
    d, n, floor = ((x[:, None] - x[None]) ** 2).sum(-1), len(x), 1e-12
    p = np.zeros((n, n))
    for i in range(n):
        rest = np.arange(n) != i
        beta = decomposition._bandwidths((d[i, rest] - d[i, rest].min())[None], 8)[0]
        p[i, rest] = (w := np.exp(-(d[i, rest] - d[i, rest].min()) * beta)) / w.sum()
    p, y, step, kl = np.maximum((p + p.T) / (2 * n), floor), np.random.default_rng(0).standard_normal((n, 2)) * 1e-4, 0.0, []
    for t in range(30):
        num = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(-1))
        np.fill_diagonal(num, 0)
        q = np.maximum(num / num.sum(), floor)
        m = (p * (12 if t < 10 else 1) - q) * num
        step = (0.5 if t < 20 else 0.8) * step - 25 * np.clip(4 * (m.sum(1)[:, None] * y - m @ y), -10, 10)
        y = y + step
        y -= y.mean(axis=0)
        if t in (0, 29):
            kl.append((p * np.log(p / q)).sum())
    df = _frame(spark, x, np.zeros(n), int)
    for rows in (1000, 100):
        t = decomposition.TSNE(["x0", "x1"], "row_id", perplexity=8, n_iter=30, n_iter_early_exag=10, switch_iter=20, driver_rows=rows)
        out = t.fit_transform(df).orderBy("row_id").toPandas()
        assert np.allclose(out[["y0", "y1"]].to_numpy(), y, atol=1e-8) and np.allclose(t.kl_, kl)


def test_tsne_floor_of_far_pairs():
    y = np.random.default_rng(8).standard_normal((700, 2)) * 1e7
    num = 1 / (1 + np.maximum((y * y).sum(1)[:, None] + (y * y).sum(1) - 2 * y @ y.T, 0))
    np.fill_diagonal(num, 0)
    q = np.maximum(num / 1e3, decomposition.FLOOR)
    parts = [(0, 300), (300, 700)]
    tiles = [(a, b) for g, a in enumerate(parts) for b in parts[g:]]
    _, push, logs = decomposition.TSNE([], "row_id")._repulsion(y, lambda f, items: [f(i) for i in items], tiles, 1e3)
    m = q * num
    assert (q == decomposition.FLOOR).mean() > 0.5 and logs == pytest.approx(np.log(q).sum())
    assert np.allclose(push, m.sum(1)[:, None] * y - m @ y)


def test_tsne_takes_any_number_of_rows(spark):
    rng = np.random.default_rng(9)
    out = decomposition.TSNE(["x0"], "row_id", perplexity=5, n_iter=2, driver_rows=20_000).fit_transform(_frame(spark, rng.standard_normal((5200, 1)), np.zeros(5200), int))
    assert out.count() == 5200 and out.filter("isnan(y0) or isnan(y1)").count() == 0


def test_tsne_grid_is_the_sum_over_all_pairs(monkeypatch):
    """Clouds from far smaller to far larger than the kernels, one direction, and pairs whose share is below the floor; against every pair."""
    rng = np.random.default_rng(10)
    cloud = rng.standard_normal((1500, 2)) * [1, 0.4]
    cloud[:300] = cloud[:300] * 0.02 + 1
    line = np.concatenate([rng.standard_normal((2500, 1)) * 1e-3, rng.standard_normal((40, 1)) * 300, [[-400.0], [500.0]]])
    t = decomposition.TSNE([], "row_id")
    monkeypatch.setattr(t, "_on_grid", lambda y: True)
    with ThreadPoolExecutor(3) as pool:
        grid = decomposition._Grid(pool)
        for y in (cloud * 1e-4, cloud * 0.1, cloud, cloud * 10, cloud * 10 + 1e-3, line / 1e5, line):
            every = [((0, len(y)), (0, len(y)))]
            found, wanted = (t._summed(y, g, lambda f, items: [f(i) for i in items], every, 12, True) for g in (grid, None))
            off, largest = np.abs(found[0] - wanted[0]).max(), 3**1.5 / 16  # of affinity * affinity * apart
            assert off < 1e-7 * largest * len(y) / wanted[1]
            assert off < 1e-6 * np.abs(wanted[0]).max() or y is line
            assert found[1] == pytest.approx(wanted[1], rel=1e-7) and found[2] == pytest.approx(wanted[2], rel=1e-8)
        assert decomposition._far(line, wanted[1])


def test_tsne_neighbours_of_many_rows():
    """Leaf by leaf the same probabilities as from the whole matrix; copies and a dense clump far from a thin cloud among the rows."""
    rng = np.random.default_rng(11)
    x = np.concatenate([np.tile(rng.standard_normal((100, 3)), (5, 1)), rng.standard_normal((1000, 3)) * 1e-3 + 50, rng.integers(0, 11, (900, 3)) * 1.0])
    n = len(x)
    d = sum((c[:, None] - c) ** 2 for c in x.T)
    np.fill_diagonal(d, np.inf)
    d -= d.min(axis=1, keepdims=True)
    p = np.exp(-d * decomposition._bandwidths(d, 8)[:, None])
    p /= p.sum(axis=1, keepdims=True)
    p = (p + p.T) / (2 * n)
    i, j, found = decomposition.TSNE([], "row_id", perplexity=8)._joint(x, lambda f, items: [f(r) for r in items], 7)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) >= set(zip(*(c.tolist() for c in np.nonzero(p > 1.001 * decomposition.FLOOR)), strict=True))
    assert np.allclose(found, p[i, j], rtol=1e-5, atol=1e-13) and len(set(zip(i.tolist(), j.tolist(), strict=True))) == len(i)


def test_tsne_of_many_rows_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(decomposition, "_tile", lambda *_: pytest.fail("took the pairs one by one"))
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.standard_normal((2000, 2)), rng.standard_normal((2000, 2)) + 20])
    t = decomposition.TSNE(["x0", "x1"], "row_id", perplexity=8, n_iter=101, n_iter_early_exag=50)
    out = t.fit_transform(_frame(spark, x, np.zeros(len(x)), int)).orderBy("row_id").toPandas()
    assert out.row_id.tolist() == list(range(4000)) and not out.isna().any().any() and t.kl_[-1] < t.kl_[1]


def test_preprocessing(spark, regression):
    s = pre.StandardScaler(X).fit_transform(regression).agg(F.avg("x0"), F.stddev_pop("x0")).first()
    assert s[0] == pytest.approx(0, abs=1e-9) and s[1] == pytest.approx(1)
    df = spark.createDataFrame([(0, 1.0, None), (1, 3.0, 4.0), (2, None, 6.0)], "row_id long, x0 double, x1 double")
    assert pre.SimpleImputer(["x0", "x1"]).fit_transform(df).orderBy("row_id").first()["x1"] == 5
    knn = spark.createDataFrame([(0, 1.0, 2.0), (1, 1.1, 2.1), (2, None, 2.05), (3, 10.0, 10.0)], "row_id long, x0 double, x1 double")
    assert pre.KNNImputer(["x0", "x1"], "row_id", 3).fit_transform(knn).filter("row_id = 2").first()["x0"] == pytest.approx(1.05)
    cat = spark.createDataFrame([("a",), ("b",), ("a",), ("c",)], "c string")
    assert len(pre.OneHotEncoder(["c"]).fit_transform(cat).columns) == 4 and len(pre.OneHotEncoder(["c"], "first").fit_transform(cat).columns) == 3
    with pytest.raises(Exception, match="unknown category"):
        pre.OneHotEncoder(["c"]).fit(cat).transform(spark.createDataFrame([("z",)], "c string")).collect()
    sparse = pre.OneHotEncoder(["c"], handle_unknown="ignore", sparse=True).fit(cat).transform(spark.createDataFrame([("z",), ("a",), ("c",), (None,)], "c string"))
    assert {r.c: r.c_onehot for r in sparse.collect()} == {"z": None, "a": 0, "c": 2, None: None}
    with pytest.raises(Exception, match="unseen"):
        pre.LabelEncoder("c").fit(cat).transform(spark.createDataFrame([("z",)], "c string")).collect()
    uneven = regression.withColumn("label", (F.col("row_id") < 30).cast("int"))
    assert {r[1] for r in pre.SMOTE(X, "label", "row_id").fit_resample(uneven).groupBy("label").count().collect()} == {170}
    assert pre.RFE(linear.RidgeRegression(X, "label"), 2).fit(regression).get_support() == ["x0", "x1"]
    assert pre.SelectKBest(X, "label", k=0).fit(uneven).get_support() == []


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (1, 1, 0.9), (1, 0, 0.8), (0, 0, 0.2), (1, 1, 0.7)], "t int, p int, s double")
    assert metrics.accuracy_score(df, "t", "p") == pytest.approx(0.8) and metrics.roc_auc_score(df, "t", "s") == 1
    assert metrics.f1_score(df, "t", "p") == pytest.approx(0.8) and "accuracy" in metrics.classification_report(df, "t", "p", True)
    assert metrics.confusion_matrix(df, "t", "p").count() == 4


def test_selection(binary):
    folds = selection.KFold("row_id", 3).assign(binary).groupBy("fold").count().collect()
    assert sorted(r[1] for r in folds) == [66, 67, 67]
    g = selection.GridSearchCV(pipeline.make_pipeline(pre.StandardScaler(X), GaussianNB(X, "label")), {"gaussiannb__var_smoothing": [1e-9, 1e3]}, "row_id", 2).fit(binary)
    assert g.best_params_ == {"gaussiannb__var_smoothing": 1e-9} and g.best_score_ > 0.8
    scored = binary.withColumn("score", F.col("x0"))
    assert selection.PlattScaler().fit(scored).a_ < 0  # higher scores are likelier 1
    iso = selection.IsotonicCalibrator().fit(scored)
    assert iso.y_ == sorted(iso.y_)


def test_special_functions():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-6)
    assert special.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)


def test_pipeline(regression):
    with pytest.raises(TypeError):
        pipeline.Pipeline([("a", object()), ("b", pre.StandardScaler(X))])
    with pytest.raises(ValueError):
        pipeline.Pipeline([("a", pre.StandardScaler(X)), ("a", pre.StandardScaler(X))])
    p = pipeline.make_pipeline(pre.StandardScaler(X), linear.RidgeRegression(X, "label")).set_params(ridgeregression__alpha=2.0)
    assert p["ridgeregression"].alpha == 2.0 and p.fit(regression).score(regression) > 0.9
    u = pipeline.make_union(pre.StandardScaler(["x0"]), pre.StandardScaler(["x0"])).fit_transform(regression)
    assert [c for c in u.columns if "__" in c] == ["standardscaler__x0", "standardscaler_1__x0"]


def test_optimisers_and_stream(spark, blobs, tmp_path):
    for o in (optim.SGD(0.1, 0.5), optim.Adam(0.2), optim.RMSProp(0.1), optim.AdaGrad(0.5)):
        w = {"w": np.array([2.0])}
        for _ in range(80):
            w = o.step(w, {"w": 2 * w["w"]})
        assert abs(w["w"][0]) < 0.5
    from basalt.streaming.online import keep_fitted

    blobs.write.parquet(str(tmp_path / "in"))
    m = GaussianNB(["x0", "x1"], "label")
    keep_fitted(m, spark.readStream.schema(blobs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "c")).awaitTermination(60)
    assert np.allclose(m.theta_, GaussianNB(["x0", "x1"], "label").fit(blobs).theta_)

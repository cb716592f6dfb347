"""Queries of the models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import special
from ..operators import bayes, cluster, decomposition, linear, metrics, svm
from ..operators.pipeline import make_pipeline
from ..operators.preprocess import StandardScaler
from ..sources.tables import table
from .frames import LINES_SQL, ORDERS_SQL, PARTS_SQL, lines, orders, parts, rounded, row, rows
from .q_preprocess import suppliers
from .registry import query

_L = f"WITH l AS ({LINES_SQL})"
_NB = f"{_L}, c AS (SELECT status, avg(x0) m0, var_pop(x0) + 1e-9 v0, avg(x1) m1, var_pop(x1) + 1e-9 v1, ln(count(*) / (SELECT count(*) FROM l)::DOUBLE) p FROM l GROUP BY status)"
_NB_PRED = ", s AS (SELECT l.rid, l.status, arg_max(c.status, p - 0.5 * (ln(2 * pi() * v0) + ln(2 * pi() * v1)) - (x0 - m0) * (x0 - m0) / (2 * v0) - (x1 - m1) * (x1 - m1) / (2 * v1)) pred FROM (SELECT *, row_number() OVER () rid FROM l) l, c GROUP BY l.rid, l.status)"


@query("gaussian_nb_confusion", f"{_NB}{_NB_PRED} SELECT a.status AS \"true\", b.status AS pred, (SELECT count(*) FROM s WHERE s.status = a.status AND s.pred = b.status) AS n FROM c a, c b")
def gaussian_nb_confusion(spark, d):
    f = lines(spark, d)
    return metrics.confusion_matrix(bayes.GaussianNB(["x0", "x1"], "status").fit(f).predict(f), "status", "prediction")


@query("gaussian_nb", f"{_NB} SELECT status, round(m0, 6) AS m0, round(v0, 6) AS v0, round(m1, 6) AS m1, round(v1, 6) AS v1, round(p, 6) AS p FROM c")
def gaussian_nb(spark, d):
    m = bayes.GaussianNB(["x0", "x1"], "status").fit(lines(spark, d))
    data = [(c, *(float(x) for x in (t[0], v[0], t[1], v[1], p))) for c, t, v, p in zip(m.classes_, m.theta_, m.var_, m.class_log_prior_, strict=True)]
    return rounded(rows(spark, data, "status string, m0 double, v0 double, m1 double, v1 double, p double"), "m0", "v0", "m1", "v1", "p")


@query("gaussian_nb_incremental", f"{_NB} SELECT status, round(m0, 6) AS m0, round(v0, 6) AS v0 FROM c")
def gaussian_nb_incremental(spark, d):
    f, m = lines(spark, d), bayes.GaussianNB(["x0", "x1"], "status")
    for flag in ("A", "N", "R"):
        m.partial_fit(f.filter(F.col("flag") == flag))
    data = [(c, float(t[0]), float(v[0])) for c, t, v in zip(m.classes_, m.theta_, m.var_, strict=True)]
    return rounded(rows(spark, data, "status string, m0 double, v0 double"), "m0", "v0")


@query("multinomial_nb", f"{_L}, c AS (SELECT status, sum(x0) + 1 a, sum(x2) + 1 b, sum(x3) + 1 e, ln(count(*) / (SELECT count(*) FROM l)::DOUBLE) p FROM l GROUP BY status) SELECT status, round(ln(a / (a + b + e)), 6) AS w0, round(ln(b / (a + b + e)), 6) AS w2, round(ln(e / (a + b + e)), 6) AS w3, round(p, 6) AS p FROM c")
def multinomial_nb(spark, d):
    m = bayes.MultinomialNB(["x0", "x2", "x3"], "status").fit(lines(spark, d))
    data = [(c, *map(float, w), float(p)) for c, w, p in zip(m.classes_, m.feature_log_prob_, m.class_log_prior_, strict=True)]
    return rounded(rows(spark, data, "status string, w0 double, w2 double, w3 double, p double"), "w0", "w2", "w3", "p")


@query("bernoulli_nb", f"{_L} SELECT status, round((count(*) FILTER (x0 > 25) + 1) / (count(*) + 2.0), 6) AS q0, round((count(*) FILTER (x2 > 25) + 1) / (count(*) + 2.0), 6) AS q2 FROM l GROUP BY status")
def bernoulli_nb(spark, d):
    m = bayes.BernoulliNB(["x0", "x2"], "status", binarize=25.0).fit(lines(spark, d))
    return rounded(rows(spark, [(c, *map(float, q)) for c, q in zip(m.classes_, m.feature_prob_, strict=True)], "status string, q0 double, q2 double"), "q0", "q2")


_SUMS = f"{_L}, g AS (SELECT count(*)::DOUBLE n, sum(x0) sx, sum(x0 * x0) sxx, sum(x1) sy, sum(x0 * x1) sxy, sum(x1 * x1) syy FROM l)"


@query("linear_regression", f"{_L} SELECT round(regr_slope(x1, x0), 6) AS coef, round(regr_intercept(x1, x0), 6) AS intercept, round(regr_r2(x1, x0), 6) AS r2 FROM l")
def linear_regression(spark, d):
    f = lines(spark, d)
    m = linear.LinearRegression(["x0"], "x1").fit(f)
    return row(spark, coef=m.coef_[0], intercept=m.intercept_, r2=m.score(f))


@query("linear_regression_gd", f"{_SUMS}, RECURSIVE_PLACE SELECT round(b, 6) AS coef, round(a, 6) AS intercept FROM r WHERE t = 50".replace("WITH l", "WITH RECURSIVE l").replace("RECURSIVE_PLACE", "r(t, a, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT t + 1, a - 0.001 * (n * a + sx * b - sy) / n, b - 0.001 * (sx * a + sxx * b - sxy) / n FROM r, g WHERE t < 50)"))
def linear_regression_gd(spark, d):
    m = linear.LinearRegression(["x0"], "x1", "gd", 1e-3, 50).fit(lines(spark, d))
    return row(spark, coef=m.coef_[0], intercept=m.intercept_)


@query("ridge_regression", f"{_SUMS} SELECT round((n * sxy - sx * sy) / (n * (sxx + 100) - sx * sx), 6) AS coef, round((sy - (n * sxy - sx * sy) / (n * (sxx + 100) - sx * sx) * sx) / n, 6) AS intercept FROM g")
def ridge(spark, d):
    m = linear.RidgeRegression(["x0"], "x1", 100.0).fit(lines(spark, d))
    return row(spark, coef=m.coef_[0], intercept=m.intercept_)


for _name, _op, _l1, _l2 in (("lasso_regression", lambda: linear.LassoRegression(["x0"], "x1", 0.5), 0.5, 0.0), ("elastic_net", lambda: linear.ElasticNet(["x0"], "x1", 0.5, 0.4), 0.2, 0.3)):

    @query(_name, f"{_SUMS}, z AS (SELECT (sxy - sx * sy / n) / n AS z, sxx / n AS q, sy / n AS m FROM g) SELECT round(sign(z) * greatest(abs(z) - {_l1}, 0) / (q + {_l2}), 6) AS coef, round(m, 6) AS intercept FROM z")
    def shrunk(spark, d, op=_op):
        m = op().fit(lines(spark, d))
        return row(spark, coef=m.coef_[0], intercept=m.intercept_)


_LOG = f"WITH l AS (SELECT x0 / 50 AS x, y FROM ({LINES_SQL})), r0 AS (SELECT 0.0::DOUBLE a, 0.0::DOUBLE b)"
for _i in range(3):
    _LOG += f", g{_i} AS (SELECT any_value(a) a, any_value(b) b, avg(1 / (1 + exp(-(a + b * x))) - y) + any_value(a) ga, avg((1 / (1 + exp(-(a + b * x))) - y) * x) + any_value(b) gb FROM l, r{_i}), r{_i + 1} AS (SELECT a - 0.5 * ga AS a, b - 0.5 * gb AS b FROM g{_i})"


@query("logistic_regression", f"{_LOG} SELECT round(b, 6) AS coef, round(a, 6) AS intercept FROM r3")
def logistic(spark, d):
    m = linear.LogisticRegression(["x"], "y", lr=0.5, n_iter=3).fit(lines(spark, d).withColumn("x", F.col("x0") / 50))
    return row(spark, coef=float(m.coef_[0][0]), intercept=float(m.intercept_[0]))


def _classes_sql(joint: bool, steps: int = 3) -> str:
    """Gradient steps of the three-class problem from zero, unrolled; w/C covers the bias, C is 1 and the rate 0.1."""
    out = f"WITH l AS (SELECT row_number() OVER () AS r, x0 / 50 AS x, x2, flag FROM ({LINES_SQL})), w0 AS (SELECT DISTINCT flag AS c, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS d FROM l)"
    for i in range(steps):
        p = "exp(z) / sum(exp(z)) OVER (PARTITION BY r)" if joint else "1 / (1 + exp(-z))"
        out += f", z{i} AS (SELECT r, c, x, x2, flag, a, b, d, a + b * x + d * x2 AS z FROM l, w{i}), p{i} AS (SELECT *, {p} - (flag = c)::INT AS e FROM z{i})"
        out += f", w{i + 1} AS (SELECT c, any_value(a) - 0.1 * (avg(e) + any_value(a)) AS a, any_value(b) - 0.1 * (avg(e * x) + any_value(b)) AS b, any_value(d) - 0.1 * (avg(e * x2) + any_value(d)) AS d FROM p{i} GROUP BY c)"
    return f"{out} SELECT c AS flag, round(a, 6) AS a, round(b, 6) AS b, round(d, 6) AS d FROM w{steps}"


for _name, _how in (("logistic_regression_softmax", "softmax"), ("logistic_regression_ovr", "ovr")):

    @query(_name, _classes_sql(_how == "softmax"))
    def logistic_classes(spark, d, how=_how):
        f = lines(spark, d).withColumn("x", F.col("x0") / 50)
        m = linear.LogisticRegression(["x", "x2"], "flag", multi_class=how, n_iter=3).fit(f)
        return rounded(rows(spark, [(c, float(a), *map(float, w)) for c, a, w in zip(m.classes_, m.intercept_, m.coef_, strict=True)], "flag string, a double, b double, d double"), "a", "b", "d")


_STOP = """WITH RECURSIVE m AS (SELECT row_number() OVER (ORDER BY date_trunc('month', o_orderdate)) AS k, avg(o_totalprice) AS v FROM orders GROUP BY date_trunc('month', o_orderdate)),
 r(k, best, misses) AS (SELECT 1::BIGINT, v, 0 FROM m WHERE k = 1 UNION ALL SELECT m.k, CASE WHEN v < best - 10 THEN v ELSE best END, CASE WHEN v < best - 10 THEN 0 ELSE misses + 1 END FROM r JOIN m ON m.k = r.k + 1)
 SELECT CAST(coalesce(min(k) FILTER (misses >= 5), -1) AS BIGINT) AS stopped FROM r"""


@query("early_stopping", _STOP)
def early_stopping(spark, d):
    months = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.avg("o_totalprice").alias("v")).orderBy("m").collect()
    stop = linear.EarlyStopping(patience=5, min_delta=10)
    return row(spark, stopped=next((i for i, r in enumerate(months, 1) if stop(r.v)), -1))


_KM = f"WITH f AS (SELECT id, size, price / 100 AS price FROM ({PARTS_SQL})), c0 AS (SELECT * FROM (VALUES (0, 10.0::DOUBLE, 10.0::DOUBLE), (1, 25.0, 14.0), (2, 40.0, 18.0)) v(k, a, b))"
for _i in range(2):
    _KM += f", n{_i} AS (SELECT id, any_value(size) size, any_value(price) price, arg_min(k, (size - a) * (size - a) + (price - b) * (price - b)) k FROM f, c{_i} GROUP BY id), c{_i + 1} AS (SELECT k, avg(size) a, avg(price) b FROM n{_i} GROUP BY k)"


@query("kmeans", f"{_KM} SELECT k AS cluster, round(a, 6) AS a, round(b, 6) AS b FROM c2")
def kmeans(spark, d):
    f = parts(spark, d).withColumn("price", F.col("price") / 100)
    m = cluster.KMeans(["size", "price"], 3, [[10.0, 10.0], [25.0, 14.0], [40.0, 18.0]], max_iter=2, tol=0).fit(f)
    return rounded(rows(spark, [(i, *map(float, c)) for i, c in enumerate(m.cluster_centers_)], "cluster int, a double, b double"), "a", "b")


@query("kmeans_plus_plus")
def kmeans_pp(spark, d):
    f = parts(spark, d)
    return cluster.KMeans(["size", "price"], 3, n_init=1, max_iter=3).fit_predict(f).groupBy("prediction").count()


@query("mini_batch_kmeans")
def mini_batch_kmeans(spark, d):
    f = parts(spark, d)
    return cluster.MiniBatchKMeans(["size", "price"], 3, max_iter=3).fit_predict(f).groupBy("prediction").count()


_DB = """WITH RECURSIVE f AS (SELECT s_suppkey id, s_acctbal / 1000 a, s_nationkey / 5.0::DOUBLE b FROM supplier), n AS (SELECT x.id i, y.id j FROM f x, f y WHERE (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) <= 0.49),
 c AS (SELECT i FROM n GROUP BY i HAVING count(*) >= 4), e AS (SELECT n.i, n.j FROM n JOIN c ON n.i = c.i JOIN c c2 ON n.j = c2.i), r(i, root) AS (SELECT i, i FROM c UNION SELECT e.j, r.root FROM r JOIN e ON e.i = r.i),
 k AS (SELECT i, min(root) root FROM r GROUP BY i), m AS (SELECT root, row_number() OVER (ORDER BY root) - 1 num FROM (SELECT DISTINCT root FROM k)), o AS (SELECT k.i, m.num FROM k JOIN m USING (root)),
 p AS (SELECT n.i, min(CASE WHEN n.i = n.j THEN num END) own, min(num) least FROM n JOIN o ON n.j = o.i GROUP BY n.i) SELECT f.id, CAST(coalesce(own, least, -1) AS INT) AS prediction FROM f LEFT JOIN p ON p.i = f.id"""


@query("dbscan", _DB)
def dbscan(spark, d):
    f = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1000).alias("a"), (F.col("s_nationkey") / F.lit(5.0)).alias("b"))
    return cluster.DBSCAN(["a", "b"], "id", 0.7, 4).fit_predict(f).select("id", "prediction")


def _mixture_sql(xs: list[str], starts: list[list[float]], steps: int) -> str:
    """Steps of expectation and maximisation of a diagonal mixture with unit variances and equal weights at the start, unrolled."""
    k, cols = len(starts), ", ".join(f"m{j}, v{j}" for j in range(len(xs)))
    first = ", ".join(f"({i}, {1 / k}::DOUBLE, " + ", ".join(f"{m}::DOUBLE, 1.0::DOUBLE" for m in row) + ")" for i, row in enumerate(starts))
    out = f"WITH f AS (SELECT id, size, price / 100 AS price FROM ({PARTS_SQL})), p0 AS (SELECT * FROM (VALUES {first}) t(k, w, {cols}))"
    for i in range(steps):
        log = " + ".join(f"-0.5 * (ln(2 * pi()) + ln(v{j}) + ({x} - m{j}) * ({x} - m{j}) / v{j})" for j, x in enumerate(xs))
        means = ", ".join(f"sum(r * {x}) / n AS m{j}, sum(r * {x} * {x}) / n - (sum(r * {x}) / n) * (sum(r * {x}) / n) + 1e-6 AS v{j}" for j, x in enumerate(xs))
        out += f", j{i} AS (SELECT f.*, p.k, ln(w) + {log} AS j FROM f, p{i} p), r{i} AS (SELECT *, exp(j - top) / sum(exp(j - top)) OVER (PARTITION BY id) AS r FROM (SELECT *, max(j) OVER (PARTITION BY id) AS top FROM j{i}))"
        out += f", n{i} AS (SELECT *, sum(r) OVER (PARTITION BY k) + 1e-10 AS n, sum(r) OVER () AS nn FROM r{i}), p{i + 1} AS (SELECT k, any_value(n / nn) AS w, {means} FROM (SELECT k, {', '.join(xs)}, r, n, nn FROM n{i}) GROUP BY k, n)"
    return out


_MIX = (("gaussian_mixture", ["size"], "full", [[15.0], [35.0]]), ("gaussian_mixture_diag", ["size", "price"], "diag", [[10.0, 12.0], [40.0, 16.0]]))
for _name, _xs, _how, _starts in _MIX:

    @query(_name, f"{_mixture_sql(_xs, _starts, 3)} SELECT k AS component, round(w, 4) AS w, " + ", ".join(f"round(m{j}, 4) AS m{j}, round(v{j}, 3) AS v{j}" for j in range(len(_xs))) + " FROM p3")
    def gaussian_mixture(spark, d, xs=_xs, how=_how, starts=_starts):
        m = cluster.GaussianMixture(xs, 2, how, 3, init_means=starts).fit(parts(spark, d).withColumn("price", F.col("price") / 100))
        data = [(k, float(m.weights_[k]), *(float(v) for j in range(len(xs)) for v in (m.means_[k][j], m.covariances_[k][j][j]))) for k in range(2)]
        names = [f"{a}{j}" for j in range(len(xs)) for a in "mv"]
        out = rounded(rows(spark, data, "component int, w double, " + ", ".join(f"{n} double" for n in names)), "w", *(n for n in names if n[0] == "m"), digits=4)
        return rounded(out, *(n for n in names if n[0] == "v"), digits=3)


@query("gaussian_mixture_predict", f"{_mixture_sql(['size', 'price'], _MIX[1][3], 3)}, q AS (SELECT id, k, ln(w) - 0.5 * (ln(v0) + ln(v1) + (size - m0) * (size - m0) / v0 + (price - m1) * (price - m1) / v1) AS j FROM f, p3) SELECT id, arg_max(k, j) AS prediction FROM q GROUP BY id")
def gaussian_mixture_predict(spark, d):
    f = parts(spark, d).withColumn("price", F.col("price") / 100)
    return cluster.GaussianMixture(["size", "price"], 2, "diag", 3, init_means=_MIX[1][3]).fit(f).predict(f).select("id", "prediction")


_COV = f"SELECT var_samp(size) a, var_samp(p) c, covar_samp(size, p) b FROM (SELECT size, price / 100 p FROM ({PARTS_SQL}))"


@query("pca", f"SELECT round((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b), 6) AS v0, round((a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b), 6) AS v1 FROM ({_COV})")
def pca(spark, d):
    m = decomposition.PCA(["size", "p"]).fit(parts(spark, d).withColumn("p", F.col("price") / 100))
    return row(spark, v0=m.explained_variance_[0], v1=m.explained_variance_[1])


_AXIS = f"WITH f AS (SELECT id, size, price / 100 AS p FROM ({PARTS_SQL})), c AS ({_COV}), v AS (SELECT b / sqrt(b * b + (l - a) * (l - a)) AS v0, (l - a) / sqrt(b * b + (l - a) * (l - a)) AS v1 FROM (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l FROM c)), m AS (SELECT avg(size) AS m0, avg(p) AS m1 FROM f)"


@query("pca_round_trip", f"{_AXIS} SELECT id, round(m0 + v0 * (v0 * (size - m0) + v1 * (p - m1)), 4) AS size, round(m1 + v1 * (v0 * (size - m0) + v1 * (p - m1)), 4) AS p FROM f, v, m")
def pca_round_trip(spark, d):
    """To the first component and back."""
    f = parts(spark, d).withColumn("p", F.col("price") / 100)
    m = decomposition.PCA(["size", "p"], 1, whiten=False).fit(f)
    return rounded(m.inverse_transform(m.transform(f).select("id", "pc0")).select("id", "size", "p"), "size", "p", digits=4)


@query("truncated_svd", f"SELECT round(sqrt((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b)), 4) AS s0, round(sqrt((a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b)), 4) AS s1 FROM (SELECT sum(size * size) a, sum(p * p) c, sum(size * p) b FROM (SELECT size, price / 100 p FROM ({PARTS_SQL})))")
def truncated_svd(spark, d):
    m = decomposition.TruncatedSVD(["size", "p"]).fit(parts(spark, d).withColumn("p", F.col("price") / 100))
    return row(spark, 4, s0=m.singular_values_[0], s1=m.singular_values_[1])


@query("nmf")
def nmf(spark, d):
    f = parts(spark, d).withColumn("p", F.col("price") / 100)
    m = decomposition.NMF(["size", "p"], "id", max_iter=10).fit(f)
    return m.transform(f).select("id", "weights")


@query("tsne")
def tsne(spark, d):
    f = suppliers(spark, d).na.fill(0.0)
    return decomposition.TSNE(["a", "b", "c"], "id", perplexity=8).fit_transform(f)


def _signed(spark, d):
    f = table(spark, d, "supplier").select((F.col("s_acctbal") / 1000).alias("a"), (F.col("s_nationkey") / 5).alias("b"))
    return f.withColumn("label", F.when(F.col("a") + F.col("b") > 6, 1).otherwise(-1))


@query("svc")
def svc(spark, d):
    f = _signed(spark, d)
    return svm.SVC(["a", "b"], "label", gamma=0.5).fit(f).predict(f).groupBy("label", "prediction").count()


@query("svc_linear")
def svc_linear(spark, d):
    f = _signed(spark, d)
    return svm.SVC(["a", "b"], "label", kernel="linear").fit(f).predict(f).groupBy("label", "prediction").count()


@query("svr")
def svr(spark, d):
    f = _signed(spark, d)
    return svm.SVR(["a"], "b").fit(f).predict(f).select("a", "prediction")


@query("pipeline_predict", f"WITH f AS ({PARTS_SQL}) SELECT id, round((SELECT regr_intercept(price, size) FROM f) + size * (SELECT regr_slope(price, size) FROM f), 4) AS prediction FROM f")
def pipeline_predict(spark, d):
    f = parts(spark, d)
    p = make_pipeline(StandardScaler(["size"]), linear.LinearRegression(["size"], "price")).fit(f)
    return rounded(p.predict(f).select("id", "prediction"), "prediction", digits=4)


@query("chi2_tail", "SELECT x, round(exp(-x / 2.0), 9) AS p FROM range(1, 20) r(x)")
def chi2(spark, d):
    return rounded(rows(spark, [(x, special.chi2_tail(x, 2)) for x in range(1, 20)], "x long, p double"), "p", digits=9)


__all__ = ["ORDERS_SQL", "np", "orders"]

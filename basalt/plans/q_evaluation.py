"""Queries of metrics, splitters, calibration and statistical tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import selection as sel
from ..operators.bayes import GaussianNB
from ..operators.linear import LinearRegression, LogisticRegression, RidgeRegression
from ..operators.preprocess import StandardScaler
from .frames import LINES_SQL, ORDERS_SQL, lines, orders, rounded, row, rows
from .registry import query

_O = f"WITH o AS ({ORDERS_SQL})"
_CLASS = f"{_O}, l AS (SELECT DISTINCT t AS label FROM o UNION SELECT DISTINCT p FROM o), c AS (SELECT label, (SELECT count(*) FROM o WHERE t = label AND p = label)::DOUBLE tp, (SELECT count(*) FROM o WHERE p = label) told, (SELECT count(*) FROM o WHERE t = label) support FROM l), s AS (SELECT label, tp / (told + 1e-15) AS precision, tp / (support + 1e-15) AS recall, support, 2 * (tp / (told + 1e-15)) * (tp / (support + 1e-15)) / (tp / (told + 1e-15) + tp / (support + 1e-15) + 1e-15) AS f1 FROM c)"
_SCALARS = {
    "accuracy_score": (lambda o: m.accuracy_score(o, "t", "p"), f"{_O} SELECT round(avg((t = p)::INT::DOUBLE), 6) AS v FROM o"),
    "precision_macro": (lambda o: m.precision_score(o, "t", "p", "macro"), f"{_CLASS} SELECT round(avg(precision), 6) AS v FROM s"),
    "recall_weighted": (lambda o: m.recall_score(o, "t", "p", "weighted"), f"{_CLASS} SELECT round(sum(recall * support) / sum(support), 6) AS v FROM s"),
    "f1_binary": (lambda o: m.f1_score(o, "t", "p"), f"{_CLASS} SELECT round(f1, 6) AS v FROM s ORDER BY label DESC LIMIT 1"),
    "f1_micro": (lambda o: m.f1_score(o, "t", "p", "micro"), f"{_O} SELECT round(avg((t = p)::INT::DOUBLE), 6) AS v FROM o"),
    "roc_auc_score": (lambda o: m.roc_auc_score(o, "b", "s"), f"{_O}, r AS (SELECT b, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 k FROM o) SELECT round((sum(k) FILTER (b = 1) - sum(b) * (sum(b) + 1) / 2.0) / (sum(b) * sum(1 - b)), 6) AS v FROM r"),
    "log_loss": (lambda o: m.log_loss(o, "b", "s"), f"{_O}, c AS (SELECT b, greatest(1e-15, least(1 - 1e-15, s)) p FROM o) SELECT round(avg(-CASE WHEN b = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS v FROM c"),
    "matthews_corrcoef": (lambda o: m.matthews_corrcoef(o, "b", "q"), f"{_O}, c AS (SELECT count(*) FILTER (b=1 AND q=1)::DOUBLE tp, count(*) FILTER (b=0 AND q=0)::DOUBLE tn, count(*) FILTER (b=0 AND q=1)::DOUBLE fp, count(*) FILTER (b=1 AND q=0)::DOUBLE fn FROM o) SELECT round((tp*tn-fp*fn)/(sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn))+1e-15), 6) AS v FROM c"),
    "mean_squared_error": (lambda o: m.mean_squared_error(o, "y", "yhat"), f"{_O} SELECT round(avg((y-yhat)*(y-yhat)), 6) AS v FROM o"),
    "root_mean_squared_error": (lambda o: m.root_mean_squared_error(o, "y", "yhat"), f"{_O} SELECT round(sqrt(avg((y-yhat)*(y-yhat))), 6) AS v FROM o"),
    "mean_absolute_error": (lambda o: m.mean_absolute_error(o, "y", "yhat"), f"{_O} SELECT round(avg(abs(y-yhat)), 6) AS v FROM o"),
    "r2_score": (lambda o: m.r2_score(o, "y", "yhat"), f"{_O} SELECT round(1 - sum((y-yhat)*(y-yhat)) / (var_pop(y) * count(*) + 1e-15), 6) AS v FROM o"),
    "mean_absolute_percentage_error": (lambda o: m.mean_absolute_percentage_error(o, "y", "yhat"), f"{_O} SELECT round(avg(abs(y-yhat) / (abs(y) + 1e-8)), 6) AS v FROM o"),
    "median_absolute_error": (lambda o: m.median_absolute_error(o, "y", "yhat"), f"{_O} SELECT round(median(abs(y-yhat)), 6) AS v FROM o"),
    "huber_loss": (lambda o: m.huber_loss(o, "y", "yhat"), f"{_O} SELECT round(avg(CASE WHEN abs(y-yhat) <= 1 THEN 0.5*(y-yhat)*(y-yhat) ELSE abs(y-yhat) - 0.5 END), 6) AS v FROM o"),
    "explained_variance_score": (lambda o: m.explained_variance_score(o, "y", "yhat"), f"{_O} SELECT round(1 - var_pop(y-yhat) / (var_pop(y) + 1e-15), 6) AS v FROM o"),
    "max_error": (lambda o: m.max_error(o, "y", "yhat"), f"{_O} SELECT round(max(abs(y-yhat)), 6) AS v FROM o"),
    "mean_squared_log_error": (lambda o: m.mean_squared_log_error(o.withColumns({"y": F.abs("y"), "yhat": F.abs("yhat")}), "y", "yhat"), f"{_O} SELECT round(avg(pow(ln(1+abs(y)) - ln(1+abs(yhat)), 2)), 6) AS v FROM o"),
    "expected_calibration_error": (lambda o: sel.expected_calibration_error(o, "b", "s"), f"{_O} SELECT round(sum(n / t * abs(a - c)), 6) AS v FROM (SELECT count(*) n, avg(b) a, avg(s) c FROM o WHERE s < 1 GROUP BY floor(s * 10)), (SELECT count(*)::DOUBLE t FROM o)"),
}
for _name, (_fn, _sql) in _SCALARS.items():

    @query(_name, _sql)
    def scalar(spark, d, fn=_fn):
        return row(spark, v=float(fn(orders(spark, d))))


@query("confusion_matrix", f"{_O}, l AS (SELECT DISTINCT t AS label FROM o UNION SELECT DISTINCT p FROM o) SELECT a.label AS \"true\", b.label AS pred, (SELECT count(*) FROM o WHERE t = a.label AND p = b.label) AS n FROM l a, l b")
def confusion(spark, d):
    return m.confusion_matrix(orders(spark, d), "t", "p")


@query("classification_report", f"{_CLASS} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM s")
def report(spark, d):
    return rounded(m.classification_report(orders(spark, d), "t", "p"), "precision", "recall", "f1")


_CUM = f"{_O}, c AS (SELECT s, sum(sum(b)) OVER (ORDER BY s DESC) tp, sum(sum(1 - b)) OVER (ORDER BY s DESC) fp, (SELECT sum(b) FROM o) pos, (SELECT sum(1 - b) FROM o) neg FROM o GROUP BY s)"


@query("roc_curve", f"{_CUM} SELECT round(fp::DOUBLE / neg, 6) AS fpr, round(tp::DOUBLE / pos, 6) AS tpr, round(s, 6) AS threshold FROM c UNION ALL SELECT 0.0, 0.0, round(max(s) + 1, 6) FROM c")
def roc(spark, d):
    return rounded(m.roc_curve(orders(spark, d), "b", "s"), "fpr", "tpr", "threshold")


@query("precision_recall_curve", f"{_CUM} SELECT round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / pos, 6) AS recall, round(s, 6) AS threshold FROM c UNION ALL SELECT 1.0, 0.0, NULL")
def pr(spark, d):
    return rounded(m.precision_recall_curve(orders(spark, d), "b", "s"), "precision", "recall", "threshold")


@query("calibration_curve", f"{_O} SELECT CAST(floor(s * 10) AS BIGINT) AS bin, round(avg(b), 6) AS mean_true, round(avg(s), 6) AS mean_prob, count(*) AS n FROM o WHERE s < 1 GROUP BY 1")
def calibration(spark, d):
    return rounded(sel.calibration_curve(orders(spark, d), "b", "s"), "mean_true", "mean_prob")


@query("kfold", f"{_O} SELECT id, CAST(ntile(5) OVER (ORDER BY id) - 1 AS INT) AS fold FROM o")
def kfold(spark, d):
    return sel.KFold("id").assign(orders(spark, d)).select("id", "fold")


@query("stratified_kfold", f"{_O} SELECT id, CAST(ntile(4) OVER (PARTITION BY t ORDER BY id) - 1 AS INT) AS fold FROM o")
def stratified(spark, d):
    return sel.StratifiedKFold("id", "t", 4).assign(orders(spark, d)).select("id", "fold")


@query("leave_one_out", f"{_O} SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS INT) AS fold FROM o")
def leave_one_out(spark, d):
    return sel.LeaveOneOut("id").assign(orders(spark, d)).select("id", "fold")


@query(
    "cross_val_score",
    f"{_O}, f AS (SELECT *, ntile(3) OVER (ORDER BY id) - 1 AS fold FROM o), k AS (SELECT unnest([0, 1, 2]) AS k), w AS (SELECT k, regr_slope(y, yhat) wa, regr_intercept(y, yhat) wb FROM f, k WHERE fold <> k GROUP BY k) SELECT CAST(k AS INT) AS fold, round(1 - sum((y - wa * yhat - wb) * (y - wa * yhat - wb)) / (var_pop(y) * count(*) + 1e-15), 6) AS score FROM f JOIN w ON fold = k GROUP BY k",
)
def cross_val(spark, d):
    s = sel.cross_val_score(LinearRegression(["yhat"], "y"), orders(spark, d), "id", 3, "r2")
    return rounded(rows(spark, list(enumerate(s)), "fold int, score double"), "score")


def _folds_sql(of: str, k: int, by: str = "") -> str:
    """Each row of o as a test row of its fold, once for each fold k as h."""
    return f"SELECT o.*, ntile({k}) OVER ({by}ORDER BY id) - 1 AS fold FROM {of} o"


_CV = f"""{_O}, f AS ({_folds_sql('o', 3, 'PARTITION BY b ')}), h AS (SELECT unnest([0, 1, 2]) AS k),
 c AS (SELECT k, b, avg(y) m0, var_pop(y) + 1e-9 v0, avg(s) m1, var_pop(s) + 1e-9 v1, ln(count(*)::DOUBLE) lp FROM f, h WHERE fold <> k GROUP BY k, b),
 z AS (SELECT f.id, f.b, c.k, arg_max(c.b, lp - 0.5 * (ln(v0) + ln(v1) + (y - m0) * (y - m0) / v0 + (s - m1) * (s - m1) / v1)) AS pred FROM f JOIN c ON f.fold = c.k GROUP BY f.id, f.b, c.k),
 t AS (SELECT k, avg((b = pred)::INT) AS acc, count(*) FILTER (b = 1 AND pred = 1) / (count(*) FILTER (pred = 1) + 1e-15) AS pr, count(*) FILTER (b = 1 AND pred = 1) / (count(*) FILTER (b = 1) + 1e-15) AS re FROM z GROUP BY k)
 SELECT CAST(k AS INT) AS fold, 'accuracy' AS metric, round(acc, 6) AS score FROM t UNION ALL SELECT CAST(k AS INT), 'f1', round(2 * pr * re / (pr + re + 1e-15), 6) FROM t"""


@query("cross_validate", _CV)
def cross_validate(spark, d):
    return rounded(sel.cross_validate(GaussianNB(["y", "s"], "b"), orders(spark, d), "id", 3, ["accuracy", "f1"]).select("fold", "metric", "score"), "score")


_GRID = f"""{_O}, f AS ({_folds_sql('o', 3)}), h AS (SELECT unnest([0, 1, 2]) AS k), a AS (SELECT unnest([1.0, 1e7, 1e8])::DOUBLE AS alpha),
 g AS (SELECT k, count(*)::DOUBLE n, sum(yhat) sx, sum(yhat * yhat) sxx, sum(y) sy, sum(yhat * y) sxy FROM f, h WHERE fold <> k GROUP BY k),
 w AS (SELECT alpha, k, n, sx, sy, (n * sxy - sx * sy) / (n * (sxx + alpha) - sx * sx) AS wa FROM g, a),
 t AS (SELECT alpha, k, 1 - sum(pow(y - wa * yhat - (sy - wa * sx) / n, 2)) / (var_pop(y) * count(*) + 1e-15) AS score FROM f JOIN w ON fold = k GROUP BY alpha, k),
 m AS (SELECT alpha, avg(score) AS mean, stddev_pop(score) AS std FROM t GROUP BY alpha)
 SELECT alpha, round(mean, 6) AS mean, round(std, 6) AS std, alpha = (SELECT arg_max(alpha, mean) FROM m) AS best FROM m"""


@query("grid_search", _GRID)
def grid(spark, d):
    g = sel.GridSearchCV(RidgeRegression(["yhat"], "y"), {"alpha": [1.0, 1e7, 1e8]}, "id", 3, "r2").fit(orders(spark, d))
    return rounded(rows(spark, [(r["params"]["alpha"], r["mean"], r["std"], r["params"] == g.best_params_) for r in g.cv_results_], "alpha double, mean double, std double, best boolean"), "mean", "std")


_PLATT = f"{_O}, n AS (SELECT sum(b)::DOUBLE AS pos, sum(1 - b)::DOUBLE AS neg FROM o), g AS (SELECT s, CASE WHEN b = 1 THEN (pos + 1) / (pos + 2) ELSE 1 / (neg + 2) END AS t, count(*)::DOUBLE AS c FROM o, n GROUP BY s, b, pos, neg), w0 AS (SELECT 0.0::DOUBLE AS a, ln((neg + 1) / (pos + 1)) AS k FROM n)"
for _i in range(10):  # Newton's steps, far more than it takes
    _PLATT += f", q{_i} AS (SELECT a, k, s, t, c, 1 / (1 + exp(a * s + k)) AS p FROM g, w{_i}), h{_i} AS (SELECT any_value(a) AS a, any_value(k) AS k, sum(c * s * (t - p)) AS g1, sum(c * (t - p)) AS g2, sum(c * p * (1 - p) * s * s) AS h11, sum(c * p * (1 - p)) AS h22, sum(c * p * (1 - p) * s) AS h12 FROM q{_i})"
    _PLATT += f", w{_i + 1} AS (SELECT a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12 + 1e-10) AS a, k - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12 + 1e-10) AS k FROM h{_i})"


@query("platt_scaler", f"{_PLATT} SELECT id, round(1 / (1 + exp(a * s + k)), 6) AS calibrated FROM o, w10")
def platt(spark, d):
    p = sel.PlattScaler("s", "b").fit(orders(spark, d))
    return rounded(p.predict_proba(orders(spark, d)).select("id", "calibrated"), "calibrated")


# the least of the greatest means over the stretches that hold a score is what pooling violators comes to
_ISO = f"""{_O}, g AS (SELECT s, row_number() OVER (ORDER BY s) AS i, sum(sum(b)) OVER (ORDER BY s) AS sb, sum(count(*)) OVER (ORDER BY s) AS sn, sum(b) AS b, count(*) AS n FROM o GROUP BY s),
 st AS (SELECT a.i AS a, z.i AS z, (z.sb - a.sb + a.b)::DOUBLE / (z.sn - a.sn + a.n) AS m FROM g a JOIN g z ON a.i <= z.i),
 v AS (SELECT i, max(least_m) AS fitted FROM (SELECT g.i, a, min(m) AS least_m FROM g JOIN st ON a <= g.i AND z >= g.i GROUP BY g.i, a) GROUP BY i)
 SELECT id, round(fitted, 6) AS calibrated FROM o JOIN (SELECT s, i FROM g) USING (s) JOIN v USING (i)"""


@query("isotonic_calibrator", _ISO)
def isotonic(spark, d):
    p = sel.IsotonicCalibrator("s", "b").fit(orders(spark, d))
    return rounded(p.predict_proba(orders(spark, d)).select("id", "calibrated"), "calibrated")


@query("calibrated_classifier")
def calibrated(spark, d):
    o = StandardScaler(["y"]).fit_transform(orders(spark, d).withColumn("hot", (F.col("y") > 150).cast("int")))
    return sel.CalibratedClassifier(LogisticRegression(["y"], "hot", n_iter=10), "id", cv=2).fit(o).predict(o).groupBy("hot", "prediction").count()


@query("paired_ttest", f"{_O}, z AS (SELECT y - yhat d FROM o), t AS (SELECT avg(d) / (stddev_samp(d) / sqrt(count(*)) + 1e-15) AS t FROM z) SELECT round(t, 6) AS statistic, abs(t) > 1.9602 AS significant FROM t")
def ttest(spark, d):
    t = sel.paired_ttest(orders(spark, d), "y", "yhat")
    return row(spark, statistic=t["statistic"], significant=t["significant"])


_WILCOXON = f"""{_O}, z AS (SELECT y - yhat d FROM o), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 k FROM z WHERE d <> 0),
 s AS (SELECT least(sum(k) FILTER (d > 0), sum(k) FILTER (d < 0))::DOUBLE AS w, count(*)::DOUBLE AS n FROM r), t AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*) AS c FROM r GROUP BY abs(d)))
 SELECT round(w, 6) AS statistic, abs((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)) > 1.959964 AS significant FROM s, t"""


@query("wilcoxon_test", _WILCOXON)
def wilcoxon(spark, d):
    t = sel.wilcoxon_test(orders(spark, d), "y", "yhat")
    return row(spark, statistic=float(t["statistic"]), significant=t["significant"])


@query("mcnemar_test", f"{_O}, c AS (SELECT count(*) FILTER (q = b AND q2 <> b) x, count(*) FILTER (q <> b AND q2 = b) z FROM o), t AS (SELECT pow(abs(x - z) - 1, 2) / (x + z + 1e-10) AS t FROM c) SELECT round(t, 6) AS statistic, t > 3.841459 AS significant FROM t")
def mcnemar(spark, d):
    t = sel.mcnemar_test(orders(spark, d), "b", "q", "q2")
    return row(spark, statistic=t["statistic"], significant=t["significant"])


@query(
    "friedman_test",
    f"{_O}, z AS (SELECT id, 0 i, -y v FROM o UNION ALL SELECT id, 1, -yhat FROM o UNION ALL SELECT id, 2, -s * 200 FROM o), r AS (SELECT i, rank() OVER (PARTITION BY id ORDER BY v) + (count(*) OVER (PARTITION BY id, v) - 1) / 2.0 k FROM z), a AS (SELECT avg(k) r, count(*) n FROM r GROUP BY i) SELECT round(12.0 * max(n) / 12 * sum((r - 2) * (r - 2)), 6) AS statistic, round(exp(-12.0 * max(n) / 12 * sum((r - 2) * (r - 2)) / 2), 6) AS p_value FROM a",
)
def friedman(spark, d):
    o = orders(spark, d).withColumn("s", F.col("s") * 200)
    t = sel.friedman_test(o, ["y", "yhat", "s"], "id")
    return row(spark, statistic=t["statistic"], p_value=t["p_value"])


@query("five_by_two_cv_ttest")
def five(spark, d):
    o = orders(spark, d).withColumn("u", F.col("s") + F.col("b") * 0.3)
    return row(spark, statistic=sel.fivex2cv_ttest(GaussianNB(["u"], "b"), GaussianNB(["s"], "b"), o, "id")["statistic"])


_MESH = f"""WITH l AS ({LINES_SQL}), c AS (SELECT status, avg(x0) m0, var_pop(x0) + 1e-9 v0, avg(x1) m1, var_pop(x1) + 1e-9 v1, ln(count(*)::DOUBLE) p FROM l GROUP BY status),
 e AS (SELECT min(x0) - 0.5 a0, max(x0) + 0.5 b0, min(x1) - 0.5 a1, max(x1) + 0.5 b1 FROM l), g AS (SELECT i, j, a0 + i * ((b0 - a0) / 19) AS x0, a1 + j * ((b1 - a1) / 19) AS x1 FROM range(20) r(i), range(20) s(j), e)
 SELECT round(any_value(x0), 6) AS x0, round(any_value(x1), 6) AS x1, arg_max(status, p - 0.5 * (ln(v0) + ln(v1) + (x0 - m0) * (x0 - m0) / v0 + (x1 - m1) * (x1 - m1) / v1)) AS prediction FROM g, c GROUP BY i, j"""


@query("decision_boundary_data", _MESH)
def boundary(spark, d):
    from ..operators.charts import decision_boundary_data

    return decision_boundary_data(GaussianNB(["x0", "x1"], "status").fit(lines(spark, d)), lines(spark, d), "x0", "x1", 20).select(F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"), "prediction")


@query("learning_curve_data")
def learning(spark, d):
    from ..operators.charts import learning_curve_data

    return learning_curve_data(GaussianNB(["s"], "b"), orders(spark, d), "id", (0.3, 1.0), 2)


__all__ = ["LINES_SQL"]

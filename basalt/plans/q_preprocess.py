"""Queries of the preprocessing operators, functions and schedules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import base, optim
from ..operators import preprocess as pre
from ..operators.pipeline import FeatureUnion, make_pipeline
from ..sources.tables import missing_to_null, table
from .frames import LINES_SQL, ORDERS_SQL, PARTS_SQL, lines, orders, parts, rounded, row, rows
from .registry import query

XS = ["x0", "x1", "x2", "x3"]


def _parts_as(select: str, more: str = "") -> str:
    return f"WITH f AS ({PARTS_SQL}) SELECT {select} FROM f {more}"


@query("standard_scaler", _parts_as("id, round((size - avg(size) OVER ()) / stddev_pop(size) OVER (), 6) AS size, round((price - avg(price) OVER ()) / stddev_pop(price) OVER (), 6) AS price"))
def standard_scaler(spark, d):
    return rounded(pre.StandardScaler(["size", "price"]).fit_transform(parts(spark, d)).select("id", "size", "price"), "size", "price")


@query("standard_scaler_inverse", _parts_as("id, round(size, 6) AS size, round(price, 6) AS price"))
def standard_scaler_inverse(spark, d):
    s = pre.StandardScaler(["size", "price"]).fit(parts(spark, d))
    return rounded(s.inverse_transform(s.transform(parts(spark, d))).select("id", "size", "price"), "size", "price")


@query("min_max_scaler", _parts_as("id, round((size - min(size) OVER ()) / (max(size) OVER () - min(size) OVER ()) * 2 - 1, 6) AS size, round((price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()) * 2 - 1, 6) AS price"))
def min_max_scaler(spark, d):
    return rounded(pre.MinMaxScaler(["size", "price"], (-1.0, 1.0)).fit_transform(parts(spark, d)).select("id", "size", "price"), "size", "price")


@query("robust_scaler", f"WITH f AS ({PARTS_SQL}), q AS (SELECT median(price) m, quantile_cont(price, 0.25) a, quantile_cont(price, 0.75) b FROM f) SELECT id, round((price - m) / (b - a), 6) AS price FROM f, q")
def robust_scaler(spark, d):
    return rounded(pre.RobustScaler(["price"]).fit_transform(parts(spark, d)).select("id", "price"), "price")


for _norm, _sql in (("l2", "sqrt(size * size + price * price)"), ("l1", "abs(size) + abs(price)"), ("max", "greatest(abs(size), abs(price))")):

    @query(f"normalizer_{_norm}", _parts_as(f"id, round(size / ({_sql}), 6) AS size, round(price / ({_sql}), 6) AS price"))
    def normalizer(spark, d, norm=_norm):
        return rounded(pre.Normalizer(["size", "price"], norm).fit_transform(parts(spark, d)).select("id", "size", "price"), "size", "price")


@query("label_encoder", _parts_as("id, CAST(dense_rank() OVER (ORDER BY brand) - 1 AS INT) AS code"))
def label_encoder(spark, d):
    return pre.LabelEncoder("brand").fit_transform(parts(spark, d)).select("id", "code")


@query("label_encoder_inverse", _parts_as("id, brand AS label"))
def label_encoder_inverse(spark, d):
    e = pre.LabelEncoder("brand").fit(parts(spark, d))
    return e.inverse_transform(e.transform(parts(spark, d)).select("id", "code")).select("id", "label")


@query("ordinal_encoder", f"WITH f AS ({PARTS_SQL}), c AS (SELECT brand, dense_rank() OVER (ORDER BY brand) - 1 AS code FROM (SELECT DISTINCT brand FROM f WHERE id % 2 = 0 AND brand < 'Brand#4')) SELECT id, CAST(coalesce(code, -1) AS DOUBLE) AS brand FROM f LEFT JOIN c USING (brand)")
def ordinal_encoder(spark, d):
    f = parts(spark, d)
    return pre.OrdinalEncoder(["brand"]).fit(f.filter("id % 2 = 0 and brand < 'Brand#4'")).transform(f).select("id", "brand")


@query("one_hot_encoder", "SELECT o_orderkey AS id, " + ", ".join(f"CAST(o_orderstatus = '{c}' AS DOUBLE) AS o_orderstatus_{c}" for c in "FOP") + " FROM orders")
def one_hot_encoder(spark, d):
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    out = pre.OneHotEncoder(["o_orderstatus"]).fit_transform(f)
    missing = [c for c in ("o_orderstatus_F", "o_orderstatus_O", "o_orderstatus_P") if c not in out.columns]
    return out.withColumns({c: F.lit(0.0) for c in missing}).select("id", "o_orderstatus_F", "o_orderstatus_O", "o_orderstatus_P")


@query("target_encoder", f"WITH f AS ({PARTS_SQL}), g AS (SELECT avg(price) m FROM f), e AS (SELECT brand, count(*) / (count(*) + 10.0) AS w, avg(price) AS a FROM f GROUP BY brand) SELECT id, round(w * a + (1 - w) * m, 6) AS v FROM f JOIN e USING (brand), g")
def target_encoder(spark, d):
    return rounded(pre.TargetEncoder("brand", "price", output="v").fit_transform(parts(spark, d)).select("id", "v"), "v")


for _how, _sql in (("mean", "avg({0}) OVER ()"), ("median", "median({0}) OVER ()"), ("most_frequent", "(SELECT {0} FROM f WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY count(*) DESC, {0} LIMIT 1)"), ("constant", "7.5")):

    @query(f"simple_imputer_{_how}", f"WITH f AS ({PARTS_SQL}) SELECT id, round(coalesce(gap, {_sql.format('gap')}), 6) AS gap, round(coalesce(gap2, {_sql.format('gap2')}), 6) AS gap2 FROM f")
    def simple_imputer(spark, d, how=_how):
        return rounded(pre.SimpleImputer(["gap", "gap2"], how, 7.5).fit_transform(parts(spark, d)).select("id", "gap", "gap2"), "gap", "gap2")


_SUPPLIERS = "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 6 <> 0 THEN s_acctbal / 1000 END AS a, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_nationkey AS DOUBLE) END AS b, CAST(s_suppkey % 11 AS DOUBLE) AS c FROM supplier"


def suppliers(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), F.when(k % 6 != 0, F.col("s_acctbal") / 1000).alias("a"), F.when(k % 7 != 0, F.col("s_nationkey").cast("double")).alias("b"), (k % 11).cast("double").alias("c"))


@query(
    "knn_imputer",
    f"""WITH f AS ({_SUPPLIERS}), p AS (SELECT f.id, t.a ta, t.b tb, row_number() OVER (PARTITION BY f.id ORDER BY sqrt(coalesce((f.a-t.a)*(f.a-t.a),0)+coalesce((f.b-t.b)*(f.b-t.b),0)+(f.c-t.c)*(f.c-t.c)), t.id) r FROM f, f t WHERE f.a IS NULL OR f.b IS NULL),
 n AS (SELECT id, avg(ta) na, avg(tb) nb FROM p WHERE r <= 5 GROUP BY id) SELECT id, round(coalesce(a, na, 0), 6) AS a, round(coalesce(b, nb, 0), 6) AS b FROM f LEFT JOIN n USING (id)""",
)
def knn_imputer(spark, d):
    return rounded(pre.KNNImputer(["a", "b", "c"], "id").fit_transform(suppliers(spark, d)).select("id", "a", "b"), "a", "b")


@query("missing_to_null", "SELECT s_suppkey AS id, CASE WHEN s_nationkey <> 3 THEN CAST(s_nationkey AS DOUBLE) END AS n FROM supplier")
def missing(spark, d):
    return missing_to_null(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("double").alias("n")), ["n"], 3.0)


@query("variance_threshold", " UNION ALL ".join(f"SELECT '{x}' AS feature FROM ({LINES_SQL}) HAVING var_pop({x}) > 0.1" for x in XS))
def variance_threshold(spark, d):
    kept = pre.VarianceThreshold(XS, 0.1).fit(lines(spark, d)).get_support()
    return rows(spark, [(k,) for k in kept], "feature string")


def _f_sql(x: str) -> str:
    return f"SELECT '{x}' AS feature, round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*)) + 1e-10), 4) AS f FROM (SELECT count(*) n, avg({x}) m, var_pop({x}) v, (SELECT avg({x}) FROM l) g FROM l GROUP BY flag)"


@query("f_classif", f"WITH l AS ({LINES_SQL}) " + " UNION ALL ".join(map(_f_sql, XS)))
def f_classif(spark, d):
    return rounded(rows(spark, list(zip(XS, pre.f_classif(lines(spark, d), XS, "flag"), strict=True)), "feature string, f double"), "f", digits=4)


def _mi_sql(x: str) -> str:
    return f"""SELECT '{x}' AS feature, round(greatest(0, sum(p * ln(p / (px * py + 1e-12)))), 6) AS mi FROM (SELECT p, sum(p) OVER (PARTITION BY b) px, sum(p) OVER (PARTITION BY flag) py FROM
 (SELECT b, flag, count(*) / (SELECT count(*)::DOUBLE FROM l) p FROM (SELECT least(9, floor(({x} - lo) / ((hi - lo) / 10))) b, flag FROM l, (SELECT min({x}) lo, max({x}) hi FROM l)) GROUP BY b, flag))"""


@query("mutual_info_classif", f"WITH l AS ({LINES_SQL}) " + " UNION ALL ".join(map(_mi_sql, XS[:2])))
def mutual_info(spark, d):
    return rounded(rows(spark, list(zip(XS[:2], pre.mutual_info_classif(lines(spark, d), XS[:2], "flag"), strict=True)), "feature string, mi double"), "mi")


@query("select_k_best", f"WITH l AS ({LINES_SQL}), s AS (" + " UNION ALL ".join(map(_f_sql, XS)) + ") SELECT feature FROM (SELECT feature, row_number() OVER (ORDER BY f DESC, feature) r FROM s) WHERE r <= 2")
def select_k_best(spark, d):
    return rows(spark, [(f,) for f in pre.SelectKBest(XS, "flag", k=2).fit(lines(spark, d)).get_support()], "feature string")


@query("rfe", f"WITH c AS (SELECT count(*) * var_pop(x0) + 1 AS a, count(*) * covar_pop(x0, x2) AS b, count(*) * var_pop(x2) + 1 AS d, count(*) * covar_pop(x0, x1) AS p, count(*) * covar_pop(x2, x1) AS q FROM ({LINES_SQL})), w AS (SELECT abs(d * p - b * q) > abs(a * q - b * p) AS first FROM c) SELECT 'x0' AS feature, CASE WHEN first THEN 1 ELSE 2 END AS ranking FROM w UNION ALL SELECT 'x2', CASE WHEN first THEN 2 ELSE 1 END FROM w")
def rfe(spark, d):
    from ..operators.linear import RidgeRegression

    r = pre.RFE(RidgeRegression(["x0", "x2"], "x1"), 1).fit(lines(spark, d))
    return rows(spark, sorted(r.ranking_.items()), "feature string, ranking int")


for _name, _op, _sql in (
    ("random_under_sampler", lambda: pre.RandomUnderSampler("label", "id"), "(SELECT min(n) FROM c) AS n, (SELECT min(n) FROM c) AS different"),
    ("random_over_sampler", lambda: pre.RandomOverSampler("label", "id"), "(SELECT max(n) FROM c) AS n, n AS different"),
):

    @query(_name, f"WITH f AS ({PARTS_SQL}), c AS (SELECT label, count(*) n FROM f GROUP BY label) SELECT label, {_sql} FROM c")
    def resampled(spark, d, op=_op):
        f = parts(spark, d)
        return op().fit_resample(f).join(f.select("id"), "id").groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("id").alias("different"))


@query("smote", f"WITH f AS ({PARTS_SQL}) SELECT label, (SELECT max(n) FROM (SELECT count(*) n FROM f GROUP BY label)) AS n, min(size) AS low, max(size) AS high, min(price) AS cheap, max(price) AS dear FROM f GROUP BY label")
def smote(spark, d):
    """New points lie between old ones, so no class grows wider."""
    out = pre.SMOTE(["size", "price"], "label", "id").fit_resample(parts(spark, d))
    return out.groupBy("label").agg(F.count("*").alias("n"), F.min("size").alias("low"), F.max("size").alias("high"), F.min("price").alias("cheap"), F.max("price").alias("dear"))


_NATION = "SELECT n_nationkey AS i, CAST(n_nationkey AS DOUBLE) / 10 AS a, CAST(n_regionkey AS DOUBLE) / 2 AS b FROM nation"


def _nations(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), (F.col("n_nationkey") / 10).alias("a"), (F.col("n_regionkey") / 2).alias("b"))


_PAIRS = {
    "linear_kernel": (expr.linear_kernel, "x.a * y.a + x.b * y.b"),
    "rbf_kernel": (expr.rbf_kernel, "exp(-((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)))"),
    "poly_kernel": (expr.poly_kernel, "pow(x.a * y.a + x.b * y.b + 1, 3)"),
    "sigmoid_kernel": (expr.sigmoid_kernel, "tanh(x.a * y.a + x.b * y.b)"),
    "euclidean_distance": (expr.euclidean_distance, "sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b))"),
    "cosine_similarity": (expr.cosine_similarity, "(x.a * y.a + x.b * y.b) / ((sqrt(x.a * x.a + x.b * x.b) + 1e-10) * (sqrt(y.a * y.a + y.b * y.b) + 1e-10))"),
}
for _name, (_fn, _sql) in _PAIRS.items():

    @query(_name, f"WITH n AS ({_NATION}) SELECT x.i AS i, y.i AS j, round({_sql}, 6) + 0.0 AS v FROM n x, n y")
    def pairwise(spark, d, fn=_fn):
        n = _nations(spark, d)
        pairs = n.crossJoin(F.broadcast(n.select(F.col("i").alias("j"), F.col("a").alias("a2"), F.col("b").alias("b2"))))
        v = fn([F.col("a"), F.col("b")], [F.col("a2"), F.col("b2")])
        return pairs.select("i", "j", (F.round(v, 6) + 0.0).alias("v"))


_Z = "(s - 0.5) * 8"
_SCALAR = {
    "sigmoid": (expr.sigmoid, f"1 / (1 + exp(-({_Z})))"),
    "relu": (expr.relu, f"greatest(0, {_Z})"),
    "tanh": (expr.tanh, f"tanh({_Z})"),
}
for _name, (_fn, _sql) in _SCALAR.items():

    @query(_name, f"WITH o AS ({ORDERS_SQL}) SELECT id, round({_sql}, 6) AS v FROM o")
    def scalar(spark, d, fn=_fn):
        return orders(spark, d).select("id", F.round(fn((F.col("s") - 0.5) * 8), 6).alias("v"))


@query("softmax", f"WITH o AS ({ORDERS_SQL}) SELECT id, round(exp(s) / (exp(s) + exp(2 * s) + 1), 6) AS p0, round(ln(exp(s) / (exp(s) + exp(2 * s) + 1)), 6) AS l0 FROM o")
def softmax(spark, d):
    z = F.array(F.col("s"), 2 * F.col("s"), F.lit(0.0))
    return orders(spark, d).select("id", F.round(expr.softmax(z)[0], 6).alias("p0"), F.round(expr.log_softmax(z)[0], 6).alias("l0"))


@query("impurity", f"WITH o AS ({ORDERS_SQL}), c AS (SELECT priority, count(*) FILTER (b = 1) / count(*)::DOUBLE p FROM o GROUP BY priority) SELECT priority, round(-(p * log2(p) + (1 - p) * log2(1 - p)), 6) AS entropy, round(1 - p * p - (1 - p) * (1 - p), 6) AS gini FROM c")
def impurity(spark, d):
    n = lambda v: F.sum((F.col("b") == v).cast("double"))
    c = orders(spark, d).groupBy("priority").agg(F.array(n(0), n(1)).alias("c"))
    p = F.transform("c", lambda x: x / F.aggregate("c", F.lit(0.0), lambda a, b: a + b))
    return c.select("priority", F.round(expr.entropy(p), 6).alias("entropy"), F.round(expr.gini(F.col("c")), 6).alias("gini"))


@query("information_gain", f"WITH o AS ({ORDERS_SQL}), e AS (SELECT g, count(*) n, -sum(p * log2(p)) * 1.0 h FROM (SELECT 0 g, b, count(*) / sum(count(*)) OVER () p FROM o GROUP BY b) GROUP BY g), k AS (SELECT side, sum(c) n, -sum(c / t * log2(c / t)) h FROM (SELECT s <= 0.5 side, b, count(*)::DOUBLE c, sum(count(*)) OVER (PARTITION BY s <= 0.5) t FROM o GROUP BY s <= 0.5, b) GROUP BY side) SELECT round(max(e.h) - sum(k.n * k.h) / sum(k.n), 6) AS gain FROM e, k")
def information_gain(spark, d):
    n = lambda c: F.array(*(F.sum((c & (F.col("b") == v)).cast("double")) for v in (0, 1)))
    left = F.col("s") <= 0.5
    r = orders(spark, d).agg(n(F.lit(True)).alias("y"), n(left).alias("l"), n(~left).alias("r"))
    return r.select(F.round(expr.information_gain(F.col("y"), F.col("l"), F.col("r")), 6).alias("gain"))


@query("penalties", f"WITH o AS ({ORDERS_SQL}) SELECT id, round(abs(s) + abs(y), 6) AS l1, round((s * s + y * y) / 2000, 6) AS l2, round((0.3 * (abs(s) + abs(y)) + 0.7 * (s * s + y * y) / 2) / 1000, 6) AS en, round(0.3 * sign(y) + 0.7 * y, 6) AS g FROM o")
def penalties(spark, d):
    w = F.array("s", "y")
    return rounded(orders(spark, d).select("id", expr.l1_penalty(w).alias("l1"), (expr.l2_penalty(w) / 1000).alias("l2"), (expr.elastic_net_penalty(w, 0.3) / 1000).alias("en"), expr.elastic_net_gradient(w, 0.3)[1].alias("g")), "l1", "l2", "en", "g")


@query("sample_weights", f"WITH o AS ({ORDERS_SQL}) SELECT id, round(y * (count(*) OVER ()) / sum(y) OVER (), 6) AS y FROM o")
def sample_weights(spark, d):
    return rounded(base.validate_sample_weights(orders(spark, d), "y").select("id", "y"), "y")


@query("classes", f"SELECT DISTINCT flag FROM ({LINES_SQL})")
def classes(spark, d):
    return rows(spark, [(c,) for c in base.check_classification_targets(lines(spark, d), "flag")], "flag string")


@query("clip_gradients", "SELECT 0 AS i, round(3.0 * 5 / (sqrt(9.0 + 144) + 1e-8), 6) AS g UNION ALL SELECT 1, round(12.0 * 5 / (sqrt(9.0 + 144) + 1e-8), 6)")
def clip(spark, d):
    return rounded(rows(spark, [(i, float(v)) for i, v in enumerate(expr.clip_gradients(np.array([3.0, 12.0])))], "i int, g double"), "g")


@query("numerical_gradient", "SELECT 0 AS i, 2.0::DOUBLE AS g UNION ALL SELECT 1, 12.0::DOUBLE")
def numeric(spark, d):
    return rounded(rows(spark, [(i, float(v)) for i, v in enumerate(expr.numerical_gradient(lambda x: x[0] ** 2 + x[1] ** 3, np.array([1.0, 2.0])))], "i int, g double"), "g", digits=4)


_SCHEDULES = {
    "step_lr": (lambda o: optim.StepLR(o, 10, 0.5), "0.1 * pow(0.5, t // 10)"),
    "exponential_lr": (lambda o: optim.ExponentialLR(o, 0.9), "0.1 * pow(0.9, t)"),
    "cosine_annealing_lr": (lambda o: optim.CosineAnnealingLR(o, 40, 0.01), "0.01 + 0.09 * (1 + cos(pi() * t / 40)) / 2"),
}
for _name, (_fn, _sql) in _SCHEDULES.items():

    @query(_name, f"SELECT t, round({_sql}, 9) AS lr FROM range(1, 101) r(t)")
    def schedule(spark, d, fn=_fn):
        return rounded(fn(optim.SGD(0.1)).rates(spark, 100), "lr", digits=9)


@query("warmup_scheduler", "SELECT t, round(CASE WHEN t <= 10 THEN 0.1 * t / 10 ELSE 0.1 * pow(0.9, t - 10) END, 9) AS lr FROM range(1, 101) r(t)")
def warmup(spark, d):
    o = optim.SGD(0.1)
    s = optim.WarmupScheduler(o, 10, optim.ExponentialLR(optim.SGD(0.1), 0.9))
    return rounded(rows(spark, [(t, float(s.step())) for t in range(1, 101)], "t long, lr double"), "lr", digits=9)


_OPT = {
    "sgd": (lambda: optim.SGD(0.1, 0.9), "0.0", "0.0", "0.9 * m - 0.1 * 2 * w", "0.0", "w + (0.9 * m - 0.1 * 2 * w)"),
    "sgd_nesterov": (lambda: optim.SGD(0.1, 0.9, True), "0.0", "0.0", "0.9 * m - 0.1 * 2 * w", "0.0", "w + 0.9 * (0.9 * m - 0.1 * 2 * w) - 0.1 * 2 * w"),
    "adam": (lambda: optim.Adam(0.1), "0.0", "0.0", "0.9 * m + 0.1 * 2 * w", "0.999 * v + 0.001 * 4 * w * w", "w - 0.1 * ((0.9 * m + 0.1 * 2 * w) / (1 - pow(0.9, t + 1))) / (sqrt((0.999 * v + 0.001 * 4 * w * w) / (1 - pow(0.999, t + 1))) + 1e-8)"),
    "rmsprop": (lambda: optim.RMSProp(0.1), "0.0", "0.0", "0.0", "0.9 * v + 0.1 * 4 * w * w", "w - 0.1 * 2 * w / (sqrt(0.9 * v + 0.1 * 4 * w * w) + 1e-8)"),
    "adagrad": (lambda: optim.AdaGrad(0.1), "0.0", "0.0", "0.0", "v + 4 * w * w", "w - 0.1 * 2 * w / (sqrt(v + 4 * w * w) + 1e-8)"),
}
for _name, (_fn, _m, _v, _m2, _v2, _w2) in _OPT.items():

    @query(f"optimizer_{_name}", f"WITH RECURSIVE r(t, w, m, v) AS (SELECT 0::BIGINT, 3.0::DOUBLE, {_m}::DOUBLE, {_v}::DOUBLE UNION ALL SELECT t + 1, ({_w2})::DOUBLE, ({_m2})::DOUBLE, ({_v2})::DOUBLE FROM r WHERE t < 25) SELECT t, round(w, 6) AS w FROM r")
    def optimise(spark, d, fn=_fn):
        o, w, out = fn(), {"w": np.array([3.0])}, [(0, 3.0)]
        for t in range(1, 26):
            w = o.step(w, {"w": 2 * w["w"]})
            out.append((t, float(w["w"][0])))
        return rounded(rows(spark, out, "t long, w double"), "w")


@query("mini_batches", f"WITH o AS ({ORDERS_SQL}) SELECT CAST((row_number() OVER (ORDER BY id) - 1) // 64 AS BIGINT) AS batch, id FROM o")
def mini_batches(spark, d):
    return optim.mini_batches(orders(spark, d), "id", 64, shuffle=False).select("batch", "id")


_EPOCH = f"""WITH RECURSIVE f AS (SELECT (row_number() OVER (ORDER BY id) - 1) // 64 AS k, size / 50 AS x, size / 25 + (id % 5) / 10.0 AS t FROM ({PARTS_SQL})), b AS (SELECT k, avg(x * x) AS xx, avg(x * t) AS xt, avg(t * t) AS tt FROM f GROUP BY k),
 r(k, w, loss) AS (SELECT -1::BIGINT, 0.0::DOUBLE, NULL::DOUBLE UNION ALL SELECT b.k, w - 0.1 * 2 * (w * xx - xt), w * w * xx - 2 * w * xt + tt FROM r JOIN b ON b.k = r.k + 1)
 SELECT round(arg_max(w, k), 6) AS w, round(avg(loss), 6) AS loss FROM r"""


@query("run_epoch", _EPOCH)
def run_epoch(spark, d):
    loss = lambda x, y, p: ((x[:, 0] * p["w"] - y) ** 2).mean()
    grad = lambda x, y, p: {"w": np.array([2 * ((x[:, 0] * p["w"] - y) * x[:, 0]).mean()])}
    f = parts(spark, d).withColumn("x", F.col("size") / 50).withColumn("t", F.col("size") / 25 + (F.col("id") % 5) / 10)
    p, mean = optim.run_epoch(f, "id", ["x"], "t", loss, grad, {"w": np.zeros(1)}, optim.SGD(0.1, 0.0), 64, shuffle=False)
    return row(spark, w=float(p["w"][0]), loss=mean)


@query("feature_union", _parts_as("id, round((size - avg(size) OVER ()) / stddev_pop(size) OVER (), 6) AS a, round(2 * (size - min(size) OVER ()) / (max(size) OVER () - min(size) OVER ()), 6) AS b"))
def feature_union(spark, d):
    u = FeatureUnion([("std", pre.StandardScaler(["size"])), ("mm", pre.MinMaxScaler(["size"]))], {"mm": 2.0})
    return rounded(u.fit_transform(parts(spark, d)).select("id", F.col("std__size").alias("a"), F.col("mm__size").alias("b")), "a", "b")


@query("pipeline_transform", f"WITH f AS ({PARTS_SQL}), g AS (SELECT id, coalesce(gap, avg(gap) OVER ()) AS v FROM f) SELECT id, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) AS gap FROM g")
def pipeline_transform(spark, d):
    return rounded(make_pipeline(pre.SimpleImputer(["gap"]), pre.StandardScaler(["gap"])).fit_transform(parts(spark, d)).select("id", "gap"), "gap")

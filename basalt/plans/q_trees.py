"""Queries of trees, forests and boosting. The oracles grow two levels over two features in SQL, split by split."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trees
from .frames import PARTS_SQL, parts, rounded, rows
from .registry import query

# price in bands, so that both features have few distinct values; `two` needs both features to tell its classes
FRAME = f"SELECT id, size, floor(price / 20) AS band, price / 100 + size * size / 300 + (id % 7) / 10.0 AS y, CAST(price > 960 OR size > 40 AS INT) AS two FROM ({PARTS_SQL})"
XS = ["size", "band"]


def frame(spark, d):
    f = parts(spark, d)
    return f.select("id", "size", F.floor(F.col("price") / 20).cast("double").alias("band"), (F.col("price") / 100 + F.col("size") * F.col("size") / 300 + (F.col("id") % 7) / 10).alias("y"), ((F.col("price") > 960) | (F.col("size") > 40)).cast("int").alias("two"))


def grown(source: str, tag: str, gain: str, allowed: str = "TRUE", midpoint: bool = False, positive: bool = False, pure: str = "FALSE", depth: int = 2) -> str:
    """CTEs that grow a tree over source (id, size, band, s0, s1, s2): {tag}_leaf has each row's node and the node's sums t0, t1, t2; {tag}_split the splits."""
    out = [f"{tag}_n0 AS (SELECT *, 1 AS node FROM {source})"]
    for k in range(depth):
        n = f"{tag}_n{k}"
        out.append(f"{tag}_t{k} AS (SELECT node, sum(s0) AS t0, sum(s1) AS t1, sum(s2) AS t2 FROM {n} GROUP BY node)")
        out.append(f"{tag}_u{k} AS (SELECT node, 0 AS j, size AS x, s0, s1, s2 FROM {n} UNION ALL SELECT node, 1, band, s0, s1, s2 FROM {n})")
        out.append(f"{tag}_c{k} AS (SELECT node, j, x, sum(sum(s0)) OVER w AS l0, sum(sum(s1)) OVER w AS l1, sum(sum(s2)) OVER w AS l2, lead(x) OVER (PARTITION BY node, j ORDER BY x) AS nx FROM {tag}_u{k} GROUP BY node, j, x WINDOW w AS (PARTITION BY node, j ORDER BY x))")
        out.append(f"{tag}_g{k} AS (SELECT *, {gain} AS gain FROM (SELECT c.*, t0, t1, t2, t0 - l0 AS r0, t1 - l1 AS r1, t2 - l2 AS r2 FROM {tag}_c{k} c JOIN {tag}_t{k} USING (node)) WHERE nx IS NOT NULL AND NOT ({pure}) AND {allowed})")
        out.append(f"{tag}_b{k} AS (SELECT node, j, {'(x + nx) / 2' if midpoint else 'x'} AS cut, gain FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, j, x) AS r FROM {tag}_g{k}{' WHERE gain > 0' if positive else ''}) WHERE r = 1)")
        out.append(f"{tag}_n{k + 1} AS (SELECT n.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN n.node WHEN CASE WHEN b.j = 0 THEN size ELSE band END <= cut THEN 2 * n.node ELSE 2 * n.node + 1 END AS node FROM {n} n LEFT JOIN {tag}_b{k} b ON b.node = n.node)")
    out.append(f"{tag}_leaf AS (SELECT *, sum(s0) OVER w AS t0, sum(s1) OVER w AS t1, sum(s2) OVER w AS t2 FROM {tag}_n{depth} WINDOW w AS (PARTITION BY node))")
    out.append(f"{tag}_split AS (" + " UNION ALL ".join(f"SELECT * FROM {tag}_b{k}" for k in range(depth)) + ")")
    return ", ".join(out)


def _sse(n: str, s: str, q: str) -> str:
    return f"({q} / {n} - ({s} / {n}) * ({s} / {n}))"


MSE = f"{_sse('t0', 't1', 't2')} - (l0 * {_sse('l0', 'l1', 'l2')} + r0 * {_sse('r0', 'r1', 'r2')}) / t0"
PURE = f"{_sse('t0', 't1', 't2')} <= 1e-12"
GINI = "(1 - (t1 * t1 + t2 * t2) / (t0 * t0)) - (l0 * (1 - (l1 * l1 + l2 * l2) / (l0 * l0)) + r0 * (1 - (r1 * r1 + r2 * r2) / (r0 * r0))) / t0"
NEWTON = "0.5 * (l1 * l1 / (l2 + 1) + r1 * r1 / (r2 + 1) - t1 * t1 / (t2 + 1))"
_F = f"WITH f AS ({FRAME})"
_NAMES = "CASE WHEN j = 0 THEN 'size' ELSE 'band' END AS feature"


def splits(spark, root):
    """(node, feature, threshold, gain) of a tree's splits; the root is node 1, children 2n and 2n + 1."""
    out, stack = [], [(1, root)]
    while stack:
        i, n = stack.pop()
        if n.feature is not None:
            out.append((i, n.feature, float(n.threshold), float(n.gain)))
            stack += [(2 * i, n.left), (2 * i + 1, n.right)]
    return rounded(rows(spark, out, "node int, feature string, threshold double, gain double"), "threshold", "gain")


def _split_sql(tag: str) -> str:
    return f"SELECT node, {_NAMES}, round(cut, 6) AS threshold, round(gain, 6) AS gain FROM {tag}_split"


_REG = f"{_F}, s AS (SELECT *, 1.0::DOUBLE AS s0, y AS s1, y * y AS s2 FROM f), {grown('s', 'a', MSE, pure=PURE)}"
_CLS = f"{_F}, s AS (SELECT *, 1.0::DOUBLE AS s0, (two = 0)::DOUBLE AS s1, (two = 1)::DOUBLE AS s2 FROM f), {grown('s', 'a', GINI, pure='greatest(t1, t2) >= t0 - 1e-9')}"


@query("decision_tree", f"{_REG} {_split_sql('a')}")
def decision_tree(spark, d):
    return splits(spark, trees.DecisionTree(XS, "y", "regression", max_depth=2).fit(frame(spark, d)).tree_)


@query("decision_tree_exact", f"{_REG} SELECT id, round(t1 / t0, 6) AS prediction FROM a_leaf")
def decision_tree_exact(spark, d):
    f = frame(spark, d)
    return rounded(trees.DecisionTree(XS, "y", "regression", max_depth=2, max_bins=None).fit(f).predict(f).select("id", "prediction"), "prediction")


@query("decision_tree_classifier", f"{_CLS} SELECT id, CAST(t2 > t1 AS INT) AS prediction FROM a_leaf")
def decision_tree_classifier(spark, d):
    f = frame(spark, d)
    return trees.DecisionTree(XS, "two", max_depth=2).fit(f).predict(f).select("id", "prediction")


@query("decision_tree_importances", f"{_CLS}, w AS (SELECT p.node, sum(s0) AS n FROM a_split p JOIN a_leaf l ON l.node = p.node OR l.node // 2 = p.node OR l.node // 4 = p.node GROUP BY p.node), i AS (SELECT unnest([0, 1]) AS j) SELECT {_NAMES}, round(coalesce(sum(gain * n) / (SELECT sum(gain * n) FROM a_split JOIN w USING (node)), 0), 6) AS importance FROM i LEFT JOIN a_split USING (j) LEFT JOIN w USING (node) GROUP BY j")
def importances(spark, d):
    t = trees.DecisionTree(XS, "two", max_depth=2).fit(frame(spark, d))
    return rounded(rows(spark, [(x, float(v)) for x, v in zip(XS, t.feature_importances_, strict=True)], "feature string, importance double"), "importance")


@query("decision_tree_stop_rules", f"{_F}, s AS (SELECT *, 1.0::DOUBLE AS s0, y AS s1, y * y AS s2 FROM f), {grown('s', 'a', MSE, 'least(l0, r0) >= 30', pure=f'{PURE} OR t0 < 600')} {_split_sql('a')}")
def stop_rules(spark, d):
    f = frame(spark, d)
    return splits(spark, trees.DecisionTree(XS, "y", "regression", max_depth=2, min_samples_leaf=30, min_samples_split=600).fit(f).tree_)


@query("random_forest")
def random_forest(spark, d):
    f = parts(spark, d)
    m = trees.RandomForest(["size", "price"], "label", "id", 5, max_depth=3, oob_score=True).fit(f)
    return m.predict(f).groupBy("label", "prediction").agg(F.count("*").alias("n"), F.round(F.avg(F.lit(m.oob_score_)), 6).alias("oob"))


@query("random_forest_without_bags", f"{_CLS} SELECT id, CAST(t2 > t1 AS INT) AS prediction, CAST(t2 > t1 AS DOUBLE) AS p1 FROM a_leaf")
def forest_without_bags(spark, d):
    f = frame(spark, d)
    m = trees.RandomForest(XS, "two", "id", 3, max_depth=2, max_features=None, bootstrap=False).fit(f)
    return m.predict_proba(f).select("id", "prediction", F.col("probability")[1].alias("p1"))


_BOOST = f"{_F}, s AS (SELECT *, 1.0::DOUBLE AS s0, y - avg(y) OVER () AS s1, pow(y - avg(y) OVER (), 2) AS s2, avg(y) OVER () AS m FROM f), {grown('s', 'a', MSE, pure=PURE)}, s2 AS (SELECT id, size, band, y, 1.0::DOUBLE AS s0, y - m - 0.5 * t1 / t0 AS s1, pow(y - m - 0.5 * t1 / t0, 2) AS s2, m + 0.5 * t1 / t0 AS m FROM a_leaf), {grown('s2', 'b', MSE, pure=PURE)}"


@query("gradient_boosting_regressor", f"{_BOOST} SELECT id, round(m + 0.5 * t1 / t0, 6) AS prediction FROM b_leaf")
def gbr(spark, d):
    f = frame(spark, d)
    return rounded(trees.GradientBoostingRegressor(XS, "y", 2, 0.5, max_depth=2).fit(f).predict(f).select("id", "prediction"), "prediction")


_LOGIT = f"{_F}, z AS (SELECT *, avg(two) OVER () AS p, ln(avg(two) OVER () / (1 - avg(two) OVER ())) AS m FROM f)"


@query("gradient_boosting_classifier", f"{_LOGIT}, s AS (SELECT id, size, band, m, 1.0::DOUBLE AS s0, two - p AS s1, pow(two - p, 2) AS s2 FROM z), {grown('s', 'a', MSE, pure=PURE)} SELECT id, round(1 / (1 + exp(-(m + 0.5 * t1 / t0))), 6) AS p1 FROM a_leaf")
def gbc(spark, d):
    f = frame(spark, d)
    return rounded(trees.GradientBoostingClassifier(XS, "two", 1, 0.5, max_depth=2).fit(f).predict_proba(f).select("id", F.col("probability")[1].alias("p1")), "p1")


_XGB = f"{_LOGIT}, s AS (SELECT id, size, band, two, m, 1.0::DOUBLE AS s0, p - two AS s1, p * (1 - p) AS s2 FROM z), {grown('s', 'a', NEWTON, 'least(l2, r2) >= 1', True, True)}"
_XGB2 = f"{_XGB}, m1 AS (SELECT id, size, band, two, m - 0.5 * t1 / (t2 + 1) AS m FROM a_leaf), s2 AS (SELECT *, 1.0::DOUBLE AS s0, 1 / (1 + exp(-m)) - two AS s1, 1 / (1 + exp(-m)) * (1 - 1 / (1 + exp(-m))) AS s2 FROM m1), {grown('s2', 'b', NEWTON, 'least(l2, r2) >= 1', True, True)}"


@query("xgb_classifier", f"{_XGB2} SELECT id, round(1 / (1 + exp(-(m - 0.5 * t1 / (t2 + 1)))), 6) AS p1 FROM b_leaf")
def xgb(spark, d):
    f = frame(spark, d)
    return rounded(trees.XGBoostClassifier(XS, "two", 2, 0.5, max_depth=2).fit(f).predict_proba(f).select("id", F.col("probability")[1].alias("p1")), "p1")


@query("xgb_tree", f"{_F}, s AS (SELECT *, 1.0::DOUBLE AS s0, y / 10 - 1.4 + size / 100 AS s1, 1.0::DOUBLE AS s2 FROM f), {grown('s', 'a', NEWTON, 'least(l2, r2) >= 1', True, True)} {_split_sql('a')}")
def xgb_tree(spark, d):
    return splits(spark, trees.xgb_tree(frame(spark, d), XS, F.col("y") / 10 - 1.4 + F.col("size") / 100, F.lit(1.0), max_depth=2))

"""Registered queries of refits, suites, wide encodings, k-means bins, metric files and substring joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foldline.functions.hashing import h15, sql_h15
from foldline.operators import features as FE
from foldline.operators import preprocess as PP
from foldline.plans import derived as D
from foldline.plans.catalog import _t, query
from foldline.session import checkpoint_dir


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/foldline-{name}-{uuid.uuid4().hex}"


# --- refit, saved, loaded, scored -------------------------------------------------------

# orders with a year that is missing in every seventh row; the target is a price in units of 100,000
_ORD_RAW_SQL = """(SELECT o_orderkey, o_totalprice / 1.0e5 AS price, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS prio,
  CASE WHEN o_orderkey % 7 <> 0 THEN year(o_orderdate) END AS yr FROM orders)"""

_OLS_SQL = f"""WITH o AS {_ORD_RAW_SQL},
x AS (SELECT price AS y, prio, yr, CAST(prio AS DOUBLE) AS b, coalesce(yr, (SELECT median(yr) FROM o)) AS a FROM o),
c AS (SELECT covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(a, b) AS ab, var_pop(a) AS va, var_pop(b) AS vb,
             avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM x),
k AS (SELECT (ay * vb - by_ * ab) / (va * vb - ab * ab) AS ka, (by_ * va - ay * ab) / (va * vb - ab * ab) AS kb, c.* FROM c)"""


def _orders_raw(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 1.0e5).alias("price"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("prio"),
        F.when(F.col("o_orderkey") % 7 != 0, F.year("o_orderdate")).alias("yr"))


@query("trn_refit_score_orders", _OLS_SQL + """
SELECT prio, yr, count(*) AS n, round(avg(my + ka * (a - ma) + kb * (b - mb)), 6) AS prediction FROM x, k GROUP BY prio, yr""")
def trn_refit_score_orders(spark, sf_dir):
    """TRN-09/13, SNK-05: imputation, scaling and a linear model fitted on all orders, saved as one pipeline, loaded again and
    applied to the raw rows."""
    from pyspark.ml.regression import LinearRegression

    from foldline.operators import training as TR
    raw = _orders_raw(spark, sf_dir)
    spec = TR.make_spec(raw, ["o_orderkey"], "price", "regression")
    path = _folder(spark, "refit")
    TR.final_refit(spec, lambda: LinearRegression(solver="normal"), path=path)
    scored = TR.score_batch(path, raw.drop("price"))
    return scored.groupBy("prio", "yr").agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("prediction"))


# --- seeds x folds x variants -------------------------------------------------------------

_SUITE_SEEDS, _SUITE_K = (42, 77), 3
_SUITE_SQL = f"""WITH p AS (SELECT p_partkey, p_retailprice / 100.0 AS y, CAST(p_size AS DOUBLE) AS x FROM part),
f AS (SELECT p.*, s.seed, (row_number() OVER (PARTITION BY s.seed ORDER BY {sql_h15('s.seed', 'p_partkey')}, p_partkey) - 1) % {_SUITE_K} AS fold
  FROM p, (SELECT unnest([{', '.join(map(str, _SUITE_SEEDS))}]) AS seed) s),
t AS (SELECT f.seed, g.g, f.y, f.x AS a, f.x * f.x AS b FROM f JOIN range(0, {_SUITE_K}) g(g) ON f.fold <> g.g),
c AS (SELECT seed, g, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(a, b) AS ab, var_pop(a) AS va, var_pop(b) AS vb,
        avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM t GROUP BY seed, g),
e AS (SELECT 'baseline' AS feature_variant, f.seed, f.fold, f.y, my + ay / va * (x - ma) AS h FROM f JOIN c ON f.seed = c.seed AND f.fold = c.g
  UNION ALL SELECT 'no_scaling', f.seed, f.fold, f.y, my + ay / va * (x - ma) FROM f JOIN c ON f.seed = c.seed AND f.fold = c.g
  UNION ALL SELECT 'poly2', f.seed, f.fold, f.y, my + (ay * vb - by_ * ab) / (va * vb - ab * ab) * (x - ma)
    + (by_ * va - ay * ab) / (va * vb - ab * ab) * (x * x - mb) FROM f JOIN c ON f.seed = c.seed AND f.fold = c.g)
SELECT 'linear' AS estimator_name, feature_variant, CAST(seed AS INTEGER) AS seed, CAST(fold AS INTEGER) AS fold, count(*) AS n,
  round(sqrt(avg((y - h) * (y - h))), 6) AS rmse, round(avg(abs(y - h)), 6) AS mae,
  round(1 - sum((y - h) * (y - h)) / (var_pop(y) * count(*)), 6) AS r2 FROM e GROUP BY feature_variant, seed, fold"""


@query("trn_suite_part", _SUITE_SQL)
def trn_suite_part(spark, sf_dir):
    """TRN-03/08, FEA-11, SPL-08: two seeds x three folds x three feature variants of a linear model on the same splits."""
    from pyspark.ml.regression import LinearRegression

    from foldline.operators import training as TR
    p = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 100.0).alias("y"), F.col("p_size").cast("double").alias("x"))
    spec = TR.make_spec(p, ["p_partkey"], "y", "regression")
    cfg = TR.ExperimentConfig(name="suite", seeds=_SUITE_SEEDS, k=_SUITE_K)
    folds, errors = TR.run_suite(spec, {"linear": lambda: LinearRegression(solver="normal")}, cfg, ("baseline", "poly2", "no_scaling"))
    if errors:
        raise RuntimeError(str(errors))
    return folds.select("estimator_name", "feature_variant", "seed", "fold", "n", "rmse", "mae", "r2")


_RIDGE = (0.0, 0.5, 2.0)
_SEARCH_SQL = f"""WITH p AS (SELECT p_partkey, p_retailprice / 100.0 AS y, CAST(p_size AS DOUBLE) AS x FROM part),
f AS (SELECT p.*, (row_number() OVER (ORDER BY {sql_h15('42', 'p_partkey')}, p_partkey) - 1) % 3 AS fold FROM p),
t AS (SELECT g.g, f.y, f.x FROM f JOIN range(0, 3) g(g) ON f.fold <> g.g),
c AS (SELECT g, covar_pop(x, y) / var_pop(x) AS b, avg(x) AS mx, avg(y) AS my, stddev_pop(y) AS sy FROM t GROUP BY g),
e AS (SELECT r.r, f.fold, sqrt(avg(pow(y - (my + b / (1 + r.r / sy) * (x - mx)), 2))) AS rmse FROM f JOIN c ON f.fold = c.g,
  (SELECT unnest([{', '.join(map(str, _RIDGE))}]) AS r) r GROUP BY r.r, f.fold),
s AS (SELECT 'regParam=' || CAST(CAST(r AS DOUBLE) AS VARCHAR) AS framework, avg(rmse) AS score FROM e GROUP BY r)
SELECT CAST(row_number() OVER (ORDER BY score, framework) AS INTEGER) AS rank, framework, 'rmse' AS metric, round(score, 6) AS score FROM s"""


@query("trn_search_part", _SEARCH_SQL)
def trn_search_part(spark, sf_dir):
    """TRN-04/06: a grid of ridge penalties on keyed folds; a classification score asked of a regression becomes RMSE."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from foldline.operators import search as SE
    p = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 100.0).alias("label"), F.col("p_size").cast("double").alias("x"))
    xy = VectorAssembler(inputCols=["x"], outputCol="features").transform(p)
    space = {"regParam": {"type": "categorical", "choices": list(_RIDGE)}}
    _, board = SE.random_search(xy, LinearRegression(solver="normal"), space, "regression", "p_partkey", n_iter=20, k=3, metric="accuracy")
    return SE.leaders(board)


@query("trn_cv_softmax_orders", None)
def trn_cv_softmax_orders(spark, sf_dir):
    """TRN-01 with three classes (order status): softmax boosting, two folds, 10 rounds of depth 4 here (500 of depth 6 by default)."""
    from foldline.operators import training as TR
    from foldline.operators.boosting import SoftmaxBoosting
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mo"),
                                           "o_orderstatus")
    spec = TR.make_spec(o, ["o_orderkey"], "o_orderstatus", "classification")
    cfg = TR.ExperimentConfig(name="softmax", seeds=(42,), k=2, parallelism=2)
    return TR.run_experiment(spec, lambda: SoftmaxBoosting(3, rounds=10, depth=4), cfg).folds


_PRED_SQL = _SUITE_SQL[:_SUITE_SQL.index("SELECT 'linear' AS estimator_name")].replace("[42, 77]", "[42]")


@query("trn_predictions_part", _PRED_SQL + """
SELECT p.p_brand, CAST(q.fold AS INTEGER) AS fold, count(*) AS n, round(avg(q.h), 6) AS mean_prediction, round(avg(abs(q.y - q.h)), 6) AS mean_error
FROM (SELECT f.p_partkey, f.fold, f.y, my + ay / va * (x - ma) AS h FROM f JOIN c ON f.seed = c.seed AND f.fold = c.g) q JOIN part p USING (p_partkey)
GROUP BY ALL""")
def trn_predictions_part(spark, sf_dir):
    """JOI-08: held-out predictions of every fold joined to the rows by key, summed up by brand."""
    from pyspark.ml.regression import LinearRegression

    from foldline.operators import training as TR
    p = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 100.0).alias("y"), F.col("p_size").cast("double").alias("x"))
    spec = TR.make_spec(p, ["p_partkey"], "y", "regression")
    r = TR.run_experiment(spec, lambda: LinearRegression(solver="normal"), TR.ExperimentConfig(name="linear", seeds=(42,), k=_SUITE_K))
    j = r.predictions.join(_t(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    return j.groupBy("p_brand", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("y_pred").alias("mean_prediction"),
                                            F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mean_error"))


@query("trn_mlp_holdout_part", None)
def trn_mlp_holdout_part(spark, sf_dir):
    """TRN-10: the feed-forward network on a stratified holdout (part: size above 25)."""
    from foldline.operators import training as TR
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_brand", "p_type", (F.col("p_size") > 25).cast("int").alias("big"))
    spec = TR.make_spec(p, ["p_partkey"], "big", "classification")
    cfg = TR.ExperimentConfig(name="mlp", seeds=(42,))
    return TR.run_experiment(spec, TR.FeedForward, cfg, folds=TR.assign_folds(spec, cfg, holdout=True)).folds


# --- one-hot of any width -------------------------------------------------------------------

def _line_fold():
    return (h15(F.lit(42), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")) % 5).cast("int")


_WIDE = ["l_orderkey", "l_shipdate", "l_returnflag"]
_WIDE_FOLD = sql_h15("42", "l_orderkey", "l_linenumber", "l_partkey") + " % 5"
_WIDE_SQL = f"""WITH f AS (SELECT *, CAST({_WIDE_FOLD} AS INTEGER) AS fold FROM lineitem),
v AS ({" UNION ALL ".join(f"SELECT {i} AS c, CAST({c} AS VARCHAR) AS v, min(fold) AS lo, max(fold) AS hi FROM f WHERE {c} IS NOT NULL GROUP BY {c}"
                          for i, c in enumerate(_WIDE))}),
d AS (SELECT *, row_number() OVER (ORDER BY c, v) - 1 AS at FROM v)
SELECT f.l_orderkey, f.l_linenumber, f.l_partkey, f.fold, """ + " || ',' || ".join(
    f"coalesce(CASE WHEN d{i}.lo <> f.fold OR d{i}.hi <> f.fold THEN CAST(d{i}.at AS VARCHAR) END, '-')" for i in range(len(_WIDE))) + f""" AS ones,
 (SELECT count(*) FROM d) AS size FROM f """ + " ".join(
    f"LEFT JOIN d d{i} ON d{i}.c = {i} AND d{i}.v = CAST(f.{c} AS VARCHAR)" for i, c in enumerate(_WIDE))


@query("fea_onehot_wide_lineitem", _WIDE_SQL)
def fea_onehot_wide_lineitem(spark, sf_dir):
    """FEA-08: sparse one-hot codes of columns with as many categories as orders; categories of the row's own fold only are unknown."""
    li = _t(spark, sf_dir, "lineitem").withColumn("fold", _line_fold())
    d = PP.category_dictionary(li.select("fold", *_WIDE), _WIDE, "fold")
    sizes = PP.category_sizes(d)
    base = li.select("l_orderkey", "l_linenumber", "l_partkey", "fold", *[F.col(c).cast("string").alias(f"{c}_") for c in _WIDE])
    named = d.withColumn("column_name", F.concat("column_name", F.lit("_")))
    out = PP.one_hot_positions(base, [f"{c}_" for c in _WIDE], named, "fold")
    start = 0

    def code(low: int, high: int):
        return F.coalesce(F.try_element_at(F.filter("positions", lambda p: (p >= low) & (p < high)), F.lit(1)).cast("string"), F.lit("-"))

    ones = []
    for c in _WIDE:
        ones.append(code(start, start + sizes[c]))
        start += sizes[c]
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "fold", F.concat_ws(",", *ones).alias("ones"), "size")


# --- k-means bins --------------------------------------------------------------------------

_KM = [("l_quantity", 5), ("l_linenumber", 3)]


def _km_sql(c: str, n: int) -> str:
    mids = f"list_transform(range(1, {n}), lambda i: (cs[i] + cs[i + 1]) / 2)"
    return f"""(WITH RECURSIVE f AS (SELECT CAST({c} AS DOUBLE) AS x, {sql_h15('42', 'l_orderkey', 'l_linenumber', 'l_partkey')} % 5 AS fold FROM lineitem),
v AS (SELECT g.g AS fold, x, count(*) AS w FROM f JOIN range(0, 5) g(g) ON f.fold <> g.g GROUP BY ALL),
s AS (SELECT fold, 0 AS it, min(x) AS mn, max(x) AS mx, list_transform(range(0, {n}), lambda i: min(x) + (2 * i + 1) * (max(x) - min(x)) / {2 * n}) AS cs
      FROM v GROUP BY fold
      UNION ALL
      SELECT s.fold, any_value(it) + 1, any_value(mn), any_value(mx), list(coalesce(m, cs[i + 1]) ORDER BY i)
      FROM s JOIN LATERAL (SELECT k.i, sum(w * x) / sum(w) AS m FROM range(0, {n}) k(i) LEFT JOIN
             (SELECT x, w, len(list_filter({mids}, lambda m: m < x)) AS at FROM v WHERE v.fold = s.fold) q ON q.at = k.i GROUP BY k.i) u ON true
      WHERE it < 100 GROUP BY s.fold, cs)
SELECT '{c}' AS column_name, CAST(fold AS INTEGER) AS fold, list_concat(list_concat([mn], {mids}), [mx]) AS edges FROM s WHERE it = 100)"""


def _km_bins_sql(c: str, n: int) -> str:
    return f"""SELECT e.column_name, e.fold, b.i AS bin, count(f.x) AS n, round(e.edges[b.i + 1], 6) AS low, round(e.edges[b.i + 2], 6) AS high
FROM {_km_sql(c, n)} e JOIN (SELECT CAST(range AS INTEGER) AS i FROM range(0, {n})) b ON true
LEFT JOIN (SELECT CAST({c} AS DOUBLE) AS x, {sql_h15('42', 'l_orderkey', 'l_linenumber', 'l_partkey')} % 5 AS fold FROM lineitem) f
  ON f.fold = e.fold AND len(list_filter(list_slice(e.edges, 2, {n}), lambda v: v <= f.x)) = b.i GROUP BY ALL"""


@query("fea_kmeans_bins_lineitem", " UNION ALL ".join(_km_bins_sql(c, n) for c, n in _KM))
def fea_kmeans_bins_lineitem(spark, sf_dir):
    """FEA-06/07: k-means edges of two columns and five folds together, and one-hot bin counts of the held-out rows."""
    li = _t(spark, sf_dir, "lineitem")
    f = li.withColumn("fold", _line_fold())
    out = None
    for c, n in _KM:
        e = FE.kmeans_edges_all(f, "fold", [c], 5, n)
        edges = spark.createDataFrame([(g, x) for (g, _), x in sorted(e.items())], "fold int, edges array<double>")
        hot = FE.apply_bins(f.select("fold", c), "fold", c, edges, "bin", one_hot=True, n_bins=n)
        got = hot.groupBy("fold").agg(F.array(*[F.sum(f"bin_{i}") for i in range(n)]).alias("ones"))
        part = got.join(edges, "fold").select(F.lit(c).alias("column_name"), "fold", F.posexplode("ones").alias("bin", "n"), "edges")
        part = part.select("column_name", "fold", "bin", F.col("n").cast("long").alias("n"),
                           F.element_at("edges", F.col("bin") + 1).alias("low"), F.element_at("edges", F.col("bin") + 2).alias("high"))
        out = part if out is None else out.unionByName(part)
    return out


# --- fold-metric files ------------------------------------------------------------------------

@query("src_fold_metric_files_lineitem", "SELECT framework, seed, fold, " + ", ".join(
    f"round({m}, 6) AS {m}" if m != "f1" else "CASE WHEN left(framework, 1) <> 'R' THEN round(f1, 6) END AS f1" for m in D.FOLD_METRIC_NAMES)
    + f" FROM {D.FOLD_METRICS_SQL} m")
def src_fold_metric_files_lineitem(spark, sf_dir):
    """SRC-04: fold metrics of lineitem written as CSV files with differently ordered, missing and renamed columns, and read back."""
    from foldline.sources.readers import read_fold_metrics
    m = D.fold_metrics_df(spark, sf_dir)
    base = _folder(spark, "folds")
    first = F.substring("framework", 1, 1)
    cols = ["framework", "seed", "fold", *D.FOLD_METRIC_NAMES]
    shapes = {"A": cols, "N": ["fold", "f1", "predict_time_sec", "seed", "accuracy", "framework", "fit_time_sec", "f1_macro"],
              "R": [c for c in cols if c != "f1"][::-1]}
    for letter, order in shapes.items():
        part = m.where(first == letter).select(*order)
        part = part.withColumnRenamed("accuracy", "accuracy_score") if letter == "N" else part
        # one folder of files per framework: a file's single framework value is its framework
        part.withColumn("part", F.col("framework")).repartition("part").write.option("header", True).partitionBy("part").csv(
            f"{base}/{letter}")
    got = read_fold_metrics(spark, f"{base}/*/*/*.csv")
    return got.select("framework", F.col("seed").cast("long").alias("seed"), F.col("fold").cast("long").alias("fold"), *D.FOLD_METRIC_NAMES)


# --- substring join -----------------------------------------------------------------------------

_TOKEN_PATHS = [("customer_path", "'/c/' || o_custkey || '/' || o_orderpriority"), ("status_path", "'/status/' || o_orderstatus"),
                ("date_path", "'/' || CAST(o_orderdate AS VARCHAR)")]


@query("joi_path_tokens_orders", " UNION ALL ".join(
    f"""SELECT '{n}' AS column_name, count(*) AS values, count(*) FILTER (EXISTS (SELECT 1 FROM orders t WHERE contains(v, CAST(t.o_orderkey AS VARCHAR))))
 AS values_with_token FROM (SELECT DISTINCT {e} AS v FROM orders) q""" for n, e in _TOKEN_PATHS))
def joi_path_tokens_orders(spark, sf_dir):
    """JOI-07 / GRD-04: path-like values that contain an order key (as many tokens as orders)."""
    from foldline.operators.substrings import texts_with_tokens
    o = _t(spark, sf_dir, "orders")
    cust = F.concat(F.lit("/c/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderpriority"))
    paths = [cust, F.concat(F.lit("/status/"), F.col("o_orderstatus")), F.concat(F.lit("/"), F.col("o_orderdate").cast("string"))]
    long = o.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), p.alias("value")) for (n, _), p in zip(_TOKEN_PATHS, paths)])
                              ).alias("e")).select("e.*")
    hits = texts_with_tokens(long, o.select(F.col("o_orderkey").cast("string").alias("tok")))
    per = long.distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("values"))
    got = hits.groupBy("column_name").agg(F.count(F.lit(1)).alias("hit"))
    return per.join(got, "column_name", "left").select("column_name", "values", F.coalesce("hit", F.lit(0)).cast("long").alias("values_with_token"))


# --- attributions by weighted least squares ------------------------------------------------------

_SHAP_SQL = f"""WITH o AS (SELECT o_orderkey, o_totalprice / 1.0e5 AS y, CAST(year(o_orderdate) - 1995 AS DOUBLE) AS a,
  CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS b FROM orders),
c AS (SELECT covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(a, b) AS ab, var_pop(a) AS va, var_pop(b) AS vb,
      avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM o),
k AS (SELECT (ay * vb - by_ * ab) / (va * vb - ab * ab) AS ka, (by_ * va - ay * ab) / (va * vb - ab * ab) AS kb, ma, mb, my FROM c),
s AS (SELECT * FROM o ORDER BY {sql_h15('42', 'o_orderkey')}, o_orderkey LIMIT 200),
g AS (SELECT avg(a) AS ga, avg(b) AS gb FROM (SELECT * FROM o ORDER BY {sql_h15('7', 'o_orderkey')}, o_orderkey LIMIT 60) q),
e AS (SELECT s.*, ka, kb, ga, gb, my + ka * (a - ma) + kb * (b - mb) AS prediction, my + ka * (ga - ma) + kb * (gb - mb) AS expected_value FROM s, k, g)
SELECT o_orderkey, 'yr' AS feature, round(ka * (a - ga), 6) AS value, round(prediction, 6) AS prediction, round(expected_value, 6) AS expected_value FROM e
UNION ALL SELECT o_orderkey, 'prio', round(kb * (b - gb), 6), round(prediction, 6), round(expected_value, 6) FROM e"""


def _shap_input(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1.0e5).alias("price"),
                                              (F.year("o_orderdate") - 1995).cast("double").alias("yr"),
                                              F.substring("o_orderpriority", 1, 1).cast("double").alias("prio"), "o_orderstatus")


@query("exp_kernel_shap_linear_orders", _SHAP_SQL)
def exp_kernel_shap_linear_orders(spark, sf_dir):
    """EXP-02/05: least-squares Shapley values of a linear model for 200 orders over 60 background rows (exact)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from foldline.operators import explain as EX
    from foldline.operators.splits import sample_n
    o = _shap_input(spark, sf_dir)
    xy = VectorAssembler(inputCols=["yr", "prio"], outputCol="features").transform(o).withColumnRenamed("price", "label")
    model = LinearRegression(solver="normal").fit(xy)
    return EX.kernel_shapley(model, sample_n(o, ["o_orderkey"], 200, 42), "o_orderkey", ["yr", "prio"],
                             sample_n(o, ["o_orderkey"], 60, 7), output="prediction")


@query("exp_kernel_shap_tree_orders", None)
def exp_kernel_shap_tree_orders(spark, sf_dir):
    """EXP-03/05: a decision tree explained: top contributions, prediction, class and expected value of 100 orders."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    from foldline.operators import explain as EX
    from foldline.operators.splits import sample_n
    o = _shap_input(spark, sf_dir).withColumn("label", (F.col("o_orderstatus") == "F").cast("double"))
    feats = ["price", "yr", "prio"]
    model = DecisionTreeClassifier(maxDepth=5, minInstancesPerNode=5, seed=42).fit(
        VectorAssembler(inputCols=feats, outputCol="features").transform(o))
    a = EX.kernel_shapley(model, sample_n(o, ["o_orderkey"], 100, 42), "o_orderkey", feats, o)
    d = EX.sample_details(a, "o_orderkey", k=3)
    return d.select("o_orderkey", "prediction", "expected_value", "predicted_class", F.to_json("top_contributions").alias("top_contributions"))


# --- Holt-Winters with given smoothing --------------------------------------------------------------

_HW = (0.3, 0.1, 0.2)
_HW_SQL = f"""WITH RECURSIVE s AS (SELECT event_type AS series, CAST(ts AS DATE) AS day, avg(value) AS y FROM events GROUP BY 1, 2),
a AS (SELECT series, list(y ORDER BY day) AS y FROM s GROUP BY series HAVING count(*) >= 14),
m AS (SELECT series, y, list_sum(list_slice(y, 1, 7)) / 7 AS l, list_sum(list_slice(y, 8, 14)) / 7 AS l2 FROM a),
r AS (SELECT series, y, 0 AS i, l AS level, (l2 - l) / 7 AS trend, list_transform(list_slice(y, 1, 7), lambda v: v - l) AS season, 0.0 :: DOUBLE AS sse FROM m
  UNION ALL
  SELECT series, y, i + 1, nl, {_HW[1]} * (nl - level) + {1 - _HW[1]} * trend,
    list_transform(season, lambda x, k: CASE WHEN k = i % 7 + 1 THEN {_HW[2]} * (v - nl) + {1 - _HW[2]} * sn ELSE x END),
    sse + (v - level - trend - sn) * (v - level - trend - sn)
  FROM (SELECT *, y[i + 1] AS v, season[i % 7 + 1] AS sn, {_HW[0]} * (y[i + 1] - season[i % 7 + 1]) + {1 - _HW[0]} * (level + trend) AS nl
        FROM r WHERE i < len(y)) q)
SELECT series, len(y) AS n, round(sse, 6) AS sse, round(level, 6) AS level, round(trend, 6) AS trend FROM r WHERE i = len(y)"""


@query("fct_holt_winters_fixed_events", _HW_SQL)
def fct_holt_winters_fixed_events(spark, sf_dir):
    """FCT-01: the additive recursion with given smoothing over every event-type series, as one array aggregate."""
    from foldline.operators import forecast as FC
    return FC.holt_winters_fixed(FC.daily_series(_t(spark, sf_dir, "events"), "event_type", F.col("ts"), "value"), *_HW)

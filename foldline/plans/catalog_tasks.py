"""Registered task queries: attributions, forecasting, signals, serving counters (Q) and
model training, text classification, anomaly scoring (rows-only, iterative ML)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldline.operators import explain as EX
from foldline.operators import forecast as FC
from foldline.operators import media as MD
from foldline.operators import splits as S
from foldline.plans.catalog import _t, query
from foldline.functions.hashing import sql_h15
from foldline.streaming import counters as SC

DIMS = [f"e{i}" for i in range(64)]


def _emb_cols(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("double").alias("y"),
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


_EMB_COLS_SQL = "(SELECT vec_id, CAST(label AS DOUBLE) AS y, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(64)) + " FROM embeddings)"
_ATTR_SQL = f"""WITH e AS {_EMB_COLS_SQL},
c AS (SELECT {", ".join(f"covar_pop(e{i}, y) / var_pop(e{i}) AS s{i}, avg(e{i}) AS m{i}" for i in range(64))} FROM e),
a AS ({" UNION ALL ".join(f"SELECT vec_id, 'e{i}' AS feature, coalesce(s{i}, 0.0) * (e{i} - m{i}) AS value FROM e, c" for i in range(64))})"""


@query("exp_additive_attributions_embeddings", _ATTR_SQL + """
SELECT feature, round(avg(abs(value)), 6) AS mean_abs_attribution FROM a GROUP BY feature""")
def exp_additive_attributions_embeddings(spark, sf_dir):
    """EXP-01 + AGG-16: exact attributions of an additive linear model → global mean |attribution|."""
    a = EX.additive_model_attributions(_emb_cols(spark, sf_dir), "vec_id", DIMS, F.col("y"))
    return EX.global_importance(a)


@query("exp_sample_details_embeddings", _ATTR_SQL + f""",
s AS (SELECT vec_id FROM embeddings ORDER BY {sql_h15('42', 'vec_id')}, vec_id LIMIT 20)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, feature, round(value, 6) AS value FROM (
  SELECT a.*, row_number() OVER (PARTITION BY a.vec_id ORDER BY abs(value) DESC, feature DESC) AS rank FROM a JOIN s USING (vec_id)) x
WHERE rank <= 3""")
def exp_sample_details_embeddings(spark, sf_dir):
    """EXP-05 + WIN-05 + SPL-07: top-3 contributions of 20 deterministically sampled rows."""
    e = _emb_cols(spark, sf_dir)
    a = EX.additive_model_attributions(e, "vec_id", DIMS, F.col("y"))
    s = S.sample_n(e.select("vec_id"), ["vec_id"], 20, seed=42)
    per = a.join(s, "vec_id")
    from foldline.operators.reports import top_contributions
    g = per.groupBy("vec_id").agg(F.collect_list("feature").alias("f"), F.collect_list("value").alias("v"))
    t = g.select("vec_id", F.posexplode(top_contributions(F.col("f"), F.col("v"), 3)).alias("pos", "c"))
    return t.select("vec_id", (F.col("pos") + 1).cast("int").alias("rank"), "c.feature", "c.value")


@query("fct_seasonal_naive_events", """WITH s AS (SELECT event_type AS series, CAST(ts AS DATE) AS day, avg(value) AS y FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS back FROM s),
t AS (SELECT *, 14 - back + 1 AS h FROM r WHERE back <= 14)
SELECT t.series, count(*) AS n_test, round(avg(abs(t.y - src.y)), 6) AS mae
FROM t LEFT JOIN r src ON src.series = t.series AND src.back = 14 + 7 - ((t.h - 1) % 7) GROUP BY t.series""")
def fct_seasonal_naive_events(spark, sf_dir):
    """FCT-02 + SRC-08: daily series per event type, last 14 days held out, seasonal-naive MAE."""
    s = FC.daily_series(_t(spark, sf_dir, "events"), "event_type", F.col("ts"), "value")
    return FC.seasonal_naive_holdout(s)


@query("fct_holt_winters_events", None)
def fct_holt_winters_events(spark, sf_dir):
    """FCT-01: additive Holt-Winters (period 7, horizon 14) per event-type series, MAE on the holdout."""
    s = FC.daily_series(_t(spark, sf_dir, "events"), "event_type", F.col("ts"), "value")
    return FC.holt_winters_holdout(s)


_SIG_SQL = """(SELECT vec_id, label, sqrt(list_avg(list_transform(x, lambda v: v * v))) AS rms,
    list_max(list_transform(x, lambda v: abs(v))) AS peak, list_avg(x) AS mean,
    sqrt(list_avg(list_transform(x, lambda v: (v - list_avg(x)) * (v - list_avg(x))))) AS std,
    CASE WHEN len(x) > 1 THEN list_sum(list_transform(range(1, len(x)), lambda i: abs(sign(x[i + 1]) - sign(x[i])))) / (len(x) - 1) / 2.0 ELSE 0.0 END AS zero_crossing_rate
  FROM (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings) s)"""


@query("aud_signal_features_embeddings", "SELECT vec_id, round(rms, 6) AS rms, round(peak, 6) AS peak, round(mean, 6) AS mean, "
       "round(std, 6) AS std, round(zero_crossing_rate, 6) AS zero_crossing_rate FROM " + _SIG_SQL + " f")
def aud_signal_features_embeddings(spark, sf_dir):
    """AUD-02: rms, peak, mean, std, zero-crossing rate of every stored signal (array HOFs)."""
    e = _t(spark, sf_dir, "embeddings")
    return e.select("vec_id", *MD.signal_features(F.col("embedding")))


@query("agg_class_features_embeddings", "SELECT label, " + ", ".join(
    f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in ["rms", "peak", "zero_crossing_rate"])
    + " FROM " + _SIG_SQL + " f GROUP BY label")
def agg_class_features_embeddings(spark, sf_dir):
    """AGG-14: per-class mean / population std of signal features, rounded to 6."""
    from foldline.operators.stats import class_feature_stats
    e = _t(spark, sf_dir, "embeddings")
    f = e.select("label", *MD.signal_features(F.col("embedding")))
    return class_feature_stats(f, "label", ["rms", "peak", "zero_crossing_rate"])


@query("aud_resample_embeddings", """SELECT vec_id, CAST(j AS INTEGER) AS i, round(CASE WHEN i0 >= 63 THEN x[64] ELSE x[i0 + 1] + (pos - i0) * (x[i0 + 2] - x[i0 + 1]) END, 6) AS value
FROM (SELECT vec_id, x, j, j * 64 / 100.0 AS pos, CAST(floor(j * 64 / 100.0) AS INTEGER) AS i0
      FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings) e, range(0, 96) r(j)) s""")
def aud_resample_embeddings(spark, sf_dir):
    """AUD-03: linear resample of each 64-sample signal to 100 points, then truncate to 96."""
    e = _t(spark, sf_dir, "embeddings")
    r = e.select("vec_id", MD.resample_array(F.col("embedding"), 100, 96).alias("w"))
    return r.select("vec_id", F.posexplode("w").alias("i", "value")).withColumn("i", F.col("i").cast("int"))


_STATUS = "CASE WHEN value >= 100 THEN '500' ELSE '200' END"


@query("str_request_counts_events", f"""SELECT CAST(epoch(time_bucket(INTERVAL '10 minutes', ts)) AS BIGINT) AS window_start,
  CAST(epoch(time_bucket(INTERVAL '10 minutes', ts)) AS BIGINT) + 600 AS window_end, event_type AS path, {_STATUS} AS status, count(*) AS n
FROM events GROUP BY ALL""")
def str_request_counts_events(spark, sf_dir):
    """STR-01 (batch twin): request counts per 10-minute window, path and status."""
    e = _t(spark, sf_dir, "events")
    st = F.when(F.col("value") >= 100, "500").otherwise("200")
    return SC.request_counts(e, "ts", F.col("event_type"), st)


@query("str_latency_histogram_events", "SELECT CAST(epoch(time_bucket(INTERVAL '10 minutes', ts)) AS BIGINT) AS window_start, " + ", ".join(
    f"CAST(sum(CASE WHEN value / 100.0 <= {le} THEN 1 ELSE 0 END) AS BIGINT) AS {SC._bucket_name(le)}" for le in SC.LATENCY_BUCKETS)
    + ", count(*) AS le_inf, round(sum(value / 100.0), 6) AS latency_sum FROM events GROUP BY 1")
def str_latency_histogram_events(spark, sf_dir):
    """STR-02 (batch twin): cumulative latency histogram per 10-minute window."""
    e = _t(spark, sf_dir, "events")
    return SC.latency_histogram(e, "ts", F.col("value") / 100.0)


@query("str_scores_events", """SELECT event_id, round(1.0 / (1.0 + pow(2.71828, -0.001 * coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0))), 6) AS score FROM events""")
def str_scores_events(spark, sf_dir):
    """STR-03 / TRN-14 (batch twin): fallback logistic score of each request's JSON features."""
    return SC.score_requests(_t(spark, sf_dir, "events"), "event_id", "props")


# ---- rows-only (iterative ML) ----------------------------------------------------------

@query("ano_isolation_forest_lineitem", None)
def ano_isolation_forest_lineitem(spark, sf_dir):
    """ANO-01 + WIN-07: isolation forest (200 trees) over lineitem; the 50 highest scores."""
    from foldline.operators.anomaly import isolation_forest, top_anomalies
    li = _t(spark, sf_dir, "lineitem")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    s = isolation_forest(li, key, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                         ["l_returnflag", "l_linestatus"])
    return top_anomalies(s, key, 50)


@query("trn_cv_gbt_orders", None)
def trn_cv_gbt_orders(spark, sf_dir):
    """TRN-01/03: 3-fold stratified CV of gradient-boosted trees on orders (status 'F' or not)."""
    from pyspark.ml.classification import GBTClassifier
    from foldline.operators import training as TR
    o = _t(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderpriority", F.year("o_orderdate").alias("o_year"),
        (F.col("o_orderstatus") == "F").cast("int").alias("is_f"))
    spec = TR.make_spec(o, ["o_orderkey"], "is_f", "classification")
    cfg = TR.ExperimentConfig(name="gbt", seeds=(42,), k=3, parallelism=3)
    r = TR.run_experiment(spec, lambda: GBTClassifier(maxIter=10, maxDepth=3, seed=42), cfg)
    return r.folds


_ORD_FEATS = ["price", "yr", "prio"]


def _orders_xy(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", (F.col("o_totalprice") / 1.0e5).alias("price"),
                    (F.year("o_orderdate") - 1995).cast("double").alias("yr"),
                    F.substring("o_orderpriority", 1, 1).cast("double").alias("prio"),
                    (F.col("o_orderstatus") == "F").cast("double").alias("label"))


def _orders_model(xy):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    return LogisticRegression(maxIter=20).fit(VectorAssembler(inputCols=_ORD_FEATS, outputCol="features").transform(xy))


@query("exp_shapley_orders", None)
def exp_shapley_orders(spark, sf_dir):
    """EXP-02/03: Monte-Carlo Shapley values of a fitted model for 400 sampled orders (200 background rows)."""
    xy = _orders_xy(spark, sf_dir)
    model = _orders_model(xy)
    rows = S.sample_n(xy, ["o_orderkey"], 400, seed=42)
    bg = S.sample_n(xy, ["o_orderkey"], 200, seed=7)
    return EX.monte_carlo_shapley(model, rows, "o_orderkey", _ORD_FEATS, bg, n_perm=10)


@query("exp_lime_orders", None)
def exp_lime_orders(spark, sf_dir):
    """EXP-04: LIME-style local surrogates (200 perturbations each) for 50 sampled orders, top terms."""
    xy = _orders_xy(spark, sf_dir)
    model = _orders_model(xy)
    rows = S.sample_n(xy, ["o_orderkey"], 50, seed=42)
    return EX.lime(model, rows, "o_orderkey", _ORD_FEATS, n_samples=200)


@query("trn_random_search_orders", None)
def trn_random_search_orders(spark, sf_dir):
    """TRN-04/06: 20 points of a parameter grid scored by stratified 3-fold CV on keyed folds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from foldline.operators import search as SE
    xy = VectorAssembler(inputCols=_ORD_FEATS, outputCol="features").transform(_orders_xy(spark, sf_dir))
    space = {"regParam": {"type": "float", "low": 1e-4, "high": 1.0, "log": True}, "maxIter": {"type": "int", "low": 5, "high": 30},
             "elasticNetParam": {"type": "categorical", "choices": [0.0, 0.5]}}
    _, board = SE.random_search(xy, LogisticRegression(), space, "classification", "o_orderkey", n_iter=20, k=3, metric="roc_auc")
    return SE.leaders(board)


@query("trn_budgeted_search_orders", None)
def trn_budgeted_search_orders(spark, sf_dir):
    """TRN-07: search over an estimator list (without a budget: every candidate is scored); leaderboard of CV scores."""
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes
    from pyspark.ml.feature import VectorAssembler
    from foldline.operators import search as SE
    xy = VectorAssembler(inputCols=_ORD_FEATS, outputCol="features").transform(_orders_xy(spark, sf_dir))
    cands = {"logreg": LogisticRegression(maxIter=20), "tree": DecisionTreeClassifier(maxDepth=5, minInstancesPerNode=5),
             "gaussian_nb": NaiveBayes(modelType="gaussian")}
    return SE.leaders(SE.budgeted_search(xy, cands, "classification", "o_orderkey", None, k=3, metric="f1_macro"))


@query("trn_text_cv_documents", None)
def trn_text_cv_documents(spark, sf_dir):
    """TRN-11: TF-IDF without English stop words + logistic regression, stratified 5-fold, on documents ⋈ quality labels."""
    from foldline.operators.text import english_stop_words, text_cross_validation
    d = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", "quality")
    return text_cross_validation(d, "doc_id", "text", "quality", k=5, stop_words=english_stop_words())




@query("trn_classifier_panel_part", None)
def trn_classifier_panel_part(spark, sf_dir):
    """TRN-02: random forest (500), decision tree (depth 5, min leaf 5), logistic regression, RBF SVM and
    Gaussian NB on the same stratified folds and fold-safe preprocessing (part: size above 25)."""
    from foldline.operators import training as TR
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_brand", "p_type",
                                         (F.col("p_size") > 25).cast("int").alias("big"))
    spec = TR.make_spec(p, ["p_partkey"], "big", "classification")
    cfg = TR.ExperimentConfig(name="panel", seeds=(42,), k=3, parallelism=3)
    return TR.classifier_panel(spec, cfg, kinds=("rf", "tree", "logreg", "svm", "nb"))

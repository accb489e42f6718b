"""Registered evaluation queries: metrics (MET-*), statistics (AGG-*), reports (WIN/JOI/SET/SHP)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldline.functions.hashing import sql_h8, sql_h15
from foldline.functions.stats import sql_normal_cdf, sql_t_two_sided_p
from foldline.operators import metrics as M
from foldline.operators import reports as R
from foldline.operators import splits as S
from foldline.operators import stats as ST
from foldline.plans import derived as D
from foldline.plans.catalog import _t, query

DP, EP, PP = D.DOC_PREDS_SQL, D.EMB_PREDS_SQL, D.PART_PREDS_SQL
FM, FL = D.FOLD_METRICS_SQL, D.FOLD_LONG_SQL


# ======================================================================================
# Metrics (MET-*)
# ======================================================================================

def _binary_sql(key: str) -> str:
    return f"""WITH p AS {DP},
cells AS (SELECT {key}, y_true AS t, y_pred AS p, count(*) AS n FROM p GROUP BY ALL),
base AS (SELECT {key}, sum(n) AS n, sum(CASE WHEN t = p THEN n ELSE 0 END) AS correct, greatest(max(t), max(p)) AS pos
         FROM cells GROUP BY {key}),
bin AS (SELECT c.{key}, sum(CASE WHEN t = pos AND p = pos THEN c.n ELSE 0 END) AS tp,
               sum(CASE WHEN t <> pos AND p = pos THEN c.n ELSE 0 END) AS fp,
               sum(CASE WHEN t = pos AND p <> pos THEN c.n ELSE 0 END) AS fn
        FROM cells c JOIN base b ON c.{key} = b.{key} GROUP BY c.{key}),
lab AS (SELECT {key}, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
          SELECT {key}, t AS label, CASE WHEN t = p THEN n ELSE 0 END AS tp, 0 AS fp, CASE WHEN t <> p THEN n ELSE 0 END AS fn FROM cells
          UNION ALL SELECT {key}, p, 0, CASE WHEN t <> p THEN n ELSE 0 END, 0 FROM cells) u GROUP BY ALL),
macro AS (SELECT {key}, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END) AS f1_macro
          FROM lab GROUP BY {key}),
hist AS (SELECT p.{key}, score AS s, sum(CASE WHEN y_true = pl THEN 1 ELSE 0 END) AS pos,
                sum(CASE WHEN y_true = pl THEN 0 ELSE 1 END) AS neg
         FROM p JOIN (SELECT {key}, max(y_true) AS pl FROM p GROUP BY {key}) m ON p.{key} = m.{key} GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
               sum(pos) OVER (PARTITION BY {key}) AS P, sum(neg) OVER (PARTITION BY {key}) AS N
        FROM hist WINDOW w AS (PARTITION BY {key} ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rank AS (SELECT {key},
           CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (N - fp + 0.5 * neg)) / (max(P) * max(N)) END AS roc_auc,
           CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(CASE WHEN pos > 0 THEN pos * tp / (tp + fp) ELSE 0 END) / max(P) END AS avg_precision
         FROM cum GROUP BY {key})
SELECT b.{key}, CAST(b.n AS BIGINT) AS n, round(b.correct / b.n, 6) AS accuracy,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
       round(f1_macro, 6) AS f1_macro, round(roc_auc, 6) AS roc_auc, round(avg_precision, 6) AS avg_precision
FROM base b JOIN bin USING ({key}) JOIN macro USING ({key}) LEFT JOIN rank USING ({key})"""


@query("met_binary_documents_by_lang", _binary_sql("lang"))
def met_binary_documents_by_lang(spark, sf_dir):
    """MET-01..05: accuracy, P/R/F1 (largest label positive), F1-macro, ROC-AUC, AP per language."""
    return M.evaluate(D.doc_preds_df(spark, sf_dir), ["lang"], "classification", score="score")


@query("stx_slice_metrics_documents_by_source", _binary_sql("source"))
def stx_slice_metrics_documents_by_source(spark, sf_dir):
    """STX-08: the same metrics sliced by a segment column (document source)."""
    return M.evaluate(D.doc_preds_df(spark, sf_dir), ["source"], "classification", score="score")


@query("met_multiclass_embeddings", f"""WITH p AS {EP},
cells AS (SELECT y_true AS t, y_pred AS p, count(*) AS n FROM p GROUP BY ALL),
lab AS (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
          SELECT t AS label, CASE WHEN t = p THEN n ELSE 0 END AS tp, 0 AS fp, CASE WHEN t <> p THEN n ELSE 0 END AS fn FROM cells
          UNION ALL SELECT p, 0, CASE WHEN t <> p THEN n ELSE 0 END, 0 FROM cells) u GROUP BY ALL),
ex AS (SELECT y_true, CAST(i - 1 AS INTEGER) AS cls, CAST(scores[i] AS DOUBLE) AS s FROM p, range(1, 11) r(i)),
hist AS (SELECT cls, s, sum(CASE WHEN y_true = cls THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y_true = cls THEN 0 ELSE 1 END) AS neg
         FROM ex GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY cls) AS P,
               sum(neg) OVER (PARTITION BY cls) AS N
        FROM hist WINDOW w AS (PARTITION BY cls ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
per AS (SELECT cls, CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (N - fp + 0.5 * neg)) / (max(P) * max(N)) END AS auc,
               CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(CASE WHEN pos > 0 THEN pos * tp / (tp + fp) ELSE 0 END) / max(P) END AS ap
        FROM cum GROUP BY cls)
SELECT (SELECT count(*) FROM p) AS n,
       round((SELECT sum(CASE WHEN t = p THEN n ELSE 0 END) / sum(n) FROM cells), 6) AS accuracy,
       round((SELECT avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END) FROM lab), 6) AS f1_macro,
       round((SELECT avg(auc) FROM per), 6) AS roc_auc_ovr, round((SELECT avg(ap) FROM per), 6) AS avg_precision_ovr""")
def met_multiclass_embeddings(spark, sf_dir):
    """MET-01/03/10 + one-vs-rest ROC-AUC/AP: label vs argmax of ten class scores over the whole vector."""
    p = D.emb_preds_df(spark, sf_dir).withColumn("grp", F.lit(1))
    c = M.classification_metrics(p, ["grp"], "y_true", "y_pred").select("grp", "n", "accuracy", "f1_macro")
    r = M.ovr_ranking_metrics(p, ["grp"], "y_true", "scores")
    return c.join(r, "grp").drop("grp")


@query("met_regression_part_by_brand", f"""SELECT p_brand, count(*) AS n, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 6) AS rmse,
  round(avg(abs(y_true - y_pred)), 6) AS mae,
  round(CASE WHEN var_pop(y_true) * count(*) > 0 THEN 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*))
             WHEN sum((y_true - y_pred) * (y_true - y_pred)) = 0 THEN 1.0 ELSE 0.0 END, 6) AS r2
FROM {PP} p GROUP BY p_brand""")
def met_regression_part_by_brand(spark, sf_dir):
    """MET-06/07: RMSE, MAE, R² per brand in one aggregate."""
    return M.regression_metrics(D.part_preds_df(spark, sf_dir), ["p_brand"], "y_true", "y_pred")


@query("met_confusion_embeddings", f"""WITH p AS {EP},
labels AS (SELECT DISTINCT l FROM (SELECT y_true AS l FROM p UNION ALL SELECT y_pred FROM p) u)
SELECT l AS true_label, """ + ", ".join(
    f"CAST(count(CASE WHEN p.y_pred = {k} THEN 1 END) AS BIGINT) AS pred_{k}" for k in range(10)) + f"""
FROM labels LEFT JOIN p ON p.y_true = labels.l GROUP BY l""")
def met_confusion_embeddings(spark, sf_dir):
    """MET-08: confusion matrix over the full label list (pivot on a size-checked class list)."""
    return M.confusion_matrix(D.emb_preds_df(spark, sf_dir), [], "y_true", "y_pred")


@query("stx_calibration_documents", f"""SELECT CAST(least(greatest(floor(score * 10), 0), 9) AS INTEGER) AS bin, count(*) AS n,
  round(avg(score), 6) AS mean_score, round(avg(CAST(y_true AS DOUBLE)), 6) AS positive_rate FROM {DP} p GROUP BY 1""")
def stx_calibration_documents(spark, sf_dir):
    """STX-07: calibration bins of the document score."""
    return M.calibration_bins(D.doc_preds_df(spark, sf_dir), [], "y_true", "score")


@query("met_first_k_embeddings", f"""WITH p AS {EP}, names AS (SELECT DISTINCT label AS code, 'class_' || label AS name FROM embeddings)
SELECT vec_id, y_true, y_pred, t.name AS true_name, q.name AS pred_name
FROM (SELECT * FROM p ORDER BY vec_id LIMIT 10) x LEFT JOIN names t ON x.y_true = t.code LEFT JOIN names q ON x.y_pred = q.code""")
def met_first_k_embeddings(spark, sf_dir):
    """MET-09: first 10 predictions with class names from a registry derived from the labels."""
    e = _t(spark, sf_dir, "embeddings")
    names = e.select(F.col("label").alias("code")).distinct().select(
        "code", F.concat(F.lit("class_"), F.col("code").cast("string")).alias("name"))
    return M.first_k_predictions(D.emb_preds_df(spark, sf_dir), "vec_id", "y_true", "y_pred", names, 10)


# ======================================================================================
# Statistics over fold metrics (AGG-*)
# ======================================================================================

_MET = D.FOLD_METRIC_NAMES


@query("agg_seed_summary_lineitem", "SELECT framework, seed, " + ", ".join(
    f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in _MET) + f" FROM {FM} fm GROUP BY 1, 2")
def agg_seed_summary_lineitem(spark, sf_dir):
    """AGG-01 + SHP-03: per (framework, seed) mean and sample std of every metric, flat names."""
    return ST.seed_summary(D.fold_metrics_df(spark, sf_dir), _MET, keys=["framework", "seed"])


@query("agg_leaderboard_lineitem", "SELECT framework, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in _MET) +
       f" FROM {FM} fm GROUP BY 1")
def agg_leaderboard_lineitem(spark, sf_dir):
    """AGG-02: leaderboard means per framework."""
    return ST.leaderboard_means(D.fold_metrics_df(spark, sf_dir), _MET)


_SUMMARY_SQL = f"""SELECT framework, metric, round(mean, 6) AS mean, round(std, 6) AS std, n,
  round(mean - CASE WHEN std > 0 THEN 1.96 * std ELSE 0 END, 6) AS ci95_low,
  round(mean + CASE WHEN std > 0 THEN 1.96 * std ELSE 0 END, 6) AS ci95_high,
  round(CASE WHEN n > 1 THEN mean - 1.96 * std / sqrt(n) END, 6) AS se_ci_low,
  round(CASE WHEN n > 1 THEN mean + 1.96 * std / sqrt(n) END, 6) AS se_ci_high
FROM (SELECT framework, metric, avg(value) AS mean, CASE WHEN count(value) > 1 THEN stddev_samp(value) ELSE 0.0 END AS std,
             count(value) AS n FROM {FL} fl GROUP BY 1, 2) s"""


@query("agg_framework_summary_lineitem", _SUMMARY_SQL)
def agg_framework_summary_lineitem(spark, sf_dir):
    """AGG-03/04/05: framework × metric mean, std, n, spread interval and normal CI of the mean."""
    return ST.framework_summary(D.fold_long_df(spark, sf_dir))


def _boot_sql(values_sql: str, keys: list[str], order: list[str], n_boot: int = 1000) -> str:
    k = ", ".join(keys)
    kk = ", ".join(f"v.{c}" for c in keys)
    join = " AND ".join(f"d.{c} = v.{c}" for c in keys)
    return f"""WITH v AS (SELECT {k}, value, row_number() OVER (PARTITION BY {k} ORDER BY {", ".join(order)}) - 1 AS pos FROM {values_sql} x),
sz AS (SELECT {k}, count(*) AS n FROM v GROUP BY ALL),
d AS (SELECT {k}, b, ({sql_h8('42', *keys, 'b', 'j')}) % n AS pos
      FROM (SELECT {k}, n, b, unnest(range(0, n)) AS j FROM (SELECT {k}, n, unnest(range(0, {n_boot})) AS b FROM sz) s1) s2),
m AS (SELECT {kk}, d.b, avg(v.value) AS mb FROM d JOIN v ON {join} AND d.pos = v.pos GROUP BY ALL)
SELECT {k}, quantile_cont(mb, 0.025) AS boot_ci_low, quantile_cont(mb, 0.975) AS boot_ci_high FROM m GROUP BY ALL"""


@query("agg_bootstrap_ci_lineitem", "SELECT framework, metric, round(boot_ci_low, 6) AS boot_ci_low, "
       "round(boot_ci_high, 6) AS boot_ci_high FROM (" + _boot_sql(FL, ["framework", "metric"], ["seed", "fold"]) + ") b")
def agg_bootstrap_ci_lineitem(spark, sf_dir):
    """AGG-06: 1000-resample percentile bootstrap CI of each framework × metric mean (hashed draws)."""
    return ST.bootstrap_ci(D.fold_long_df(spark, sf_dir), ["framework", "metric"], ["seed", "fold"])


_PAIRS_SQL = f"""WITH fl AS {FL},
j AS (SELECT a.framework AS framework_a, b.framework AS framework_b, a.metric, a.seed, a.fold, a.value - b.value AS value
      FROM fl a JOIN fl b ON a.metric = b.metric AND a.framework < b.framework AND a.seed = b.seed AND a.fold = b.fold
      WHERE a.metric IN ('f1_macro', 'accuracy', 'fit_time_sec', 'predict_time_sec')),
c AS (SELECT framework, metric, count(value) AS c FROM fl GROUP BY ALL),
s AS (SELECT framework_a, framework_b, metric, count(value) AS n, avg(value) AS diff, stddev_samp(value) AS sd FROM j GROUP BY ALL),
t AS (SELECT s.*, CASE WHEN sd > 0 THEN diff / (sd / sqrt(n)) END AS t_stat FROM s
      JOIN c ca ON ca.framework = s.framework_a AND ca.metric = s.metric
      JOIN c cb ON cb.framework = s.framework_b AND cb.metric = s.metric
      WHERE ca.c = cb.c AND ca.c = s.n AND s.n > 1)"""


@query("agg_paired_tests_lineitem", _PAIRS_SQL + f""",
b AS ({_boot_sql("(SELECT * FROM j WHERE (framework_a, framework_b, metric) IN (SELECT framework_a, framework_b, metric FROM t))",
                 ["framework_a", "framework_b", "metric"], ["seed", "fold"])})
SELECT t.framework_a, t.framework_b, t.metric, t.n, round(diff, 6) AS diff, round(t_stat, 6) AS t_stat,
       round({sql_t_two_sided_p('t_stat', 'n - 1')}, 6) AS p_value,
       round(b.boot_ci_low, 6) AS boot_ci_low, round(b.boot_ci_high, 6) AS boot_ci_high
FROM t LEFT JOIN b USING (framework_a, framework_b, metric)""")
def agg_paired_tests_lineitem(spark, sf_dir):
    """AGG-07 + JOI-03: paired t-tests (closed-form p) and bootstrap CI of differences, all framework pairs."""
    return ST.paired_tests(D.fold_long_df(spark, sf_dir), metrics=ST.COMPARISON_METRICS)


@query("agg_pairwise_matrix_lineitem", _PAIRS_SQL + f""",
tt AS (SELECT framework_a, framework_b, metric, diff, {sql_t_two_sided_p('t_stat', 'n - 1')} AS p_value FROM t)
SELECT metric, framework_a AS row_framework, framework_b AS col_framework, round(diff, 6) AS diff, round(p_value, 6) AS p_value FROM tt
UNION ALL SELECT metric, framework_b, framework_a, round(-diff, 6), round(p_value, 6) FROM tt
UNION ALL SELECT DISTINCT metric, f, f, 0.0, 0.0 FROM (SELECT metric, framework_a AS f FROM tt UNION SELECT metric, framework_b FROM tt) u""")
def agg_pairwise_matrix_lineitem(spark, sf_dir):
    """AGG-08: antisymmetric diff / symmetric p matrix (long form) with zero diagonal."""
    tests = ST.paired_tests(D.fold_long_df(spark, sf_dir), metrics=ST.COMPARISON_METRICS, with_bootstrap=False)
    return ST.pairwise_matrix(tests)


@query("shp_pivot_accuracy_diff_lineitem", _PAIRS_SQL + """,
m AS (SELECT framework_a AS r, framework_b AS c, diff FROM t WHERE metric = 'accuracy'
      UNION ALL SELECT framework_b, framework_a, -diff FROM t WHERE metric = 'accuracy')
SELECT r AS row_framework, """ + ", ".join(
    f"round(max(CASE WHEN c = '{a}{b}' THEN diff END), 6) AS \"{a}{b}\"" for a in "ANR" for b in "FO") + """
FROM m GROUP BY r""")
def shp_pivot_accuracy_diff_lineitem(spark, sf_dir):
    """SHP-02: long → matrix pivot of the paired accuracy differences (frameworks as columns)."""
    tests = ST.paired_tests(D.fold_long_df(spark, sf_dir), metrics=["accuracy"], with_bootstrap=False)
    m = ST.pairwise_matrix(tests).where(F.col("row_framework") != F.col("col_framework"))
    cols = [f"{a}{b}" for a in "ANR" for b in "FO"]
    return m.groupBy("row_framework").pivot("col_framework", cols).agg(F.max("diff"))


_ABL_SQL = f"""WITH li AS (SELECT l_returnflag AS family, l_linestatus AS estimator,
         CASE WHEN l_linenumber = 1 THEN 'baseline' ELSE 'variant_' || l_linenumber END AS variant_key,
         CAST(year(l_shipdate) AS BIGINT) AS seed, avg(1 - l_discount) AS accuracy, avg(1 - l_tax) AS f1
       FROM lineitem GROUP BY ALL),
long AS (SELECT family, estimator, variant_key, seed, 'accuracy' AS metric, accuracy AS value FROM li
         UNION ALL SELECT family, estimator, variant_key, seed, 'f1', f1 FROM li),
s AS (SELECT family, estimator, variant_key, metric, avg(value) AS mean, stddev_samp(value) AS std, count(value) AS n FROM long GROUP BY ALL)
SELECT s.family, s.estimator, s.variant_key, s.metric, round(s.mean, 6) AS mean, round(s.std, 6) AS std, s.n,
       round(s.mean - b.mean, 6) AS delta_vs_baseline
FROM s LEFT JOIN (SELECT * FROM s WHERE variant_key = 'baseline') b
  ON s.family IS NOT DISTINCT FROM b.family AND s.estimator IS NOT DISTINCT FROM b.estimator AND s.metric = b.metric"""


@query("agg_ablation_lineitem", _ABL_SQL)
def agg_ablation_lineitem(spark, sf_dir):
    """AGG-09 + JOI-02: ablation summary per (family, estimator, variant, metric) and delta vs baseline."""
    li = _t(spark, sf_dir, "lineitem")
    vk = F.when(F.col("l_linenumber") == 1, F.lit("baseline")).otherwise(
        F.concat(F.lit("variant_"), F.col("l_linenumber").cast("string")))
    folds = li.groupBy(F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("estimator"),
                       vk.alias("variant_key"), F.year("l_shipdate").cast("long").alias("seed")).agg(
        F.avg(1 - F.col("l_discount")).alias("accuracy"), F.avg(1 - F.col("l_tax")).alias("f1"))
    long = ST.melt(folds, ["family", "estimator", "variant_key", "seed"], ["accuracy", "f1"])
    return ST.ablation_summary(long)


@query("agg_dataset_rollup_orders", f"""SELECT dataset, framework, coalesce(round(avg(accuracy), 4), 0.0) AS mean,
  coalesce(round(stddev_samp(accuracy), 4), 0.0) AS std, count(accuracy) AS n
FROM {D.LEADERBOARD_YEARS_SQL} ly GROUP BY GROUPING SETS ((dataset, framework), (dataset))""")
def agg_dataset_rollup_orders(spark, sf_dir):
    """AGG-10: dataset × framework and dataset roll-ups (grouping sets), rounded to 4, null → 0."""
    return ST.dataset_rollup(D.leaderboard_years_df(spark, sf_dir))


@query("agg_coverage_orders", f"SELECT framework, count(DISTINCT dataset) AS datasets_covered FROM {D.LEADERBOARD_SQL} lb GROUP BY 1")
def agg_coverage_orders(spark, sf_dir):
    """AGG-11: datasets covered per framework."""
    return ST.coverage(D.leaderboard_df(spark, sf_dir))


@query("agg_distribution_lineitem", f"""SELECT framework, metric, round(q[1], 6) AS min, round(q[2], 6) AS q1, round(q[3], 6) AS median,
  round(q[4], 6) AS q3, round(q[5], 6) AS max, round(q[4] - q[2], 6) AS iqr,
  round(q[2] - 1.5 * (q[4] - q[2]), 6) AS lower_fence, round(q[4] + 1.5 * (q[4] - q[2]), 6) AS upper_fence
FROM (SELECT framework, metric, quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM {FL} fl GROUP BY 1, 2) x""")
def agg_distribution_lineitem(spark, sf_dir):
    """AGG-12: box/violin feed per framework × metric (distributed exact quantiles)."""
    return ST.distribution_table(D.fold_long_df(spark, sf_dir), distributed=True)


@query("agg_latency_quantiles_lineitem", f"""SELECT framework, round(quantile_cont(predict_time_sec, 0.5), 6) AS predict_time_p50,
  round(quantile_cont(predict_time_sec, 0.95), 6) AS predict_time_p95 FROM {FM} fm GROUP BY 1""")
def agg_latency_quantiles_lineitem(spark, sf_dir):
    """AGG-15: per-framework p50/p95 of fold predict time (producer of predict_time_p95)."""
    return ST.latency_quantiles(D.fold_metrics_df(spark, sf_dir))


@query("agg_classifier_means_lineitem", f"""SELECT framework, round(avg(accuracy), 6) AS accuracy, round(avg(f1), 6) AS f1
FROM {FM} fm GROUP BY 1 HAVING avg(accuracy) IS NOT NULL AND avg(f1) IS NOT NULL""")
def agg_classifier_means_lineitem(spark, sf_dir):
    """AGG-13: mean accuracy and F1 per classifier, dropna, sorted."""
    return ST.classifier_means(D.fold_metrics_df(spark, sf_dir))


_WX_KEYS = "framework_a, framework_b, metric"


@query("stx_wilcoxon_lineitem", f"""WITH fl AS {FL},
j AS (SELECT a.framework AS framework_a, b.framework AS framework_b, a.metric, a.value - b.value AS d
      FROM fl a JOIN fl b ON a.metric = b.metric AND a.framework < b.framework AND a.seed = b.seed AND a.fold = b.fold
      WHERE a.metric IN ('f1_macro', 'accuracy', 'fit_time_sec', 'predict_time_sec') AND a.value - b.value <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY {_WX_KEYS} ORDER BY abs(d)) AS rk,
             count(*) OVER (PARTITION BY {_WX_KEYS}, abs(d)) AS t FROM j),
s AS (SELECT {_WX_KEYS}, count(*) AS n, sum(CASE WHEN d > 0 THEN rk + (t - 1) / 2.0 ELSE 0.0 END) AS w_plus,
             sum(CASE WHEN d < 0 THEN rk + (t - 1) / 2.0 ELSE 0.0 END) AS w_minus FROM r GROUP BY ALL),
tc AS (SELECT {_WX_KEYS}, sum(t * t * t - t) AS tc FROM (SELECT {_WX_KEYS}, abs(d) AS a, count(*) AS t FROM j GROUP BY ALL) x GROUP BY ALL),
z AS (SELECT s.*, CASE WHEN n * (n + 1) * (2 * n + 1) / 24.0 - tc / 48.0 > 0
                       THEN (least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tc / 48.0) END AS z
      FROM s JOIN tc USING (framework_a, framework_b, metric))
SELECT framework_a, framework_b, metric, n, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, round(z, 6) AS z,
       round(CASE WHEN z IS NOT NULL THEN least(1.0, 2 * ({sql_normal_cdf('z')})) END, 6) AS p_value FROM z""")
def stx_wilcoxon_lineitem(spark, sf_dir):
    """STX-06: paired Wilcoxon signed-rank (average ranks, tie-corrected normal approximation)."""
    return ST.wilcoxon_signed_rank(D.fold_long_df(spark, sf_dir).where(F.col("metric").isin(ST.COMPARISON_METRICS)))


# ======================================================================================
# Reports (WIN/JOI/SET)
# ======================================================================================

@query("win_top5_orders", f"""SELECT dataset, framework, round(accuracy, 6) AS accuracy, CAST(row_number() OVER (ORDER BY round(accuracy, 9) DESC, framework, dataset) AS INTEGER) AS rank
FROM (SELECT * FROM {D.LEADERBOARD_SQL} lb WHERE accuracy IS NOT NULL ORDER BY round(accuracy, 9) DESC, framework, dataset LIMIT 5) t""")
def win_top5_orders(spark, sf_dir):
    """WIN-01: top-5 (dataset, framework) rows by accuracy with 1-based rank."""
    return R.top_k(D.leaderboard_df(spark, sf_dir), 5, "accuracy", tiebreak=["framework", "dataset"])


@query("win_winners_orders", f"""SELECT dataset, framework, round(accuracy, 6) AS accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(accuracy, 9) DESC NULLS LAST, framework) AS rn FROM {D.LEADERBOARD_SQL} lb) x WHERE rn = 1""")
def win_winners_orders(spark, sf_dir):
    """WIN-02: winning framework per dataset (nulls last, ties by name)."""
    return R.winners(D.leaderboard_df(spark, sf_dir))


@query("win_pareto_suppliers", f"""SELECT framework, round(accuracy, 6) AS accuracy, round(predict_time_p95, 6) AS predict_time_p95,
  (best IS NULL OR accuracy >= best - 1e-10) AS is_pareto
FROM (SELECT *, max(accuracy) OVER (ORDER BY predict_time_p95, framework ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
      FROM {D.SUPPLIER_LATENCY_SQL} s WHERE predict_time_p95 IS NOT NULL AND NOT isnan(predict_time_p95)
        AND predict_time_p95 > 0 AND NOT isinf(predict_time_p95) AND accuracy IS NOT NULL) x""")
def win_pareto_suppliers(spark, sf_dir):
    """WIN-03 + PRJ-21: Pareto front of accuracy vs p95 latency over all suppliers (bucketed running max)."""
    return R.pareto_front(D.supplier_latency_df(spark, sf_dir), "predict_time_p95", "accuracy", tiebreak=["framework"])


@query("win_zero_crossing_events", """SELECT user_id, round(avg(abs(sg - psg) / 2), 6) AS zero_crossing_rate, count(*) AS n
FROM (SELECT user_id, sign(value - 50.0) AS sg, lag(sign(value - 50.0)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS psg
      FROM events) x GROUP BY user_id""")
def win_zero_crossing_events(spark, sf_dir):
    """WIN-09: sign-change rate of each user's centred event values in time order (bucketed lag)."""
    e = _t(spark, sf_dir, "events")
    return R.zero_crossing_rate(e, ["user_id"], F.col("ts"), F.col("value") - 50.0, tiebreak=["event_id"])


@query("win_top_importances_embeddings", f"""WITH f AS (SELECT vec_id, embedding,
    CAST((row_number() OVER (ORDER BY {sql_h15('42', 'vec_id')}, vec_id) - 1) % 5 AS INTEGER) AS fold FROM embeddings),
imp AS (SELECT fold, 'dim_' || CAST(i - 1 AS VARCHAR) AS feature, avg(abs(CAST(embedding[i] AS DOUBLE))) AS importance
        FROM f, range(1, 65) r(i) GROUP BY ALL)
SELECT fold, feature, round(importance, 6) AS importance, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY importance DESC, feature) AS rank FROM imp) x WHERE rank <= 20""")
def win_top_importances_embeddings(spark, sf_dir):
    """WIN-06 + TRN-12 shape: top-20 features per fold by importance (mean |value| on the fold)."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    f = S.kfold(e, ["vec_id"], k=5, seeds=[42])
    ex = f.select("fold", F.posexplode("embedding").alias("i", "v"))
    imp = ex.groupBy("fold", F.concat(F.lit("dim_"), F.col("i").cast("string")).alias("feature")).agg(
        F.avg(F.abs(F.col("v").cast("double"))).alias("importance"))
    return R.top_k_per_group(imp, ["fold"], F.col("importance"), 20, tiebreak=["feature"])


@query("joi_leaderboard_latency_lineitem", f"""SELECT l.framework, round(l.accuracy, 6) AS accuracy, round(q.predict_time_p95, 6) AS predict_time_p95
FROM (SELECT framework, avg(accuracy) AS accuracy FROM {FM} a GROUP BY 1) l
LEFT JOIN (SELECT framework, quantile_cont(predict_time_sec, 0.95) AS predict_time_p95 FROM {FM} b GROUP BY 1) q USING (framework)""")
def joi_leaderboard_latency_lineitem(spark, sf_dir):
    """JOI-01: leaderboard ⟕ latency table on framework (the latency side is size-checked before broadcast)."""
    fm = D.fold_metrics_df(spark, sf_dir)
    lb = fm.groupBy("framework").agg(F.avg("accuracy").alias("accuracy"))
    lat = ST.latency_quantiles(fm).select("framework", "predict_time_p95")
    return lb.join(lat, "framework", "left")


@query("joi_registry_lookup_orders", f"""SELECT lb.dataset, lb.framework, coalesce(r.region, 'unknown') AS region
FROM {D.LEADERBOARD_SQL} lb LEFT JOIN (SELECT n.n_name AS dataset, rg.r_name AS region FROM nation n JOIN region rg ON n.n_regionkey = rg.r_regionkey) r
ON lb.dataset = r.dataset""")
def joi_registry_lookup_orders(spark, sf_dir):
    """JOI-05: dataset → metadata registry lookup with an 'unknown' default."""
    n = _t(spark, sf_dir, "nation")
    rg = _t(spark, sf_dir, "region")
    reg = n.join(rg, n.n_regionkey == rg.r_regionkey).select(F.col("n_name").alias("dataset"),
                                                             F.col("r_name").alias("region"))
    lb = D.leaderboard_df(spark, sf_dir).select("dataset", "framework")
    return R.registry_lookup(lb, reg, "dataset", ["region"])


@query("joi_upsert_leaderboard_orders", f"""WITH old AS (SELECT dataset, framework, avg(accuracy) AS accuracy FROM {D.LEADERBOARD_YEARS_SQL} a WHERE year < 1998 GROUP BY 1, 2),
new AS (SELECT dataset, framework, avg(accuracy) AS accuracy FROM {D.LEADERBOARD_YEARS_SQL} b WHERE framework = '1-URGENT' GROUP BY 1, 2)
SELECT dataset, framework, round(accuracy, 6) AS accuracy FROM old WHERE (dataset, framework) NOT IN (SELECT dataset, framework FROM new)
UNION ALL SELECT dataset, framework, round(accuracy, 6) FROM new""")
def joi_upsert_leaderboard_orders(spark, sf_dir):
    """SNK-02 + JOI-06: keyed upsert (anti-join + union) of a refreshed leaderboard slice."""
    ly = D.leaderboard_years_df(spark, sf_dir)
    old = ly.where(F.col("year") < 1998).groupBy("dataset", "framework").agg(F.avg("accuracy").alias("accuracy"))
    new = ly.where(F.col("framework") == "1-URGENT").groupBy("dataset", "framework").agg(
        F.avg("accuracy").alias("accuracy"))
    return R.upsert(old, new, ["dataset", "framework"])


@query("joi_metric_alignment_lineitem", f"""SELECT framework, round(avg(CASE WHEN metric = 'accuracy' THEN value END), 6) AS accuracy,
  round(avg(CASE WHEN metric = 'predict_time_sec' THEN value END), 6) AS predict_time_sec FROM {FL} fl GROUP BY 1""")
def joi_metric_alignment_lineitem(spark, sf_dir):
    """JOI-04: score-vs-time alignment per framework by conditional aggregation."""
    return R.metric_alignment(D.fold_long_df(spark, sf_dir), "accuracy", "predict_time_sec")


@query("set_union_modalities", f"""SELECT dataset, framework, round(accuracy, 6) AS accuracy, CAST(NULL AS DOUBLE) AS f1_macro FROM {D.LEADERBOARD_SQL} lb
UNION ALL SELECT 'nlp', 'length_rule_' || lang, round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6), NULL FROM {DP} p GROUP BY lang
UNION ALL SELECT 'vision', 'argmax10', round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6), NULL FROM {EP} e""")
def set_union_modalities(spark, sf_dir):
    """SET-01/02: union by name of tabular, nlp and vision leaderboards, tagging frames without a dataset."""
    tab = D.leaderboard_df(spark, sf_dir).withColumn("f1_macro", F.lit(None).cast("double"))
    nlp = D.doc_preds_df(spark, sf_dir).groupBy(F.concat(F.lit("length_rule_"), F.col("lang")).alias("framework")).agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))
    vis = D.emb_preds_df(spark, sf_dir).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias(
        "accuracy")).withColumn("framework", F.lit("argmax10"))
    return R.union_tagged([(tab, "tabular"), (nlp, "nlp"), (vis, "vision")]).select(
        "dataset", "framework", "accuracy", "f1_macro")


@query("set_dedupe_conversations", "SELECT DISTINCT role, text FROM conversations")
def set_dedupe_conversations(spark, sf_dir):
    """SET-03: exact-row dedupe of (role, text) over whole conversation turns."""
    return _t(spark, sf_dir, "conversations").select("role", "text").dropDuplicates()


@query("set_label_sets_embeddings", f"""WITH p AS {EP}, t AS (SELECT DISTINCT y_true AS l FROM p), q AS (SELECT DISTINCT y_pred AS l FROM p)
SELECT l AS label, l IN (SELECT l FROM t) AS in_truth, l IN (SELECT l FROM q) AS in_pred FROM (SELECT l FROM t UNION SELECT l FROM q) u""")
def set_label_sets_embeddings(spark, sf_dir):
    """SET-04: union / membership of the label sets of truth and prediction."""
    p = D.emb_preds_df(spark, sf_dir)
    t = p.select(F.col("y_true").alias("label")).distinct().withColumn("in_truth", F.lit(True))
    q = p.select(F.col("y_pred").alias("label")).distinct().withColumn("in_pred", F.lit(True))
    u = t.join(q, "label", "full")
    return u.select("label", F.coalesce("in_truth", F.lit(False)).alias("in_truth"),
                    F.coalesce("in_pred", F.lit(False)).alias("in_pred"))


@query("agg_dashboard_orders", f"""WITH lb AS {D.LEADERBOARD_SQL},
w AS (SELECT framework, count(*) AS wins FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY accuracy DESC NULLS LAST, framework) AS rn FROM lb) x WHERE rn = 1 GROUP BY 1),
m AS (SELECT framework, avg(accuracy) AS mean_accuracy, count(DISTINCT dataset) AS datasets_covered FROM lb GROUP BY 1)
SELECT m.framework, round(mean_accuracy, 6) AS mean_accuracy, datasets_covered, CAST(coalesce(wins, 0) AS BIGINT) AS wins,
       CAST(row_number() OVER (ORDER BY mean_accuracy DESC, m.framework) AS INTEGER) AS rank
FROM m LEFT JOIN w USING (framework) ORDER BY mean_accuracy DESC, m.framework LIMIT 5""")
def agg_dashboard_orders(spark, sf_dir):
    """AGG-17: dashboard summary — top frameworks, datasets covered, wins per framework."""
    lb = D.leaderboard_df(spark, sf_dir)
    wins = R.winners(lb).groupBy("framework").agg(F.count(F.lit(1)).alias("wins"))
    m = lb.groupBy("framework").agg(F.avg("accuracy").alias("mean_accuracy"),
                                    F.countDistinct("dataset").cast("long").alias("datasets_covered"))
    m = m.join(wins, "framework", "left").withColumn("wins", F.coalesce("wins", F.lit(0)).cast("long"))
    return R.top_k(m, 5, "mean_accuracy", tiebreak=["framework"])

"""Metric edge cases against brute force, and statistics against the reference's committed goldens."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldline.operators import metrics as M
from foldline.operators import stats as ST


def brute_auc(y, s):
    pos = [a for a, t in zip(s, y) if t == 1]
    neg = [a for a, t in zip(s, y) if t == 0]
    if not pos or not neg:
        return None
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def brute_ap(y, s):
    P = sum(y)
    if P == 0:
        return None
    ap = 0.0
    for thr in sorted(set(s), reverse=True):
        tp = sum(1 for a, t in zip(s, y) if a >= thr and t == 1)
        fp = sum(1 for a, t in zip(s, y) if a >= thr and t == 0)
        dp = sum(1 for a, t in zip(s, y) if a == thr and t == 1)
        ap += dp / P * tp / (tp + fp)
    return ap


def test_ranking_metrics_vs_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(3):
        for i in range(60):
            y = int(rng.integers(0, 2))
            s = float(np.round(rng.random() * 0.5 + 0.3 * y, 1))  # rounded -> many ties
            rows.append((g, y, s))
    df = spark.createDataFrame(rows, "g int, y int, s double")
    for nb in (1, 4):
        got = {r["g"]: r for r in M.ranking_metrics(df, ["g"], "y", "s", n_buckets=nb).collect()}
        for g in range(3):
            y = [r[1] for r in rows if r[0] == g]
            s = [r[2] for r in rows if r[0] == g]
            assert abs(got[g]["roc_auc"] - brute_auc(y, s)) < 1e-12
            assert abs(got[g]["avg_precision"] - brute_ap(y, s)) < 1e-12


def test_metric_edges(spark):
    one_class = spark.createDataFrame([(1, 1, 0.3), (1, 1, 0.7)], "y_true int, y_pred int, s double")
    r = M.ranking_metrics(one_class, [], "y_true", "s").first()
    assert r["roc_auc"] is None
    ties = spark.createDataFrame([(0, 0, 0.5), (1, 0, 0.5), (1, 0, 0.5), (0, 0, 0.5)], "y_true int, y_pred int, s double")
    assert M.ranking_metrics(ties, [], "y_true", "s").first()["roc_auc"] == 0.5
    c = M.classification_metrics(ties, [], "y_true", "y_pred").first()
    assert c["precision"] == 0.0 and c["recall"] == 0.0 and c["f1"] == 0.0
    const = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y double, p double")
    assert M.regression_metrics(const, [], "y", "p").first()["r2"] == 1.0
    const2 = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "y double, p double")
    assert M.regression_metrics(const2, [], "y", "p").first()["r2"] == 0.0


def test_f1_macro_and_positive_label(spark):
    rows = [(0, 0), (1, 1), (2, 1), (2, 2), (1, 0)]
    df = spark.createDataFrame(rows, "y_true int, y_pred int")
    m = M.classification_metrics(df, [], "y_true", "y_pred").first()
    # labels 0,1,2: f1_0 = 2/3, f1_1 = 1/2, f1_2 = 2/3 ; positive label 2: tp 1, fp 0, fn 1
    assert abs(m["f1_macro"] - (2 / 3 + 1 / 2 + 2 / 3) / 3) < 1e-12
    assert m["precision"] == 1.0 and m["recall"] == 0.5


def _folds(spark):
    rows = [(1, "XGBoost", 0.9508771929824561, 0.9470091372715682), (2, "XGBoost", 0.9647887323943662, 0.962370150519398),
            (1, "LightGBM", 0.9649122807017544, 0.9621493837654058), (2, "LightGBM", 0.9612676056338029, 0.9583638762644773)]
    return spark.createDataFrame(rows, "fold int, framework string, accuracy double, f1_macro double")


def test_paired_t_golden_df1(spark):
    long = ST.melt(_folds(spark), ["framework", "fold"], ["f1_macro", "accuracy"])
    t = ST.paired_tests(long, pair_on=["fold"], with_bootstrap=False).where(F.col("metric") == "f1_macro").first()
    # reference pairs XGBoost − LightGBM; ours orders lexically (LightGBM < XGBoost): sign flips, p equal
    assert abs(-t["t_stat"] - (-0.5815141238983981)) < 1e-9
    assert abs(t["p_value"] - 0.6646821570035102) < 1e-9


def test_normal_ci_golden(spark):
    long = ST.melt(_folds(spark), ["framework", "fold"], ["f1_macro", "accuracy"])
    s = {(r["framework"], r["metric"]): r for r in ST.framework_summary(long).collect()}
    assert abs(s[("XGBoost", "f1_macro")]["se_ci_low"] - 0.9396358509126098) < 1e-12
    assert abs(s[("LightGBM", "accuracy")]["se_ci_high"] - 0.9666617247343712) < 1e-12


def test_leaderboard_mean_golden(spark):
    acc = [0.9736842105263158, 0.9649122807017544, 0.9736842105263158, 0.9473684210526315, 0.9734513274336283]
    df = spark.createDataFrame([(i, "CatBoost", a) for i, a in enumerate(acc)], "fold int, framework string, accuracy double")
    m = ST.leaderboard_means(df, ["accuracy"]).first()
    assert abs(m["accuracy"] - 0.9666200900481292) < 1e-12


def test_paired_edges(spark):
    one = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.4)], "framework string, fold int, value double").withColumn(
        "metric", F.lit("m"))
    assert ST.paired_tests(one, ["fold"], with_bootstrap=False).count() == 0       # n = 1
    uneq = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.6), ("a", 3, 0.6), ("b", 1, 0.4), ("b", 2, 0.4)],
                                 "framework string, fold int, value double").withColumn("metric", F.lit("m"))
    assert ST.paired_tests(uneq, ["fold"], with_bootstrap=False).count() == 0      # unequal lengths
    zero = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.6), ("b", 1, 0.4), ("b", 2, 0.5)],
                                 "framework string, fold int, value double").withColumn("metric", F.lit("m"))
    r = ST.paired_tests(zero, ["fold"], with_bootstrap=False).first()
    assert r["t_stat"] is None and r["p_value"] is None                               # zero variance


@pytest.mark.parametrize("t,dof,p", [(4.0, 4, 0.016130089900092237), (2.0, 30, 0.054625044962982816),
                                     (-6.0, 9, 0.00020249932206761745)])
def test_t_pvalues_closed_form(spark, t, dof, p):
    from foldline.functions.stats import t_two_sided_p
    got = spark.range(1).select(t_two_sided_p(F.lit(t), F.lit(dof))).first()[0]
    assert abs(got - p) < 1e-12


def test_bootstrap_is_deterministic_and_brackets_mean(spark):
    long = ST.melt(_folds(spark), ["framework", "fold"], ["accuracy"])
    a = ST.bootstrap_ci(long, ["framework", "metric"], ["fold"]).orderBy("framework").collect()
    b = ST.bootstrap_ci(long.repartition(3), ["framework", "metric"], ["fold"]).orderBy("framework").collect()
    assert a == b
    for r in a:
        assert r["boot_ci_low"] <= r["boot_ci_high"]


def test_pareto_ties_kept(spark):
    from foldline.operators.reports import pareto_front
    df = spark.createDataFrame([("a", 0.9, 1.0), ("b", 0.9, 2.0), ("c", 0.8, 3.0), ("d", 0.95, 4.0), ("e", 0.5, float("inf"))],
                               "framework string, accuracy double, p95 double")
    r = {x["framework"]: x["is_pareto"] for x in pareto_front(df, "p95", "accuracy", n_buckets=2).collect()}
    assert r == {"a": True, "b": True, "c": False, "d": True}


def test_wilcoxon_runs(spark):
    rows = [(f, s, v) for s in range(8) for f, v in [("a", 0.5 + s * 0.01), ("b", 0.45 + s * 0.011)]]
    df = spark.createDataFrame(rows, "framework string, seed int, value double").withColumn("metric", F.lit("m"))
    r = ST.wilcoxon_signed_rank(df, ["seed"]).first()
    assert r["n"] == 8 and 0 <= r["p_value"] <= 1 and not math.isnan(r["z"])

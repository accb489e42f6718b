"""Evaluation metrics over a prediction table (MET-*), for every group in one pass.

A prediction table has group keys (framework, seed, fold, segment …), ``y_true``,
``y_pred`` and optionally a ``score``. Classification metrics are derived from the
*confusion cells* ``groupBy(keys, y_true, y_pred).count()`` — one map-side-combined
aggregate whose size is groups × labels², independent of the row count. Ranking metrics
(ROC-AUC with half credit for ties, non-interpolated average precision) are derived from
the per-group score histogram ``groupBy(keys, score, y_true).count()`` and a bucketed
descending cumulative sum, so no group is ever sorted inside one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldline.functions.ordered import cumsum_within, null_safe_join


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def threshold(score: Column, cut: float = 0.5) -> Column:
    """MET-10: 1 when score >= cut else 0."""
    return F.when(score >= cut, F.lit(1)).otherwise(F.lit(0))


def argmax(arr: Column) -> Column:
    """MET-10: 0-based index of the first maximum of an array."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def coerce_labels(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """MET-12: when the two label columns differ in type, compare them as strings."""
    if df.schema[y_true].dataType != df.schema[y_pred].dataType:
        return df.withColumn(y_true, F.col(y_true).cast("string")).withColumn(y_pred, F.col(y_pred).cast("string"))
    return df


def confusion_cells(pred: DataFrame, keys: Sequence[str], y_true: str, y_pred: str) -> DataFrame:
    """``keys…, t, p, n``: counts per (truth, prediction) pair."""
    return pred.groupBy(*keys, F.col(y_true).alias("t"), F.col(y_pred).alias("p")).agg(
        F.count(F.lit(1)).cast("long").alias("n"))


def classification_metrics(pred: DataFrame, keys: Sequence[str], y_true: str, y_pred: str) -> DataFrame:
    """MET-01/02/03: ``keys…, n, accuracy, precision, recall, f1, f1_macro``.

    Binary precision/recall/F1 use the largest label in y_true ∪ y_pred as positive
    (0 on zero division); F1-macro is the unweighted mean over labels in y_true ∪ y_pred.
    """
    keys = list(keys)
    cells = confusion_cells(coerce_labels(pred, y_true, y_pred), keys, y_true, y_pred)
    base = cells.groupBy(*keys).agg(
        F.sum("n").cast("long").alias("n"),
        F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("_correct"),
        F.greatest(F.max("t"), F.max("p")).alias("_pos"))
    c2 = null_safe_join(cells, base.select(*keys, "_pos"), keys)
    pos = c2.groupBy(*keys).agg(
        F.sum(F.when((F.col("t") == F.col("_pos")) & (F.col("p") == F.col("_pos")), F.col("n")).otherwise(0)).alias("_tp"),
        F.sum(F.when((F.col("t") != F.col("_pos")) & (F.col("p") == F.col("_pos")), F.col("n")).otherwise(0)).alias("_fp"),
        F.sum(F.when((F.col("t") == F.col("_pos")) & (F.col("p") != F.col("_pos")), F.col("n")).otherwise(0)).alias("_fn"))
    per_label = cells.select(*keys, F.explode(F.array(
        F.struct(F.col("t").cast("string").alias("label"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("long").alias("fp"),
                 F.when(F.col("t") != F.col("p"), F.col("n")).otherwise(0).alias("fn")),
        F.struct(F.col("p").cast("string").alias("label"), F.lit(0).cast("long").alias("tp"),
                 F.when(F.col("t") != F.col("p"), F.col("n")).otherwise(0).alias("fp"),
                 F.lit(0).cast("long").alias("fn")))).alias("_l")).select(*keys, "_l.*")
    per_label = per_label.where(F.col("label").isNotNull()).groupBy(*keys, "label").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    macro = per_label.groupBy(*keys).agg(
        F.avg(_safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1_macro"))
    out = null_safe_join(null_safe_join(base, pos, keys), macro, keys)
    prec = _safe_div(F.col("_tp"), F.col("_tp") + F.col("_fp"))
    rec = _safe_div(F.col("_tp"), F.col("_tp") + F.col("_fn"))
    f1 = _safe_div(2 * F.col("_tp"), 2 * F.col("_tp") + F.col("_fp") + F.col("_fn"))
    return out.select(*keys, "n", (F.col("_correct") / F.col("n")).alias("accuracy"),
                      prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), "f1_macro")


def ranking_metrics(pred: DataFrame, keys: Sequence[str], y_true: str, score: str,
                    n_buckets=None) -> DataFrame:
    """MET-04/05: ``keys…, roc_auc, avg_precision`` (positive = largest y_true label per group).

    ROC-AUC = sum_s pos(s)·(negatives below s + ½·neg(s)) / (P·N); AP = sum_s pos(s)/P · precision(s)
    over distinct scores in descending order. Null when a group has a single class.
    """
    keys = list(keys)
    # one row per group: the positive label is known before the only count of rows by score
    lab = pred.groupBy(*keys).agg(F.max(y_true).alias("_pl"))
    own = pred.select(*keys, F.col(score).cast("double").alias("_s"), F.col(y_true).alias("_y"))
    h = null_safe_join(own, F.broadcast(lab), keys)
    h = h.withColumn("_p", F.when(F.col("_y") == F.col("_pl"), 1).otherwise(0)).withColumn(
        "_q", F.when(F.col("_y") == F.col("_pl"), 0).otherwise(1))
    dist = h.groupBy(*keys, "_s").agg(F.sum("_p").alias("pos"), F.sum("_q").alias("neg"))
    dist = dist.where(F.col("_s").isNotNull())
    # WIN-11: cumulative sums over distinct scores in descending order (bucketed, exact)
    cum = cumsum_within(dist, keys, -F.col("_s"), {"tp": F.col("pos"), "fp": F.col("neg")}, n_buckets=n_buckets)
    tot = dist.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    c = null_safe_join(cum, F.broadcast(tot), keys)
    auc_term = F.col("pos") * (F.col("N") - F.col("fp") + 0.5 * F.col("neg"))
    ap_term = F.when(F.col("pos") > 0, F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    agg = c.groupBy(*keys).agg(F.sum(auc_term).alias("_auc"), F.sum(ap_term).alias("_ap"),
                               F.first("P").alias("P"), F.first("N").alias("N"))
    ok = (F.col("P") > 0) & (F.col("N") > 0)
    return agg.select(*keys, F.when(ok, F.col("_auc") / (F.col("P") * F.col("N"))).alias("roc_auc"),
                      F.when(ok, F.col("_ap") / F.col("P")).alias("avg_precision"))


def ovr_ranking_metrics(pred: DataFrame, keys: Sequence[str], y_true: str, scores: str,
                        n_buckets=None) -> DataFrame:
    """One-vs-rest macro ROC-AUC / AP over a per-class score array (class c = index c)."""
    keys = list(keys)
    ex = pred.select(*keys, F.col(y_true).alias("_yt"), F.posexplode(scores).alias("_cls", "_sc"))
    ex = ex.withColumn("_is", (F.col("_yt") == F.col("_cls")).cast("int"))
    per = ranking_metrics(ex, keys + ["_cls"], "_is", "_sc", n_buckets=n_buckets)
    return per.groupBy(*keys).agg(F.avg("roc_auc").alias("roc_auc_ovr"), F.avg("avg_precision").alias("avg_precision_ovr"))


def regression_metrics(pred: DataFrame, keys: Sequence[str], y_true: str, y_pred: str) -> DataFrame:
    """MET-06/07: ``keys…, n, rmse, mae, r2`` in one aggregate (R² of constant truth: 1 if exact else 0)."""
    e = F.col(y_true).cast("double") - F.col(y_pred).cast("double")
    a = pred.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum(e * e).alias("_sse"),
                                F.avg(F.abs(e)).alias("mae"), F.var_pop(F.col(y_true).cast("double")).alias("_vp"))
    sst = F.col("_vp") * F.col("n")
    r2 = F.when(sst > 0, 1 - F.col("_sse") / sst).when(F.col("_sse") == 0, 1.0).otherwise(0.0)
    return a.select(*keys, "n", F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"), "mae", r2.alias("r2"))


def confusion_matrix(pred: DataFrame, keys: Sequence[str], y_true: str, y_pred: str) -> DataFrame:
    """MET-08: one row per (keys, true label in the label union) with a count column per class.

    The class list is collected: it is the result's column list. :func:`confusion_cells` is the long form.
    """
    keys = list(keys)
    cells = confusion_cells(coerce_labels(pred, y_true, y_pred), keys, y_true, y_pred)
    labels = cells.select(*keys, F.explode(F.array("t", "p")).alias("label")).where(
        F.col("label").isNotNull()).distinct()
    classes = labels.select("label").distinct()
    values = sorted(r[0] for r in classes.collect())
    wide = cells.groupBy(*keys, F.col("t").alias("label")).pivot("p", values).agg(F.sum("n"))
    out = null_safe_join(labels, wide, keys + ["label"], "left")
    names = {v: f"pred_{v}" for v in values}
    return out.select(*keys, F.col("label").alias("true_label"),
                      *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("long").alias(names[v]) for v in values])


def first_k_predictions(pred: DataFrame, key: str, y_true: str, y_pred: str, class_names: DataFrame,
                        k: int = 10) -> DataFrame:
    """MET-09: the first k rows by key with class names (out-of-range codes give null names).

    ``class_names`` is ``(code, name)``; the k rows are the small side.
    """
    top = pred.orderBy(key).limit(k)
    names = class_names
    t = top.join(names.select(F.col("code").alias("_tc"), F.col("name").alias("true_name")),
                 F.col(y_true) == F.col("_tc"), "left")
    t = t.join(names.select(F.col("code").alias("_pc"), F.col("name").alias("pred_name")),
               F.col(y_pred) == F.col("_pc"), "left")
    return t.select(key, y_true, y_pred, "true_name", "pred_name")


def calibration_bins(pred: DataFrame, keys: Sequence[str], y_true: str, score: str, n_bins: int = 10) -> DataFrame:
    """STX-07: per (keys, bin of score in [0,1]) mean score, observed positive rate, count."""
    b = F.least(F.greatest(F.floor(F.col(score) * n_bins), F.lit(0)), F.lit(n_bins - 1)).cast("int")
    return pred.groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.avg(F.col(score)).alias("mean_score"),
        F.avg(F.col(y_true).cast("double")).alias("positive_rate"))


def custom_metrics(pred: DataFrame, keys: Sequence[str], metrics: dict, y_true: str = "y_true",
                   y_pred: str = "y_pred") -> DataFrame:
    """UDF-01: user metric callables ``f(y_true: pd.Series, y_pred: pd.Series) -> float`` run as
    grouped-aggregate pandas UDFs (Arrow batches), one column per metric, all groups in one pass.

    A grouped-aggregate UDF sees a whole group at once; the built-in metrics above are the
    scalable path, custom callables suit bounded groups (folds of a sampled evaluation)."""

    def make(fn):
        def _m(t: pd.Series, p: pd.Series) -> float:
            return float(fn(t, p))
        return F.pandas_udf(_m, "double")

    aggs = [make(fn)(F.col(y_true), F.col(y_pred)).alias(name) for name, fn in metrics.items()]
    return pred.groupBy(*keys).agg(*aggs)


def evaluate(pred: DataFrame, keys: Sequence[str], task: str, y_true: str = "y_true", y_pred: str = "y_pred",
             score: str | None = None, n_buckets=None) -> DataFrame:
    """UDF-01 / TRN-03 helper: every metric of the task for every group."""
    keys = list(keys)
    if task == "regression":
        return regression_metrics(pred, keys, y_true, y_pred)
    m = classification_metrics(pred, keys, y_true, y_pred)
    if score:
        if isinstance(pred.schema[score].dataType, T.ArrayType):
            r = ovr_ranking_metrics(pred, keys, y_true, score, n_buckets)
        else:
            r = ranking_metrics(pred, keys, y_true, score, n_buckets)
        m = null_safe_join(m, r, keys, "left")
    return m

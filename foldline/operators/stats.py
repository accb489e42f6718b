"""Statistics over fold-level metric tables (AGG-01..17, STX-06).

Fold-metric tables hold one row per (framework, seed, fold): they are small by
construction, so windows over them need no bucketing. Everything is still expressed
as DataFrame operations (no pandas on the driver) so the same code summarises one
experiment or ten thousand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldline.functions.hashing import h8
from foldline.functions.ordered import exact_percentiles, null_safe_join
from foldline.operators.reports import RANK_DIGITS
from foldline.functions.stats import normal_cdf, t_two_sided_p

# Fixed values of the reference's summaries.
SUMMARY_METRICS = ["f1_macro", "accuracy", "roc_auc_ovr", "avg_precision_ovr", "fit_time_sec", "predict_time_sec"]
COMPARISON_METRICS = ["f1_macro", "accuracy", "fit_time_sec", "predict_time_sec"]
Z95 = 1.96
N_BOOT = 1000
ALPHA = 0.05
BOOT_SEED = 42


def melt(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """SHP-01: wide → long ``ids…, metric, value`` keeping only present, non-null, non-NaN values."""
    present = [m for m in metrics if m in df.columns]
    if not present:
        raise ValueError("none of the metrics is present")
    long = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in present]).unpivot(
        list(ids), present, "metric", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def seed_summary(folds: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("seed",)) -> DataFrame:
    """AGG-01 + SHP-03: per seed ``<metric>_mean`` and sample ``<metric>_std``."""
    present = [m for m in metrics if m in folds.columns]
    aggs = []
    for m in present:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return folds.groupBy(*keys).agg(*aggs)


def leaderboard_means(folds: DataFrame, metrics: Sequence[str], key: str = "framework") -> DataFrame:
    """AGG-02: per framework mean of every present metric."""
    present = [m for m in metrics if m in folds.columns]
    return folds.groupBy(key).agg(*[F.avg(m).alias(m) for m in present])


def framework_summary(long: DataFrame, keys: Sequence[str] = ("framework", "metric")) -> DataFrame:
    """AGG-03/04/05: mean, sample std (0 when n = 1), n, spread interval ±1.96·std and the
    normal CI of the mean ±1.96·std/√n (null when n ≤ 1)."""
    a = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("_sd"),
                                F.count("value").cast("long").alias("n"))
    std = F.when(F.col("n") > 1, F.col("_sd")).otherwise(F.lit(0.0))
    a = a.withColumn("std", std).drop("_sd")
    spread = F.when(F.col("std") > 0, Z95 * F.col("std")).otherwise(F.lit(0.0))
    se = F.when(F.col("n") > 1, Z95 * F.col("std") / F.sqrt("n"))
    return a.select(*keys, "mean", "std", "n",
                    (F.col("mean") - spread).alias("ci95_low"), (F.col("mean") + spread).alias("ci95_high"),
                    (F.col("mean") - se).alias("se_ci_low"), (F.col("mean") + se).alias("se_ci_high"))


BOOT_BLOCKS = 50          # tasks' share of one group's resamples


def bootstrap_ci(long: DataFrame, keys: Sequence[str], order: Sequence[str], n_boot: int = N_BOOT,
                 alpha: float = ALPHA, seed: int = BOOT_SEED) -> DataFrame:
    """AGG-06: percentile bootstrap CI of the mean with hashed (engine-independent) resampling.

    Draw j of resample b picks position ``md5(seed|keys|b|j) mod n``; the mean of each
    resample is taken and the linear-interpolated ``alpha/2`` and ``1-alpha/2`` quantiles
    of the resample means are returned. Output: ``keys…, boot_ci_low, boot_ci_high``.

    A group is the seeds x folds of one comparison, a handful of values: it travels as one array, in
    ``BOOT_BLOCKS`` copies that each compute their share of the resamples, so no draw becomes a row.
    """
    keys = list(keys)
    rest = [c for c in order if c not in keys]
    groups = long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*rest, "value"))).alias("_v"))
    groups = groups.select(*keys, F.transform("_v", lambda x: x["value"]).alias("_v"), F.size("_v").alias("_n"))
    share = -(-n_boot // BOOT_BLOCKS)
    n_part = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = groups.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit(BOOT_BLOCKS - 1)))).repartition(n_part, "_blk", *keys)
    first = F.col("_blk") * share
    mine = F.filter(F.sequence(first, first + share - 1), lambda b: b < n_boot)

    def mean_of(b):
        at = lambda j: h8(F.lit(seed), *[F.col(k) for k in keys], b, j) % F.col("_n")
        total = F.aggregate(F.sequence(F.lit(0), F.col("_n") - 1), F.lit(0.0),
                            lambda acc, j: acc + F.element_at("_v", (at(j) + 1).cast("int")))
        return total / F.col("_n")

    means = blocks.select(*keys, F.explode(F.transform(mine, mean_of)).alias("_m"))
    return means.groupBy(*keys).agg(F.percentile("_m", alpha / 2).alias("boot_ci_low"),
                                    F.percentile("_m", 1 - alpha / 2).alias("boot_ci_high"))


def paired_tests(long: DataFrame, pair_on: Sequence[str] = ("seed", "fold"), metrics=None,
                 with_bootstrap: bool = True, n_boot: int = N_BOOT) -> DataFrame:
    """AGG-07 + JOI-03: paired t-test for every framework pair a < b and metric.

    Values are paired on ``pair_on``; a pair of frameworks is compared only when both have
    the same number of values and more than one pair. Zero variance of the differences
    gives null t and p. Output: ``framework_a, framework_b, metric, n, diff, t_stat,
    p_value`` (+ ``boot_ci_low, boot_ci_high`` of the differences).
    """
    pair_on = list(pair_on)
    if metrics is not None:
        long = long.where(F.col("metric").isin(list(metrics)))
    a = long.select(F.col("framework").alias("framework_a"), "metric", *pair_on, F.col("value").alias("_va"))
    b = long.select(F.col("framework").alias("framework_b"), "metric", *pair_on, F.col("value").alias("_vb"))
    cond = [a["metric"] == b["metric"], a["framework_a"] < b["framework_b"]] + [a[c] == b[c] for c in pair_on]
    j = a.join(b, cond).select("framework_a", "framework_b", a["metric"], *[a[c] for c in pair_on],
                               (F.col("_va") - F.col("_vb")).alias("value"))
    counts = long.groupBy("framework", "metric").agg(F.count("value").alias("_c"))
    ca = counts.select(F.col("framework").alias("framework_a"), "metric", F.col("_c").alias("_ca"))
    cb = counts.select(F.col("framework").alias("framework_b"), "metric", F.col("_c").alias("_cb"))
    s = j.groupBy("framework_a", "framework_b", "metric").agg(
        F.count("value").cast("long").alias("n"), F.avg("value").alias("diff"), F.stddev_samp("value").alias("_sd"))
    s = s.join(ca, ["framework_a", "metric"]).join(cb, ["framework_b", "metric"])
    s = s.where((F.col("_ca") == F.col("_cb")) & (F.col("_ca") == F.col("n")) & (F.col("n") > 1))
    t = F.when(F.col("_sd") > 0, F.col("diff") / (F.col("_sd") / F.sqrt("n")))
    s = s.withColumn("t_stat", t).withColumn("p_value", t_two_sided_p(F.col("t_stat"), F.col("n") - 1))
    s = s.select("framework_a", "framework_b", "metric", "n", "diff", "t_stat", "p_value")
    if with_bootstrap:
        keys = ["framework_a", "framework_b", "metric"]
        boot = bootstrap_ci(j.join(s.select(*keys), keys, "left_semi"), keys, pair_on, n_boot=n_boot)
        s = s.join(boot, keys, "left")
    return s


def pairwise_matrix(tests: DataFrame) -> DataFrame:
    """AGG-08: long matrix ``metric, row_framework, col_framework, diff, p_value``:
    antisymmetric diff, symmetric p, zero diagonal."""
    fw = tests.select("metric", F.col("framework_a").alias("f")).union(
        tests.select("metric", F.col("framework_b").alias("f"))).distinct()
    fwd = tests.select("metric", F.col("framework_a").alias("row_framework"),
                       F.col("framework_b").alias("col_framework"), "diff", "p_value")
    rev = tests.select("metric", F.col("framework_b").alias("row_framework"),
                       F.col("framework_a").alias("col_framework"), (-F.col("diff")).alias("diff"), "p_value")
    diag = fw.select("metric", F.col("f").alias("row_framework"), F.col("f").alias("col_framework"),
                     F.lit(0.0).alias("diff"), F.lit(0.0).alias("p_value"))
    return fwd.unionByName(rev).unionByName(diag)


def ablation_summary(long: DataFrame, group: Sequence[str] = ("family", "estimator", "variant_key"),
                     baseline_key: str = "baseline") -> DataFrame:
    """AGG-09 + JOI-02: mean/std/n per (group, metric) and the delta to the baseline variant of the
    same (family, estimator, metric). Null keys form their own groups."""
    group = list(group)
    s = long.groupBy(*group, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                           F.count("value").cast("long").alias("n"))
    fam = [g for g in group if g != "variant_key"]
    base = s.where(F.col("variant_key") == baseline_key).select(*fam, "metric", F.col("mean").alias("_base"))
    out = null_safe_join(s, base, fam + ["metric"], "left")
    return out.withColumn("delta_vs_baseline", F.col("mean") - F.col("_base")).drop("_base")


def dataset_rollup(scores: DataFrame, value: str = "accuracy", digits: int = 4) -> DataFrame:
    """AGG-10: mean/std by (dataset, framework) and by dataset alone (framework null), rounded, null → 0."""
    g = scores.groupingSets([["dataset", "framework"], ["dataset"]], "dataset", "framework").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).cast("long").alias("n"))
    return g.select("dataset", "framework", F.coalesce(F.round("mean", digits), F.lit(0.0)).alias("mean"),
                    F.coalesce(F.round("std", digits), F.lit(0.0)).alias("std"), "n")


def coverage(leaderboard: DataFrame) -> DataFrame:
    """AGG-11: distinct datasets per framework."""
    return leaderboard.groupBy("framework").agg(F.countDistinct("dataset").cast("long").alias("datasets_covered"))


def distribution_table(long: DataFrame, keys: Sequence[str] = ("framework", "metric"),
                       distributed: bool = False) -> DataFrame:
    """AGG-12: min, q1, median, q3, max, IQR and the 1.5·IQR fences (exact, linear interpolation).

    ``distributed=True`` ranks values with bucketed windows instead of holding each group's
    values in one aggregation buffer (for very large groups).
    """
    keys = list(keys)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    if distributed:
        q = exact_percentiles(long, keys, "value", probs, out_prefix="_q")
    else:
        q = long.groupBy(*keys).agg(F.percentile("value", probs).alias("_qs")).select(
            *keys, *[F.col("_qs")[i].alias(f"_q_{i}") for i in range(5)])
    iqr = F.col("_q_3") - F.col("_q_1")
    return q.select(*keys, F.col("_q_0").alias("min"), F.col("_q_1").alias("q1"), F.col("_q_2").alias("median"),
                    F.col("_q_3").alias("q3"), F.col("_q_4").alias("max"), iqr.alias("iqr"),
                    (F.col("_q_1") - 1.5 * iqr).alias("lower_fence"), (F.col("_q_3") + 1.5 * iqr).alias("upper_fence"))


def latency_quantiles(folds: DataFrame, key: str = "framework", col: str = "predict_time_sec") -> DataFrame:
    """AGG-15: p50/p95 of per-fold latency per framework (the ``predict_time_p95`` producer)."""
    return folds.groupBy(key).agg(F.percentile(col, 0.5).alias("predict_time_p50"),
                                  F.percentile(col, 0.95).alias("predict_time_p95"))


def classifier_means(folds: DataFrame, key: str = "framework") -> DataFrame:
    """AGG-13: mean accuracy and f1 per classifier, rows with a missing mean dropped, sorted by accuracy."""
    a = folds.groupBy(key).agg(F.avg("accuracy").alias("accuracy"), F.avg("f1").alias("f1"))
    # WIN-10: multi-key sort of a report table (explicit tie-break key)
    return a.na.drop(subset=["accuracy", "f1"]).orderBy(F.col("accuracy").desc(), key)


def class_feature_stats(df: DataFrame, label: str, features: Sequence[str], digits: int = 6) -> DataFrame:
    """AGG-14: per class mean and population std of every feature, rounded."""
    aggs = []
    for f in features:
        aggs += [F.round(F.avg(f), digits).alias(f"{f}_mean"), F.round(F.stddev_pop(f), digits).alias(f"{f}_std")]
    return df.groupBy(label).agg(*aggs)


def wilcoxon_signed_rank(long: DataFrame, pair_on: Sequence[str] = ("seed", "fold")) -> DataFrame:
    """STX-06: paired Wilcoxon signed-rank (zero differences dropped, average ranks of |d|,
    normal approximation with tie correction, two-sided). One row per framework pair and metric."""
    pair_on = list(pair_on)
    a = long.select(F.col("framework").alias("framework_a"), "metric", *pair_on, F.col("value").alias("_va"))
    b = long.select(F.col("framework").alias("framework_b"), "metric", *pair_on, F.col("value").alias("_vb"))
    cond = [a["metric"] == b["metric"], a["framework_a"] < b["framework_b"]] + [a[c] == b[c] for c in pair_on]
    d = a.join(b, cond).select("framework_a", "framework_b", a["metric"],
                               F.round(F.col("_va") - F.col("_vb"), RANK_DIGITS).alias("d")).where(F.col("d") != 0)
    keys = ["framework_a", "framework_b", "metric"]
    ties = d.groupBy(*keys, F.abs("d").alias("_a")).agg(F.count(F.lit(1)).alias("_t"))
    w = Window.partitionBy(*keys).orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("_below", F.coalesce(F.sum("_t").over(w), F.lit(0)))
    ties = ties.withColumn("_rank", F.col("_below") + (F.col("_t") + 1) / 2.0)
    r = d.withColumn("_a", F.abs("d")).join(ties, keys + ["_a"])
    s = r.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.sum(F.when(F.col("d") > 0, F.col("_rank")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("d") < 0, F.col("_rank")).otherwise(0.0)).alias("w_minus"))
    tc = ties.groupBy(*keys).agg(F.sum(F.pow("_t", 3) - F.col("_t")).alias("_tc"))
    s = s.join(tc, keys)
    mu = F.col("n") * (F.col("n") + 1) / 4.0
    var = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24.0 - F.col("_tc") / 48.0
    z = F.when(var > 0, (F.least("w_plus", "w_minus") - mu) / F.sqrt(var))
    return s.select(*keys, "n", "w_plus", "w_minus", z.alias("z"),
                    F.when(z.isNotNull(), F.least(F.lit(1.0), 2 * normal_cdf(z))).alias("p_value"))


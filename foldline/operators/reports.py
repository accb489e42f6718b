"""Report tables: leaderboards, winners, Pareto fronts, registries, upserts (WIN/JOI/SET/SHP).

Leaderboards and registries have one row per (dataset, framework): small by
construction. Registries are broadcast only behind an explicit row-count check; the
Pareto front uses the bucketed running maximum so it also works on large candidate sets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldline.functions.ordered import lag_within, null_safe_join, rank_within, running_max_within

PARETO_TOLERANCE = 1e-10
RANK_DIGITS = 9          # scores are ranked at this precision, so that summation order can't decide a tie


def top_k(board: DataFrame, k: int = 5, by: str = "accuracy", tiebreak: Sequence[str] = ("framework",)) -> DataFrame:
    """WIN-01: top-k rows by ``by`` desc (nulls dropped) with a 1-based ``rank``."""
    best = F.round(F.col(by), RANK_DIGITS).desc()
    t = board.where(F.col(by).isNotNull()).orderBy(best, *tiebreak).limit(k)
    w = Window.orderBy(best, *tiebreak)  # k rows only
    return t.withColumn("rank", F.row_number().over(w))


def winners(board: DataFrame, group: str = "dataset", by: str = "accuracy",
            tiebreak: Sequence[str] = ("framework",)) -> DataFrame:
    """WIN-02: best row per group (nulls last, ties by framework)."""
    w = Window.partitionBy(group).orderBy(F.round(F.col(by), RANK_DIGITS).desc_nulls_last(), *tiebreak)
    return board.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def pareto_front(df: DataFrame, cost: str, gain: str, keys: Sequence[str] = (), tiebreak: Sequence[str] = (),
                 tol: float = PARETO_TOLERANCE, n_buckets=None) -> DataFrame:
    """WIN-03: keep rows (ordered by cost asc) whose gain >= best earlier gain − tol.

    Rows with null/NaN/±inf or non-positive cost are dropped first (PRJ-21). Adds ``is_pareto``.
    """
    c = F.col(cost).cast("double")
    ok = c.isNotNull() & ~F.isnan(c) & (c != float("inf")) & (c > 0) & F.col(gain).isNotNull()
    d = df.where(ok)
    r = running_max_within(d, list(keys), c, F.col(gain), tiebreak=list(tiebreak), out="_best",
                           n_buckets=n_buckets)
    keep = F.col("_best").isNull() | (F.col(gain) >= F.col("_best") - tol)
    return r.withColumn("is_pareto", keep).drop("_best")


def keep_last(df: DataFrame, keys: Sequence[str], sequence_col: str) -> DataFrame:
    """WIN-08: last row per key by a sequence column (rows of the same sequence value: the largest one by its other columns). One
    aggregate, combined before the shuffle, so a hot key is one row per task."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(sequence_col, *[c for c in rest if c != sequence_col])
    g = df.groupBy(*keys).agg(F.max(order).alias("_r"))
    return g.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def zero_crossing_rate(df: DataFrame, keys: Sequence[str], order_value: Column, x: Column,
                       tiebreak: Sequence[str] = (), n_buckets=None) -> DataFrame:
    """WIN-09: mean |Δsign(x)|/2 over the ordered signal per key (first element contributes no pair)."""
    d = df.withColumn("_sg", F.signum(x))
    lagged = lag_within(d, list(keys), order_value, F.col("_sg"), tiebreak=tiebreak, out="_psg", n_buckets=n_buckets)
    return lagged.groupBy(*keys).agg(
        F.avg(F.abs(F.col("_sg") - F.col("_psg")) / 2).alias("zero_crossing_rate"),
        F.count(F.lit(1)).cast("long").alias("n"))


def top_k_per_group(df: DataFrame, keys: Sequence[str], by: Column, k: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """WIN-06: top-k rows per group by ``by`` desc. Groups here are (experiment, seed, fold)
    importance lists — bounded by the feature count."""
    w = Window.partitionBy(*keys).orderBy(by.desc(), *tiebreak)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_contributions(arr_features: Column, arr_values: Column, k: int = 10) -> Column:
    """WIN-05: per row, the k (feature, value) pairs with the largest |value| (array HOFs, no shuffle)."""
    pairs = F.arrays_zip(arr_features.alias("feature"), arr_values.alias("value"))
    keyed = F.transform(pairs, lambda p: F.struct(F.abs(p["value"]).alias("a"), p["feature"].alias("feature"),
                                                  p["value"].alias("value")))
    srt = F.reverse(F.array_sort(keyed))
    return F.transform(F.slice(srt, 1, k), lambda s: F.struct(s["feature"].alias("feature"), s["value"].alias("value")))


def registry_lookup(df: DataFrame, registry: DataFrame, on: str, value_cols: Sequence[str],
                    default: str = "unknown") -> DataFrame:
    """JOI-05: left join a small registry (size checked) and fill unknown keys with a default."""
    j = df.join(registry, on, "left")      # broadcast if its bytes allow it: the planner's threshold
    for c in value_cols:
        j = j.withColumn(c, F.coalesce(F.col(c), F.lit(default)))
    return j


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SNK-02 + JOI-06: rows of ``existing`` whose key is not in ``incoming``, plus ``incoming``."""
    kept = null_safe_join(existing, incoming.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def union_tagged(frames: Sequence[tuple[DataFrame, str]], column: str = "dataset") -> DataFrame:
    """SET-01/02: union by name (missing columns → null), tagging frames lacking ``column``."""
    out = None
    for df, tag in frames:
        if column not in df.columns:
            df = df.withColumn(column, F.lit(tag))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def metric_alignment(long: DataFrame, x_metric: str, y_metric: str, key: str = "framework") -> DataFrame:
    """JOI-04: one row per framework with two metrics side by side (conditional aggregation)."""
    return long.groupBy(key).agg(F.avg(F.when(F.col("metric") == x_metric, F.col("value"))).alias(x_metric),
                                 F.avg(F.when(F.col("metric") == y_metric, F.col("value"))).alias(y_metric)
                                 ).na.drop().orderBy(key)


def label_rank(df: DataFrame, column: str, out: str = "code", n_buckets=None) -> DataFrame:
    """Distinct values with 0-based codes in sorted order (shared by PRJ-12 / SRC-07)."""
    vals = df.select(F.col(column)).where(F.col(column).isNotNull()).distinct()
    return rank_within(vals, [], F.col(column), out=out, n_buckets=n_buckets)

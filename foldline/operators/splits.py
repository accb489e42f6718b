"""Deterministic splits (SPL-*, STX-01/02) as columns, never as positional index arrays.

Randomness is ``md5(seed | id)`` (see ``functions.hashing``), so a fold assignment is a
pure function of the row key: identical on any partitioning, after executor loss and
recomputation, and in the DuckDB oracle. Ranks are computed with the bucketed
``rank_within`` so a large class never lands in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.functions.hashing import h15, uniform
from foldline.functions.ordered import null_safe_join, rank_within, spread

DEFAULT_SEEDS = (42, 77)


def with_seeds(df: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """SPL-03: one copy of every row per seed (explode of a literal array, no join)."""
    return spread(df).withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))


def kfold(df: DataFrame, id_cols: Sequence[str], k: int = 5, seeds: Sequence[int] = (42,),
          n_buckets=None) -> DataFrame:
    """SPL-01 shuffled K-fold: fold = (rank of md5(seed|id)) mod k, per seed."""
    ids = list(id_cols)
    d = with_seeds(df, seeds).withColumn("_h", h15(F.col("seed"), *[F.col(c) for c in ids]))
    r = rank_within(d, ["seed"], F.col("_h"), tiebreak=ids, out="_rk", n_buckets=n_buckets)
    return r.withColumn("fold", (F.col("_rk") % k).cast("int")).drop("_h", "_rk")


def stratified_kfold(df: DataFrame, id_cols: Sequence[str], label: str, k: int = 5,
                     seeds: Sequence[int] = (42,), n_buckets=None) -> DataFrame:
    """SPL-02: classes dealt round-robin in hash order, each class starting where the previous
    (in label order) stopped — fold sizes differ by at most one overall and per class."""
    ids = list(id_cols)
    d = with_seeds(df, seeds).withColumn("_h", h15(F.col("seed"), *[F.col(c) for c in ids]))
    # in the order (label, hash) a row's place is its rank within the class plus the sizes of the classes before: one rank
    r = rank_within(d, ["seed"], F.col(label), tiebreak=["_h", *ids], out="_rk", n_buckets=n_buckets)
    return r.withColumn("fold", (F.col("_rk") % k).cast("int")).drop("_h", "_rk")


def holdout(df: DataFrame, id_cols: Sequence[str], label: str | None = None, test_fraction: float = 0.2,
            seed: int = 42, n_buckets=None) -> DataFrame:
    """SPL-04: ``is_test`` = within-class hash rank < ceil(test_fraction * class size).

    With ``label=None`` (or a single class) the split is over all rows.
    """
    ids = list(id_cols)
    keys = [label] if label else []
    d = df.withColumn("_h", h15(F.lit(seed), *[F.col(c) for c in ids]))
    r = rank_within(d, keys, F.col("_h"), tiebreak=ids, out="_rk", n_buckets=n_buckets)
    if keys:
        n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        r = null_safe_join(r, n, keys)
    else:
        r = r.crossJoin(d.agg(F.count(F.lit(1)).alias("_n")))  # one-row total
    return r.withColumn("is_test", F.col("_rk") < F.ceil(F.col("_n") * test_fraction)).drop("_h", "_rk", "_n")


def bernoulli_split(df: DataFrame, id_cols: Sequence[str], ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """SPL-05: ``is_train`` = uniform(md5(seed|id)) < ratio (no shuffle at all)."""
    return df.withColumn("is_train", uniform(F.lit(seed), *[F.col(c) for c in id_cols]) < F.lit(ratio))


def needs_holdout_fallback(df: DataFrame, label: str, k: int = 5) -> bool:
    """SPL-06: smallest class has fewer than k rows → fall back from K-fold to holdout."""
    m = df.groupBy(label).count().agg(F.min("count")).first()[0]
    return m is None or m < k


def sample_n(df: DataFrame, id_cols: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """SPL-07: deterministic n-row sample (top-n by md5(seed|id); TakeOrderedAndProject)."""
    ids = list(id_cols)
    return df.withColumn("_h", h15(F.lit(seed), *[F.col(c) for c in ids])).orderBy("_h", *ids).limit(n).drop("_h")


def group_kfold(df: DataFrame, group: str, k: int = 5, seed: int = 42, n_buckets=None) -> DataFrame:
    """STX-01: whole groups per fold. Groups ranked by (size desc, hash) are dealt in snake order
    (0..k-1, k-1..0, ...) so large groups spread evenly; every row of a group shares its fold."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", h15(F.lit(seed), F.col(group)))
    r = rank_within(sizes, [], -F.col("_n"), tiebreak=["_h", group], out="_rk", n_buckets=n_buckets)
    pos = F.col("_rk") % (2 * k)
    fold = F.when(pos < k, pos).otherwise(2 * k - 1 - pos).cast("int")
    g = r.select(group, fold.alias("fold"))
    return null_safe_join(df, g, [group])


def time_series_split(df: DataFrame, order_col: str, tiebreak: Sequence[str] = (), n_splits: int = 5,
                      n_buckets=None) -> DataFrame:
    """STX-02: expanding-window splits. Output adds ``split`` and ``role`` ('train'/'test').

    As in the usual definition, test blocks have size n // (n_splits + 1) and end at the
    last row; all earlier rows train.
    """
    r = rank_within(df, [], F.col(order_col), tiebreak=list(tiebreak), out="_rk", n_buckets=n_buckets)
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    r = r.crossJoin(n)  # one-row total
    ts = F.floor(F.col("_n") / (n_splits + 1))
    splits = F.sequence(F.lit(0), F.lit(n_splits - 1))

    def start(i):
        return F.col("_n") - (F.lit(n_splits) - i) * ts

    roles = F.transform(splits, lambda i: F.struct(
        i.alias("split"),
        F.when(F.col("_rk") < start(i), "train").when(F.col("_rk") < start(i) + ts, "test").alias("role")))
    out = r.withColumn("_s", F.explode(F.filter(roles, lambda s: s["role"].isNotNull())))
    return out.withColumn("split", F.col("_s.split")).withColumn("role", F.col("_s.role")).drop("_s", "_rk", "_n")

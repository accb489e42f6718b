"""Fold-safe feature statistics and transforms (FEA-*, STX-03/04/09).

Every statistic is fitted on the *training* rows of each fold (all rows whose fold is
not g) and applied to the held-out rows of fold g. Additive statistics never rescan:

* count / mean / population variance are computed once per fold and merged across the
  other folds with the parallel (Chan) update — a table of k × columns rows;
* category counts per fold give training counts as a sum over the other folds;
* only order statistics (medians, quantile edges) need the training rows themselves:
  each row is exploded to the k-1 training sets it belongs to and ranked with the
  bucketed, exact ``exact_percentiles`` (or ``percentile_approx`` when ``approx=True``).

Fitted tables are tiny (folds × columns × bins) and are joined back by fold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.functions.names import safe_col
from foldline.functions.ordered import order_statistics, spread

MAX_CATEGORIES = 10000
RARE_TOKEN = "__rare__"


def _long(df: DataFrame, fold_col: str, columns: Sequence[str], as_string: bool = False) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"),
                                 (F.col(c).cast("string") if as_string else F.col(c).cast("double")).alias("value"))
                        for c in columns])
    src = spread(df.select(fold_col, *columns))
    return src.select(F.col(fold_col).alias("_f"), F.explode(entries).alias("_e")).select(
        "_f", "_e.column_name", "_e.value")


def _to_training_sets(df: DataFrame, fold: Column, k: int) -> Column:
    """Folds g != own fold: the training sets this row belongs to."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda g: g != fold))


def training_moments(df: DataFrame, fold_col: str, columns: Sequence[str], k: int) -> DataFrame:
    """``fold, column_name, n, mean, std`` (population std) of each fold's training rows (FEA-01/03/04)."""
    long = _long(df, fold_col, columns).where(F.col("value").isNotNull() & ~F.isnan("value"))
    per = long.groupBy("_f", "column_name").agg(F.count("value").alias("n_f"), F.avg("value").alias("m_f"),
                                                 (F.var_pop("value") * F.count("value")).alias("q_f"))
    ex = per.select("column_name", "n_f", "m_f", "q_f", _to_training_sets(per, F.col("_f"), k).alias("fold"))
    first = ex.groupBy("fold", "column_name").agg(F.sum("n_f").alias("n"),
                                                  (F.sum(F.col("n_f") * F.col("m_f")) / F.sum("n_f")).alias("mean"))
    j = ex.join(first, ["fold", "column_name"])
    m2 = j.groupBy("fold", "column_name").agg(
        F.sum(F.col("q_f") + F.col("n_f") * F.pow(F.col("m_f") - F.col("mean"), 2)).alias("_m2"))
    out = first.join(m2, ["fold", "column_name"])
    return out.select(F.col("fold").cast("int").alias("fold"), "column_name", F.col("n").cast("long").alias("n"),
                      "mean", F.sqrt(F.col("_m2") / F.col("n")).alias("std"))


def training_quantiles(df: DataFrame, fold_col: str, columns: Sequence[str], k: int, probs: Sequence[float],
                       n_buckets=None) -> DataFrame:
    """``fold, column_name, q_0 …`` exact (linear-interpolation) quantiles of each fold's training rows.

    No row is copied into the k − 1 training sets: values are counted once per (column, value)
    with one count column per fold (map-side combined), training counts are sums over the other
    folds, and each order statistic is the smallest value whose cumulative training count
    reaches its rank (bucketed cumulative sums over the distinct values).
    """
    long = _long(df, fold_col, columns).where(F.col("value").isNotNull() & ~F.isnan("value"))
    cnt = long.groupBy("column_name", "value").agg(
        *[F.sum(F.when(F.col("_f") == g, 1).otherwise(0)).alias(f"_c{g}") for g in range(k)])
    tot = cnt.groupBy("column_name").agg(*[F.sum(f"_c{g}").alias(f"_n{g}") for g in range(k)])
    count_cols = {f"t{g}": sum((F.col(f"_c{f}") for f in range(k) if f != g), F.lit(0)) for g in range(k)}
    tcols, pcols, ranks = [], [], {}
    for g in range(k):
        n_tr = sum((F.col(f"_n{f}") for f in range(k) if f != g), F.lit(0))
        for i, p in enumerate(probs):
            pos = (n_tr - 1) * F.lit(float(p))
            tcols += [F.floor(pos).cast("long").alias(f"_lo_{g}_{i}"), F.ceil(pos).cast("long").alias(f"_hi_{g}_{i}")]
            pcols.append(pos.alias(f"_pos_{g}_{i}"))
            ranks[f"_lo_{g}_{i}"] = f"t{g}"
            ranks[f"_hi_{g}_{i}"] = f"t{g}"
    targets = tot.select("column_name", *tcols)
    st = order_statistics(cnt, ["column_name"], "value", count_cols, targets, ranks, n_buckets=n_buckets)
    st = st.join(tot.select("column_name", *pcols), "column_name")
    rows = []
    for g in range(k):
        qs = []
        for i in range(len(probs)):
            lo, hi, pos = F.col(f"_lo_{g}_{i}"), F.col(f"_hi_{g}_{i}"), F.col(f"_pos_{g}_{i}")
            qs.append((lo + (pos - F.floor(pos)) * (hi - lo)).alias(f"q_{i}"))
        rows.append(F.struct(F.lit(g).alias("fold"), *qs))
    return st.select("column_name", F.explode(F.array(*rows)).alias("_r")).select(
        F.col("_r.fold").cast("int").alias("fold"), "column_name", *[f"_r.q_{i}" for i in range(len(probs))])


def training_medians(df: DataFrame, fold_col: str, columns: Sequence[str], k: int, approx: bool = False,
                     n_buckets=None) -> DataFrame:
    """``fold, column_name, median`` of each fold's training rows (exact by default)."""
    if approx:
        long = _long(df, fold_col, columns).where(F.col("value").isNotNull() & ~F.isnan("value"))
        ex = long.select("column_name", "value", _to_training_sets(long, F.col("_f"), k).alias("fold"))
        return ex.groupBy("fold", "column_name").agg(F.percentile_approx("value", 0.5, 100000).alias("median"))
    q = training_quantiles(df, fold_col, columns, k, [0.5], n_buckets=n_buckets)
    return q.select("fold", "column_name", F.col("q_0").alias("median"))


def training_modes(df: DataFrame, fold_col: str, columns: Sequence[str], k: int) -> DataFrame:
    """FEA-02: ``fold, column_name, mode`` — most frequent training value, ties → smallest value."""
    long = _long(df, fold_col, columns, as_string=True).where(F.col("value").isNotNull())
    cnt = long.groupBy("_f", "column_name", "value").agg(F.count(F.lit(1)).alias("c"))
    ex = cnt.select("column_name", "value", "c", _to_training_sets(cnt, F.col("_f"), k).alias("fold"))
    tot = ex.groupBy("fold", "column_name", "value").agg(F.sum("c").alias("c"))
    return tot.groupBy("fold", "column_name").agg(
        F.min_by("value", F.struct((-F.col("c")).alias("nc"), F.col("value").alias("v"))).alias("mode")).select(
        F.col("fold").cast("int").alias("fold"), "column_name", "mode")


def _wide(stats: DataFrame, value: str, columns: Sequence[str], prefix: str) -> DataFrame:
    """fold-keyed wide table ``fold, {prefix}{col}`` from a long (fold, column_name, value) table."""
    return stats.groupBy("fold").agg(*[F.max(F.when(F.col("column_name") == c, F.col(value))).alias(f"{prefix}{c}")
                                       for c in columns])


def impute(df: DataFrame, fold_col: str, columns: Sequence[str], stats: DataFrame, value: str) -> DataFrame:
    """Fill nulls/NaN of ``columns`` with the row's fold statistic (small table, joined by fold)."""
    w = _wide(stats, value, columns, "_imp_").withColumnRenamed("fold", "_wf")
    j = df.join(F.broadcast(w), F.col(fold_col) == F.col("_wf"), "left").drop("_wf")
    for c in columns:
        x = F.col(c)
        j = j.withColumn(c, F.when(x.isNull() | F.isnan(x), F.col(f"_imp_{c}")).otherwise(x))
    return j.drop(*[f"_imp_{c}" for c in columns])


def scale(df: DataFrame, fold_col: str, columns: Sequence[str], moments: DataFrame, center: bool = True,
          suffix: str = "") -> DataFrame:
    """FEA-03/04: (x − mean)/std with the fold's training moments; std 0 → 1 (no centring if center=False)."""
    mw = _wide(moments, "mean", columns, "_mu_")
    sw = _wide(moments, "std", columns, "_sd_")
    w = mw.join(sw, "fold").withColumnRenamed("fold", "_wf")
    j = df.join(F.broadcast(w), F.col(fold_col) == F.col("_wf"), "left").drop("_wf")
    for c in columns:
        sd = F.when((F.col(f"_sd_{c}") == 0) | F.col(f"_sd_{c}").isNull(), F.lit(1.0)).otherwise(F.col(f"_sd_{c}"))
        num = (F.col(c) - F.col(f"_mu_{c}")) if center else F.col(c)
        j = j.withColumn(c + suffix, num / sd)
    return j.drop(*[f"_mu_{c}" for c in columns], *[f"_sd_{c}" for c in columns])


def quantile_edges(df: DataFrame, fold_col: str, column: str, k: int, n_bins: int = 5,
                   n_buckets=None) -> DataFrame:
    """FEA-06 quantile strategy: ``fold, edges`` (exact training percentiles at 0, 1/n, …, 1;
    edges closer than 1e-8 to the previous one are dropped)."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    q = training_quantiles(df, fold_col, [column], k, probs, n_buckets=n_buckets)
    arr = F.array(*[F.col(f"q_{i}") for i in range(n_bins + 1)])
    kept = F.filter(arr, lambda e, i: F.when(i == 0, F.lit(True)).otherwise(
        e - F.element_at(arr, F.greatest(i, F.lit(1))) > 1e-8))
    return q.select(F.col("fold").cast("int").alias("fold"), kept.alias("edges"))


def uniform_edges(df: DataFrame, fold_col: str, column: str, k: int, n_bins: int = 5) -> DataFrame:
    """FEA-06 uniform strategy: ``fold, edges`` = training min + i·(max − min)/n_bins."""
    per = df.groupBy(F.col(fold_col).alias("_f")).agg(F.min(column).alias("mn"), F.max(column).alias("mx"))
    ex = per.select("mn", "mx", _to_training_sets(per, F.col("_f"), k).alias("fold"))
    mm = ex.groupBy("fold").agg(F.min("mn").cast("double").alias("mn"), F.max("mx").cast("double").alias("mx"))
    step = (F.col("mx") - F.col("mn")) / n_bins
    edges = F.array(*[F.col("mn") + F.lit(i) * step for i in range(n_bins)], F.col("mx"))
    return mm.select(F.col("fold").cast("int").alias("fold"), edges.alias("edges"))


def kmeans_edges_all(df: DataFrame, fold_col: str, columns: Sequence[str], k: int, n_bins: int = 5,
                     max_iter: int = 300) -> dict[tuple[int, str], list[float]]:
    """FEA-06 k-means strategy: ``(fold, column) → edges`` of each fold's training rows, all columns and folds together.

    Exact weighted 1-D k-means over value counts: centres start at the middles of uniform bins, and one aggregate
    over the counts per step moves all of them until none moves (``max_iter`` steps at most). A value in the middle
    of two centres belongs to the lower one; a centre without values stays. Edges are the training minimum, the
    middles of neighbouring centres and the training maximum; folds without training values have none.
    """
    from foldline.session import checkpoint_dir
    spark = df.sparkSession
    checkpoint_dir(spark)
    long = _long(df, fold_col, columns).where(F.col("value").isNotNull() & ~F.isnan("value"))
    per = [F.count(F.when(F.col("_f") != g, 1)) for g in range(k)]
    counts = long.groupBy("column_name", "value").agg(F.array(*per).alias("w")).checkpoint()   # read once per step
    ext = counts.groupBy("column_name").agg(*[f(F.when(F.col("w")[g] > 0, F.col("value"))).alias(f"{n}{g}")
                                              for g in range(k) for n, f in (("a", F.min), ("b", F.max))]).collect()
    span = {(g, r["column_name"]): (r[f"a{g}"], r[f"b{g}"]) for r in ext for g in range(k) if r[f"a{g}"] is not None}
    centres = {x: [lo + (2 * i + 1) * (hi - lo) / (2 * n_bins) for i in range(n_bins)] for x, (lo, hi) in span.items()}
    middles = lambda c: [(a + b) / 2 for a, b in zip(c[:-1], c[1:])]
    moving = set(centres)
    for _ in range(max_iter):
        if not moving:
            break
        now = spark.createDataFrame([(c, g, middles(centres[g, c])) for g, c in sorted(moving)],
                                    "column_name string, fold int, mids array<double>")
        j = counts.join(F.broadcast(now), "column_name")              # columns x folds rows
        w = F.element_at("w", F.col("fold") + 1)
        at = F.size(F.filter("mids", lambda m: m < F.col("value")))
        got = j.groupBy("column_name", "fold", at.alias("i")).agg(F.sum(w).alias("n"), F.sum(w * F.col("value")).alias("s"))
        after = {x: list(centres[x]) for x in moving}
        for r in got.where("n > 0").collect():
            after[r["fold"], r["column_name"]][r["i"]] = r["s"] / r["n"]
        moving = {x for x in moving if after[x] != centres[x]}
        centres.update(after)
    return {x: [span[x][0], *middles(sorted(c)), span[x][1]] for x, c in centres.items()}


def kmeans_edges(df: DataFrame, fold_col: str, column: str, k: int, n_bins: int = 5) -> DataFrame:
    """``fold, edges`` of one column (see :func:`kmeans_edges_all`)."""
    found = kmeans_edges_all(df, fold_col, [column], k, n_bins)
    return df.sparkSession.createDataFrame([(g, e) for (g, _), e in sorted(found.items())], "fold int, edges array<double>")


def apply_bins(df: DataFrame, fold_col: str, column: str, edges: DataFrame, out: str,
               one_hot: bool = False, n_bins: int | None = None) -> DataFrame:
    """FEA-06/07: bin = number of inner edges <= x (searchsorted right), ordinal or one-hot."""
    e = edges.withColumnRenamed("edges", "_edges").withColumnRenamed("fold", "_ef")
    j = df.join(F.broadcast(e), F.col(fold_col) == F.col("_ef"), "left").drop("_ef")
    x = F.col(column).cast("double")
    inner = F.slice(F.col("_edges"), 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    b = F.when(x.isNull(), F.lit(None)).otherwise(F.size(F.filter(inner, lambda v: v <= x)))
    j = j.withColumn(out, b.cast("int")).drop("_edges")
    if one_hot:
        for i in range(n_bins or 0):
            j = j.withColumn(f"{out}_{i}", (F.col(out) == i).cast("double"))
        j = j.drop(out)
    return j


def training_categories(df: DataFrame, fold_col: str, columns: Sequence[str], k: int,
                        max_categories: int = MAX_CATEGORIES) -> dict[int, dict[str, list[str]]]:
    """Sorted training categories per fold and column (collected: size checked first)."""
    long = _long(df, fold_col, columns, as_string=True).where(F.col("value").isNotNull())
    cats = long.select("_f", "column_name", "value").distinct()
    ex = cats.select("column_name", "value", _to_training_sets(cats, F.col("_f"), k).alias("fold")).distinct()
    n = ex.limit(max_categories + 1).count()
    if n > max_categories:
        raise ValueError("too many categories for one-hot encoding; use frequency or target encoding")
    out: dict[int, dict[str, list[str]]] = {}
    for r in ex.collect():
        out.setdefault(r["fold"], {}).setdefault(r["column_name"], []).append(r["value"])
    for f in out.values():
        for c in f:
            f[c].sort()
    return out


def indicator_names(pairs: Sequence[tuple[str, str]], taken: Sequence[str]) -> dict[tuple[str, str], str]:
    """A clean name for each (column, category), numbered where cleaning makes names meet each other or ``taken``."""
    used, out = set(taken), {}
    for c, v in pairs:
        base = name = safe_col(f"{c}_{v}")
        i = 2
        while name in used:
            name, i = f"{base}_{i}", i + 1
        used.add(name)
        out[(c, v)] = name
    return out


def one_hot(df: DataFrame, fold_col: str, columns: Sequence[str], categories: dict[int, dict[str, list[str]]],
            drop_original: bool = True) -> DataFrame:
    """FEA-08: one indicator per training category (all kept); unseen values → all zeros."""
    pairs = [(c, v) for c in columns for v in sorted({v for f in categories.values() for v in f.get(c, [])})]
    added = {}
    for (c, v), name in indicator_names(pairs, df.columns).items():
        known = [f for f, cols in categories.items() if v in cols.get(c, [])]
        added[name] = F.when(F.col(fold_col).isin(known) & (F.col(c).cast("string") == v), 1.0).otherwise(0.0)
    out = df.withColumns(added) if added else df
    return out.drop(*columns) if drop_original else out


def polynomial2(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """FEA-05 (degree 2, no bias): x_i, then x_i·x_j for i <= j, in the usual generated order."""
    cols = list(columns)
    exprs = [F.col(c).alias(c) for c in cols]
    for i, a in enumerate(cols):
        for b in cols[i:]:
            name = safe_col(f"{a}^2") if a == b else safe_col(f"{a} {b}")
            exprs.append((F.col(a) * F.col(b)).alias(name))
    return df.select(*keep, *exprs)


def gramian(df: DataFrame, columns: Sequence[str], normalise: bool = True) -> DataFrame:
    """FEA-09 first step: one pass of ``sum(x_i·x_j)`` (÷ n when normalised), long form."""
    cols = list(columns)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    aggs = [F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    stack = F.array(*[F.struct(F.lit(a).alias("col_i"), F.lit(b).alias("col_j"),
                               (F.col(f"{i}") / (F.col("_n") if normalise else F.lit(1.0))).alias("value"))
                      for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(stack).alias("_s")).select("_s.*")


def vif_filter(df: DataFrame, columns: Sequence[str], threshold: float = 8.0) -> tuple[list[str], list[dict]]:
    """FEA-09: repeatedly drop the feature with the largest VIF above ``threshold`` (keep ≥ 1).

    One Spark pass builds the p×p Gramian; the loop runs on that small matrix on the driver:
    VIF_i = G_ii · (G⁻¹)_ii (uncentred R², as when no constant column is present). A singular
    Gramian drops the first feature involved in the dependency.
    """
    cols = list(columns)
    g = {(r["col_i"], r["col_j"]): r["value"] for r in gramian(df, cols).collect()}
    G = np.array([[g.get((a, b), g.get((b, a))) for b in cols] for a in cols], dtype=float)
    keep = list(range(len(cols)))
    history = []
    while len(keep) > 1:
        sub = G[np.ix_(keep, keep)]
        try:
            inv = np.linalg.inv(sub)
            vifs = np.diag(sub) * np.diag(inv)
        except np.linalg.LinAlgError:
            vifs = np.full(len(keep), math.inf)
        worst = int(np.argmax(vifs))
        history.append({cols[i]: float(v) for i, v in zip(keep, vifs)})
        if not vifs[worst] > threshold:
            break
        keep.pop(worst)
    return [cols[i] for i in keep], history


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """FEA-12: balanced weights n / (k · n_c) per class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = c.agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return c.crossJoin(tot).select(label, F.col("n").cast("long").alias("n"),
                                   (F.col("_n") / (F.col("_k") * F.col("n"))).alias("weight"))  # tot: one row


def frequency_encoding(df: DataFrame, fold_col: str, column: str, k: int) -> DataFrame:
    """STX-03: ``fold, value, freq`` = training count / training rows."""
    cnt = df.groupBy(F.col(fold_col).alias("_f"), F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    ex = cnt.select("value", "c", _to_training_sets(cnt, F.col("_f"), k).alias("fold"))
    per = ex.groupBy("fold", "value").agg(F.sum("c").alias("c"))
    tot = ex.groupBy("fold").agg(F.sum("c").alias("n"))
    return per.join(tot, "fold").select(F.col("fold").cast("int").alias("fold"), "value",
                                        (F.col("c") / F.col("n")).alias("freq"))


def target_encoding(df: DataFrame, fold_col: str, column: str, target: Column, k: int) -> DataFrame:
    """STX-03 out-of-fold target mean: ``fold, value, n, encoding`` with training = total − fold."""
    per = df.groupBy(F.col(fold_col).alias("_f"), F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("c"), F.sum(target.cast("double")).alias("s"))
    ex = per.select("value", "c", "s", _to_training_sets(per, F.col("_f"), k).alias("fold"))
    g = ex.groupBy("fold", "value").agg(F.sum("c").alias("n"), F.sum("s").alias("s"))
    return g.select(F.col("fold").cast("int").alias("fold"), "value", F.col("n").cast("long").alias("n"),
                    (F.col("s") / F.col("n")).alias("encoding"))


def rare_bucket(df: DataFrame, fold_col: str, column: str, k: int, min_count: int, out: str) -> DataFrame:
    """STX-03: values seen fewer than ``min_count`` times in the fold's training rows → '__rare__'."""
    cnt = df.groupBy(F.col(fold_col).alias("_f"), F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("c"))
    ex = cnt.select("_v", "c", _to_training_sets(cnt, F.col("_f"), k).alias("_g"))
    tr = ex.groupBy("_g", "_v").agg(F.sum("c").alias("_tc"))
    j = df.join(tr, (df[fold_col] == tr["_g"]) & (df[column] == tr["_v"]), "left")
    val = F.when(F.coalesce(F.col("_tc"), F.lit(0)) < min_count, F.lit(RARE_TOKEN)).otherwise(
        F.col(column).cast("string"))
    return j.withColumn(out, val).drop("_g", "_v", "_tc")


def calendar_features(ts: Column, prefix: str) -> list[Column]:
    """STX-04: month, day of week (1 = Sunday), hour and their cyclic sin/cos encodings."""
    m = F.month(ts)
    d = F.dayofweek(ts)
    h = F.hour(ts)
    two_pi = 2 * math.pi
    return [m.alias(f"{prefix}_month"), d.alias(f"{prefix}_dow"), h.alias(f"{prefix}_hour"),
            F.sin(two_pi * (m - 1) / 12).alias(f"{prefix}_month_sin"),
            F.cos(two_pi * (m - 1) / 12).alias(f"{prefix}_month_cos"),
            F.sin(two_pi * (d - 1) / 7).alias(f"{prefix}_dow_sin"),
            F.cos(two_pi * (d - 1) / 7).alias(f"{prefix}_dow_cos")]


def mutual_information(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """STX-09: ``feature, mutual_info`` (nats) from joint and marginal counts, one shuffle."""
    long = df.select(F.col(target).cast("string").alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("x")) for c in features])).alias("_e")
    ).select("_e.feature", "_e.x", "_y")
    joint = long.groupBy("feature", "x", "_y").agg(F.count(F.lit(1)).alias("nxy"))
    px = joint.groupBy("feature", "x").agg(F.sum("nxy").alias("nx"))
    py = joint.groupBy("feature", "_y").agg(F.sum("nxy").alias("ny"))
    n = joint.groupBy("feature").agg(F.sum("nxy").alias("n"))
    j = joint.join(px, ["feature", "x"]).join(py, ["feature", "_y"]).join(n, "feature")
    term = (F.col("nxy") / F.col("n")) * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return j.groupBy("feature").agg(F.sum(term).alias("mutual_info"))

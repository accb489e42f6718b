"""Model-agnostic attributions as Spark jobs (EXP-01..05, AGG-16, WIN-05).

* linear models: exact attributions coef · (x − mean) — a projection, no model calls;
* any Spark ML model: Monte-Carlo Shapley values — rows × permutations × (p + 1) hybrid
  points are exploded, scored with **one** ``model.transform``, and marginal
  contributions are differences of consecutive points (``lag`` within a permutation);
* LIME-style local surrogates: perturbations exploded per row, scored once, weighted
  normal equations accumulated with ``groupBy(row)`` and solved per row in pandas.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldline.functions.hashing import h15, uniform
from foldline.operators.reports import top_contributions
from foldline.operators.splits import sample_n

BACKGROUND = 100          # background rows of a coalition's mean (a sample by hash)
COALITIONS = 2048         # beyond 2 p, when not all subsets of the features fit


def linear_attributions(df: DataFrame, key: Sequence[str], features: Sequence[str],
                        coefficients: dict[str, float], means: dict[str, float]) -> DataFrame:
    """``key…, feature, value`` with value = coef · (x − mean) (long form)."""
    arr = F.array(*[F.struct(F.lit(f).alias("feature"),
                             (F.lit(coefficients[f]) * (F.col(f).cast("double") - F.lit(means[f]))).alias("value"))
                    for f in features])
    return df.select(*key, F.explode(arr).alias("_a")).select(*key, "_a.feature", "_a.value")


def global_importance(attr: DataFrame) -> DataFrame:
    """AGG-16 / EXP-01: ``feature, mean_abs_attribution``."""
    return attr.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs_attribution"))


def sample_details(attr: DataFrame, key: str, k: int = 10, keep: Sequence[str] = ("prediction", "expected_value", "predicted_class")) -> DataFrame:
    """EXP-05 + WIN-05: per explained row what ``attr`` says about it (``keep``) and its top-k contributions by |value|."""
    keep = [c for c in keep if c in attr.columns]
    per = attr.groupBy(key).agg(F.collect_list("feature").alias("_f"), F.collect_list("value").alias("_v"), *[F.first(c).alias(c) for c in keep])
    return per.select(key, *keep, top_contributions(F.col("_f"), F.col("_v"), k).alias("top_contributions"))


def coalitions(p: int, limit: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Subsets of p features (neither none nor all) as 0/1 rows and their Shapley kernel weights: all of them if they are at
    most ``limit``, else ``limit / 2`` drawn ones by weight together with their complements, equally weighted."""
    if p <= 1:
        return np.ones((0, p)), np.ones(0)
    if 2 ** p - 2 <= limit:
        z = ((np.arange(1, 2 ** p - 1)[:, None] >> np.arange(p)) & 1).astype(float)
        s = z.sum(axis=1).astype(int)
        return z, np.array([(p - 1) / (math.comb(p, k) * k * (p - k)) for k in s])
    rng = np.random.default_rng(seed)
    sizes = np.arange(1, p)
    share = 1.0 / (sizes * (p - sizes))
    z = np.zeros((limit // 2, p))
    for row, k in zip(z, rng.choice(sizes, len(z), p=share / share.sum())):
        row[rng.choice(p, k, replace=False)] = 1.0
    z = np.concatenate([z, 1 - z])
    return z, np.ones(len(z)) / len(z)


def kernel_shapley(model, df: DataFrame, key: str, features: Sequence[str], background: DataFrame, output: str = "probability",
                   index: int = 1, n_background: int = BACKGROUND, n_coalitions: int | None = None, seed: int = 42) -> DataFrame:
    """EXP-02/03: ``key, feature, value, prediction, expected_value, predicted_class`` by coalition-weighted least squares.

    A coalition's worth is the model's mean over the background with the coalition's features taken from the row. One
    ``transform`` scores rows x coalitions x background, and the right-hand side of every row's weighted least squares is a sum,
    so it is added up in Spark (combined before the shuffle) and solved with the inverse Gram matrix, which all rows share.
    Values add up to prediction - expected value. They are exact when all subsets are used (up to 11 features), and for
    additive models always.
    """
    feats, spark = list(features), df.sparkSession
    p = len(feats)
    z, w = coalitions(p, n_coalitions or 2 * p + COALITIONS, seed)
    gram = np.linalg.inv((z * w[:, None]).T @ z + 1e-12 * np.eye(p)) if len(z) else np.ones((1, 1))
    out = vector_to_array(output)[index] if output in ("probability", "rawPrediction") else F.col(output)
    assemble = lambda cols: VectorAssembler(inputCols=cols, outputCol="features")
    bg = sample_n(background.select(*feats), feats, n_background, seed).select(*[F.col(f).cast("double").alias(f"_b_{f}") for f in feats])
    bg = bg.withColumn("_bi", F.row_number().over(Window.orderBy(*bg.columns)) - 1).cache()       # n_background rows
    nb = bg.count()
    expected = model.transform(assemble([f"_b_{f}" for f in feats]).transform(bg)).agg(F.avg(out.cast("double"))).first()[0]
    rows = df.select(key, *[F.col(f).cast("double").alias(f) for f in feats])
    scored = model.transform(assemble(feats).transform(rows))
    kept = [out.cast("double").alias("prediction")] + ([F.col("prediction").alias("predicted_class")] if output != "prediction" else [])
    whole = scored.select(key, *kept)
    table = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(z, w))],
                                  "_ci int, " + ", ".join(f"_z_{f} double" for f in feats) + ", _w double")
    pts = rows.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(max(len(z) * nb - 1, 0)))))
    pts = pts.withColumn("_ci", F.expr(f"int(_at div {nb})")).withColumn("_bi", (F.col("_at") % nb).cast("int"))
    pts = pts.join(F.broadcast(table), "_ci").join(F.broadcast(bg), "_bi")                # n_coalitions and n_background rows
    mixed = [F.when(F.col(f"_z_{f}") > 0, F.col(f)).otherwise(F.col(f"_b_{f}")).alias(f"_x_{f}") for f in feats]
    pts = pts.select(key, "_w", *[f"_z_{f}" for f in feats], *mixed)
    y = model.transform(assemble([f"_x_{f}" for f in feats]).transform(pts)).withColumn("_y", (out.cast("double") - expected) / nb)
    sums = y.groupBy(key).agg(*[F.sum(F.col("_w") * F.col(f"_z_{f}") * F.col("_y")).alias(f"_s_{i}") for i, f in enumerate(feats)])
    j = whole.join(sums, key, "left") if len(z) else whole.withColumn("_s_0", F.lit(0.0))
    gap = F.col("prediction") - F.lit(expected)
    free = [sum((F.lit(float(gram[i, k])) * F.coalesce(F.col(f"_s_{k}"), F.lit(0.0)) for k in range(p)), F.lit(0.0)) for i in range(p)]
    j = j.withColumn("_free", F.array(*free)).withColumn("_gap", gap)
    miss = (F.aggregate("_free", F.lit(0.0), lambda a, v: a + v) - F.col("_gap")) / F.lit(float(gram.sum()))
    per = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col("_free")[i] - F.lit(float(gram[i].sum())) * F.col("_miss")).alias("value"))
                    for i, f in enumerate(feats)])
    j = j.withColumn("_miss", miss).withColumn("expected_value", F.lit(expected)).withColumn("_a", F.explode(per))
    return j.select(key, "_a.feature", "_a.value", "prediction", "expected_value", *(["predicted_class"] if output != "prediction" else []))


def monte_carlo_shapley(model, df: DataFrame, key: str, features: Sequence[str], background: DataFrame,
                        n_perm: int = 10, seed: int = 42, output: str = "probability", index: int = 1,
                        n_background: int = 10_000) -> DataFrame:
    """EXP-02 (and EXP-03 for tree models): ``key, feature, shapley`` for any fitted Spark ML model.

    UDF-05: the model's ``transform`` plays the reference's ``predict_fn`` on the exploded frame.

    For each explained row and permutation π a background row b is drawn (hashed); points
    z_0 = b, z_j = z_{j−1} with feature π_j taken from x. One ``transform`` scores all points;
    the contribution of π_j is f(z_j) − f(z_{j−1}). Averaged over permutations.
    """
    feats = list(features)
    p = len(feats)
    # at most n_background rows, so one ordered window and a broadcast are safe
    bg = sample_n(background.select(*feats), feats, n_background, seed).withColumn("_bi", F.row_number().over(Window.orderBy(*feats)) - 1)
    nb = bg.count()
    rows = df.select(key, *feats)
    perm = rows.withColumn("_perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    perm = perm.withColumn("_bi", (h15(F.lit(seed), F.col(key), F.col("_perm")) % nb).cast("int"))
    bgr = bg.select("_bi", *[F.col(f).alias(f"_b_{f}") for f in feats])
    perm = perm.join(F.broadcast(bgr), "_bi")
    # order of features in the permutation: sort by a hashed draw per (row, perm, feature)
    order = F.array_sort(F.array(*[F.struct(uniform(F.lit(seed), F.col(key), F.col("_perm"), F.lit(i)).alias("u"),
                                            F.lit(i).alias("i")) for i in range(p)]))
    perm = perm.withColumn("_order", F.transform(order, lambda s: s["i"]))
    pts = perm.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(p))))
    for i, f in enumerate(feats):
        # feature i is switched to x once its position in the permutation is < step
        pos = F.array_position(F.col("_order"), F.lit(i)) - 1
        pts = pts.withColumn(f"_z_{f}", F.when(pos < F.col("_step"), F.col(f)).otherwise(F.col(f"_b_{f}")))
    va = VectorAssembler(inputCols=[f"_z_{f}" for f in feats], outputCol="features")
    scored = model.transform(va.transform(pts))
    out = vector_to_array(output)[index] if output in ("probability", "rawPrediction") else F.col(output)
    scored = scored.select(key, "_perm", "_step", "_order", out.cast("double").alias("_y"))
    w = Window.partitionBy(key, "_perm").orderBy("_step")  # p + 1 rows per group: bounded
    d = scored.withColumn("_dy", F.col("_y") - F.lag("_y").over(w)).where(F.col("_step") > 0)
    d = d.withColumn("feature_idx", F.element_at("_order", F.col("_step").cast("int")))
    names = F.array(*[F.lit(f) for f in feats])
    return d.groupBy(key, "feature_idx").agg(F.avg("_dy").alias("shapley")).select(
        key, F.element_at(names, F.col("feature_idx") + 1).alias("feature"), "shapley")


def lime(model, df: DataFrame, key: str, features: Sequence[str], n_samples: int = 200, kernel_width: float = 0.75,
         seed: int = 42, output: str = "probability", index: int = 1, k: int = 10) -> DataFrame:
    """EXP-04: per row a proximity-weighted linear surrogate; ``key, attribution`` top-k (feature, weight)."""
    feats = list(features)
    p = len(feats)
    sd = df.agg(*[F.stddev_pop(f).alias(f) for f in feats]).first()
    rows = df.select(key, *feats).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    # Gaussian-like perturbation from two hashed uniforms (Box–Muller), scaled by the feature std
    for i, f in enumerate(feats):
        u1 = F.greatest(uniform(F.lit(seed), F.col(key), F.col("_s"), F.lit(2 * i)), F.lit(1e-12))
        u2 = uniform(F.lit(seed), F.col(key), F.col("_s"), F.lit(2 * i + 1))
        z = F.sqrt(-2 * F.log(u1)) * F.cos(2 * np.pi * u2)
        rows = rows.withColumn(f"_d_{f}", F.when(F.col("_s") == 0, 0.0).otherwise(z))
        rows = rows.withColumn(f"_p_{f}", F.col(f) + F.col(f"_d_{f}") * F.lit(float(sd[f] or 1.0)))
    dist2 = sum((F.col(f"_d_{f}") * F.col(f"_d_{f}") for f in feats), F.lit(0.0))
    rows = rows.withColumn("_w", F.exp(-dist2 / (kernel_width ** 2 * p)))
    va = VectorAssembler(inputCols=[f"_p_{f}" for f in feats], outputCol="features")
    scored = model.transform(va.transform(rows))
    out = vector_to_array(output)[index] if output in ("probability", "rawPrediction") else F.col(output)
    s = scored.select(key, "_w", out.cast("double").alias("_y"), *[F.col(f"_d_{f}") for f in feats])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        X = np.column_stack([np.ones(len(pdf))] + [pdf[f"_d_{f}"].to_numpy() for f in feats])
        w = pdf["_w"].to_numpy()
        A = X.T @ (X * w[:, None]) + 1e-6 * np.eye(p + 1)
        b = X.T @ (w * pdf["_y"].to_numpy())
        coef = np.linalg.solve(A, b)[1:]
        order = np.argsort(-np.abs(coef))[:k]
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(order), "feature": [feats[i] for i in order],
                             "weight": [float(coef[i]) for i in order]})

    kt = dict(df.dtypes)[key]
    return s.groupBy(key).applyInPandas(solve, f"{key} {kt}, feature string, weight double")


def additive_model_attributions(df: DataFrame, key: str, features: Sequence[str], target: Column) -> DataFrame:
    """Exact attributions of the additive model y ≈ Σ slope_f (x_f − mean_f), computed as Columns.

    Slopes and means are scalar aggregates joined as a one-row frame (no driver round trip).
    """
    aggs = []
    for f in features:
        x = F.col(f).cast("double")
        aggs += [(F.covar_pop(x, target) / F.var_pop(x)).alias(f"s_{f}"), F.avg(x).alias(f"m_{f}")]
    coef = df.agg(*aggs)
    j = df.select(key, *features).crossJoin(coef)  # coef: exactly one row
    arr = F.array(*[F.struct(F.lit(f).alias("feature"),
                             (F.coalesce(F.col(f"s_{f}"), F.lit(0.0)) * (F.col(f).cast("double") - F.col(f"m_{f}"))
                              ).alias("value")) for f in features])
    return j.select(key, F.explode(arr).alias("_a")).select(key, "_a.feature", "_a.value")

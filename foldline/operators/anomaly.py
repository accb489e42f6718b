"""Isolation-forest anomaly scores (ANO-01, WIN-07).

Spark has no isolation forest, so the work is split into Spark-shaped pieces:

1. preprocessing (median imputation, population scaling) as aggregates; a categorical value stays one code: a split on
   an indicator "column = value" is what a split on its one-hot column is, at any number of categories;
2. every tree takes the 256 rows with the smallest hashes of (seed, tree, key), at every table size. Rows whose hash
   exceeds a bound that leaves a few more candidates per tree than needed are dropped in the scan; the bound is widened until
   every tree has its rows, so it never decides the sample;
3. ``groupBy(tree).applyInPandas`` grows the trees in parallel, from rows in hash order;
4. the forest (≤ trees × 511 nodes, bounded by construction) is shipped to the tasks in
   the closure of an Arrow-batched ``mapInPandas`` that scores every row;
5. the flag threshold is the exact 97th percentile of the scores (contamination 3 %).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.functions.ordered import exact_percentiles, rank_within, spread
from foldline.session import checkpoint_dir

N_TREES = 200
SAMPLE = 256
CONTAMINATION = 0.03
SEED = 42
EULER = 0.5772156649


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def prepare_features(df: DataFrame, key: Sequence[str], numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """``key…, x, c``: scaled, median-imputed numbers (array<double>) and one 64-bit code per categorical value (array<long>,
    0 where missing).

    One aggregate gives counts and moments; exact medians are computed only for columns that actually have missing
    values. Statistics are applied as literals.
    """
    df = spread(df.select(*key, *numeric, *categorical))  # the Arrow scoring below is per-partition
    num = list(numeric)
    parts = []
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in num:
        x = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        aggs += [F.count(x).alias(f"n_{c}"), F.avg(x).alias(f"mu_{c}"), F.stddev_pop(x).alias(f"sd_{c}")]
    st = df.agg(*aggs).first()
    missing = [c for c in num if st[f"n_{c}"] < st["_rows"]]
    med = {}
    if missing:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v"))
                                             for c in missing])).alias("e")).select("e.c", "e.v")
        med = {r["c"]: r["m_0"] for r in exact_percentiles(long, ["c"], "v", [0.5], out_prefix="m").collect()}
    for c in num:
        mu, sd = st[f"mu_{c}"] or 0.0, st[f"sd_{c}"] or 1.0
        x = F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(med.get(c, mu)))
        parts.append((x - F.lit(mu)) / F.lit(sd))
    codes = [F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(c), F.col(c).cast("string"))).otherwise(0) for c in categorical]
    none = F.array().cast("array<bigint>")
    return df.select(*[F.col(k) for k in key], (F.array(*parts) if parts else F.array().cast("array<double>")).alias("x"),
                     (F.array(*codes) if codes else none).alias("c"))


def _draw(*parts) -> Column:
    """Fast uniform draw in [0, 1) from xxhash64 (no oracle needs these draws)."""
    h = F.xxhash64(*parts)
    return (F.when(h < 0, -(h + 1)).otherwise(h)).cast("double") / F.lit(9.223372036854776e18)


@contextmanager
def _small_methods(spark):
    """Whole-stage code off for jobs that run inside: hundreds of draws in one method are more than the JVM compiles, while
    code for a single expression is split."""
    name = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _sample(feats: DataFrame, key: Sequence[str], n_trees: int, sample: int, seed: int) -> DataFrame:
    """``tree, u, x, c``: for every tree the ``sample`` rows with the smallest draws (all rows, if there are fewer).

    A tree's draws below ``bound`` number sample + 8 sqrt(sample) on average, so the bound is almost never widened."""
    n = feats.count()
    need = min(sample, n)
    bound = (sample + 8 * math.sqrt(sample)) / max(n, 1)
    while True:
        draw = lambda t: _draw(F.lit(seed), t, *[F.col(k) for k in key])
        mine = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: F.struct(t.alias("tree"), draw(t).alias("u"))),
                        lambda s: s["u"] < min(bound, 1.1))
        # nearly all rows belong to no tree: the least of their draws, compiled, drops them before the lists are made
        least_draw = F.least(*[draw(F.lit(t)) for t in range(n_trees)]) if n_trees > 1 else draw(F.lit(0))
        near = feats.where(least_draw < min(bound, 1.1))
        # about trees x sample rows
        with _small_methods(feats.sparkSession):
            picked = near.withColumn("_m", F.explode(mine)).select(*key, "x", "c", "_m.tree", "_m.u").checkpoint()
        least = picked.groupBy("tree").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("t"), F.min("k").alias("k")).first()
        if bound >= 1 or (least["t"] == n_trees and least["k"] >= need):
            break
        bound *= 2
    r = rank_within(picked, ["tree"], F.col("u"), tiebreak=list(key), out="_rk", n_buckets=1)      # a tree's candidates are bounded
    return r.where(F.col("_rk") < sample).select("tree", "_rk", "x", "c")


def _grow(pdf: pd.DataFrame, max_depth: int, seed: int) -> pd.DataFrame:
    """A node tests ``x[f] < thr`` or, for f beyond the numbers, whether code f - len(x) differs from ``code``; rows
    that pass go left."""
    pdf = pdf.sort_values("_rk")
    tree = int(pdf["tree"].iloc[0])
    X = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1)
    C = np.array(pdf["c"].tolist(), dtype=np.int64).reshape(len(pdf), -1)
    rng = np.random.default_rng(seed * 100003 + tree)
    feat, thr, code, left, right, size = [], [], [], [], [], []

    def node(idx, depth):
        i = len(feat)
        feat.append(-1), thr.append(0.0), code.append(0), left.append(-1), right.append(-1), size.append(len(idx))
        if depth >= max_depth or len(idx) <= 1:
            return i
        sub = X[idx]
        cand = [(int(f), 0) for f in np.flatnonzero(sub.max(axis=0) > sub.min(axis=0))] if X.shape[1] else []
        # indicators of the values that some but not all of these rows have
        for j in range(C.shape[1]):
            values, count = np.unique(C[idx, j], return_counts=True)
            cand += [(X.shape[1] + j, int(v)) for v, k in zip(values, count) if v != 0 and k < len(idx)]
        if not cand:
            return i
        f, v = cand[int(rng.integers(len(cand)))]
        if f < X.shape[1]:
            t = float(rng.uniform(sub[:, f].min(), sub[:, f].max()))
            mask = sub[:, f] < t
        else:
            t, mask = 0.0, C[idx, f - X.shape[1]] != v
        feat[i], thr[i], code[i] = f, t, v
        left[i] = node(idx[mask], depth + 1)
        right[i] = node(idx[~mask], depth + 1)
        return i

    node(np.arange(len(X)), 0)
    return pd.DataFrame({"tree": [tree], "feat": [feat], "thr": [thr], "code": [code], "left": [left], "right": [right],
                         "size": [size], "n": [len(X)]})


def fit_forest(feats: DataFrame, key: Sequence[str], n_trees: int = N_TREES, sample: int = SAMPLE,
               seed: int = SEED) -> list[dict]:
    """Grow the trees in parallel (one ``applyInPandas`` group per tree) and return them."""
    checkpoint_dir(feats.sparkSession)
    max_depth = int(math.ceil(math.log2(max(sample, 2))))
    s = _sample(feats, key, n_trees, sample, seed)
    schema = ("tree int, feat array<int>, thr array<double>, code array<bigint>, left array<int>, right array<int>, "
              "size array<int>, n int")
    trees = s.groupBy("tree").applyInPandas(lambda p: _grow(p, max_depth, seed), schema)
    return [r.asDict() for r in trees.orderBy("tree").collect()]  # bounded: trees × (2·256 − 1) nodes


SCORE_ROWS = 4096         # rows walked through the trees together: their values stay in the processor's cache


def _table(feat, thr, code, left, right, ending, wide: int):
    """A tree as one table of equal steps, breadth first: a row at node i goes to ``child[i]``, or to the next node if its value in
    column ``col[i]`` is at least ``thr[i]``. An indicator of a code is a column of its own, 1 where the row has the code; a
    leaf tests a column of zeros and stays. Returns the columns' codes, the table, the depth and the path length at every leaf."""
    order, depth = [0], {0: 0}
    for i in order:                                     # grows while it is read
        if feat[i] >= 0:
            order += [int(left[i]), int(right[i])]
            depth[int(left[i])] = depth[int(right[i])] = depth[i] + 1
    place = {i: at for at, i in enumerate(order)}
    pairs = sorted({(int(feat[i]) - wide, int(code[i])) for i in order if feat[i] >= wide})
    column = {p: wide + 1 + at for at, p in enumerate(pairs)}           # column ``wide`` is the zeros
    inner = [feat[i] >= 0 for i in order]
    col = np.array([wide if not test else int(feat[i]) if feat[i] < wide else column[int(feat[i]) - wide, int(code[i])]
                    for i, test in zip(order, inner)], dtype=np.intp)
    at_least = np.array([np.inf if not test else thr[i] if feat[i] < wide else 0.5 for i, test in zip(order, inner)])
    child = np.array([place[int(left[i])] if test else place[i] for i, test in zip(order, inner)], dtype=np.intp)
    return pairs, col, at_least, child, max(depth.values()), np.array([depth[i] + ending[i] for i in order])


def _path_lengths(tables, X: np.ndarray, C: np.ndarray) -> np.ndarray:
    """Sum of the path lengths of every row over the trees."""
    n, wide = X.shape
    values = np.zeros((wide + 1 + max((len(t[0]) for t in tables), default=0), n))
    values[:wide] = np.where(np.isnan(X), np.inf, X).T                  # a number that can't be compared is not below a threshold
    flat, rows = values.ravel(), np.arange(n, dtype=np.intp)
    total = np.zeros(n)
    for pairs, col, at_least, child, deep, length in tables:
        for i, (j, code) in enumerate(pairs):
            np.equal(C[:, j], code, out=values[wide + 1 + i])
        start, nodes = col * n, np.zeros(n, dtype=np.intp)
        for _ in range(deep):
            at = start.take(nodes)
            at += rows
            up = flat.take(at) >= at_least.take(nodes)
            nodes = child.take(nodes)
            nodes += up
        total += length.take(nodes)
    return total


def score(feats: DataFrame, forest: list[dict], key: Sequence[str], sample: int = SAMPLE) -> DataFrame:
    """``key…, anomaly_score`` = 2^(−E[h(x)] / c(ψ)) with Arrow-batched scoring."""
    arrays = [(np.array(t["feat"]), np.array(t["thr"], dtype=float), np.array(t["code"], dtype=np.int64), np.array(t["left"]),
               np.array(t["right"]), np.array([c_factor(x) for x in t["size"]])) for t in forest]
    denom = c_factor(min(sample, max((t["n"] for t in forest), default=sample)))
    key = list(key)

    def run(it):
        tables = None
        for whole in it:
            for at in range(0, len(whole), SCORE_ROWS):
                pdf = whole.iloc[at:at + SCORE_ROWS]
                n = len(pdf)
                X = np.array(pdf["x"].tolist(), dtype=float).reshape(n, -1)
                C = np.array(pdf["c"].tolist(), dtype=np.int64).reshape(n, -1)
                if tables is None:
                    tables = [_table(*t, X.shape[1]) for t in arrays]
                depth = _path_lengths(tables, X, C)
                mean = depth / max(len(tables), 1)
                out = pdf[key].copy()
                out["anomaly_score"] = np.power(2.0, -mean / denom) if denom > 0 else 0.5
                yield out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in feats.schema.fields if f.name in key)
    return feats.mapInPandas(run, f"{schema}, anomaly_score double")


def isolation_forest(df: DataFrame, key: Sequence[str], numeric: Sequence[str], categorical: Sequence[str] = (),
                     n_trees: int = N_TREES, contamination: float = CONTAMINATION, seed: int = SEED) -> DataFrame:
    """ANO-01: ``key…, anomaly_score, is_anomaly`` (flag = score above the (1 − contamination) quantile)."""
    feats = prepare_features(df, key, numeric, categorical)
    forest = fit_forest(feats, key, n_trees, SAMPLE, seed)
    # scoring is the expensive Python step and is read twice (threshold, then the rows):
    # a reliable checkpoint in the shared folder runs it once and cuts the lineage
    checkpoint_dir(df.sparkSession)
    s = score(feats, forest, key).checkpoint(eager=True)
    thr = exact_percentiles(s.withColumn("_g", F.lit(0)), ["_g"], "anomaly_score", [1 - contamination],
                            out_prefix="t").drop("_g")
    return s.crossJoin(thr).withColumn("is_anomaly", F.col("anomaly_score") > F.col("t_0")).drop("t_0")  # 1 row


def top_anomalies(scored: DataFrame, key: Sequence[str], n: int = 50) -> DataFrame:
    """WIN-07: the n highest scores (TakeOrderedAndProject; ties by key)."""
    return scored.orderBy(F.col("anomaly_score").desc(), *key).limit(n)

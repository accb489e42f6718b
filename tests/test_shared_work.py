"""Work that several fits or candidates share is done once."""

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F


def _rows(spark, n=240):
    x = spark.range(n).select(F.col("id").alias("key"), (F.col("id") % 7).cast("double").alias("a"), F.sin("id").alias("b"),
                              F.concat(F.lit("c"), F.col("id") % 3).alias("c"))
    return x.withColumn("label", (F.col("a") + F.col("b") > 3).cast("int"))


def test_panel_prepares_every_fold_once(spark, monkeypatch):
    from foldline.operators import training as TR
    calls, fit = [], TR.fit_preprocessing
    monkeypatch.setattr(TR, "fit_preprocessing", lambda *a, **k: calls.append(1) or fit(*a, **k))
    spec = TR.make_spec(_rows(spark), ["key"], "label", "classification")
    cfg = TR.ExperimentConfig(name="panel", seeds=(42,), k=2, parallelism=2)
    got = TR.classifier_panel(spec, cfg, kinds=("tree", "logreg", "nb"))
    assert len(calls) == 2 and got.count() == 6
    for kind in ("tree", "nb"):              # as when each kind prepares its own rows
        own = TR.run_experiment(spec, lambda k=kind: TR.default_estimator("classification", 2, k), TR.replace(cfg, name=kind)).folds
        a, b = ({r["fold"]: (r["n"], round(r["accuracy"], 9), round(r["roc_auc"], 9)) for r in d.collect()}
                for d in (got.where(F.col("framework") == kind), own))
        assert a == b


def test_candidates_read_the_folds_they_need(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression
    from foldline.operators import search as SE
    made, by_fold = [], SE._by_fold
    monkeypatch.setattr(SE, "_by_fold", lambda d: made.append(by_fold(d)) or made[-1])
    xy = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(_rows(spark))
    space = {"regParam": {"type": "float", "low": 1e-3, "high": 1.0, "log": True}}
    _, board = SE.random_search(xy, LogisticRegression(maxIter=5), space, "classification", "key", n_iter=2, k=3, metric="roc_auc")
    assert board.where("status = 'ok' and score > 0.9").count() == 2
    plan = made[0].where("fold <> 1").select("features", "label")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan and "key" not in plan.split("ReadSchema")[1]


def test_ranking_counts_scores_once(spark):
    from foldline.operators.metrics import ranking_metrics
    rows = [("x", 0.1, 0), ("x", 0.4, 0), ("x", 0.35, 1), ("x", 0.8, 1), ("x", None, 1), ("x", 0.8, None), (None, 0.5, 1), ("y", 0.2, 1), ("y", 0.2, 0)]
    df = spark.createDataFrame(rows, "k string, s double, y int")
    out = ranking_metrics(df, ["k"], "y", "s")
    got = {r["k"]: (r["roc_auc"], r["avg_precision"]) for r in out.collect()}
    # x: rows with a null label count as negative, rows without a score are left out
    assert got[None] == (None, None) and got["y"] == (0.5, 0.5)
    assert abs(got["x"][0] - 3.5 / 6) < 1e-12 and abs(got["x"][1] - (0.5 / 2 + 2 / 4 / 2)) < 1e-12

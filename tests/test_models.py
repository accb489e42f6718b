"""Refits, wide categories, softmax boosting and the kernel map on planted data."""

import math

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from foldline.operators import preprocess as PP
from foldline.operators import training as TR
from foldline.operators.boosting import SoftmaxBoosting, SoftmaxBoostingModel
from foldline.operators.kernels import KernelMap, KernelMapModel, rbf_svm


def test_refit_scores_raw_rows_after_loading(spark, tmp_path):
    from pyspark.ml.classification import DecisionTreeClassifier
    rows = [(i, float(i % 10) if i % 11 else None, ["red", "blue", "a'b\\c"][i % 3] if i % 13 else None, "yes" if i % 3 else "no") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, colour string, label string")
    spec = TR.make_spec(df, ["id"], "label", "classification")
    TR.final_refit(spec, lambda: DecisionTreeClassifier(maxDepth=4), path=f"{tmp_path}/m")
    new = spark.createDataFrame([(1, None, "red", "kept"), (2, 3.0, None, "kept"), (3, float("nan"), "unseen", "kept")],
                                "id long, x double, colour string, extra string")
    got = TR.score_batch(f"{tmp_path}/m", new)
    assert {r["id"]: r["predicted_label"] for r in got.collect()}.keys() == {1, 2, 3}
    assert not [c for c in got.columns if c.startswith("_fp_")] and "extra" in got.columns
    assert all(r["predicted_label"] == ("no" if r["colour"] == "red" else "yes") for r in TR.score_batch(f"{tmp_path}/m", df).collect()
               if r["colour"] is not None)
    assert len(PipelineModel.load(f"{tmp_path}/m").stages) > 4


def test_category_positions_of_hot_and_rare_values(spark):
    rows = [(i, "hot" if i % 3 else f"v{i:05d}", i % 5, None if i % 7 == 0 else f"w{i % 4}") for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, a string, fold int, b string")
    d = PP.category_dictionary(df, ["a", "b"])
    got = {r["id"]: (r["positions"], r["size"]) for r in PP.one_hot_positions(df, ["a", "b"], d).collect()}
    a = {v: i for i, v in enumerate(sorted({r[1] for r in rows}))}
    b = {v: i for i, v in enumerate(sorted({r[3] for r in rows if r[3]}))}
    for i, x, _, y in rows:
        assert got[i] == ([a[x]] + ([len(a) + b[y]] if y else []), len(a) + len(b))
    f = PP.category_dictionary(df, ["a"], "fold")
    folded = {r["id"]: r["positions"] for r in PP.one_hot_positions(df.select("id", "a", "fold"), ["a"], f, "fold").collect()}
    assert all(folded[i] == ([a["hot"]] if x == "hot" else []) for i, x, _, _ in rows)      # a rare value is in its own fold only


def test_monomials_and_fill_rules(spark):
    assert PP.monomials(["a", "b"], 3) == [("a",), ("b",), ("a", "a"), ("a", "b"), ("b", "b"), ("a", "a", "a"), ("a", "a", "b"),
                                            ("a", "b", "b"), ("b", "b", "b")]
    df = spark.createDataFrame([(1.0, 0), (1.0, 0), (5.0, 1), (None, 1), (9.0, 0)], "x double, fold int")
    cfg = TR.FeatureConfig(impute="most_frequent", poly_degree=3, scale=False)
    pre = PP.fit_preprocessing(df, ["x"], [], cfg)
    assert pre.names() == ["x", "x__x__x", "x__x__x__x__x"]
    assert sorted(tuple(r["features"]) for r in pre.model.transform(df).collect()) == [
        (1, 1, 1), (1, 1, 1), (1, 1, 1), (5, 25, 125), (9, 81, 729)]


def _three_classes(spark, n=900):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        c = i % 3
        centre = [(0, 0), (3, 0), (0, 3)][c]
        x = rng.normal(centre, 0.7)
        rows.append((i, Vectors.dense([x[0], x[1], float(rng.normal()), math.nan if i % 50 == 0 else 1.0]), float(c)))
    return spark.createDataFrame(rows, ["id", "features", "label"])


def test_softmax_boosting_learns_three_classes(spark, tmp_path):
    df = _three_classes(spark)
    est = SoftmaxBoosting(3, rounds=12, depth=3, rate=0.3, subsample=0.9, feature_rate=1.0)
    train, test = df.where("id % 3 <> 0 or id % 2 = 0"), df.where("id % 5 = 0")
    model = est.fit(train)
    pred = model.transform(test)
    assert pred.where("prediction = label").count() / pred.count() > 0.93
    rows = pred.select("probability", "prediction").collect()
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 and int(np.argmax(r["probability"])) == int(r["prediction"]) for r in rows)
    assert est.fit(train).trees == model.trees
    model.save(f"{tmp_path}/b")
    loaded = SoftmaxBoostingModel.load(f"{tmp_path}/b")
    assert [r[0] for r in loaded.transform(test).select("probability").collect()] == [r["probability"] for r in rows]
    imp = model.featureImportances.toArray()
    assert imp[:2].sum() > 0.6 and abs(imp.sum() - 1) < 1e-9


def test_one_tree_against_brute_force(spark):
    """The first split of the first class is the best one over all cuts, and its leaves are Newton steps."""
    rng = np.random.default_rng(5)
    x = np.round(rng.uniform(0, 10, (60, 2)), 1)
    y = (x[:, 1] > 4).astype(float)
    df = spark.createDataFrame([(Vectors.dense(r), float(c)) for r, c in zip(x, y)], ["features", "label"])
    m = SoftmaxBoosting(2, rounds=1, depth=1, rate=1.0, subsample=1.0, feature_rate=1.0, bins=256, l2=1.0).fit(df)
    feat, cut, value = m.trees[0]
    g, h = 0.5 - (y == 0), np.full(60, 0.25)
    best = max(((g[m_].sum() ** 2 / (h[m_].sum() + 1) + g[~m_].sum() ** 2 / (h[~m_].sum() + 1), j, c)
                for j in range(2) for c in np.unique(x[:, j])[:-1] for m_ in [x[:, j] <= c]), key=lambda t: round(t[0], 9))
    left = x[:, feat[0]] <= cut[0]
    assert feat[0] == best[1] == 1 and (left == (x[:, 1] <= best[2])).all()
    assert abs(value[1] + g[left].sum() / (h[left].sum() + 1)) < 1e-12 and abs(value[2] + g[~left].sum() / (h[~left].sum() + 1)) < 1e-12


def test_kernel_map_and_circles(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        r, t = (1.0 if i % 2 else 3.0) + rng.normal(0, 0.2), rng.uniform(0, 2 * math.pi)
        rows.append((i, Vectors.dense([r * math.cos(t), r * math.sin(t)]), float(i % 2)))
    df = spark.createDataFrame(rows, ["id", "features", "label"])
    km = KernelMap(size=2000, gamma=0.5).fit(df)
    z = np.array([r["kernel_features"].toArray() for r in km.transform(df.where("id < 20")).collect()])
    x = np.array([r[1].toArray() for r in rows[:20]])
    exact = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - exact).max() < 0.12
    km.save(f"{tmp_path}/k")
    assert (KernelMapModel.load(f"{tmp_path}/k").draws()[0] == km.draws()[0]).all()
    scale = KernelMap().fit(df).getOrDefault("gamma")
    allx = np.array([r[1].toArray() for r in rows])
    assert abs(scale - 1 / (2 * allx.var())) < 1e-9
    model = rbf_svm(iterations=30).fit(df.where("id % 3 <> 0"))
    pred = model.transform(df.where("id % 3 = 0"))
    assert pred.where("prediction = label").count() / pred.count() > 0.97
    spec = TR.make_spec(spark.createDataFrame([(r[0], float(r[1][0]), float(r[1][1]), int(r[2])) for r in rows],
                                              "id long, a double, b double, y int"), ["id"], "y", "classification")
    folds = TR.run_experiment(spec, lambda: rbf_svm(iterations=20), TR.ExperimentConfig(name="svm", seeds=(42,), k=2)).folds
    assert all(r["roc_auc"] > 0.97 for r in folds.select(F.col("roc_auc")).collect())


def test_kernel_shapley_adds_up_and_matches_all_permutations(spark):
    from itertools import permutations

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    from foldline.operators import explain as EX
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (200, 3)).astype(float)
    y = x[:, 0] * x[:, 1] + (x[:, 2] > 3)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, a double, b double, c double, label double")
    feats = ["a", "b", "c"]
    model = DecisionTreeRegressor(maxDepth=4).fit(VectorAssembler(inputCols=feats, outputCol="features").transform(df))
    bg, rows = df.where("id < 12"), df.where("id >= 190")
    got = EX.kernel_shapley(model, rows, "id", feats, bg, output="prediction").collect()
    f = lambda v: model.predict(Vectors.dense(v))
    base = float(np.mean([f(b) for b in x[:12]]))
    for i in range(190, 200):
        mine = {r["feature"]: r for r in got if r["id"] == i}
        assert abs(sum(r["value"] for r in mine.values()) - (f(x[i]) - base)) < 1e-9
        worth = lambda s: float(np.mean([f([x[i][k] if k in s else b[k] for k in range(3)]) for b in x[:12]]))
        for k in range(3):
            exact = np.mean([worth(set(o[:o.index(k) + 1])) - worth(set(o[:o.index(k)])) for o in permutations(range(3))])
            assert abs(mine[feats[k]]["value"] - exact) < 1e-6
        assert abs(mine["a"]["prediction"] - f(x[i])) < 1e-12 and abs(mine["a"]["expected_value"] - base) < 1e-12
    d = EX.sample_details(EX.kernel_shapley(model, rows, "id", feats, bg, output="prediction"), "id", k=2).collect()
    assert len(d) == 10 and all(len(r["top_contributions"]) == 2 for r in d)


def test_coalitions_are_paired_when_sampled():
    from foldline.operators.explain import coalitions
    z, w = coalitions(20, 400, 1)
    assert len(z) == 400 and (z[:200] + z[200:] == 1).all() and abs(w.sum() - 1) < 1e-12
    z, w = coalitions(4, 100, 1)
    assert len(z) == 14 and len({tuple(r) for r in z}) == 14


def test_holt_winters_fit_is_not_worse_than_the_grid():
    from foldline.operators import forecast as FC
    rng = np.random.default_rng(0)
    for case in range(6):
        n = 60 + 10 * case
        y = 10 + 0.05 * np.arange(n) + np.tile(rng.normal(0, 2, 7), n)[:n] + rng.normal(0, 0.5 + case, n)
        smooth, start, sse = FC.holt_winters_fit(y)
        grid = np.array(np.meshgrid(FC.GRID, FC.GRID, FC.GRID)).reshape(3, -1).T
        err, _ = FC._errors(y, grid, np.repeat(FC._usual_start(y, 7)[None], len(grid), axis=0), 7)
        assert sse <= (err ** 2).sum(axis=1).min() + 1e-9 and (smooth >= 0).all() and (smooth <= 1).all()
        # the initial state is the best one: no single change lowers the error
        for i in range(len(start)):
            for d in (1e-3, -1e-3):
                moved = start.copy()
                moved[i] += d
                e, _ = FC._errors(y, smooth[None], moved[None], 7)
                assert (e ** 2).sum() >= sse - 1e-9
    exact = 5 + np.tile(np.arange(7.0), 10)
    smooth, start, sse = FC.holt_winters_fit(exact[:-14])
    assert sse < 1e-12 and np.allclose(FC.holt_winters_forecast(exact[:-14], smooth, start), exact[-14:])


def test_isolation_forest_is_the_same_for_any_partitioning(spark):
    from foldline.operators import anomaly as AN
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal()), None if i % 9 == 0 else f"c{i % 1500}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, x double, c string")
    forests = [AN.fit_forest(AN.prepare_features(d, ["id"], ["x"], ["c"]), ["id"], n_trees=5, sample=64)
               for d in (df.coalesce(1), df.repartition(7))]
    assert forests[0] == forests[1] and all(t["n"] == 64 for t in forests[0])
    feats = AN.prepare_features(df, ["id"], ["x"], ["c"])
    draws = {t: sorted((r["u"], r["id"]) for r in feats.select("id", AN._draw(F.lit(42), F.lit(t), F.col("id")).alias("u")).collect())[:64]
             for t in (0, 4)}
    got = AN._sample(feats, ["id"], 5, 64, 42)
    x = {r[0]: r[1] for r in feats.select("id", "x").collect()}
    for t, smallest in draws.items():
        assert [r["x"] for r in got.where(F.col("tree") == t).orderBy("_rk").collect()] == [x[i] for _, i in smallest]
    assert AN._sample(feats.where("id < 20"), ["id"], 3, 64, 42).count() == 60


def test_holdout_runner_skip_rule_and_written_config(spark, tmp_path):
    from foldline.sources.writers import write_config
    rows = [(i, float(i % 20), "rare" if i in (7, 8) else ("hi" if i % 20 > 9 else "lo")) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x double, y string")
    spec = TR.make_spec(df, ["id"], "y", "classification")
    cfg = TR.ExperimentConfig(name="h", seeds=(1,), k=5)
    assert [r[0] for r in TR.assign_folds(spec, cfg).df.select("fold").distinct().orderBy("fold").collect()] == [-1, 0]   # 2 rows, 5 folds
    two = TR.make_spec(df.where("y <> 'rare'"), ["id"], "y", "classification")
    folds = TR.assign_folds(two, cfg, holdout=True)
    assert {(r["y"], r["count"]) for r in folds.df.where("fold = 0").groupBy("y").count().collect()} == {("hi", 12), ("lo", 12)}
    r = TR.run_experiment(two, lambda: TR.FeedForward(hidden=(8,), iterations=60), cfg, folds=folds)
    got = r.folds.collect()
    assert len(got) == 1 and got[0]["n"] == 24 and got[0]["accuracy"] > 0.9
    write_config(spark, r.config, f"{tmp_path}/config")
    assert '"name": "h"' in spark.read.text(f"{tmp_path}/config").first()[0]
    out, errors = TR.run_suite(TR.make_spec(df.limit(10), ["id"], "y", "classification"), {}, cfg)
    assert out is None and "fewer than 40 rows" in errors[0]["error"]
    fill = TR.run_experiment(two, lambda: TR.default_estimator("classification", 2, "tree"),
                             TR.ExperimentConfig(name="raw", seeds=(1,), k=2, skip_preprocessing=True)).folds.collect()
    assert len(fill) == 2 and all(f["accuracy"] > 0.95 for f in fill)


def test_kernel_map_reads_batches_as_arrays(spark):
    """The map's rows went through Python objects both ways, most of its time."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.util import PythonEvalType
    rows = spark.range(500).select("id", array_to_vector(F.array(F.sin("id"), F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).otherwise(
        F.cos("id")), F.lit(0.0))).alias("features")).repartition(3, "id")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        model = KernelMap(size=20, seed=5).fit(rows)
        out = model.transform(rows)
        got = out.select(vector_to_array("features").alias("x"), vector_to_array("kernel_features").alias("z")).collect()
        assert model.transform(rows.where("id < 0")).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    w, b = model.draws()
    x, z = np.array([r["x"] for r in got]), np.array([r["z"] for r in got])
    assert z.shape == (500, 20) and np.allclose(z, np.sqrt(2 / 20) * np.cos(np.nan_to_num(x) @ w.T + b), rtol=0, atol=1e-12)
    kinds = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "ArrowEvalPython" in line]
    assert kinds and all(line.rstrip().endswith(str(PythonEvalType.SQL_SCALAR_ARROW_UDF)) for line in kinds)

"""Model search (TRN-04/06/07): candidates scored on the same keyed folds, with a deadline that binds inside a fit.

Every candidate runs under a Spark job group of its own, several at a time. Its held-out predictions of all folds go through
the grouped metrics once, so any metric of the library can choose. When the budget is spent, running groups are cancelled (a
fit stops at its current job) and candidates that have not begun are skipped; both say so in their status. Finished candidates
are stored as they end: a search that is started again with the same ``store`` takes them from there.
"""

from __future__ import annotations

import json
import math
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.operators import splits as S
from foldline.operators.metrics import evaluate, ranking_metrics
from foldline.session import checkpoint_dir

CLASS_METRICS = ("accuracy", "precision", "recall", "f1", "f1_macro", "roc_auc", "avg_precision")
ERRORS = ("rmse", "mae")                     # lower is better


def param_grid(spec: dict) -> list:
    """UDF-04: the values of one parameter: all integers of a range, ``num`` (20) floats on a linear or logarithmic grid,
    or the given choices."""
    kind = spec["type"]
    if kind == "int":
        return list(range(int(spec["low"]), int(spec["high"]) + 1))
    if kind == "categorical":
        return list(spec["choices"])
    if kind not in ("float", "log"):
        raise ValueError(f"unknown parameter type {kind}")
    low, high, num = float(spec["low"]), float(spec["high"]), int(spec.get("num", 20))
    if kind == "log" or spec.get("log"):
        return np.geomspace(max(low, 1e-6), max(high, low, 1e-6), num).tolist()
    return np.linspace(low, high, num).tolist()


def sample_param_maps(estimator: Estimator, space: dict[str, dict], n_iter: int, seed: int = 42) -> list[dict]:
    """UDF-04 / TRN-04: up to ``n_iter`` different points of the grid, drawn without repeats."""
    grids = {name: param_grid(spec) for name, spec in space.items()}
    total = math.prod(len(g) for g in grids.values())
    rng = np.random.default_rng(seed)
    picked: dict[int, None] = {}
    while len(picked) < min(n_iter, total):
        picked[int(rng.integers(total))] = None
    maps = []
    for at in picked:
        pm = {}
        for name, grid in grids.items():
            at, i = divmod(at, len(grid))
            pm[estimator.getParam(name)] = grid[i]
        maps.append(pm)
    return maps


def scoring_rule(task: str, requested: str = "auto") -> tuple[str, bool]:
    """TRN-06: ``(metric, higher is better)``; auto is f1 or RMSE, and a classification score of a regression becomes RMSE."""
    if requested == "auto":
        return ("f1", True) if task == "classification" else ("rmse", False)
    if task == "regression" and requested in CLASS_METRICS:
        return "rmse", False
    return requested, requested not in ERRORS


class _Budget:
    """Cancels the job groups that are still running when ``seconds`` are over."""

    def __init__(self, sc, seconds: float | None):
        self.sc, self.groups, self.lock = sc, set(), threading.Lock()
        self.deadline = None if seconds is None else time.time() + seconds
        self.done = threading.Event()
        if seconds is not None:
            threading.Thread(target=self._watch, daemon=True).start()

    def spent(self) -> bool:
        return self.deadline is not None and time.time() >= self.deadline

    def _watch(self) -> None:
        self.done.wait(max(0.0, self.deadline - time.time()))
        while not self.done.wait(0.2):                 # a fit is many jobs: each one that still begins is cancelled
            with self.lock:
                for g in self.groups:
                    self.sc.cancelJobGroup(g)

    def run(self, group: str, work: Callable):
        with self.lock:
            self.groups.add(group)
        try:
            self.sc.setJobGroup(group, group, interruptOnCancel=True)
            return work()
        finally:
            with self.lock:
                self.groups.discard(group)


def _stored(spark, path: str) -> dict | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return json.loads(spark.read.text(path).first()[0])


def _draws(est: Estimator) -> bool:
    """Whether a fit may draw rows by partition and place (it has a seed, or isn't a learner by itself)."""
    return est.hasParam("seed") or est.hasParam("classifier") or not est.hasParam("featuresCol")


def _by_fold(folded: DataFrame) -> DataFrame:
    """The rows with their fold, written once as Parquet by fold: every candidate reads the folds and columns that it needs.

    Reading deals the rows anew, so this is for estimators that don't draw rows."""
    spark = folded.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/foldline-folds-{uuid.uuid4().hex}"
    folded.write.partitionBy("fold").parquet(path)
    return spark.read.schema(folded.schema).parquet(path)


def search(train: DataFrame, candidates: dict[str, tuple[Estimator, dict]], task: str, key: str, metric: str = "auto", k: int = 3,
           seed: int = 42, seconds: float | None = None, parallelism: int = 4, store: str | None = None,
           label: str = "label") -> DataFrame:
    """TRN-07: the leaderboard ``rank, framework, metric, score, fit_time_sec, status`` of named (estimator, parameters).

    ``train`` has ``label`` and what the estimators read; ``key`` identifies rows, so folds survive recomputation.
    Without ``seconds`` every candidate is scored. Unscored candidates have rank null."""
    from foldline.operators.training import _score_col
    spark = train.sparkSession
    name, higher = scoring_rule(task, metric)
    base = f"{checkpoint_dir(spark).rstrip('/')}/foldline-search-{uuid.uuid4().hex}" if store is None else store.rstrip("/")
    if task == "classification":
        folded = S.stratified_kfold(train, [key], label, k=k, seeds=(seed,))
        classes = train.select(label).distinct().count()
    else:
        folded, classes = S.kfold(train, [key], k=k, seeds=(seed,)), 0
    folded = folded.checkpoint() if any(_draws(est) for est, _ in candidates.values()) else _by_fold(folded)
    budget = _Budget(spark.sparkContext, seconds)

    def score(who: str, est: Estimator, params: dict) -> float:
        preds = None
        for g in range(k):
            model = est.fit(folded.where(F.col("fold") != g), params) if params else est.fit(folded.where(F.col("fold") != g))
            out = model.transform(folded.where(F.col("fold") == g))
            sc = _score_col(out, classes) if task == "classification" else None
            p = out.select(F.lit(g).alias("fold"), F.col(label).cast("double").alias("y_true"), F.col("prediction").cast("double").alias("y_pred"),
                           *([sc.alias("score")] if sc is not None else []))
            preds = p if preds is None else preds.unionByName(p)
        if name in ("roc_auc", "avg_precision") and classes == 2 and "score" in preds.columns:
            # one pass over the held-out predictions: no other metric is computed, and they needn't be written
            return ranking_metrics(preds, ["fold"], "y_true", "score").agg(F.avg(name)).first()[0]
        preds = preds.checkpoint()
        needs_score = name in ("roc_auc", "avg_precision", "roc_auc_ovr", "avg_precision_ovr")
        got = evaluate(preds, ["fold"], task, score="score" if needs_score else None)
        return got.agg(F.avg(name)).first()[0]

    def one(item):
        i, (who, (est, params)) = item
        path = f"{base}/candidate-{i}"
        known = _stored(spark, path)
        if known and known["framework"] == who and known["metric"] == name:
            return known
        row = {"framework": who, "metric": name, "score": None, "fit_time_sec": 0.0, "status": "skipped: budget spent"}
        if budget.spent():
            return row
        began = time.time()
        try:
            row["score"] = budget.run(f"search-{uuid.uuid4().hex}", lambda: score(who, est, params))
            row["status"] = "ok"
        except Exception as e:  # noqa: BLE001 - a failed candidate is a row of the leaderboard
            row["status"] = "cancelled: budget spent" if budget.spent() else f"error: {type(e).__name__}"
        row["fit_time_sec"] = time.time() - began
        if row["status"] == "ok":
            spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return row

    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            rows = list(pool.map(one, enumerate(candidates.items())))
    finally:
        budget.done.set()
    scored = sorted((r for r in rows if r["score"] is not None and not math.isnan(r["score"])),
                    key=lambda r: (-r["score"] if higher else r["score"], r["framework"]))
    rank = {r["framework"]: i + 1 for i, r in enumerate(scored)}
    return spark.createDataFrame([(rank.get(r["framework"]), r["framework"], r["metric"], r["score"], r["fit_time_sec"], r["status"])
                                  for r in rows], "rank int, framework string, metric string, score double, fit_time_sec double, status string")


def random_search(train: DataFrame, estimator: Estimator, space: dict, task: str, key: str, n_iter: int = 20, k: int = 3,
                  seed: int = 42, parallelism: int = 4, metric: str = "auto", seconds: float | None = None, store: str | None = None):
    """TRN-04: ``(best model refitted on all rows, leaderboard)`` over sampled parameter maps; ``framework`` is the parameters."""
    maps = {", ".join(f"{p.name}={v!r}" for p, v in sorted(m.items(), key=lambda x: x[0].name)): (estimator, m)
            for m in sample_param_maps(estimator, space, n_iter, seed)}
    board = search(train, maps, task, key, metric, k, seed, seconds, parallelism, store)
    best = board.where("rank = 1").first()
    model = None if best is None else estimator.fit(train, maps[best["framework"]][1])
    return model, board


def budgeted_search(train: DataFrame, candidates: dict[str, Estimator], task: str, key: str, seconds: float | None, k: int = 3,
                    seed: int = 42, metric: str = "auto", parallelism: int = 4, store: str | None = None) -> DataFrame:
    """TRN-07: :func:`search` over estimators at their own settings."""
    return search(train, {n: (e, {}) for n, e in candidates.items()}, task, key, metric, k, seed, seconds, parallelism, store)


def leaders(board: DataFrame, names: Sequence[str] = ("rank", "framework", "metric", "score")) -> DataFrame:
    """The scored part of a leaderboard."""
    return board.where("rank is not null").orderBy("rank").select(*names)

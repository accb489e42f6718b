"""Reading the tables and keeping intermediate tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCOPE: ContextVar[tuple[list[str], ...]] = ContextVar("foldline_scope", default=())


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet below ``spark.checkpoint.dir`` and read it back: the lineage is
    cut, every later job reads the same rows, and a lost executor costs no recomputation.

    Inside :func:`temporary` the table belongs to that scope; with ``keep`` to the scope around it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/foldline-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    scopes = _SCOPE.get()[:-1] if keep else _SCOPE.get()
    if scopes:
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths that :func:`stored` writes in this scope; they are the caller's to delete."""
    paths: list[str] = []
    token = _SCOPE.set((*_SCOPE.get(), paths))
    try:
        yield paths
    finally:
        _SCOPE.reset(token)


def released(spark: SparkSession, paths: list[str], shuffles: bool = True) -> None:
    """Delete tables that nothing reads any more; with ``shuffles`` the driver's garbage collection releases the files of
    shuffles that nothing reads any more, too."""
    while paths:
        discard(spark, paths.pop())
    if shuffles:
        spark._jvm.System.gc()


@contextmanager
def temporary(spark: SparkSession, shuffles: bool = False) -> Iterator[None]:
    """Tables stored in this scope are deleted at its end; what leaves it is stored with ``keep``."""
    with collected() as paths:
        try:
            yield
        finally:
            released(spark, paths, shuffles)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table written by this library, wherever Spark's file systems keep it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fold_of(id_col: str, folds: int):
    """``crc32`` of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled_rows(docs: DataFrame, labels: DataFrame, target: str, train, per_class: int, max_chars: int) -> DataFrame:
    """A bounded sample to fit on, ``doc_id, y, draw, text``: at most ``per_class`` documents of each label whose fold ``train``
    accepts and whose text has at most ``max_chars`` characters; ``draw`` is a hash of the id. Scoring is never limited this way."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    own = own.where(F.col("y").isin(0, 1) & train).groupBy("doc_id").agg(F.max("y").alias("y"))
    size = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.col("text").cast("string")).alias("n"))
    size = size.where(F.col("n") <= max_chars).select("doc_id").distinct()
    known = own.join(size, "doc_id").withColumn("draw", F.xxhash64(F.lit("sample"), F.col("doc_id")))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy("draw", "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * per_class rows of three numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.where(F.length("text") <= max_chars).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y", "draw").agg(
        F.min("text").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, train, per_class: int, max_chars: int) -> list:
    """The rows of :func:`labelled_rows` on the driver: ``[(doc_id, text, label)]`` in the order of their draw."""
    rows = labelled_rows(docs, labels, target, train, per_class, max_chars).collect()
    return [(r["doc_id"], r["text"], r["y"]) for r in sorted(rows, key=lambda r: (r["draw"], r["doc_id"]))]


def fit_logistic(x, y, l2: float = 1.0, steps: int = 50):
    """Weights (bias last) of an L2-regularised logistic regression, by Newton steps."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w

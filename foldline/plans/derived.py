"""Inputs of the registered queries, derived by Spark from the given tables.

Each derivation has a Spark form (``*_df``) and a DuckDB twin (``*_SQL``, a sub-query
over the same parquet views) so that every registered query can be checked against an
independent engine. All work grows with the given tables: nothing here is a fixed
sample or a made-up input.
"""

from __future__ import annotations

import operator
from functools import reduce

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.operators.metrics import argmax, threshold

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# --- binary prediction table: documents ⋈ labels ---------------------------------------

def doc_preds_df(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id")  # labels cover a subset of documents; inner join on the key
    score = F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))
    return j.select("doc_id", "lang", "source", F.col("quality").alias("y_true"), score.alias("score"),
                    threshold(score).alias("y_pred"))


DOC_PREDS_SQL = """(SELECT d.doc_id, d.lang, d.source, l.quality AS y_true,
       d.n_chars / (d.n_chars + 1000.0) AS score,
       CASE WHEN d.n_chars / (d.n_chars + 1000.0) >= 0.5 THEN 1 ELSE 0 END AS y_pred
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


# --- multiclass prediction table: embeddings -------------------------------------------

# The score of class c is the sum of components c, c + 10, c + 20, ... of the whole vector.

EMB_DIMS, EMB_CLASSES = 64, 10


def emb_preds_df(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = [F.col("embedding")[i].cast("double") for i in range(EMB_DIMS)]
    s = F.array(*[reduce(operator.add, v[c::EMB_CLASSES]) for c in range(EMB_CLASSES)])
    e = e.select("vec_id", F.col("label").alias("y_true"), s.alias("scores"))
    return e.withColumn("y_pred", argmax(F.col("scores")))


_EMB_SCORES = "list_value(" + ", ".join(
    " + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(c, EMB_DIMS, EMB_CLASSES))
    for c in range(EMB_CLASSES)) + ")"
EMB_PREDS_SQL = f"""(SELECT vec_id, y_true, scores, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS y_pred
  FROM (SELECT vec_id, label AS y_true, {_EMB_SCORES} AS scores FROM embeddings) s)"""


# --- regression prediction table: part --------------------------------------------------

def part_preds_df(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_brand", F.col("p_retailprice").alias("y_true"),
                    (F.lit(900.0) + F.lit(2.0) * F.col("p_size")).alias("y_pred"))


PART_PREDS_SQL = """(SELECT p_partkey, p_brand, p_retailprice AS y_true, 900.0 + 2.0 * p_size AS y_pred FROM part)"""


# --- fold-metric table: lineitem --------------------------------------------------------
# framework = returnflag‖linestatus, seed = ship year, fold = line number.

def fold_metrics_df(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("framework"),
                      F.year("l_shipdate").cast("long").alias("seed"),
                      F.col("l_linenumber").cast("long").alias("fold")).agg(
        F.avg(1 - F.col("l_discount")).alias("accuracy"),
        F.avg(1 - F.col("l_tax")).alias("f1_macro"),
        F.avg(1 - F.col("l_discount") * F.col("l_tax")).alias("f1"),
        (F.avg("l_quantity") / 10.0).alias("fit_time_sec"),
        (F.avg("l_extendedprice") / 1.0e6).alias("predict_time_sec"))


FOLD_METRICS_SQL = """(SELECT l_returnflag || l_linestatus AS framework,
       CAST(year(l_shipdate) AS BIGINT) AS seed, CAST(l_linenumber AS BIGINT) AS fold,
       avg(1 - l_discount) AS accuracy, avg(1 - l_tax) AS f1_macro, avg(1 - l_discount * l_tax) AS f1,
       avg(l_quantity) / 10.0 AS fit_time_sec, avg(l_extendedprice) / 1.0e6 AS predict_time_sec
  FROM lineitem GROUP BY 1, 2, 3)"""

FOLD_METRIC_NAMES = ["accuracy", "f1_macro", "f1", "fit_time_sec", "predict_time_sec"]


def fold_long_df(spark, sf_dir) -> DataFrame:
    from foldline.operators.stats import melt
    return melt(fold_metrics_df(spark, sf_dir), ["framework", "seed", "fold"], FOLD_METRIC_NAMES)


FOLD_LONG_SQL = "(" + " UNION ALL ".join(
    f"SELECT framework, seed, fold, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {FOLD_METRICS_SQL} fm "
    f"WHERE {m} IS NOT NULL AND NOT isnan({m})" for m in FOLD_METRIC_NAMES) + ")"


# --- leaderboard by dataset: orders ⋈ customer ⋈ nation ----------------------------------

def leaderboard_years_df(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("dataset"), F.col("o_orderpriority").alias("framework"),
                     F.year("o_orderdate").cast("long").alias("year")).agg(
        F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("accuracy"))


LEADERBOARD_YEARS_SQL = """(SELECT n.n_name AS dataset, o.o_orderpriority AS framework,
       CAST(year(o.o_orderdate) AS BIGINT) AS year,
       avg(CASE WHEN o.o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS accuracy
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY 1, 2, 3)"""


def leaderboard_df(spark, sf_dir) -> DataFrame:
    ly = leaderboard_years_df(spark, sf_dir)
    return ly.groupBy("dataset", "framework").agg(F.avg("accuracy").alias("accuracy"))


LEADERBOARD_SQL = f"""(SELECT dataset, framework, avg(accuracy) AS accuracy FROM {LEADERBOARD_YEARS_SQL} ly
  GROUP BY 1, 2)"""


# --- per-supplier latency table: lineitem ⋈ supplier -----------------------------------

def supplier_latency_df(spark, sf_dir) -> DataFrame:
    from foldline.functions.ordered import exact_percentiles
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_discount",
                                                 F.col("l_extendedprice").alias("lat"))
    acc = li.groupBy("l_suppkey").agg(F.avg(1 - F.col("l_discount")).alias("accuracy"))
    p95 = exact_percentiles(li, ["l_suppkey"], "lat", [0.95], out_prefix="p")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    out = acc.join(p95, "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return out.select(F.col("s_name").alias("framework"), "accuracy", F.col("p_0").alias("predict_time_p95"))


SUPPLIER_LATENCY_SQL = """(SELECT s.s_name AS framework, avg(1 - l.l_discount) AS accuracy,
       quantile_cont(l.l_extendedprice, 0.95) AS predict_time_p95
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY s.s_name)"""

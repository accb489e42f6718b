"""Sinks (SNK-01..06): twin CSV/JSON, keyed upserts into a new version, sectioned appends,
per-dataset archives with dynamic partition overwrite, model size, guardrail documents."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame

from foldline.operators.guardrails import audit_index
from foldline.operators.reports import upsert


def write_twin(df: DataFrame, base_path: str, single_file: bool = False) -> None:
    """SNK-01: the same table as CSV (header) and JSON records.

    ``single_file`` coalesces to one part file — only for report tables (small by construction).
    """
    d = df.coalesce(1) if single_file else df
    d.write.mode("overwrite").option("header", True).csv(base_path + ".csv")
    d.write.mode("overwrite").json(base_path + ".json")


def upsert_versioned(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], out_path: str,
                     fmt: str = "parquet") -> DataFrame:
    """SNK-02: keyed upsert written to a new version folder (never overwrite the input in place)."""
    merged = upsert(existing, incoming, keys)
    merged.write.mode("overwrite").format(fmt).save(out_path)
    return merged.sparkSession.read.format(fmt).load(out_path)


def append_sections(records: DataFrame, out_path: str, fmt: str = "json") -> None:
    """SNK-03: append run records under their ``section`` partition."""
    records.write.mode("append").partitionBy("section").format(fmt).save(out_path)


def archive_dataset(df: DataFrame, out_path: str, fmt: str = "parquet") -> None:
    """SNK-04: replace only the partitions of the datasets present in ``df`` (dynamic overwrite)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").format(fmt).save(out_path)


def write_guardrails(docs: DataFrame, out_path: str) -> DataFrame:
    """SNK-06: guardrail documents (one JSON per dataset partition) plus the index table."""
    docs.write.mode("overwrite").partitionBy("dataset").json(out_path + "/reports")
    idx = audit_index(docs)
    idx.coalesce(1).write.mode("overwrite").json(out_path + "/index")  # one row per dataset
    return idx


def write_config(spark, config: dict, out_path: str) -> None:
    """SNK-07: the provenance snapshot of a run as one JSON document."""
    text = json.dumps(config, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(out_path)


def folder_size_bytes(spark, path: str) -> int:
    """SNK-05 helper: total bytes under a folder (Hadoop content summary, no data read)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())


def with_lineage_cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut a long lineage with a reliable checkpoint in ``spark.checkpoint.dir`` (never a local one)."""
    from foldline.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)



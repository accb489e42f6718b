"""Sources (SRC-01/03/04/06/08): CSV tables, dataset discovery, fold-metric files, JSON reports.

Discovery lists files with the ``binaryFile`` source selecting only ``path`` and
``length`` (the content column is pruned, so no file is read). Multi-file scans read
all files in one job and recover the file of each row from ``_metadata.file_path``.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.functions.names import sanitize_columns
from foldline.operators.profile import legacy_target_rename, nan_to_null

# Metric column aliases and the framework name of tables that carry none.
COLUMN_ALIASES = {"f1_score": "f1", "f1score": "f1", "accuracy_score": "accuracy", "roc_auc": "roc_auc_ovr",
                  "avg_prec": "avg_precision_ovr", "average_precision": "avg_precision_ovr"}
DEFAULT_FRAMEWORK = "UNKNOWN"


def read_table(spark: SparkSession, path: str, schema=None, sanitize: bool = True,
               nrows: int | None = None) -> DataFrame:
    """SRC-01/05: header CSV (schema given or inferred), NaN → null, legacy target rename, clean
    names; ``nrows`` bounds the scan (the chunked/bounded read of the reference)."""
    r = spark.read.option("header", True).option("mode", "PERMISSIVE")
    df = r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)
    if nrows is not None:
        df = df.limit(nrows)
    df = legacy_target_rename(nan_to_null(df))
    return sanitize_columns(df) if sanitize else df


# Canonical metric order of report tables (presence-aware: only columns that exist are kept).
STANDARD_METRICS = ["f1_macro", "accuracy", "roc_auc_ovr", "avg_precision_ovr", "fit_time_sec",
                    "predict_time_sec", "f1", "precision", "recall"]


def project_metrics(df: DataFrame, keys: Sequence[str] = ("framework",)) -> DataFrame:
    """PRJ-20: keys, then the standard metrics present in canonical order, then other numeric
    metric columns sorted by name."""
    present = [m for m in STANDARD_METRICS if m in df.columns]
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long")}
    extras = sorted(c for c in df.columns if c not in present and c not in keys and c in numeric)
    return df.select(*[k for k in keys if k in df.columns], *present, *extras)


def first_existing(spark: SparkSession, candidates: Sequence[str], env: str = "CSV_PATH") -> str:
    """SRC-02: the env path if set, else the first candidate that exists (Hadoop FS check)."""
    paths = ([os.environ[env]] if os.environ.get(env) else []) + list(candidates)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).exists(hp):
            return p
    raise FileNotFoundError(f"none of {paths} exists")


def discover_datasets(spark: SparkSession, root: str, max_datasets: int | None = None, prefer_small: bool = False,
                      max_size_mb: float | None = None, pattern: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """SRC-03: ``(selected, skipped_large)`` of ``path, length, dataset`` under ``root`` (recursive).

    ``dataset`` is the PRJ-19 slug: file stem, lower-cased, spaces → ``_``."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
             .load(root).select("path", "length").dropDuplicates(["path"]))
    slug = F.regexp_replace(F.lower(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)), " ", "_")
    files = files.withColumn("dataset", slug)
    if max_size_mb is not None:
        limit = int(max_size_mb * 1024 * 1024)
        skipped = files.where(F.col("length") > limit)
        files = files.where(F.col("length") <= limit)
    else:
        skipped = files.limit(0)
    ordered = files.orderBy("length", "path") if prefer_small else files.orderBy("path")
    if max_datasets is not None:
        ordered = ordered.limit(max_datasets)
    return ordered, skipped


def standardize_metrics(df: DataFrame, default_framework: str | None = None) -> DataFrame:
    """PRJ-03: ``framework`` (from ``model``, else the default), aliased metric columns (coalesced when both
    spellings exist), and no repeated rows."""
    out = df
    if "framework" not in out.columns and "model" in out.columns:
        out = out.withColumnRenamed("model", "framework")
    for old, new in COLUMN_ALIASES.items():
        if old in out.columns:
            if new in out.columns:
                out = out.withColumn(new, F.coalesce(F.col(new), F.col(old))).drop(old)
            else:
                out = out.withColumnRenamed(old, new)
    if "framework" not in out.columns:
        out = out.withColumn("framework", F.lit(default_framework or DEFAULT_FRAMEWORK))
    return out.distinct()


def file_headers(spark: SparkSession, pattern: str) -> DataFrame:
    """``file, header`` of all files of a pattern that hold a line: the first line of each file's first split."""
    lines = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("file"), "value",
                                            F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_block_start").alias("start"))
    return lines.where("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))


def empty_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files of a pattern without any byte; Spark's scans leave these out without a word."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [] if f.isFile() and f.getLen() == 0)


def _header_group(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Files of one header, with ``_file`` and ``_bad``: the text of a row that does not fit the header, else null."""
    paths = list(files)
    reader = lambda: spark.read.option("header", True).option("enforceSchema", False)
    schema = reader().option("inferSchema", True).csv(paths).schema
    # all columns are parsed, so that the number of fields of every row is looked at
    rows = reader().schema(schema.add("_bad", "string")).option("columnNameOfCorruptRecord", "_bad").option(
        "columnPruning", False).csv(paths)
    return rows.withColumn("_file", F.col("_metadata.file_path"))


def scan_fold_metrics(spark: SparkSession, pattern: str, leaderboard: str | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-04: ``(metrics, unreadable)`` of all fold-metric files.

    Files are grouped by their header, each group is read under a schema of its own, and the groups are united by name, so
    reordered and missing columns keep their values. The framework of a file is its single ``framework`` value, else
    its stem without ``_folds``. ``leaderboard`` names one more file, read as the framework(s) it holds.
    ``unreadable`` lists ``file, reason, rows``: empty files, and rows that don't fit their header (left out of ``metrics``)."""
    heads = file_headers(spark, pattern).collect()           # one row per file: the listing that the scan needs anyway
    groups: dict[str, list[str]] = {}
    empty = [(f, "empty", 0) for f in empty_files(spark, pattern)]
    for r in heads:
        if (r["header"] or "").strip():
            groups.setdefault(r["header"].strip(), []).append(r["file"])
        else:
            empty.append((r["file"], "no header", 0))
    out, bad = None, spark.createDataFrame(empty, "file string, reason string, rows long")
    for _, files in sorted(groups.items()):
        raw = _header_group(spark, files)
        # grouped by a data column first: Spark refuses to query the corrupt column by itself
        wrong = raw.where(F.col("_bad").isNotNull()).groupBy(F.col(f"`{raw.columns[0]}`"), "_file").agg(F.count(F.lit(1)).alias("rows"))
        bad = bad.unionByName(wrong.groupBy(F.col("_file").alias("file")).agg(F.sum("rows").alias("rows")).select(
            "file", F.lit("rows that don't fit the header").alias("reason"), "rows"))
        raw = raw.where(F.col("_bad").isNull()).drop("_bad")
        stem = F.regexp_replace(F.regexp_extract("_file", r"([^/]+)\.csv$", 1), "_folds$", "")
        if "framework" in raw.columns:
            per = raw.groupBy(F.col("_file").alias("_pf")).agg(
                F.min("framework").alias("_lo"), F.max("framework").alias("_hi"))
            raw = raw.join(per, F.col("_file") == F.col("_pf")).withColumn(
                "framework", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo").cast("string")).otherwise(stem)).drop("_lo", "_hi", "_pf")
        else:
            raw = raw.withColumn("framework", stem)
        # repeated rows are repeats within a file, as files are read one by one
        raw = standardize_metrics(raw).drop("_file")
        out = raw if out is None else out.unionByName(raw, allowMissingColumns=True)
    if leaderboard:
        board = standardize_metrics(_header_group(spark, [leaderboard]).drop("_bad", "_file"))
        out = board if out is None else out.unionByName(board, allowMissingColumns=True)
    if out is None:
        out = spark.createDataFrame([], "framework string")
    return nan_to_null(out), bad


def read_fold_metrics(spark: SparkSession, pattern: str) -> DataFrame:
    """SRC-04: the metrics of :func:`scan_fold_metrics`."""
    return scan_fold_metrics(spark, pattern)[0]


def ingest_sources(frames: Sequence[DataFrame], key: Sequence[str] | None = None,
                   source_names: Sequence[str] | None = None) -> DataFrame:
    """STX-05: multi-source ingest — union by name (missing columns → null), tag the source, and
    de-duplicate on ``key`` (else on all data columns) keeping the row of the earliest source.

    Database tables arrive the same way through ``spark.read.jdbc``. The de-duplication is one
    map-side-combined aggregate (``min`` of a struct led by the source order), so it is
    deterministic, unlike an arbitrary ``dropDuplicates`` survivor."""
    out = None
    for i, df in enumerate(frames):
        tagged = df.withColumn("_source", F.lit(source_names[i] if source_names else str(i))).withColumn(
            "_src_order", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    data_cols = [c for c in out.columns if c not in ("_source", "_src_order")]
    keys = list(key) if key else data_cols
    rest = [c for c in out.columns if c not in keys and c != "_src_order"]
    g = out.groupBy(*keys).agg(F.min(F.struct("_src_order", *rest)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def read_json_reports(spark: SparkSession, pattern: str, schema=None) -> DataFrame:
    """SRC-06: multi-line JSON documents; malformed files are dropped."""
    r = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED")
    return r.schema(schema).json(pattern) if schema is not None else r.json(pattern)


def read_json_lines(spark: SparkSession, pattern: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """SRC-06: ``(documents, unreadable)``: one JSON document per line; lines that are none are listed with their file and text."""
    lines = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("file"), "value").where("trim(value) <> ''")
    parsed = lines.withColumn("d", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    names = [f.name for f in parsed.schema["d"].dataType.fields if f.name != "_bad"]
    return (parsed.where("d._bad is null").select(*[f"d.{n}" for n in names]),
            parsed.where("d._bad is not null").select("file", F.col("value").alias("text")))


def read_runtime_log(spark: SparkSession, pattern: str, record_schema: str) -> DataFrame:
    """SRC-06: a ``{section: [records]}`` log as a long ``section, record…`` table."""
    raw = spark.read.option("multiLine", True).text(pattern, wholetext=True)
    m = F.from_json("value", f"map<string, array<struct<{record_schema}>>>")
    return raw.select(F.explode(m).alias("section", "records")).select(
        "section", F.explode("records").alias("r")).select("section", "r.*")


def read_time_series(spark: SparkSession, path: str, date_col: str = "date", value_col: str = "y",
                     series: str | None = None) -> DataFrame:
    """SRC-08: parse dates (coercing), drop unparsable, order within each series."""
    df = spark.read.option("header", True).csv(path)
    d = df.select(*([F.col(series).alias("series")] if series else [F.lit("series").alias("series")]),
                  F.try_to_timestamp(F.col(date_col)).alias("day"),
                  F.col(value_col).try_cast("double").alias("y")).where(F.col("day").isNotNull())
    return d.repartition("series").sortWithinPartitions("series", "day")

"""Leakage audit of a table (GRD-01..08): every check is one Spark job over all columns.

* duplicates: ``groupBy(all columns).count`` with map-side combine — a row repeated a
  third of the table collapses to one partial count per task;
* proxies: the table is unpivoted once to ``(column, value, target)``, de-duplicated
  (partial aggregation again), then reduced per value and per column — never a job per
  column, and never a group held in one task;
* path tokens: a posting join of texts and distinct target values on rare grams, verified
  (see ``operators.substrings``);
* temporal order: a bucketed ``lag`` in key order (see ``functions.ordered``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldline.functions.hashing import compact
from foldline.functions.ordered import lag_within, spread
from foldline.operators.substrings import columns_with_tokens

# Fixed values that must equal the reference's for the same decisions:
# target-name candidates of the audit, in priority order.
AUDIT_TARGET_CANDIDATES = ["target", "class", "label", "variety", "species", "diagnosis", "survived", "salary"]
# Column-name pattern for time columns (case-insensitive substring match).
TIME_COLUMN_PATTERN = r"(date|time|timestamp)"
# Thresholds: duplicate scan skipped under 50 rows; near-unique ratio 0.98; mean targets per value 1.05;
# a deterministic proxy needs more than 3 distinct values; audit fallback target needs at most 50 distinct.
MIN_ROWS_FOR_DUPLICATES = 50
HIGH_CARDINALITY_THRESHOLD = 0.98
MEAN_TARGETS_LIMIT = 1.05
MIN_PROXY_DISTINCT = 3
FALLBACK_TARGET_MAX_DISTINCT = 50

_ATOMIC = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)

# issue id -> (what was found, what to do about it)
DESCRIPTIONS = {
    "duplicate_rows": ("{n} rows repeat another row; a copy on the other side of a split is seen in training.",
                       "Remove the copies, or keep equal rows together by splitting on a group key."),
    "deterministic_proxy": ("Every value of '{column}' occurs with a single value of '{target}'.",
                            "Leave the column out unless it is known before the outcome."),
    "high_cardinality_proxy": ("'{column}' is close to a row identifier, and a model can memorise it.",
                               "Leave it out, or split by it so that no value is on both sides."),
    "path_token_leakage": ("Values of the target are spelled out in path-like columns.",
                           "Replace paths by opaque names before they reach a feature."),
    "temporal_split_warning": ("Rows don't follow the order of their time column, so a random split mixes past and future.",
                               "Order by time and train on the earlier part only."),
    "missing_target": ("No column could be taken for the target, so checks against it were left out.",
                       "Name the target column."),
    "cross_fold_duplicates": ("Equal rows lie in different folds.",
                              "Assign folds by a key that equal rows share."),
}

FINDING_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("issue_id", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("fraction", T.DoubleType()),
])


@dataclass(frozen=True)
class AuditConfig:
    min_rows_for_duplicates: int = MIN_ROWS_FOR_DUPLICATES
    high_cardinality_threshold: float = HIGH_CARDINALITY_THRESHOLD
    key: tuple[str, ...] = ()          # row-order key for the temporal check
    duplicate_subset: tuple[str, ...] = ()
    word_time_match: bool = False       # True: match time words as whole words only
    extra: dict = field(default_factory=dict)


def atomic_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _ATOMIC)]


# Catalogue variant (PRJ-07): its own candidate order and an unconditional last-column fallback.
CATALOGUE_TARGET_CANDIDATES = ["target", "class", "label", "species", "variety", "diagnosis", "survived", "salary"]


def infer_audit_target(df: DataFrame, policy: str = "audit") -> str | None:
    """Candidate names first (case-insensitive); else the last column if it has <= 50 distinct values.

    ``policy="catalogue"`` (PRJ-07) uses the catalogue's candidate order and always falls back to
    the last column.
    """
    lower = {}
    for c in df.columns:
        lower[c.lower()] = c
    cands = CATALOGUE_TARGET_CANDIDATES if policy == "catalogue" else AUDIT_TARGET_CANDIDATES
    for cand in cands:
        if cand in lower:
            return lower[cand]
    if policy == "catalogue":
        return df.columns[-1] if df.columns else None
    tail = df.columns[-1]
    # exact distinct count, stopped early: only whether it exceeds the limit matters
    n = df.select(tail).where(F.col(tail).isNotNull()).distinct().limit(FALLBACK_TARGET_MAX_DISTINCT + 1).count()
    return tail if n <= FALLBACK_TARGET_MAX_DISTINCT else None


# --- GRD-01 ---------------------------------------------------------------------------

def duplicate_summary(df: DataFrame, subset=None) -> DataFrame:
    """One row ``(rows, duplicates, fraction)``: repeats after the first over ``subset`` (default: all)."""
    cols = list(subset) if subset else df.columns
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    by = [compact(F.col(f"`{c}`")).alias(f"_k{i}") if c in texts else F.col(f"`{c}`") for i, c in enumerate(cols)]
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_c"))  # partial aggregation map-side
    s = g.agg(F.sum("_c").cast("long").alias("rows"), F.sum(F.col("_c") - 1).cast("long").alias("duplicates"))
    return s.select(F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"),
                    F.try_divide(F.col("duplicates"), F.col("rows")).alias("fraction"))


def duplicate_findings(df: DataFrame, dataset: str, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    s = duplicate_summary(df, cfg.duplicate_subset or None)
    s = s.where((F.col("rows") >= cfg.min_rows_for_duplicates) & (F.col("duplicates") > 0))
    return s.select(F.lit(dataset).alias("dataset"), F.lit("duplicate_rows").alias("issue_id"),
                    F.lit("warning").alias("severity"), F.lit(None).cast("string").alias("column_name"),
                    F.col("duplicates").alias("n"), F.col("fraction"))


# --- GRD-02 / GRD-03 -------------------------------------------------------------------

def _families(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for c in cols:
        dt = df.schema[c].dataType
        if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType,
                           T.DateType, T.TimestampType, T.TimestampNTZType)):
            fam = "long"
        elif isinstance(dt, (T.FloatType, T.DoubleType)):
            fam = "double"
        else:
            fam = "string"
        out.setdefault(fam, []).append(c)
    return out


def _family_value(df: DataFrame, c: str, fam: str):
    dt = df.schema[c].dataType
    if fam == "long":
        if isinstance(dt, T.TimestampNTZType):  # exact wall-clock micros, no time-zone folding
            return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(c))
        if isinstance(dt, T.TimestampType):
            return F.unix_micros(F.col(c))
        if isinstance(dt, T.DateType):
            return F.unix_date(F.col(c)).cast("long")
        return F.col(c).cast("long")
    if fam == "double":
        return F.when(~F.isnan(c), F.col(c).cast("double"))      # NaN is missing
    return compact(F.col(c).cast("string"))


def proxy_evidence(df: DataFrame, target: str, columns=None) -> DataFrame:
    """Per audited column: distinct values, max/mean distinct targets per value, rows, target classes.

    Columns: ``column_name, n_values, max_targets, mean_targets, rows, target_classes``.
    """
    cols = [c for c in (columns or atomic_columns(df)) if c != target]
    totals = df.agg(F.count(F.lit(1)).cast("long").alias("rows"),
                    F.countDistinct(F.col(target)).cast("long").alias("target_classes"))
    df = spread(df.select(target, *cols))
    tcol = F.col(target).cast("string")
    # one unpivot for all columns; the value is a typed struct (long | double | string) with only
    # its family's field set, so values stay in a cheap, exact native type (no double → string
    # formatting) and the whole audit is one explode and one shuffle
    fams = {c: fam for fam, members in _families(df, cols).items() for c in members}
    nul = {"long": F.lit(None).cast("long"), "double": F.lit(None).cast("double"), "string": F.lit(None).cast("string")}

    def typed(c):
        return F.struct(*[(_family_value(df, c, f) if fams[c] == f else nul[f]).alias(f) for f in ("long", "double", "string")])

    # columns go by their place in ``cols``, and a missing value has no field set: keys stay narrow
    entries = F.array(*[F.struct(F.lit(i).alias("column_no"), typed(c).alias("value")) for i, c in enumerate(cols)])
    long = df.select(tcol.alias("_t"), F.explode(entries).alias("_e")).select(
        "_e.column_no", "_e.value.long", "_e.value.double", "_e.value.string", "_t")
    triples = long.distinct()
    per_value = triples.groupBy("column_no", "long", "double", "string").agg(F.count("_t").alias("n_targets")).withColumn(
        "is_null", F.col("long").isNull() & F.col("double").isNull() & F.col("string").isNull())
    per_col = per_value.groupBy("column_no").agg(
        F.count(F.when(~F.col("is_null"), 1)).cast("long").alias("n_values"),
        F.max("n_targets").cast("long").alias("max_targets"),
        F.avg(F.when(~F.col("is_null") & (F.col("n_targets") > 0), F.col("n_targets"))).alias("mean_targets"))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "column_no int, column_name string")
    per_col = per_col.join(F.broadcast(names), "column_no").select(
        "column_name", "n_values", "max_targets", "mean_targets")       # one row per column of the schema
    return per_col.crossJoin(F.broadcast(totals))  # totals is exactly one row


def proxy_findings(evidence: DataFrame, dataset: str, target: str,
                   cfg: AuditConfig = AuditConfig()) -> DataFrame:
    e = evidence.where(F.col("n_values") > 0)  # all-null columns are skipped
    det = (F.col("max_targets") == 1) & (F.col("n_values") > MIN_PROXY_DISTINCT)
    ratio = F.col("n_values") / F.col("rows")
    near = (~det) & (F.col("target_classes") > 1) & (F.col("mean_targets") <= MEAN_TARGETS_LIMIT) & (
        ratio >= cfg.high_cardinality_threshold)
    issue = F.when(det, "deterministic_proxy").when(near, "high_cardinality_proxy")
    sev = F.when(det, "high").when(near, "warning")
    return e.select(F.lit(dataset).alias("dataset"), issue.alias("issue_id"), sev.alias("severity"),
                    F.col("column_name"), F.col("n_values").alias("n"), ratio.alias("fraction")
                    ).where(F.col("issue_id").isNotNull())


# --- GRD-04 -----------------------------------------------------------------------------

def path_token_columns(df: DataFrame, target: str, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """Rows ``column_name`` of string columns that contain '/' or '\\' and any target value."""
    spark = df.sparkSession
    scols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != target]
    empty = spark.createDataFrame([], "column_name string")
    if not scols:
        return empty
    flags = df.agg(*[F.max((F.instr(F.col(c), "/") > 0) | (F.instr(F.col(c), "\\") > 0)).alias(c)
                     for c in scols]).first()
    path_cols = [c for c in scols if flags[c]]
    if not path_cols:
        return empty
    tokens = df.select(F.col(target).cast("string").alias("tok")).where(
        F.col("tok").isNotNull() & (F.col("tok") != "")).distinct()
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in path_cols])
    long = df.select(F.explode(entries).alias("_e")).select("_e.column_name", "_e.value").where(
        F.col("value").isNotNull())
    return columns_with_tokens(long, tokens)


def path_token_findings(df: DataFrame, dataset: str, target: str, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    cols = path_token_columns(df, target, cfg)
    return cols.select(F.lit(dataset).alias("dataset"), F.lit("path_token_leakage").alias("issue_id"),
                       F.lit("high").alias("severity"), "column_name",
                       F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("fraction"))


# --- GRD-05 -----------------------------------------------------------------------------

def time_candidates(df: DataFrame, word: bool = False) -> list[str]:
    pat = re.compile(r"\b" + TIME_COLUMN_PATTERN + r"\b" if word else TIME_COLUMN_PATTERN, re.IGNORECASE)
    ok = (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema.fields if pat.search(f.name) and isinstance(f.dataType, ok)]


def _parsed(df: DataFrame, c: str):
    dt = df.schema[c].dataType
    if isinstance(dt, T.StringType):
        return F.try_to_timestamp(F.col(c))
    if isinstance(dt, T.TimestampNTZType):
        return F.col(c)  # compare wall-clock values directly (no time-zone conversion)
    return F.col(c).cast("timestamp")


def temporal_order(df: DataFrame, key: list[str], columns=None, n_buckets=None) -> DataFrame:
    """Per time column: ``column_name, n_parsed, rows, n_decreases`` in ``key`` order."""
    cols = list(columns) if columns is not None else time_candidates(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column_name string, n_parsed long, rows long, n_decreases long")
    fields = [f"_p{i}" for i in range(len(cols))]
    d = df.select(*[F.col(k) for k in key], *[_parsed(df, c).alias(f) for c, f in zip(cols, fields)])
    val = F.struct(*[F.col(f) for f in fields])
    order = F.col(key[0])
    x = lag_within(d, [], order, val, tiebreak=key[1:], out="_prev", n_buckets=n_buckets)
    aggs = []
    for c, f in zip(cols, fields):
        aggs += [F.count(F.col(f)).cast("long").alias(f"{f}_n"),
                 F.sum(F.when(F.col(f) < F.col(f"_prev.{f}"), 1).otherwise(0)).cast("long").alias(f"{f}_d")]
    row = x.agg(F.count(F.lit(1)).cast("long").alias("rows"), *aggs)
    stack = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{f}_n").alias("n_parsed"),
                               F.col(f"{f}_d").alias("n_decreases")) for c, f in zip(cols, fields)])
    return row.select("rows", F.explode(stack).alias("_s")).select(
        "_s.column_name", "_s.n_parsed", "rows", F.coalesce("_s.n_decreases", F.lit(0)).alias("n_decreases"))


def temporal_findings(df: DataFrame, dataset: str, key: list[str], columns=None, n_buckets=None) -> DataFrame:
    t = temporal_order(df, key, columns, n_buckets)
    unsorted = (F.col("n_parsed") > 0) & ((F.col("n_parsed") < F.col("rows")) | (F.col("n_decreases") > 0))
    return t.where(unsorted).select(
        F.lit(dataset).alias("dataset"), F.lit("temporal_split_warning").alias("issue_id"),
        F.lit("info").alias("severity"), "column_name", F.col("n_decreases").alias("n"),
        F.lit(None).cast("double").alias("fraction"))


# --- GRD-08 -----------------------------------------------------------------------------

def cross_fold_duplicates(df_with_fold: DataFrame, columns: list[str], fold_cols=("fold",)) -> DataFrame:
    """Groups of identical rows (over ``columns``) that span more than one fold.

    Returns ``groups, rows`` (how many duplicate groups are split, how many rows they hold).
    """
    fold = F.struct(*[F.col(c) for c in fold_cols])
    g = df_with_fold.groupBy(*columns).agg(F.countDistinct(fold).alias("_folds"), F.count(F.lit(1)).alias("_rows"))
    return g.where(F.col("_folds") > 1).agg(F.count(F.lit(1)).cast("long").alias("groups"),
                                             F.coalesce(F.sum("_rows"), F.lit(0)).cast("long").alias("rows"))


# --- GRD-06 / GRD-07 -------------------------------------------------------------------

def audit_findings(df: DataFrame, dataset: str, target: str | None = None,
                   cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """All findings of one table as flat rows (``FINDING_SCHEMA``)."""
    spark = df.sparkSession
    tgt = target if target is not None else infer_audit_target(df)
    if tgt is None:
        return spark.createDataFrame([(dataset, "missing_target", "info", None, None, None)], FINDING_SCHEMA)
    parts = [duplicate_findings(df, dataset, cfg),
             proxy_findings(proxy_evidence(df, tgt), dataset, tgt, cfg),
             path_token_findings(df, dataset, tgt, cfg)]
    key = list(cfg.key)
    tcols = time_candidates(df, cfg.word_time_match)
    if key and tcols:
        parts.append(temporal_findings(df, dataset, key, tcols))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_document(df: DataFrame, dataset: str, path: str = "", target: str | None = None,
                   cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """One nested row: ``dataset, path, rows, columns, target, issues[...], status``."""
    tgt = target if target is not None else infer_audit_target(df)
    f = audit_findings(df, dataset, tgt, cfg)
    tmpl = F.create_map(*[x for k, (d, s) in DESCRIPTIONS.items() for x in (F.lit(k), F.lit(d))])
    fix = F.create_map(*[x for k, (d, s) in DESCRIPTIONS.items() for x in (F.lit(k), F.lit(s))])
    desc = F.replace(F.replace(F.replace(tmpl[F.col("issue_id")], F.lit("{column}"),
                                         F.coalesce("column_name", F.lit(""))),
                               F.lit("{target}"), F.lit(tgt or "")),
                     F.lit("{n}"), F.coalesce(F.col("n").cast("string"), F.lit("")))
    issue = F.struct("issue_id", "severity", "column_name", "n", "fraction",
                     desc.alias("description"), fix[F.col("issue_id")].alias("suggested_fix"))
    # findings are bounded by the number of columns, so collecting them per table is safe
    issues = f.agg(F.collect_list(issue).alias("issues"))
    rows = df.agg(F.count(F.lit(1)).cast("long").alias("rows"))
    doc = rows.crossJoin(issues)
    return doc.select(F.lit(dataset).alias("dataset"), F.lit(path).alias("path"), "rows",
                      F.lit(len(df.columns)).cast("long").alias("columns"), F.lit(tgt).alias("target"),
                      "issues",
                      F.when(F.size("issues") == 0, "pass").otherwise("issues_found").alias("status"))


def audit_index(docs: DataFrame) -> DataFrame:
    """``dataset, status, issue_count, path`` over audit documents (SNK-06 index)."""
    return docs.select("dataset", "status", F.size("issues").cast("long").alias("issue_count"), "path")

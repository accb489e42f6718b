"""Registered queries: each is a Spark job over the given tables plus its DuckDB oracle.

``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, oracle SQL or None)``. Every double
column is rounded to 6 decimals on both sides (summation order differs between
engines); counts are BIGINT on both sides. Queries without SQL (iterative ML, tree
ensembles) get the driver's rows-only check and are covered by tolerance tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldline.functions.hashing import sql_h15, sql_h8
from foldline.functions.names import safe_col_expr
from foldline.operators import guardrails as G
from foldline.operators import profile as P
from foldline.operators import reports as R
from foldline.operators import splits as S
from foldline.plans import derived as D
from foldline.plans import sqlgen as Q

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf_dir):
            return finish(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = (run, sql)
        return run
    return deco


def _t(spark, sf_dir, name):
    return D.table(spark, sf_dir, name)


def _pages(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    return p.withColumn("page_lang", F.regexp_extract("html", 'lang="([a-z]+)"', 1))


# ======================================================================================
# Guardrails (GRD-*)
# ======================================================================================

AUDITS = {
    # table: (target, key)
    # (orderkey, linenumber) repeats in this table; rows tied on the key also tie on the
    # audited date, so the decrease count does not depend on the order inside a tie.
    "lineitem": ("l_returnflag", ["l_orderkey", "l_linenumber", "l_shipdate"]),
    "orders": ("o_orderstatus", ["o_orderkey"]),
    "customer": ("c_mktsegment", ["c_custkey"]),
    "events": ("event_type", ["event_id"]),
    "pages": ("page_lang", ["page_id"]),
}


def _audit_source(spark, sf_dir, table):
    return _pages(spark, sf_dir) if table == "pages" else _t(spark, sf_dir, table)


def _register_audit(table):
    target, key = AUDITS[table]

    @query(f"grd_findings_{table}", Q.sql_findings(table, target, key))
    def _q(spark, sf_dir):
        """GRD-01..05 + GRD-07 findings of one table (flat)."""
        df = _audit_source(spark, sf_dir, table)
        return G.audit_findings(df, table, target, G.AuditConfig(key=tuple(key)))


for _tbl in AUDITS:
    _register_audit(_tbl)


@query("grd_proxy_evidence_lineitem", Q.sql_proxy_evidence("lineitem", "l_returnflag"))
def grd_proxy_evidence_lineitem(spark, sf_dir):
    """GRD-02/03 evidence: per column distinct values and targets per value (one job, all columns)."""
    return G.proxy_evidence(_t(spark, sf_dir, "lineitem"), "l_returnflag")


@query("grd_proxy_evidence_events", Q.sql_proxy_evidence("events", "event_type"))
def grd_proxy_evidence_events(spark, sf_dir):
    """GRD-02/03 evidence on the event stream table."""
    return G.proxy_evidence(_t(spark, sf_dir, "events"), "event_type")


@query("grd_duplicates_documents", """SELECT CAST(sum(c) AS BIGINT) AS rows, CAST(sum(c - 1) AS BIGINT) AS duplicates,
       round(sum(c - 1) / sum(c), 6) AS fraction FROM (SELECT count(*) AS c FROM documents GROUP BY text) g""")
def grd_duplicates_documents(spark, sf_dir):
    """GRD-01 over the whole text of every document (exact copies)."""
    return G.duplicate_summary(_t(spark, sf_dir, "documents"), ["text"])


@query("grd_cross_fold_duplicates_documents", f"""SELECT count(*) AS groups, CAST(coalesce(sum(r), 0) AS BIGINT) AS rows
FROM (SELECT text, count(DISTINCT fold) AS f, count(*) AS r
      FROM (SELECT text, CAST((row_number() OVER (ORDER BY {sql_h15('42', 'doc_id')}, doc_id) - 1) % 5 AS INTEGER) AS fold
            FROM documents) a GROUP BY text) g WHERE f > 1""")
def grd_cross_fold_duplicates_documents(spark, sf_dir):
    """GRD-08: identical texts that a shuffled 5-fold split puts into different folds."""
    d = S.kfold(_t(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], k=5, seeds=[42])
    return G.cross_fold_duplicates(d, ["text"], ["fold"])


@query("grd_temporal_orders", Q.sql_temporal("orders", ["o_orderkey"], ["o_orderdate"]))
def grd_temporal_orders(spark, sf_dir):
    """GRD-05 / WIN-04: monotonicity of the order date in key order (bucketed lag)."""
    return G.temporal_order(_t(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderdate"])


@query("grd_temporal_events", Q.sql_temporal("events", ["event_id"], ["ts"]))
def grd_temporal_events(spark, sf_dir):
    """GRD-05 / WIN-04 on the event stream: is ``ts`` non-decreasing in event_id order."""
    return G.temporal_order(_t(spark, sf_dir, "events"), ["event_id"], ["ts"])


# ======================================================================================
# Profiling (PRJ-*)
# ======================================================================================

@query("prj_column_profile_lineitem", Q.sql_column_profile("lineitem"))
def prj_column_profile_lineitem(spark, sf_dir):
    """PRJ-16: dtype, missing %, distinct per column in one job."""
    return P.column_profile(_t(spark, sf_dir, "lineitem"))


@query("prj_column_profile_pages", Q.sql_column_profile("pages"))
def prj_column_profile_pages(spark, sf_dir):
    """PRJ-16 over whole web pages."""
    return P.column_profile(_pages(spark, sf_dir))


def _binary_sql(table):
    parts = []
    for c, t in Q.SCHEMAS[table]:
        v = f"CAST({c} AS VARCHAR)"
        parts.append(f"""SELECT '{c}' AS column_name, (count(DISTINCT {c}) BETWEEN 1 AND 2) AS n_distinct_le2,
       (count({c}) > 0 AND coalesce(bool_and({v} IS NULL OR trim({v}) = '' OR lower(trim({v})) IN ('yes','no','true','false','0','1')), true)) AS token_subset,
       ({'true' if t == 'boolean' else 'false'} OR count(DISTINCT {c}) BETWEEN 1 AND 2 OR (count({c}) > 0 AND coalesce(bool_and({v} IS NULL OR trim({v}) = '' OR lower(trim({v})) IN ('yes','no','true','false','0','1')), true))) AS is_binary
FROM {Q._src(table)} s""")
    return "\nUNION ALL\n".join(parts)


@query("prj_binary_flags_orders", _binary_sql("orders"))
def prj_binary_flags_orders(spark, sf_dir):
    """PRJ-04: binary-like columns (≤2 distinct or yes/no tokens) in two narrow passes."""
    return P.binary_flags(_t(spark, sf_dir, "orders"))


def _advice_sql(table):
    parts = []
    for c, t in Q.SCHEMAS[table]:
        if t in ("int", "bigint"):
            sug = (f"CASE WHEN min({c}) IS NULL THEN 'bigint' WHEN min({c}) > -128 AND max({c}) < 127 THEN 'tinyint' "
                   f"WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'smallint' "
                   f"WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE 'bigint' END")
        elif t == "double":
            sug = f"CASE WHEN min({c}) > -3.4e38 AND max({c}) < 3.4e38 THEN 'float' ELSE 'double' END"
        elif t == "string":
            sug = f"CASE WHEN count(DISTINCT {c}) / count(*) < 0.5 THEN 'category' ELSE 'string' END"
        else:
            sug = f"max('{t}')"
        parts.append(f"SELECT '{c}' AS column_name, '{t}' AS current, {sug} AS suggested FROM {Q._src(table)} s")
    return "\nUNION ALL\n".join(parts)


@query("prj_type_advice_lineitem", _advice_sql("lineitem"))
def prj_type_advice_lineitem(spark, sf_dir):
    """PRJ-10/11: narrowest-type and dictionary-encoding advice from one min/max/distinct aggregate."""
    return P.type_advice(_t(spark, sf_dir, "lineitem"))


def _task_sql(table):
    parts = []
    for c, t in Q.SCHEMAS[table]:
        if t not in ("int", "bigint", "double"):
            continue
        frac = f"coalesce(max(CASE WHEN {c} <> floor({c}) THEN 1 ELSE 0 END), 0) = 1" if t == "double" else "false"
        parts.append(f"""SELECT '{c}' AS column_name, {frac} AS has_fraction, count(DISTINCT {c}) AS n_distinct,
       CASE WHEN {frac} THEN 'regression' ELSE 'classification' END AS task_a,
       CASE WHEN count(DISTINCT {c}) > 20 THEN 'regression' ELSE 'classification' END AS task_b FROM {Q._src(table)} s""")
    return "\nUNION ALL\n".join(parts)


@query("prj_task_inference_part", _task_sql("part"))
def prj_task_inference_part(spark, sf_dir):
    """PRJ-08: fractional-part rule and >20-distinct rule per numeric column."""
    return P.task_table(_t(spark, sf_dir, "part"))


def _stats_sql(tables):
    parts = []
    for table in tables:
        cands = " || ',' || ".join([])
        sel = []
        for c, _ in Q.SCHEMAS[table]:
            sel.append(f"CASE WHEN count(DISTINCT {c}) <= 20 THEN '{c}' END")
        arr = "array_to_string(list_filter([" + ", ".join(sel) + "], lambda x: x IS NOT NULL), ',')"
        _ = cands
        parts.append(f"SELECT '{table}' AS dataset, count(*) AS rows, CAST({len(Q.SCHEMAS[table])} AS BIGINT) AS columns, "
                     f"{arr} AS target_candidates FROM {Q._src(table)} s")
    return "\nUNION ALL\n".join(parts)


@query("prj_table_stats", _stats_sql(["lineitem", "orders", "customer", "part", "events"]))
def prj_table_stats(spark, sf_dir):
    """PRJ-17 / dataset registry: rows, columns, target candidates (≤20 distinct) per table."""
    out = None
    for t in ["lineitem", "orders", "customer", "part", "events"]:
        s = P.table_stats(_t(spark, sf_dir, t), t).withColumn(
            "target_candidates", F.array_join("target_candidates", ","))
        out = s if out is None else out.unionByName(s)
    return out


@query("prj_label_encode_part", """SELECT p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS p_brand_code
FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL) v""")
def prj_label_encode_part(spark, sf_dir):
    """PRJ-12: codes by sorted value (distributed rank of the distinct values)."""
    return R.label_rank(_t(spark, sf_dir, "part"), "p_brand", out="p_brand_code")


@query("prj_safe_names_part", """SELECT p_partkey,
  CASE WHEN s = '' THEN 'col' ELSE s END AS safe_type
FROM (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_type, '[^0-9a-zA-Z_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM part) x""")
def prj_safe_names_part(spark, sf_dir):
    """PRJ-01 applied to values: the column-name cleaning rule as a Column expression."""
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", safe_col_expr(F.col("p_type")).alias("safe_type"))


@query("prj_yes_no_labels", """SELECT raw, CASE WHEN lower(trim(raw)) IN ('yes','y','true','1','present') THEN 1 ELSE 0 END AS mapped,
       count(*) AS n
FROM (SELECT CASE WHEN quality = 1 THEN ' Yes' ELSE 'no ' END AS raw FROM labels) x GROUP BY ALL""")
def prj_yes_no_labels(spark, sf_dir):
    """PRJ-13: yes/no target normalisation guarded by 'every value is a yes/no token'."""
    lab = _t(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, " Yes").otherwise("no ").alias("raw"))
    m = P.yes_no_normalise(lab.withColumn("mapped", F.col("raw")), "mapped")
    return m.groupBy("raw", "mapped").agg(F.count(F.lit(1)).alias("n"))


@query("prj_coerce_page_numbers", """SELECT page_id, TRY_CAST(split_part(url, '/', 5) AS DOUBLE) AS page_number
FROM pages WHERE TRY_CAST(split_part(url, '/', 5) AS DOUBLE) IS NOT NULL AND NOT isnan(TRY_CAST(split_part(url, '/', 5) AS DOUBLE))""")
def prj_coerce_page_numbers(spark, sf_dir):
    """PRJ-14: try_cast to double and drop rows whose coerced target is missing."""
    p = _t(spark, sf_dir, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(5)).alias("page_number"))
    return P.coerce_numeric_target(p, "page_number")


@query("prj_missing_sentinel_documents", """SELECT coalesce(CAST(l.quality AS VARCHAR), '__nan__') AS quality, count(*) AS n
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def prj_missing_sentinel_documents(spark, sf_dir):
    """PRJ-15: missing categories become '__nan__' (unlabelled documents)."""
    d = _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy(P.missing_sentinel(F.col("quality")).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@query("prj_chart_feed_orders", f"""SELECT dataset, framework, round(accuracy, 6) AS accuracy FROM {D.LEADERBOARD_SQL} lb
WHERE dataset IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3', 'NATION_4') AND accuracy IS NOT NULL""")
def prj_chart_feed_orders(spark, sf_dir):
    """PRJ-22/23: dataset membership filter, metric projection, dropna, sort."""
    lb = D.leaderboard_df(spark, sf_dir)
    sel = ["NATION_0", "NATION_1", "NATION_2", "NATION_3", "NATION_4"]
    return lb.where(F.col("dataset").isin(sel)).select("dataset", "framework", "accuracy").na.drop().orderBy(
        "dataset", "framework")


# ======================================================================================
# Splits (SPL-*, STX-01/02)
# ======================================================================================

@query("spl_kfold_lineitem", f"""SELECT l_orderkey, l_linenumber, seed,
  CAST((row_number() OVER (PARTITION BY seed ORDER BY {sql_h15('seed', 'l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber) - 1) % 5 AS INTEGER) AS fold
FROM lineitem, (SELECT unnest([42, 77]) AS seed) s""")
def spl_kfold_lineitem(spark, sf_dir):
    """SPL-01 + SPL-03: shuffled 5-fold over every line item, repeated for seeds 42 and 77."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return S.kfold(li, ["l_orderkey", "l_linenumber"], k=5, seeds=S.DEFAULT_SEEDS)


_STRAT_SQL = f"""SELECT o_orderkey, o_orderstatus, seed,
  CAST((rk + off) % 5 AS INTEGER) AS fold
FROM (SELECT o_orderkey, o_orderstatus, seed,
        row_number() OVER (PARTITION BY seed, o_orderstatus ORDER BY {sql_h15('seed', 'o_orderkey')}, o_orderkey) - 1 AS rk
      FROM orders, (SELECT unnest([42, 77]) AS seed) s) r
JOIN (SELECT seed, o_orderstatus, coalesce(sum(n) OVER (PARTITION BY seed ORDER BY o_orderstatus ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
      FROM (SELECT seed, o_orderstatus, count(*) AS n FROM orders, (SELECT unnest([42, 77]) AS seed) s GROUP BY 1, 2) c) o
USING (seed, o_orderstatus)"""


@query("spl_stratified_orders", _STRAT_SQL)
def spl_stratified_orders(spark, sf_dir):
    """SPL-02 + SPL-03: stratified shuffled 5-fold on order status, seeds 42 and 77."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return S.stratified_kfold(o, ["o_orderkey"], "o_orderstatus", k=5, seeds=S.DEFAULT_SEEDS)


@query("spl_fold_balance_orders", f"SELECT seed, o_orderstatus, fold, count(*) AS n FROM ({_STRAT_SQL}) x GROUP BY ALL")
def spl_fold_balance_orders(spark, sf_dir):
    """SPL-02 check table: rows per (seed, class, fold) — classes spread evenly."""
    return spl_stratified_orders(spark, sf_dir).groupBy("seed", "o_orderstatus", "fold").agg(
        F.count(F.lit(1)).alias("n"))


@query("spl_holdout_orders", f"""SELECT o_orderkey, rk < ceil(n * 0.2) AS is_test
FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {sql_h15('42', 'o_orderkey')}, o_orderkey) - 1 AS rk,
             count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) x""")
def spl_holdout_orders(spark, sf_dir):
    """SPL-04: stratified 80/20 holdout by hash rank within each class."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return S.holdout(o, ["o_orderkey"], "o_orderstatus", 0.2, seed=42).select("o_orderkey", "is_test")


@query("spl_bernoulli_customer", f"""SELECT c_custkey, ({sql_h8('42', 'c_custkey')} / 4294967296.0) < 0.8 AS is_train FROM customer""")
def spl_bernoulli_customer(spark, sf_dir):
    """SPL-05: hashed Bernoulli 0.8 split (no shuffle)."""
    return S.bernoulli_split(_t(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 0.8, seed=42)


@query("spl_sample_documents", f"""SELECT doc_id, lang FROM documents ORDER BY {sql_h15('42', 'doc_id')}, doc_id LIMIT 50""")
def spl_sample_documents(spark, sf_dir):
    """SPL-07: deterministic 50-row sample by seed (the limit is the operator)."""
    return S.sample_n(_t(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], 50, seed=42)


@query("stx_group_kfold_lineitem", f"""SELECT l.l_orderkey, l.l_linenumber, g.fold FROM lineitem l JOIN (
  SELECT l_orderkey, CAST(CASE WHEN rk % 10 < 5 THEN rk % 10 ELSE 9 - rk % 10 END AS INTEGER) AS fold
  FROM (SELECT l_orderkey, row_number() OVER (ORDER BY n DESC, {sql_h15('42', 'l_orderkey')}, l_orderkey) - 1 AS rk
        FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) s) r) g ON l.l_orderkey = g.l_orderkey""")
def stx_group_kfold_lineitem(spark, sf_dir):
    """STX-01: group 5-fold on the order key (all lines of an order share a fold)."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return S.group_kfold(li, "l_orderkey", k=5, seed=42)


@query("stx_time_split_events", """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS rk,
         count(*) OVER () AS n FROM events),
s AS (SELECT unnest(range(0, 5)) AS split)
SELECT event_id, CAST(split AS INTEGER) AS split,
       CASE WHEN rk < n - (5 - split) * (n // 6) THEN 'train' ELSE 'test' END AS role
FROM r, s WHERE rk < n - (5 - split) * (n // 6) + (n // 6)""")
def stx_time_split_events(spark, sf_dir):
    """STX-02: expanding-window time-series splits (5) over events by timestamp."""
    e = _t(spark, sf_dir, "events").select("event_id", "ts")
    return S.time_series_split(e, "ts", ["event_id"], n_splits=5).select("event_id", "split", "role")


# ======================================================================================
# Dataset catalogue (PRJ-05/06/08b/17/18, JOI-05)
# ======================================================================================

CATALOGUE_TABLES = ["customer", "events", "labels", "lineitem", "orders", "part"]
CATALOGUE_SCHEMAS = {
    **Q.SCHEMAS,
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
}
CATALOGUE_SOURCE = "driver"
CATALOGUE_LICENSE = "unknown"


def _catalogue_row(spark, sf_dir, table):
    from foldline.operators.guardrails import infer_audit_target
    df = _t(spark, sf_dir, table)
    target = P.guess_target_column(df)
    audit = infer_audit_target(df)
    dt = df.schema[target].dataType
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(target).alias("k")).first()
    numeric = isinstance(dt, (T.NumericType,))
    task = "regression" if numeric and stats["k"] > P.REGRESSION_MIN_DISTINCT else "classification"
    return (table, "tabular", task, int(stats["n"]), len(df.columns) - 1,
            int(stats["k"]) if task == "classification" else None, target, audit)


def _catalogue_sql():
    parts = []
    for table in CATALOGUE_TABLES:
        cols = CATALOGUE_SCHEMAS[table]
        flags = []
        for pos, (c, t) in enumerate(cols):
            v = f"CAST({c} AS VARCHAR)"
            tok = (f"(count({c}) > 0 AND coalesce(bool_and({v} IS NULL OR trim({v}) = '' OR "
                   f"lower(trim({v})) IN ('yes','no','true','false','0','1')), true))")
            flags.append(f"SELECT {pos} AS pos, '{c}' AS c, (count(DISTINCT {c}) BETWEEN 1 AND 2 OR {tok}) AS b FROM {table}")
        last = cols[-1][0]
        target = (f"coalesce((SELECT c FROM f WHERE b AND lower(c) LIKE 'i%' ORDER BY pos LIMIT 1), "
                  f"(SELECT c FROM f WHERE b ORDER BY pos LIMIT 1), '{last}')")
        names = [c.lower() for c, _ in cols]
        cand = next((c for c in ["target", "class", "label", "variety", "species", "diagnosis", "survived", "salary"]
                     if c in names), None)
        audit = f"'{cand}'" if cand else f"(SELECT CASE WHEN count(DISTINCT {last}) <= 50 THEN '{last}' END FROM {table})"
        num = {c for c, t in cols if t in ("int", "bigint", "double")}
        k_expr = " ".join(f"WHEN tg = '{c}' THEN (SELECT count(DISTINCT {c}) FROM {table})" for c, _ in cols)
        parts.append(f"""(WITH f AS ({" UNION ALL ".join(flags)}),
tgt AS (SELECT {target} AS tg),
k AS (SELECT tg, CASE {k_expr} END AS k FROM tgt)
SELECT '{table}' AS name, 'tabular' AS modality,
  CASE WHEN tg IN ({", ".join(f"'{c}'" for c in num) or "''"}) AND k > 20 THEN 'regression' ELSE 'classification' END AS task,
  (SELECT count(*) FROM {table}) AS n_samples, CAST({len(cols) - 1} AS BIGINT) AS n_features,
  CASE WHEN NOT (tg IN ({", ".join(f"'{c}'" for c in num) or "''"}) AND k > 20) THEN k END AS n_classes,
  tg AS target, {audit} AS audit_target, '{CATALOGUE_SOURCE}' AS source, '{CATALOGUE_LICENSE}' AS license FROM k)""")
    return "\nUNION ALL\n".join(parts)


@query("prj_dataset_catalogue", _catalogue_sql())
def prj_dataset_catalogue(spark, sf_dir):
    """PRJ-05/06/08/17/18 + JOI-05: one catalogue row per driver table (guessed and audit targets,
    task, samples, features, classes), with source/license from a registry and an 'unknown' default."""
    rows = [_catalogue_row(spark, sf_dir, t) for t in CATALOGUE_TABLES]
    cat = spark.createDataFrame(rows, "name string, modality string, task string, n_samples long, n_features long, "
                                      "n_classes long, target string, audit_target string")
    registry = spark.createDataFrame([], "name string, source string, license string")
    from foldline.operators.reports import registry_lookup
    out = registry_lookup(cat, registry, "name", ["source"], default=CATALOGUE_SOURCE)
    out = out.withColumn("license", F.coalesce("license", F.lit(CATALOGUE_LICENSE)))
    return out.orderBy("modality", "name")


@query("stx_ingest_texts", """WITH u AS (SELECT text, 0 AS o FROM documents UNION ALL SELECT text, 1 FROM benchmark
                   UNION ALL SELECT text, 2 FROM conversations),
w AS (SELECT text, min(o) AS o FROM u GROUP BY text)
SELECT CASE o WHEN 0 THEN 'documents' WHEN 1 THEN 'benchmark' ELSE 'conversations' END AS source, count(*) AS n
FROM w GROUP BY 1""")
def stx_ingest_texts(spark, sf_dir):
    """STX-05: ingest texts from three sources, union by name, de-duplicate whole texts (earliest source wins)."""
    from foldline.sources.readers import ingest_sources
    frames = [_t(spark, sf_dir, "documents").select("text", "lang"), _t(spark, sf_dir, "benchmark").select("text"),
              _t(spark, sf_dir, "conversations").select("text", "role")]
    u = ingest_sources(frames, key=["text"], source_names=["documents", "benchmark", "conversations"])
    return u.groupBy(F.col("_source").alias("source")).agg(F.count(F.lit(1)).alias("n"))

"""DuckDB text of the oracle queries that depend on a table's column list.

The column lists are the driver tables' schemas (``TESTDATA.md``); the generated SQL is
an independent, row-at-a-time statement of the same semantics as the Spark operators.
"""

from __future__ import annotations

# (column, spark type) per audited table, in schema order.
SCHEMAS = {
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string"), ("page_lang", "string")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")],
}

PAGES_SOURCE_SQL = ("(SELECT page_id, url, html, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS page_lang "
                    "FROM pages)")


def _src(table: str) -> str:
    return PAGES_SOURCE_SQL if table == "pages" else table


def sql_long(table: str, target: str) -> str:
    cols = [c for c, _ in SCHEMAS[table] if c != target]
    parts = [f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, CAST({target} AS VARCHAR) AS t "
             f"FROM {_src(table)} s" for c in cols]
    return " UNION ALL ".join(parts)


def sql_proxy_evidence(table: str, target: str) -> str:
    return f"""WITH long AS ({sql_long(table, target)}),
triples AS (SELECT DISTINCT column_name, value, t FROM long),
per_value AS (SELECT column_name, value, count(t) AS n_targets FROM triples GROUP BY column_name, value),
per_col AS (SELECT column_name, count(value) AS n_values, max(n_targets) AS max_targets,
                   avg(CASE WHEN value IS NOT NULL AND n_targets > 0 THEN n_targets END) AS mean_targets
            FROM per_value GROUP BY column_name)
SELECT column_name, n_values, max_targets, round(mean_targets, 6) AS mean_targets,
       (SELECT count(*) FROM {_src(table)} s) AS rows,
       (SELECT count(DISTINCT {target}) FROM {_src(table)} s) AS target_classes
FROM per_col"""


def sql_findings(table: str, target: str, key: list[str], dataset: str | None = None,
                 min_rows: int = 50, threshold: float = 0.98) -> str:
    ds = dataset or table
    src = _src(table)
    cols = [c for c, _ in SCHEMAS[table]]
    all_cols = ", ".join(cols)
    str_cols = [c for c, t in SCHEMAS[table] if t == "string" and c != target]
    import re
    time_cols = [c for c, t in SCHEMAS[table]
                 if re.search(r"(date|time|timestamp)", c, re.IGNORECASE) and t in ("string", "timestamp", "timestamp_ntz")]
    parts = []
    # duplicates
    parts.append(f"""SELECT '{ds}' AS dataset, 'duplicate_rows' AS issue_id, 'warning' AS severity,
       CAST(NULL AS VARCHAR) AS column_name, CAST(sum(c - 1) AS BIGINT) AS n,
       round(sum(c - 1) / sum(c), 6) AS fraction
FROM (SELECT count(*) AS c FROM {src} s GROUP BY {all_cols}) g
HAVING sum(c) >= {min_rows} AND sum(c - 1) > 0""")
    # proxies
    parts.append(f"""SELECT '{ds}' AS dataset,
       CASE WHEN det THEN 'deterministic_proxy' ELSE 'high_cardinality_proxy' END AS issue_id,
       CASE WHEN det THEN 'high' ELSE 'warning' END AS severity, column_name, n_values AS n,
       round(n_values / rows, 6) AS fraction
FROM (SELECT *, (max_targets = 1 AND n_values > 3) AS det,
             (target_classes > 1 AND mean_targets <= 1.05 AND n_values / rows >= {threshold}) AS near
      FROM ({sql_proxy_evidence(table, target)}) e WHERE n_values > 0) x
WHERE det OR near""")
    # path tokens
    if str_cols:
        tok = f"(SELECT DISTINCT CAST({target} AS VARCHAR) AS tok FROM {src} s WHERE {target} IS NOT NULL AND CAST({target} AS VARCHAR) <> '')"
        for c in str_cols:
            parts.append(f"""SELECT '{ds}' AS dataset, 'path_token_leakage' AS issue_id, 'high' AS severity,
       '{c}' AS column_name, CAST(NULL AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS fraction
WHERE EXISTS (SELECT 1 FROM {src} s WHERE contains({c}, '/') OR contains({c}, '\\'))
  AND EXISTS (SELECT 1 FROM {src} s, {tok} tk WHERE {c} IS NOT NULL AND contains({c}, tk.tok))""")
    # temporal
    if key and time_cols:
        order = ", ".join(key)
        for c in time_cols:
            typ = dict(SCHEMAS[table])[c]
            parsed = f"TRY_CAST({c} AS TIMESTAMP)" if typ == "string" else c
            parts.append(f"""SELECT '{ds}' AS dataset, 'temporal_split_warning' AS issue_id, 'info' AS severity,
       '{c}' AS column_name, CAST(n_dec AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS fraction
FROM (SELECT count(p) AS n_parsed, count(*) AS rows, coalesce(sum(CASE WHEN p < pp THEN 1 ELSE 0 END), 0) AS n_dec
      FROM (SELECT p, lag(p) OVER (ORDER BY {order}) AS pp FROM (SELECT {parsed} AS p, {order} FROM {src} s) a) b) t
WHERE n_parsed > 0 AND (n_parsed < rows OR n_dec > 0)""")
    return "\nUNION ALL\n".join(parts)


def sql_temporal(table: str, key: list[str], columns: list[str]) -> str:
    order = ", ".join(key)
    parts = []
    for c in columns:
        parts.append(f"""SELECT '{c}' AS column_name, count(p) AS n_parsed, count(*) AS rows,
       CAST(coalesce(sum(CASE WHEN p < pp THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_decreases
FROM (SELECT p, lag(p) OVER (ORDER BY {order}) AS pp FROM (SELECT CAST({c} AS TIMESTAMP) AS p, {order} FROM {_src(table)} s) a) b""")
    return "\nUNION ALL\n".join(parts)


def sql_column_profile(table: str) -> str:
    parts = []
    for c, t in SCHEMAS[table]:
        parts.append(f"""SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) AS rows,
       count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_pct,
       count(DISTINCT {c}) AS n_distinct FROM {_src(table)} s""")
    return "\nUNION ALL\n".join(parts)

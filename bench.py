"""Benchmark the headline queries and print ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (optional comma list to run a subset). Each query is executed completely
with the ``noop`` sink (no driver collection); the value is the sum of query seconds.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "grd_findings_lineitem",            # flagship leakage audit (duplicates, proxies, paths, temporal order)
    "grd_proxy_evidence_lineitem",
    "grd_findings_pages",
    "grd_cross_fold_duplicates_documents",
    "prj_column_profile_lineitem",
    "spl_kfold_lineitem",
    "spl_stratified_orders",
    "met_binary_documents_by_lang",
    "met_multiclass_embeddings",
    "agg_framework_summary_lineitem",
    "agg_bootstrap_ci_lineitem",
    "agg_paired_tests_lineitem",
    "win_pareto_suppliers",
    "fea_impute_stats_lineitem",
    "fea_scaled_values_lineitem",
    "fea_kbins_lineitem",
    "fea_tfidf_documents",
    "stx_target_encoding_lineitem",
    "str_request_counts_events",
    "ano_isolation_forest_lineitem",
    "trn_refit_score_orders",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    from foldline.session import get_spark
    from foldline.plans.registry import all_queries

    events = tempfile.mkdtemp(prefix="foldline-bench-events-")
    spark = get_spark("foldline-bench", master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2),
                      extra={"spark.driver.memory": "16g", "spark.eventLog.enabled": "true",
                             "spark.eventLog.dir": events})
    spark.sparkContext.setLogLevel("ERROR")
    qs = all_queries()
    # warm-up (JVM, codegen caches, Python workers) is not query time
    spark.read.parquet(f"{sf_dir}/region.parquet").groupBy("r_name").count().collect()
    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().toPandas()
    times: dict[str, float] = {}
    for name in names:
        fn, _ = qs[name]
        t0 = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else None, "cpus": cpus}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()

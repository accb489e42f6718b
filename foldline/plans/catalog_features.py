"""Registered fold-safe feature queries (FEA-*, STX-03/04/09) and TF-IDF (FEA-13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldline.functions.hashing import sql_h15
from foldline.operators import features as FE
from foldline.operators import text as TX
from foldline.plans.catalog import _t, query

K = 5
NUM = ["l_quantity", "l_extendedprice", "l_discount"]

# lineitem rows with their 5-fold assignment (seed 42); the DuckDB twin of ``_li_folds``
LI_FOLDS_SQL = f"""(SELECT *, CAST((row_number() OVER (ORDER BY {sql_h15('42', 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')},
       l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) - 1) % 5 AS INTEGER) AS fold
  FROM lineitem)"""
_LI_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_LI_TIE = ["l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]


def _li_folds(spark, sf_dir, columns=None):
    """All columns of lineitem, or ``columns``, with the fold."""
    from foldline.functions.hashing import h15
    from foldline.functions.ordered import rank_within, spread
    li = spread(_t(spark, sf_dir, "lineitem"))
    # the hash key plus every remaining column as tie-break: identical rows may swap, harmlessly
    d = li.withColumn("_h", h15(F.lit(42), *[F.col(c) for c in _LI_ID]))
    r = rank_within(d, [], F.col("_h"), tiebreak=_LI_ID + _LI_TIE, out="_rk")
    folds = r.withColumn("fold", (F.col("_rk") % K).cast("int")).drop("_h", "_rk")
    if columns is not None:
        folds = folds.select(*columns, "fold")
    # every fold statistic reads the assignment several times: materialise it once in the
    # shared checkpoint folder (cuts the lineage; survives executor loss)
    from foldline.session import checkpoint_dir
    checkpoint_dir(spark)
    return folds.checkpoint(eager=True)


def _train_join(cols: str) -> str:
    return f"(SELECT g.g AS fold, {cols} FROM {LI_FOLDS_SQL} f JOIN range(0, {K}) g(g) ON f.fold <> g.g)"


@query("fea_impute_stats_lineitem", " UNION ALL ".join(
    f"SELECT CAST(fold AS INTEGER) AS fold, '{c}' AS column_name, round(quantile_cont({c}, 0.5), 6) AS median, "
    f"round(avg({c}), 6) AS mean FROM {_train_join(c)} t GROUP BY fold" for c in NUM))
def fea_impute_stats_lineitem(spark, sf_dir):
    """FEA-01: exact median and mean of each fold's training rows (imputation statistics)."""
    f = _li_folds(spark, sf_dir, NUM)
    med = FE.training_medians(f, "fold", NUM, K)
    mom = FE.training_moments(f, "fold", NUM, K).select("fold", "column_name", "mean")
    return med.join(mom, ["fold", "column_name"])


@query("fea_scaler_stats_lineitem", " UNION ALL ".join(
    f"SELECT CAST(fold AS INTEGER) AS fold, '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, "
    f"round(stddev_pop({c}), 6) AS std FROM {_train_join(c)} t GROUP BY fold" for c in NUM))
def fea_scaler_stats_lineitem(spark, sf_dir):
    """FEA-03: training-fold mean and population std merged from per-fold moments (no rescans)."""
    return FE.training_moments(_li_folds(spark, sf_dir), "fold", NUM, K)


@query("fea_scaled_values_lineitem", f"""WITH s AS (SELECT fold, avg(l_extendedprice) AS mu, stddev_pop(l_extendedprice) AS sd
  FROM {_train_join('l_extendedprice')} t GROUP BY fold)
SELECT f.l_orderkey, f.l_linenumber, f.fold,
  round((f.l_extendedprice - s.mu) / CASE WHEN s.sd = 0 THEN 1.0 ELSE s.sd END, 6) AS l_extendedprice_scaled,
  round(f.l_discount / CASE WHEN d.sd = 0 THEN 1.0 ELSE d.sd END, 6) AS l_discount_unscaled_centre
FROM {LI_FOLDS_SQL} f JOIN s ON f.fold = s.fold
JOIN (SELECT fold, stddev_pop(l_discount) AS sd FROM {_train_join('l_discount')} t GROUP BY fold) d ON f.fold = d.fold""")
def fea_scaled_values_lineitem(spark, sf_dir):
    """FEA-03/04: held-out rows scaled with their fold's training statistics (centred and not)."""
    f = _li_folds(spark, sf_dir)
    mom = FE.training_moments(f, "fold", ["l_extendedprice", "l_discount"], K)
    a = FE.scale(f, "fold", ["l_extendedprice"], mom, center=True, suffix="_scaled")
    b = FE.scale(a, "fold", ["l_discount"], mom, center=False, suffix="_unscaled_centre")
    return b.select("l_orderkey", "l_linenumber", "fold", "l_extendedprice_scaled", "l_discount_unscaled_centre")


@query("fea_mode_lineitem", " UNION ALL ".join(
    f"""SELECT CAST(fold AS INTEGER) AS fold, '{c}' AS column_name, arg_min(v, struct_pack(nc := -n, v := v)) AS mode
FROM (SELECT fold, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {_train_join(c)} t WHERE {c} IS NOT NULL GROUP BY 1, 2) x GROUP BY fold"""
    for c in ["l_returnflag", "l_linestatus", "l_linenumber"]))
def fea_mode_lineitem(spark, sf_dir):
    """FEA-02: most frequent training value per fold (ties → smallest), from per-fold counts."""
    return FE.training_modes(_li_folds(spark, sf_dir), "fold", ["l_returnflag", "l_linestatus", "l_linenumber"], K)


@query("fea_kbins_lineitem", f"""WITH qe AS (SELECT fold, quantile_cont(l_extendedprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e
            FROM {_train_join('l_extendedprice')} t GROUP BY fold),
ue AS (SELECT fold, min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM {_train_join('l_extendedprice')} t GROUP BY fold),
b AS (SELECT f.fold,
        len(list_filter(list_slice(list_filter(qe.e, lambda x, i: i = 1 OR x - qe.e[i - 1] > 1e-8), 2, -2), lambda v: v <= f.l_extendedprice)) AS bin_quantile,
        len(list_filter([ue.mn + 1 * ((ue.mx - ue.mn) / 5), ue.mn + 2 * ((ue.mx - ue.mn) / 5), ue.mn + 3 * ((ue.mx - ue.mn) / 5), ue.mn + 4 * ((ue.mx - ue.mn) / 5)],
                        lambda v: v <= f.l_extendedprice)) AS bin_uniform
      FROM {LI_FOLDS_SQL} f JOIN qe ON f.fold = qe.fold JOIN ue ON f.fold = ue.fold)
SELECT fold, CAST(bin_quantile AS INTEGER) AS bin_quantile, CAST(bin_uniform AS INTEGER) AS bin_uniform, count(*) AS n FROM b GROUP BY ALL""")
def fea_kbins_lineitem(spark, sf_dir):
    """FEA-06/07: quantile and uniform 5-bin discretisation with training-fold edges (ordinal codes)."""
    f = _li_folds(spark, sf_dir, ["l_extendedprice"])
    qe = FE.quantile_edges(f, "fold", "l_extendedprice", K, 5)
    ue = FE.uniform_edges(f, "fold", "l_extendedprice", K, 5)
    a = FE.apply_bins(f, "fold", "l_extendedprice", qe, "bin_quantile")
    b = FE.apply_bins(a, "fold", "l_extendedprice", ue, "bin_uniform")
    return b.groupBy("fold", "bin_quantile", "bin_uniform").agg(F.count(F.lit(1)).alias("n"))


_OH = [("l_returnflag", ["A", "N", "R"]), ("l_linestatus", ["F", "O"])]


@query("fea_onehot_lineitem", "SELECT l_orderkey, l_linenumber, fold, " + ", ".join(
    f"CAST(CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS {c}_{v}" for c, vs in _OH for v in vs)
    + f" FROM {LI_FOLDS_SQL} f")
def fea_onehot_lineitem(spark, sf_dir):
    """FEA-08: one-hot with categories learnt from each training fold (unseen → all zeros)."""
    f = _li_folds(spark, sf_dir)
    cols = [c for c, _ in _OH]
    cats = FE.training_categories(f, "fold", cols, K)
    return FE.one_hot(f.select("l_orderkey", "l_linenumber", "fold", *cols), "fold", cols, cats)


@query("fea_poly2_part", """SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, CAST(p_size * p_size AS DOUBLE) AS p_size_2,
  round(p_size * p_retailprice, 6) AS p_size_p_retailprice, round(p_retailprice * p_retailprice, 6) AS p_retailprice_2 FROM part""")
def fea_poly2_part(spark, sf_dir):
    """FEA-05: degree-2 polynomial features without bias."""
    p = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return FE.polynomial2(p, ["p_size", "p_retailprice"], keep=["p_partkey"])


_GR = ["l_quantity", "l_discount", "l_tax", "l_price_k"]


@query("fea_gramian_lineitem", " UNION ALL ".join(
    f"SELECT '{a}' AS col_i, '{b}' AS col_j, round(avg({a} * {b}), 6) AS value FROM "
    f"(SELECT l_quantity, l_discount, l_tax, l_extendedprice / 1000.0 AS l_price_k FROM lineitem) x"
    for i, a in enumerate(_GR) for b in _GR[i:]))
def fea_gramian_lineitem(spark, sf_dir):
    """FEA-09 (first step): one-pass uncentred Gramian ÷ n of the numeric features."""
    li = _t(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax",
                                             (F.col("l_extendedprice") / 1000.0).alias("l_price_k"))
    return FE.gramian(li, _GR)


@query("fea_vif_filter_lineitem", None)
def fea_vif_filter_lineitem(spark, sf_dir):
    """FEA-09: variance-inflation filter (threshold 8) over lineitem numerics plus a near-collinear column."""
    li = _t(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / 1000.0).alias("l_price_k"),
        (F.col("l_quantity") * 2 + F.col("l_tax")).alias("l_qty_tax"))
    cols = ["l_quantity", "l_discount", "l_tax", "l_price_k", "l_qty_tax"]
    kept, hist = FE.vif_filter(li, cols, 8.0)
    last = hist[-1] if hist else {}
    return spark.createDataFrame([(c, c in kept, float(last.get(c, float("nan")))) for c in cols],
                                 "feature string, kept boolean, vif double")


@query("fea_class_weights_orders", """SELECT o_orderstatus, count(*) AS n,
  round((SELECT count(*) FROM orders) / ((SELECT count(DISTINCT o_orderstatus) FROM orders) * count(*)), 6) AS weight
FROM orders GROUP BY 1""")
def fea_class_weights_orders(spark, sf_dir):
    """FEA-12: balanced class weights n / (k · n_c)."""
    return FE.class_weights(_t(spark, sf_dir, "orders"), "o_orderstatus")


@query("fea_tfidf_documents", """WITH tok AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents),
tf AS (SELECT doc, term, count(*) AS tf FROM tok GROUP BY 1, 2),
voc AS (SELECT term, count(*) AS df, sum(tf) AS cnt FROM tf GROUP BY term ORDER BY cnt DESC, term LIMIT 10000),
w AS (SELECT tf.doc, tf.term, tf.tf, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + voc.df)) + 1.0 AS idf FROM tf JOIN voc USING (term))
SELECT doc, term, tf, round(idf, 6) AS idf, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc)), 6) AS weight FROM w""")
def fea_tfidf_documents(spark, sf_dir):
    """FEA-13: TF-IDF over every whole document: top-10k vocabulary, smooth idf, L2-normalised rows."""
    return TX.tfidf(_t(spark, sf_dir, "documents"), "doc_id", "text")


@query("stx_frequency_encoding_lineitem", f"""SELECT CAST(fold AS INTEGER) AS fold, l_suppkey AS value, round(count(*) / sum(count(*)) OVER (PARTITION BY fold), 6) AS freq
FROM {_train_join('l_suppkey')} t GROUP BY fold, l_suppkey""")
def stx_frequency_encoding_lineitem(spark, sf_dir):
    """STX-03: frequency encoding of the supplier key from each fold's training rows."""
    return FE.frequency_encoding(_li_folds(spark, sf_dir), "fold", "l_suppkey", K)


@query("stx_target_encoding_lineitem", f"""SELECT CAST(fold AS INTEGER) AS fold, l_partkey AS value, count(*) AS n,
  round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS encoding
FROM {_train_join('l_partkey, l_returnflag')} t GROUP BY fold, l_partkey""")
def stx_target_encoding_lineitem(spark, sf_dir):
    """STX-03: out-of-fold target mean of (returnflag = 'R') per part key (total − fold sums)."""
    f = _li_folds(spark, sf_dir)
    return FE.target_encoding(f, "fold", "l_partkey", (F.col("l_returnflag") == "R").cast("int"), K)


@query("stx_rare_bucket_lineitem", f"""WITH tr AS (SELECT fold, l_partkey, count(*) AS c FROM {_train_join('l_partkey')} t GROUP BY 1, 2)
SELECT f.fold, CASE WHEN coalesce(tr.c, 0) < 30 THEN '__rare__' ELSE CAST(f.l_partkey AS VARCHAR) END AS part_bucket, count(*) AS n
FROM {LI_FOLDS_SQL} f LEFT JOIN tr ON f.fold = tr.fold AND f.l_partkey = tr.l_partkey GROUP BY 1, 2""")
def stx_rare_bucket_lineitem(spark, sf_dir):
    """STX-03: rare-category bucket (fewer than 30 training rows → '__rare__')."""
    f = _li_folds(spark, sf_dir)
    r = FE.rare_bucket(f, "fold", "l_partkey", K, 30, "part_bucket")
    return r.groupBy("fold", "part_bucket").agg(F.count(F.lit(1)).alias("n"))


@query("stx_calendar_orders", """SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS d_month, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS d_dow,
  CAST(hour(o_orderdate) AS INTEGER) AS d_hour,
  round(sin(2 * pi() * (month(o_orderdate) - 1) / 12), 6) AS d_month_sin, round(cos(2 * pi() * (month(o_orderdate) - 1) / 12), 6) AS d_month_cos,
  round(sin(2 * pi() * dayofweek(o_orderdate) / 7), 6) AS d_dow_sin, round(cos(2 * pi() * dayofweek(o_orderdate) / 7), 6) AS d_dow_cos
FROM orders""")
def stx_calendar_orders(spark, sf_dir):
    """STX-04: calendar and cyclic date features of the order date."""
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", *FE.calendar_features(F.col("o_orderdate"), "d"))


@query("stx_mutual_info_lineitem", """WITH long AS (SELECT 'l_linestatus' AS feature, l_linestatus AS x, l_returnflag AS y FROM lineitem
  UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), l_returnflag FROM lineitem
  UNION ALL SELECT 'l_tax', CAST(l_tax AS VARCHAR), l_returnflag FROM lineitem),
j AS (SELECT feature, x, y, count(*) AS nxy FROM long GROUP BY ALL),
px AS (SELECT feature, x, sum(nxy) AS nx FROM j GROUP BY ALL), py AS (SELECT feature, y, sum(nxy) AS ny FROM j GROUP BY ALL),
n AS (SELECT feature, sum(nxy) AS n FROM j GROUP BY ALL)
SELECT feature, round(sum(nxy / n * ln(nxy * n / (nx * ny))), 6) AS mutual_info
FROM j JOIN px USING (feature, x) JOIN py USING (feature, y) JOIN n USING (feature) GROUP BY feature""")
def stx_mutual_info_lineitem(spark, sf_dir):
    """STX-09: mutual information of categorical features with the return flag."""
    return FE.mutual_information(_t(spark, sf_dir, "lineitem"), ["l_linestatus", "l_linenumber", "l_tax"],
                                 "l_returnflag")



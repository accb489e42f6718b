"""Split invariants and fold-safe statistics against pandas brute force on driver-table fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldline.operators import features as FE
from foldline.operators import splits as S


@pytest.fixture(scope="module")
def orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def test_kfold_disjoint_complete_balanced_and_partition_invariant(orders):
    a = S.kfold(orders.select("o_orderkey"), ["o_orderkey"], k=5, seeds=[42, 77], n_buckets=3)
    b = S.kfold(orders.select("o_orderkey").repartition(7), ["o_orderkey"], k=5, seeds=[42, 77], n_buckets=1)
    assert a.exceptAll(b).count() == 0
    n = orders.count()
    sizes = a.groupBy("seed", "fold").count().collect()
    assert len(sizes) == 10 and all(abs(r["count"] - n / 5) <= 1 for r in sizes)
    assert a.groupBy("seed", "o_orderkey").count().where("count > 1").count() == 0


def test_stratified_class_balance_within_one(orders):
    f = S.stratified_kfold(orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey"], "o_orderstatus", k=5,
                           seeds=[42], n_buckets=2)
    per = f.groupBy("o_orderstatus", "fold").count().toPandas()
    for _, g in per.groupby("o_orderstatus"):
        assert g["count"].max() - g["count"].min() <= 1
    tot = f.groupBy("fold").count().toPandas()["count"]
    assert tot.max() - tot.min() <= 1


def test_holdout_fallback_and_holdout(spark, orders):
    small = spark.createDataFrame([(i, "a" if i < 20 else "b") for i in range(23)], "id long, y string")
    assert S.needs_holdout_fallback(small, "y", 5)  # class b has 3 rows < 5
    h = S.holdout(orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey"], "o_orderstatus", 0.2)
    c = h.groupBy("o_orderstatus").agg(F.sum(F.col("is_test").cast("int")).alias("t"), F.count("*").alias("n")).collect()
    for r in c:
        assert r["t"] == int(np.ceil(r["n"] * 0.2))


def test_group_kfold_keeps_groups_whole(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    g = S.group_kfold(li, "l_orderkey", k=5)
    assert g.groupBy("l_orderkey").agg(F.countDistinct("fold").alias("f")).where("f > 1").count() == 0


def test_time_series_split_expanding(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    t = S.time_series_split(e, "ts", ["event_id"], n_splits=3).toPandas()
    n = e.count()
    ts = n // 4
    for s in range(3):
        part = t[t.split == s]
        assert (part.role == "test").sum() == ts
        assert (part.role == "train").sum() == n - (3 - s) * ts


def _li(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return S.kfold(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], k=5, seeds=[42]).drop("seed")


def test_training_moments_medians_modes_vs_pandas(spark, sf_dir):
    f = _li(spark, sf_dir)
    pdf = f.toPandas()
    mom = {(r["fold"], r["column_name"]): r for r in FE.training_moments(f, "fold", ["l_quantity", "l_extendedprice"], 5).collect()}
    med = {(r["fold"], r["column_name"]): r["median"] for r in
           FE.training_medians(f, "fold", ["l_quantity"], 5, n_buckets=3).collect()}
    mode = {(r["fold"], r["column_name"]): r["mode"] for r in FE.training_modes(f, "fold", ["l_returnflag"], 5).collect()}
    for g in range(5):
        tr = pdf[pdf.fold != g]
        for c in ["l_quantity", "l_extendedprice"]:
            assert abs(mom[(g, c)]["mean"] - tr[c].mean()) < 1e-9
            assert abs(mom[(g, c)]["std"] - tr[c].std(ddof=0)) < 1e-7
        assert abs(med[(g, "l_quantity")] - np.median(tr.l_quantity)) < 1e-12
        vc = tr.l_returnflag.value_counts()
        assert mode[(g, "l_returnflag")] == sorted(vc[vc == vc.max()].index)[0]


def test_kbins_match_searchsorted(spark, sf_dir):
    f = _li(spark, sf_dir)
    pdf = f.toPandas()
    qe = {r["fold"]: r["edges"] for r in FE.quantile_edges(f, "fold", "l_extendedprice", 5, 4).collect()}
    b = FE.apply_bins(f, "fold", "l_extendedprice", FE.quantile_edges(f, "fold", "l_extendedprice", 5, 4), "b").toPandas()
    for g in range(5):
        tr = pdf[pdf.fold != g].l_extendedprice.to_numpy()
        edges = np.quantile(tr, np.linspace(0, 1, 5))
        assert np.allclose(qe[g], edges)
        te = b[b.fold == g]
        expect = np.searchsorted(edges[1:-1], te.l_extendedprice.to_numpy(), side="right")
        assert (te.b.to_numpy() == expect).all()


def test_onehot_unseen_is_all_zero(spark):
    df = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "c")], "fold int, c string")
    cats = FE.training_categories(df, "fold", ["c"], 2)
    assert cats[0]["c"] == ["a", "c"] and cats[1]["c"] == ["a", "b"]
    o = {(r["fold"], r["c_a"], r["c_b"], r["c_c"]) for r in FE.one_hot(df, "fold", ["c"], cats, drop_original=False).collect()}
    assert (0, 0.0, 0.0, 0.0) in o  # 'b' unseen by fold 0's training rows


def test_vif_drops_collinear(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    y = rng.normal(size=500)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": x * 2 + y + rng.normal(scale=0.01, size=500)}))
    kept, hist = FE.vif_filter(df, ["x", "y", "z"], 8.0)
    assert len(kept) == 2 and hist[0]["z"] > 8


def test_tfidf_vs_bruteforce(spark):
    from foldline.operators.text import tfidf
    docs = [(1, "Le chat et le chien"), (2, "the cat the dog a"), (3, "Chat chat, DOG!")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc"], r["term"]): r["weight"] for r in tfidf(df, "doc_id", "text").collect()}
    import re
    toks = {d: re.findall(r"(?u)\b\w\w+\b", t.lower()) for d, t in docs}
    vocab = sorted({w for v in toks.values() for w in v})
    n = len(docs)
    dfreq = {w: sum(1 for v in toks.values() if w in v) for w in vocab}
    for d, v in toks.items():
        w = {t: v.count(t) * (np.log((1 + n) / (1 + dfreq[t])) + 1) for t in set(v)}
        norm = np.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            assert abs(got[(d, t)] - x / norm) < 1e-12


def test_mutual_information_independent_is_zero(spark):
    rows = [(a, b) for a in range(4) for b in range(3) for _ in range(5)]
    df = spark.createDataFrame(rows, "x int, y int")
    r = FE.mutual_information(df, ["x"], "y").first()
    assert abs(r["mutual_info"]) < 1e-12


def test_tfidf_moves_texts_and_no_term_rows(spark):
    from foldline.operators import text as TX
    rows = [(1, "red blue red"), (2, "green blue"), (2, "blue sky"), (None, "red lost"), (3, None), (4, "of a")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    tf = TX.term_counts(df, "doc_id", "text")
    plan = tf._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(doc" in plan      # a shuffle of (doc, term) rows before
    assert {tuple(r) for r in tf.collect()} == {(1, "red", 2), (1, "blue", 1), (2, "green", 1), (2, "blue", 2), (2, "sky", 1),
                                                (None, "red", 1), (None, "lost", 1), (4, "of", 1)}
    got = TX.tfidf(df, "doc_id", "text")
    assert {r["doc"] for r in got.collect()} == {1, 2, 4}
    norms = got.groupBy("doc").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-12 for r in norms)


def test_imputation_folds_hold_the_fitted_columns_only(spark, sf_dir, monkeypatch):
    from foldline.plans import catalog_features as CF
    made, folds = [], CF._li_folds
    monkeypatch.setattr(CF, "_li_folds", lambda *a: made.append(folds(*a)) or made[-1])
    assert CF.fea_impute_stats_lineitem(spark, sf_dir).count() == 15
    assert made[0].columns == [*CF.NUM, "fold"]
    whole = folds(spark, sf_dir).select(*made[0].columns)
    assert made[0].exceptAll(whole).count() == 0 and whole.count() == made[0].count()

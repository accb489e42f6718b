import numpy as np
import pytest
from pyspark.sql import functions as F

from foldline.functions import ordered as O


@pytest.fixture(scope="module")
def li(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


@pytest.mark.parametrize("nb", [1, 3, 7])
def test_rank_within_matches_plain_window(li, nb):
    a = O.rank_within(li, ["l_returnflag"], F.col("l_extendedprice"), tiebreak=ORDER, n_buckets=nb)
    b = O.rank_within(li, ["l_returnflag"], F.col("l_extendedprice"), tiebreak=ORDER, n_buckets=1)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    # ranks are 0..n-1 per class
    chk = a.groupBy("l_returnflag").agg(F.min("rank"), F.max("rank"), F.count("*"), F.countDistinct("rank")).collect()
    for r in chk:
        assert r[1] == 0 and r[2] == r[3] - 1 and r[4] == r[3]


def test_lag_runmax_cumsum_bucketed_equal(li):
    for fn, kw in [(O.lag_within, dict(value=F.col("l_quantity"))),
                   (O.running_max_within, dict(value=F.col("l_quantity"))),
                   (O.cumsum_within, dict(values={"cs": F.col("l_quantity")}))]:
        a = fn(li, ["l_linestatus"], F.col("l_extendedprice"), tiebreak=ORDER, n_buckets=5, **kw)
        b = fn(li, ["l_linestatus"], F.col("l_extendedprice"), tiebreak=ORDER, n_buckets=1, **kw)
        assert a.exceptAll(b).count() == 0


def test_null_keys_are_one_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 3.0)], "k string, v double")
    r = O.rank_within(df, ["k"], F.col("v"), n_buckets=2).orderBy("v").collect()
    assert [x["rank"] for x in r] == [0, 1, 0]


@pytest.mark.parametrize("method", ["aggregate", "rank"])
def test_exact_percentiles_match_numpy(li, method):
    probs = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    q = O.exact_percentiles(li, ["l_returnflag"], "l_extendedprice", probs, n_buckets=4, method=method).collect()
    pdf = li.select("l_returnflag", "l_extendedprice").toPandas()
    for r in q:
        vals = pdf[pdf.l_returnflag == r["l_returnflag"]].l_extendedprice.to_numpy()
        expect = np.quantile(vals, probs)
        got = [r[f"q_{i}"] for i in range(len(probs))]
        assert np.allclose(got, expect, rtol=0, atol=1e-9)


def test_string_orders_with_a_long_common_prefix_fill_the_buckets(spark):
    df = spark.range(1000).select(F.format_string("user_%06d", F.col("id")).alias("w"), "id").repartition(5)
    b, nb = O.with_bucket(df, [F.col("w")], 8)
    sizes = [r["count"] for r in b.groupBy("_fl_bkt").count().collect()]
    assert nb == 8 and len(sizes) == 8 and max(sizes) < 300
    assert O.rank_within(df, [], F.col("w"), out="r", n_buckets=8).where("r <> id").count() == 0


def test_tied_order_values_are_split_by_the_tiebreak(spark):
    df = spark.range(4000).select(F.lit(1).alias("size"), F.xxhash64("id").alias("h"), "id").repartition(3)
    b, _ = O.with_bucket(df, [F.col("size"), F.col("h")], 16)
    sizes = [r["count"] for r in b.groupBy("_fl_bkt").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1000


@pytest.mark.parametrize("dtype", ["string", "double", "decimal(12,3)", "timestamp", "timestamp_ntz", "date", "boolean",
                                   "binary", "long"])
def test_typed_order_keys_with_nulls(spark, dtype):
    make = {"string": "concat('it\\'s \"', id % 37)", "double": "if(id % 11 = 0, double('NaN'), id / 7.0)",
            "decimal(12,3)": "id / 7.0", "timestamp": "timestamp_seconds(id * 86399)",
            "timestamp_ntz": "to_timestamp_ntz('2024-01-01') + make_interval(0, 0, 0, id)",
            "date": "date_add(date'1969-06-01', cast(id as int))", "boolean": "id % 2 = 0",
            "binary": "unhex(hex(id))", "long": "id - 250"}[dtype]
    df = spark.range(500).selectExpr("id", f"if(id % 13 = 0, null, cast({make} as {dtype})) AS v").repartition(4)
    a = O.rank_within(df, [], F.col("v"), tiebreak=["id"], n_buckets=6).select("id", "rank")
    b = O.rank_within(df, [], F.col("v"), tiebreak=["id"], n_buckets=1).select("id", "rank")
    assert a.exceptAll(b).count() == 0 and a.count() == 500


def test_default_is_bucketed_at_every_size_and_empty_input_works(spark):
    from foldline.operators.splits import group_kfold
    small = spark.range(40).selectExpr("id", "id % 3 AS g")
    assert O.default_buckets(small) > 1
    assert O.rank_within(small.where("id < 0"), ["g"], F.col("id")).count() == 0
    groups = spark.range(3000).selectExpr("id div 3 AS g")
    assert group_kfold(groups, "g", 5).groupBy("fold").count().count() == 5


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    df = spark.range(6000).select(F.xxhash64("id").alias("h"), "id").checkpoint()
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 100)
    r = O.rank_within(df, [], F.col("h"), out="r")
    sizes = [x["count"] for x in r.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1500 and len(sizes) > 25        # at most 4 tasks before, one for each shuffle partition
    plain = O.rank_within(df, [], F.col("h"), out="r", n_buckets=1)
    assert r.exceptAll(plain).count() == 0 and r.count() == 6000
    c = O.cumsum_within(df, [], F.col("h"), {"s": F.col("id")})
    assert c.exceptAll(O.cumsum_within(df, [], F.col("h"), {"s": F.col("id")}, n_buckets=1)).count() == 0


def test_one_large_file_is_spread_by_its_size(spark, monkeypatch, tmp_path):
    path = str(tmp_path / "one.parquet")
    spark.range(200_000).select("id", F.xxhash64("id").alias("v")).coalesce(1).write.parquet(path)
    one = spark.read.parquet(path)
    # a split of 1 KB makes the old rule (bytes against splits per core) leave the file to its one row group
    monkeypatch.setattr(O, "SPREAD_BYTES", 100_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        s = O.spread(one.select("id"))
        got = [x["count"] for x in s.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) > 10 and max(got) < 40_000 and sum(got) == 200_000


def test_many_bounds_stay_small_in_the_plan(spark, monkeypatch):
    """An expression per bound and order column, repeated for both levels of the search, filled the driver."""
    df = spark.range(6000).select(F.xxhash64("id").alias("h"), (F.col("id") % 2).alias("two"), "id").checkpoint()
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 30)
    b, n = O.with_bucket(df, [F.col("h"), F.col("two"), F.col("id")], 4, grow=True)
    assert n == 200 and len(b._jdf.queryExecution().analyzed().toJSON()) < 100_000
    sizes = [r["count"] for r in b.groupBy("_fl_bkt").count().collect()]
    assert len(sizes) == 200 and max(sizes) < 150
    # ties of the leading column need the next ones
    b, n = O.with_bucket(df, [F.col("two"), F.col("h")], 4, grow=True)
    assert n == 200 and b.groupBy("_fl_bkt").count().agg(F.max("count")).first()[0] < 150
    assert not b.schema["_fl_bkt"].nullable            # else a join on it filters by it, at the scan


def test_bounds_of_any_text(spark):
    odd = ["'", '"', "\\", "\n", "\x00", "\u007f", "é", "😀", "퟿", "", "{}", "null", " "]
    df = spark.createDataFrame([(i, a + b) for i, (a, b) in enumerate((a, b) for a in odd for b in odd)], "id long, w string")
    broken = spark.range(40).selectExpr("1000 + id AS id", "cast(unhex(concat('FF', hex(id), 'C3')) AS string) AS w")
    df = df.unionByName(broken).checkpoint()
    a = O.rank_within(df, [], F.col("w"), tiebreak=["id"], n_buckets=60).select("id", "rank")
    b = O.rank_within(df, [], F.col("w"), tiebreak=["id"], n_buckets=1).select("id", "rank")
    assert a.exceptAll(b).count() == 0 and a.count() == len(odd) ** 2 + 40

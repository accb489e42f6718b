"""Order-dependent operators that never put a whole key group into one task.

Ranks, lags, running maxima and cumulative sums "within a key, in an order" are the
building blocks of folds, ROC/PR areas, Pareto fronts, exact quantiles and
monotonicity checks. A plain ``Window.partitionBy(key).orderBy(x)`` sends every row of
a key to one task, so one hot key (a class holding a third of all rows) becomes one
straggler. Here every such window is split by a *range bucket* of the whole order
(order value and tiebreak columns together, whatever their types):

1. a small random sample of the order columns gives ``B - 1`` global bounds (at most
   ``SAMPLE_PER_BUCKET`` rows per bucket reach the driver);
2. the window runs per ``(key, bucket)`` — a hot key, or one tied order value, is cut into ``B`` tasks;
3. a per-``(key, bucket)`` summary (one row per non-empty bucket, so tiny) carries the
   prefix (offset, running max, last value) across bucket borders and is joined back.

Results are exact for any bounds: the bucket is a monotone function of the order columns, so the
order is preserved across buckets. The same path serves every input size; the bucket count follows
the session's shuffle partitions. ``n_buckets=1`` asks for the plain window, for tables that are
bounded by construction.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BKT = "_fl_bkt"


MAX_BUCKETS = 4096        # of one ordered operator (per key, so a task count of keys x buckets)
SAMPLE_PER_BUCKET = 20    # expected sampled rows per bucket, collected to choose the bounds
ROWS_PER_BUCKET = 250_000 # a larger input takes more buckets than there are shuffle partitions
SPREAD_BYTES = 16 << 20   # of scanned files per task of heavy per-row work
MAX_SPREAD = 20_000


def default_buckets(df: DataFrame) -> int:
    """Range buckets at every input size: one per shuffle partition, at most ``MAX_BUCKETS``. With more rows than
    ``ROWS_PER_BUCKET`` in each, ``with_bucket`` takes more."""
    return max(2, min(MAX_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Repartition ``df`` so that heavy per-row work before the first shuffle — unpivots, hashing, regex tokenising,
    Arrow UDFs — uses every core and no task holds more than about ``SPREAD_BYTES`` of scanned files.

    A file can be a single row group, which no scan cuts, so files are counted, not their bytes: a table of at least as many
    files as wanted tasks is left as it is. Other inputs are repartitioned only when they hold less than a quarter of a
    full scan split per core. Only the sizes of the plan's leaves and the names of its files are read; no job runs.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    nodes = [leaves.apply(i) for i in range(leaves.size())]
    size = sum(int(str(x.stats().sizeInBytes())) for x in nodes)
    files = len(df.inputFiles()) if len(nodes) == 1 and nodes[0].nodeName() == "LogicalRelation" else 0
    if files:
        target = max(target, min(MAX_SPREAD, -(-size // SPREAD_BYTES)))
        if files >= target:
            return df
    else:
        split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
            spark.conf.get("spark.sql.files.maxPartitionBytes")))
        if 4 * size >= target * split:
            return df
    # hash of the row's atomic columns: deterministic on retry without the local sort that a
    # round-robin repartition needs for the same guarantee
    from pyspark.sql import types as T
    atomic = [f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType, T.DateType,
                                         T.TimestampType, T.TimestampNTZType, T.BinaryType))]
    if not atomic:
        return df.repartition(target)
    return df.repartition(target, F.xxhash64(*[F.col(f"`{c}`") for c in atomic]))


def by_key(df: DataFrame, key: str, task_bytes: int = SPREAD_BYTES // 4) -> DataFrame:
    """``df`` dealt by ``key`` into tasks of about ``task_bytes`` of scanned files, at least one per shuffle partition."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    nodes = [leaves.apply(i) for i in range(leaves.size())]
    size = sum(int(str(x.stats().sizeInBytes())) for x in nodes if x.nodeName() == "LogicalRelation")    # others have no known size
    return df.repartition(max(default_buckets(df), min(MAX_BUCKETS, -(-size // task_bytes))), key)


def _as_cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _order_fields(df: DataFrame, order: Sequence[Column]) -> list[tuple[Column, str]]:
    """The leading order columns whose values can be written as literals, with their types."""
    from pyspark.sql import types as T
    fields = []
    for c, f in zip(order, df.select(*[c.alias(f"_o{i}") for i, c in enumerate(order)]).schema):
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.NullType)):
            break
        fields.append((c, f.dataType.simpleString()))
    return fields


def range_bounds(df: DataFrame, order: Sequence[Column], n_buckets: int, grow: bool = False) -> tuple[list[tuple], list]:
    """Up to ``n_buckets - 1`` different bounds of the order columns as texts, ascending, and the order fields they are made of;
    with ``grow``, of as many buckets as hold ``ROWS_PER_BUCKET`` rows each, if these are more.

    Counting prunes every column, and the order columns are computed for sampled rows only. Bounds hold as many leading order
    columns as tell them apart: the others matter only where many rows tie. They ascend as the values that their texts give."""
    fields = _order_fields(df, order)
    if n_buckets <= 1 or not fields:
        return [], []
    n = df.count()
    if grow:
        n_buckets = max(n_buckets, min(MAX_BUCKETS, -(-n // ROWS_PER_BUCKET)))
    want = SAMPLE_PER_BUCKET * n_buckets
    rows = df if n <= want else df.sample(fraction=want / n, seed=7)
    texts = [F.make_valid_utf8(c.cast("string")).alias(f"_t{i}") for i, (c, _) in enumerate(fields)]
    picked = rows.select(*texts).orderBy(*[F.col(f"_t{i}").cast(t) for i, (_, t) in enumerate(fields)]).collect()
    made = list(dict.fromkeys(tuple(picked[len(picked) * i // n_buckets]) for i in range(1, n_buckets))) if picked else []
    width = next((w for w in range(1, len(fields)) if len({m[:w] for m in made}) == len(made)), len(fields))
    return [m[:width] for m in made], fields[:width]


def with_bucket(df: DataFrame, order: Sequence[Column], n_buckets: int, grow: bool = False) -> tuple[DataFrame, int]:
    """Add ``_fl_bkt`` = number of bounds <= the row's order columns (nulls come first, as in the window).

    The sorted bounds are searched in two levels, so a row meets about ``2 * sqrt(n_buckets)`` of them. They are one text in
    the plan, which the optimizer turns into values once: an expression per bound fills the driver where there are many."""
    bounds, fields = range_bounds(df, order, n_buckets, grow)
    if not bounds:
        return df.withColumn(_BKT, F.lit(0)), 1
    own = F.struct(*[c.cast(t).alias(f"o{i}") for i, (c, t) in enumerate(fields)])
    step = max(1, round(len(bounds) ** 0.5))
    each = [{f"o{i}": x for i, x in enumerate(m)} for m in bounds]
    text = json.dumps({"heads": each[::step], "groups": [each[i:i + step] for i in range(0, len(each), step)]})

    def shape(types: list[str]) -> str:
        one = "struct<" + ",".join(f"o{i}:{t}" for i, t in enumerate(types)) + ">"
        return f"struct<heads:array<{one}>,groups:array<array<{one}>>>"

    known = F.from_json(F.lit(text), shape(["string"] * len(fields))).cast(shape([t for _, t in fields]))
    b = df.withColumn("_fl_own", own).withColumn(
        "_fl_head", F.size(F.filter(known["heads"], lambda x: x <= F.col("_fl_own"))))
    inside = F.size(F.filter(F.element_at(known["groups"], F.col("_fl_head")), lambda x: x <= F.col("_fl_own")))
    bkt = F.when(F.col("_fl_head") == 0, F.lit(0)).otherwise((F.col("_fl_head") - 1) * step + inside)
    # never null, and known as such: a join on a bucket that may be null filters it at the scan, where the order columns are
    # computed again for every bound that a row meets
    return b.withColumn(_BKT, F.coalesce(bkt, F.lit(0))).drop("_fl_own", "_fl_head"), len(bounds) + 1


_COSTLY = re.compile(r"\b(Aggregate|Join|Window|Generate|Distinct|Sort|MapInPandas|MapInArrow|FlatMap\w+)\b")


def settled(df: DataFrame) -> DataFrame:
    """``df``, written once if its plan does more than scan, project and filter.

    An ordered operator reads its input several times (bounds, window, summary); a derived input would be
    computed each time."""
    if not _COSTLY.search(df._jdf.queryExecution().analyzed().toString()):
        return df
    from foldline.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _bucketed(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n_buckets) -> tuple[DataFrame, DataFrame, int]:
    """``with_bucket`` of the settled input, as it is (for summaries) and as the window reads it, and the number of buckets. More
    buckets than shuffle partitions get as many tasks, so that a task's rows are bounded at every input size."""
    auto = n_buckets in (None, "auto")
    nb = default_buckets(df) if auto else int(n_buckets)
    if nb > 1:
        df = settled(df)
    b, got = with_bucket(df, order, nb, grow=auto)
    return b, (b.repartition(got, *keys, _BKT) if auto and got > nb else b), got


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``on`` where NULL keys match NULL keys; keeps the left key columns."""
    if not on:
        return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    ren = {c: f"_fl_r_{c}" for c in on}
    r = right
    for c, rc in ren.items():
        r = r.withColumnRenamed(c, rc)
    cond = None
    for c, rc in ren.items():
        e = left[c].eqNullSafe(r[rc])
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*ren.values())


def _on_bucket(x: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The per-(key, bucket) summary joined back; without keys the window's own partitioning serves (a bucket is never null)."""
    return null_safe_join(x, summary, [*keys, _BKT]) if keys else x.join(summary, _BKT)


def rank_within(df: DataFrame, keys: Sequence[str], order_value: Column,
                tiebreak: Sequence = (), out: str = "rank", n_buckets=None) -> DataFrame:
    """0-based row number within ``keys`` ordered by (order_value, *tiebreak)."""
    keys = list(keys)
    b, placed, nb = _bucketed(df, keys, [order_value, *_as_cols(tiebreak)], n_buckets)
    w = Window.partitionBy(*keys, _BKT).orderBy(order_value, *_as_cols(tiebreak))
    x = placed.withColumn("_fl_rin", F.row_number().over(w) - 1)
    if nb == 1:
        return x.withColumn(out, F.col("_fl_rin").cast("long")).drop("_fl_rin", _BKT)
    cnt = b.groupBy(*keys, _BKT).agg(F.count(F.lit(1)).alias("_fl_n"))
    w2 = Window.partitionBy(*keys).orderBy(_BKT).rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.withColumn("_fl_off", F.coalesce(F.sum("_fl_n").over(w2), F.lit(0))).drop("_fl_n")
    res = _on_bucket(x, off, keys)
    return res.withColumn(out, (F.col("_fl_off") + F.col("_fl_rin")).cast("long")).drop("_fl_off", "_fl_rin", _BKT)


def lag_within(df: DataFrame, keys: Sequence[str], order_value: Column, value: Column,
               tiebreak: Sequence = (), out: str = "prev", n_buckets=None) -> DataFrame:
    """``lag(value, 1)`` within ``keys`` in (order_value, *tiebreak) order."""
    keys = list(keys)
    b, placed, nb = _bucketed(df, keys, [order_value, *_as_cols(tiebreak)], n_buckets)
    order = [order_value, *_as_cols(tiebreak)]
    w = Window.partitionBy(*keys, _BKT).orderBy(*order)
    x = placed.withColumn(out, F.lag(value, 1).over(w))
    if nb == 1:
        return x.drop(_BKT)
    x = x.withColumn("_fl_first", F.row_number().over(w) == 1)
    okey = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)])
    last = b.groupBy(*keys, _BKT).agg(F.max_by(value, okey).alias("_fl_last"))
    w2 = Window.partitionBy(*keys).orderBy(_BKT)
    prev = last.withColumn("_fl_prev", F.lag("_fl_last", 1).over(w2)).drop("_fl_last")
    res = _on_bucket(x, prev, keys)
    res = res.withColumn(out, F.when(F.col("_fl_first"), F.col("_fl_prev")).otherwise(F.col(out)))
    return res.drop("_fl_first", "_fl_prev", _BKT)


def running_max_within(df: DataFrame, keys: Sequence[str], order_value: Column, value: Column,
                       tiebreak: Sequence = (), out: str = "running_max", inclusive: bool = False,
                       n_buckets=None) -> DataFrame:
    """Max of ``value`` over all earlier rows within ``keys`` (and the row itself if inclusive)."""
    keys = list(keys)
    b, placed, nb = _bucketed(df, keys, [order_value, *_as_cols(tiebreak)], n_buckets)
    end = Window.currentRow if inclusive else -1
    w = Window.partitionBy(*keys, _BKT).orderBy(order_value, *_as_cols(tiebreak)).rowsBetween(
        Window.unboundedPreceding, end)
    x = placed.withColumn(out, F.max(value).over(w))
    if nb == 1:
        return x.drop(_BKT)
    bmax = b.groupBy(*keys, _BKT).agg(F.max(value).alias("_fl_bmax"))
    w2 = Window.partitionBy(*keys).orderBy(_BKT).rowsBetween(Window.unboundedPreceding, -1)
    pre = bmax.withColumn("_fl_pre", F.max("_fl_bmax").over(w2)).drop("_fl_bmax")
    res = _on_bucket(x, pre, keys)
    return res.withColumn(out, F.greatest(F.col(out), F.col("_fl_pre"))).drop("_fl_pre", _BKT)


def cumsum_within(df: DataFrame, keys: Sequence[str], order_value: Column, values: dict[str, Column],
                  tiebreak: Sequence = (), n_buckets=None) -> DataFrame:
    """Inclusive running sums ``{out_name: value}`` within ``keys`` in order."""
    keys = list(keys)
    b, placed, nb = _bucketed(df, keys, [order_value, *_as_cols(tiebreak)], n_buckets)
    w = Window.partitionBy(*keys, _BKT).orderBy(order_value, *_as_cols(tiebreak)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    x = placed
    for name, v in values.items():
        x = x.withColumn(name, F.sum(v).over(w))
    if nb == 1:
        return x.drop(_BKT)
    tot = b.groupBy(*keys, _BKT).agg(*[F.sum(v).alias(f"_fl_t_{n}") for n, v in values.items()])
    w2 = Window.partitionBy(*keys).orderBy(_BKT).rowsBetween(Window.unboundedPreceding, -1)
    for n in values:
        tot = tot.withColumn(f"_fl_o_{n}", F.coalesce(F.sum(f"_fl_t_{n}").over(w2), F.lit(0)))
    tot = tot.drop(*[f"_fl_t_{n}" for n in values])
    res = _on_bucket(x, tot, keys)
    for n in values:
        res = res.withColumn(n, F.col(n) + F.col(f"_fl_o_{n}")).drop(f"_fl_o_{n}")
    return res.drop(_BKT)


def order_statistics(counts: DataFrame, keys: Sequence[str], value: str, count_cols: dict[str, Column],
                     targets: DataFrame, ranks: dict[str, str], n_buckets=None) -> DataFrame:
    """Order statistics from value counts: for each named rank column r, the smallest value whose
    cumulative count (over ``count_cols[r]``) reaches ``r + 1``.

    ``counts`` holds one row per (keys, value) with count columns; ``targets`` one row per key with
    the 0-based rank columns; ``ranks`` maps each rank column to the count column it is read from.
    The cumulative sums are bucketed (``cumsum_within``), so no key is held in one task.
    """
    keys = list(keys)
    cum = cumsum_within(counts, keys, F.col(value), {f"_cum_{c}": e for c, e in count_cols.items()},
                        n_buckets=n_buckets)
    j = null_safe_join(cum, targets, keys)
    aggs = [F.min(F.when(F.col(f"_cum_{cc}") >= F.col(rk) + 1, F.col(value))).alias(rk) for rk, cc in ranks.items()]
    return j.groupBy(*keys).agg(*aggs)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                      n_buckets=None, out_prefix: str = "q", method: str = "counts") -> DataFrame:
    """Exact linear-interpolation percentiles (numpy/pandas default) per key.

    Values are first counted per (key, value) — a map-side-combined aggregate, so duplicates and
    hot keys collapse before any shuffle — then a bucketed cumulative count over the distinct
    values locates the two order statistics around each position (n − 1)·p. Nothing is sorted
    row by row and no group is held in one task. ``method="aggregate"`` uses Spark's built-in
    exact ``percentile`` instead (fine for small, low-cardinality groups).
    Returns one row per key with columns ``{out_prefix}_{i}`` in ``probs`` order.
    """
    keys = list(keys)
    d = df.select(*keys, F.col(value).cast("double").alias("_fl_v")).filter(
        F.col("_fl_v").isNotNull() & ~F.isnan("_fl_v"))
    if method == "aggregate":
        q = d.groupBy(*keys).agg(F.percentile("_fl_v", [float(p) for p in probs]).alias("_fl_q"))
        return q.select(*keys, *[F.col("_fl_q")[i].alias(f"{out_prefix}_{i}") for i in range(len(probs))])
    cnt = d.groupBy(*keys, "_fl_v").agg(F.count(F.lit(1)).alias("_fl_c"))
    tot = cnt.groupBy(*keys).agg(F.sum("_fl_c").alias("_fl_n"))
    tcols, ranks = [], {}
    for i, p in enumerate(probs):
        pos = (F.col("_fl_n") - 1) * F.lit(float(p))
        tcols += [pos.alias(f"_fl_pos{i}"), F.floor(pos).cast("long").alias(f"_fl_lo{i}"),
                  F.ceil(pos).cast("long").alias(f"_fl_hi{i}")]
        ranks[f"_fl_lo{i}"] = "c"
        ranks[f"_fl_hi{i}"] = "c"
    targets = tot.select(*keys, *tcols)
    st = order_statistics(cnt, keys, "_fl_v", {"c": F.col("_fl_c")}, targets.drop(*[f"_fl_pos{i}" for i in range(len(probs))]),
                          ranks, n_buckets=n_buckets)
    # st holds the order-statistic *values* under the rank column names
    out = null_safe_join(st, targets.select(*keys, *[f"_fl_pos{i}" for i in range(len(probs))]), keys)
    res = []
    for i in range(len(probs)):
        lo, hi, pos = F.col(f"_fl_lo{i}"), F.col(f"_fl_hi{i}"), F.col(f"_fl_pos{i}")
        res.append((lo + (pos - F.floor(pos)) * (hi - lo)).alias(f"{out_prefix}_{i}"))
    return out.select(*keys, *res)

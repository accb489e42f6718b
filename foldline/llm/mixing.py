"""Operator 3: mixing sources to target weights by entropy balancing.

Sizes are word counts; a source's size is the sum over its documents. Targets share the total size by
weight, stop at ``max_rate`` times their source's size, and the excess is shared again by weight.

Entropy balancing looks for document rates r close to 1 (relative entropy weighted by size, r at most ``max_rate``) that
meet every token constraint ``sum(size * r over the documents of a category) = target``; a document may take part in several
(its source, its language, ...). The solution is an exponential tilt ``r = min(exp(sum of its categories' multipliers),
max_rate)``, and the multipliers solve a convex dual. It is solved by Newton iterations, one grouping at a time: one distributed
aggregate gives every category's gradient (tokens taken minus target) and curvature (tokens of documents below the limit), a step
is at most ``MAX_STEP`` long, and multipliers are a stored table. Documents of equal categories have equal rates, so they are added up
to cells once, before the iterations. It ends when every gradient is below ``TOLERANCE`` of its target, or its documents
are all at the limit.

Rounding: every document gets ``floor(r)`` copies. The words still missing are taken as one more copy
of documents in the order of a hash of their id. Documents larger than what is missing are set aside, the others
are taken as long as they fit (a running sum, split over hash ranges so that a hot source is no single task), and
the draw is repeated over the documents not yet taken that fit the rest, until none does: what stays missing is less than
the smallest document without an additional copy. Rounding depends on ids and sizes only, so reruns agree.

Edge cases: null text has size 0; documents of size 0 are taken 0 words and take part in the first draw
only, where words are missing or the source has none; a null source is a source of its own, the last; null doc_ids take part; repeated rows count one by one; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldline.llm.common import stored, table, temporary

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
MAX_RATE = 3
BINS = 256
MAX_STEP = 0.7              # of a multiplier: a rate at most doubles or halves
TOLERANCE = 1e-11          # of a target


def _ranked(sources: DataFrame) -> DataFrame:
    """``position`` (from 0) of every source by code point, null last: range partitions are counted and
    ranked within, so no task holds all sources."""
    parts = stored(sources.repartitionByRange(F.col("source").asc_nulls_last())
                   .withColumn("part", F.spark_partition_id()), "sources")
    before, total = {}, 0
    for r in parts.groupBy("part").count().orderBy("part").collect():          # one row per partition
        before[r["part"]] = total
        total += r["count"]
    if not before:
        return parts.withColumn("position", F.lit(0).cast("long")).drop("part")
    shift = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    w = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return parts.withColumn("position", F.row_number().over(w) - 1 + shift[F.col("part")]).drop("part")


def targets(sources: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """Adds ``target`` to ``source, source_size``: shares of the total by weight under the caps."""
    ws = F.array(*[F.lit(float(x)) for x in weights])
    s = stored(_ranked(sources).withColumn("weight", ws[F.pmod("position", F.lit(len(weights))).cast("int")]), "weights")
    cap = F.col("source_size") * max_rate
    total = s.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0
    while total:                                  # at least one more source is capped in every round
        over = cap <= F.col("weight") * share if share else F.lit(False)
        r = s.agg(F.sum(F.when(over, cap)).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        if not r["free"]:
            break
        new = (total - (r["capped"] or 0)) / r["free"]
        if new <= share:
            break
        share = new
    return s.withColumn("target", F.least(cap.cast("double"), F.col("weight") * share)).drop("weight", "position")


def entropy_balance(docs: DataFrame, targets: dict[str, DataFrame], max_rate: float = MAX_RATE, size: str = "size",
                    rounds: int = 200) -> dict[str, DataFrame]:
    """The multipliers ``category, lam`` of every grouping column of ``docs`` named in ``targets`` (``category, target`` tables).

    Raises when the constraints can't be met together within ``rounds`` steps over every grouping."""
    spark = docs.sparkSession
    names = list(targets)
    cells = docs.groupBy(*names).agg(F.sum(size).cast("double").alias("tokens")).where("tokens > 0")
    cells = stored(cells, "cells")
    lam = {n: stored(targets[n].select("category", F.col("target").cast("double").alias("target"), F.lit(0.0).alias("lam")), "multipliers")
           for n in names}

    def tilted() -> DataFrame:
        d = cells
        for n in names:
            own = lam[n].select(F.col("category").alias(f"_c_{n}"), F.col("lam").alias(f"_l_{n}"))
            d = d.join(own, F.col(n).eqNullSafe(F.col(f"_c_{n}"))).drop(f"_c_{n}")
        power = sum((F.col(f"_l_{n}") for n in names), F.lit(0.0))
        return d.withColumn("free", power < math.log(max_rate)).withColumn("rate", F.least(F.exp(power), F.lit(float(max_rate))))

    for _ in range(rounds):
        settled = True
        for n in names:
            with temporary(spark):
                taken = F.col("tokens") * F.col("rate")
                sums = tilted().groupBy(n).agg(F.sum(taken).alias("got"), F.sum(F.when(F.col("free"), taken).otherwise(0.0)).alias("bend"))
                j = lam[n].join(sums.withColumnRenamed(n, "_n"), F.col("category").eqNullSafe(F.col("_n")), "left")
                gap = F.col("target") - F.coalesce("got", F.lit(0.0))
                # at the limit: only a way back is of use
                step = F.when(F.col("bend") > 0, gap / F.col("bend")).otherwise(F.when(gap < 0, -MAX_STEP).otherwise(0.0))
                step = F.when(F.col("got").isNull(), 0.0).otherwise(F.greatest(F.lit(-MAX_STEP), F.least(F.lit(MAX_STEP), step)))
                off = F.col("got").isNotNull() & (F.abs(gap) > TOLERANCE * F.col("target")) & ~((gap > 0) & (F.col("bend") <= 0))
                moved = stored(j.select("category", "target", (F.col("lam") + F.when(off, step).otherwise(0.0)).alias("lam"), off.alias("off")),
                               "multipliers", keep=True)
            lam[n] = moved.drop("off")
            settled &= moved.where("off").isEmpty()
        if settled:
            return {n: t.drop("target") for n, t in lam.items()}
    raise ValueError("the constraints can't be met together")


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE, text: str = "text") -> DataFrame:
    """Per document: size, its source's size and target, the tilted ``rate``, ``copies`` and ``taken`` words."""
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                               F.col("source").cast("string").alias("source"), size.alias("size")), "sizes")
    return mix_sizes(sizes, weights, max_rate)


def _draw(rest: DataFrame, bins: DataFrame, left: DataFrame) -> DataFrame:
    """The rows of ``rest`` that fit their source's gap, and whether they are ``took`` in order up to the first that does
    not fit beside those before it."""
    fits = rest.join(bins.join(left, "key"), ["key", "bin"]).where("size >= least and size <= gap")
    within = Window.partitionBy("key", "bin").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    fits = fits.withColumn("run", F.sum("size").over(within))
    upto = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = fits.groupBy("key", "bin").agg(F.max("run").alias("n"))
    before = before.select("key", "bin", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    return fits.join(before, ["key", "bin"]).withColumn("took", F.col("before") + F.col("run") <= F.col("gap"))


def mix_sizes(sizes: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """The mix over a stored table ``doc_id, source, size``."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    near = F.round("rate", 9)
    src = targets(sources, weights, max_rate)
    goal = src.where("target > 0").select(F.col("source").alias("category"), "target")
    tilt = entropy_balance(sizes, {"source": goal}, max_rate)["source"].withColumnRenamed("category", "_c")
    rate = F.when(F.col("lam").isNotNull(), F.least(F.exp("lam"), F.lit(float(max_rate)))).otherwise(0.0)
    src = src.join(tilt, F.col("source").eqNullSafe(F.col("_c")), "left").withColumn("rate", rate).drop("_c", "lam")
    src = src.withColumn("whole", F.least(F.floor(near), F.lit(max_rate)).cast("long"))
    src = src.withColumn("missing", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    src = src.withColumn("missing", F.when(F.col("whole") >= max_rate, 0.0).otherwise(F.col("missing")))
    # one name for a source that equi-joins treat like any other, null included
    name = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    src = stored(src.withColumn("key", name), "targets")

    d = sizes.withColumn("key", name).withColumn("draw", F.xxhash64(F.lit("mix"), F.coalesce("doc_id", F.lit(-1))))
    d = d.withColumn("bin", F.pmod("draw", F.lit(BINS)).cast("int"))
    d = d.withColumn("place", F.row_number().over(Window.partitionBy("key", "bin").orderBy("draw", "doc_id", "size")))
    d = stored(d.drop("draw"), "placed")
    bins = stored(d.select("key", "bin").distinct(), "bins")              # BINS rows per source

    zero = (F.col("missing") > 0) | (F.col("whole") == 0)
    left = src.select("key", F.col("missing").alias("gap"), F.when(zero, 0).otherwise(1).alias("least"))
    rest, extra = d.select("key", "bin", "place", "size"), None
    while True:                        # every round takes one more document at least of each source with documents that fit
        drawn = stored(_draw(rest, bins, left), "drawn")
        took = drawn.where("took").select("key", "bin", "place", "size")
        if took.isEmpty():
            break
        extra = took if extra is None else extra.unionByName(took)
        got = F.sum(F.when(F.col("took"), F.col("size")).otherwise(0))
        left = drawn.groupBy("key").agg((F.max("gap") - got).alias("gap"), F.lit(1).alias("least"))
        rest = drawn.where("not took").select("key", "bin", "place", "size")
    facts = bins.join(src.drop("source"), "key")
    d = d.join(facts, ["key", "bin"])
    if extra is None:
        d = d.withColumn("extra", F.lit(0))
    else:
        d = d.join(extra.select("key", "bin", "place", F.lit(1).alias("extra")), ["key", "bin", "place"], "left")
    copies = F.col("whole") + F.coalesce("extra", F.lit(0))
    return d.select("doc_id", "source", "size", "source_size", "target", "rate", copies.cast("long").alias("copies"),
                    (copies * F.col("size")).cast("long").alias("taken"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))

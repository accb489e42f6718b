"""Connected components of a distributed link table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm.common import stored, temporary

SALTS = 16
LINKS = 1 << 18          # links of a block that a task contracts at a time


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(node, smallest node reachable)`` equivalent to the links given, at most one per node."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[:len(a)], inv[len(a):]
    label = np.arange(len(nodes))
    while True:                                  # hook roots to smaller roots, then shorten paths
        lx, ly = label[x], label[y]
        open_ = lx != ly
        if not open_.any():
            break
        x, y, lx, ly = x[open_], y[open_], lx[open_], ly[open_]
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _contract(batches):
    """A forest of every ``LINKS`` links or so."""
    def flush(held):
        u, v = forest(*(np.concatenate([np.asarray(b.column(k)) for b in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= LINKS:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def _done(e: DataFrame) -> bool:
    """Whether links ``u > v`` are stars: every ``u`` has one ``v``, and none is a ``u`` itself."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or up = 1 and down = 1").isEmpty()


def _salted_join(links: DataFrame, low: DataFrame) -> DataFrame:
    """Links with the ``low`` of their ``u``; a node of very many links is dealt to several tasks."""
    low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(low, ["u", "salt"])


def _round(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links ``u > v``."""
    # large star: larger neighbours move to the smallest node of the neighbourhood
    both = stored(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "both")
    low = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("low")), "low")
    large = _salted_join(both, low).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    # small star: smaller neighbours and the node itself move to its smallest neighbour
    down = stored(large.where("u <> v").distinct(), "down")
    low = stored(down.groupBy("u").agg(F.min("v").alias("low")), "low")
    small = _salted_join(down, low).where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return stored(small.unionByName(low.select("u", F.col("low").alias("v"))).distinct(), "links", keep=True)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``links (u, v)``.

    Alternating large-star and small-star steps; each is one map-side combined minimum and one salted
    join, stored, so no component is ever held by one task or the driver. Blocks of ``LINKS`` links
    are first contracted to forests. Goes on until all components are stars (a handful of rounds for
    the shapes met here; logarithmic in general); a round's tables are deleted when it ends."""
    spark = links.sparkSession
    e = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    e = stored(e.mapInArrow(_contract, "u long, v long"), "links")
    # few links of very many partitions are contracted once more, in as many blocks as they fill
    e = stored(e.coalesce(-(-e.count() // LINKS) or 1).mapInArrow(_contract, "u long, v long"), "links")
    while not _done(e):
        with temporary(spark):
            e = _round(e)
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

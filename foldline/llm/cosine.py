"""Operator 7: embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are compared only within a group (equal, non-null label and equal length). Identical vectors
of a group are folded to one row with a count. The rest are scaled to unit length, turned to the corpus'
principal axes (one distributed sum of outer products, ``dim x dim`` per partition) and cut into tiles
along the first axis. Unit vectors with cosine >= t differ by at most ``sqrt(2 - 2t)`` on any axis,
so tiles further apart never meet. Within a pair of tiles products are accumulated from the leading axes
on; what the remaining axes can add is bounded by the product of suffix norms, and a pair is left as soon
as it can't reach the threshold. Surviving pairs are checked once by the cosine of the original components
in double precision.

A pair of tiles returns link counts per vector and a forest of its links (at most one per vector), never
the links themselves, so a group of thousands of near copies stays linear. A hot label is cut into
many tiles, each pair of tiles being a row of its own.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null
label, link with nothing (a component of their own); null vec_ids link with nothing and have a null component;
repeated rows are linked copies, each counting the others; every row has its row in the result, and an id that occurs with
several vectors shares one component, its links being counted over the classes that it names; ties don't occur; an empty table
gives no rows; other columns are ignored. Tables in between are deleted when the result is stored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldline.llm.common import stored, table, temporary
from foldline.llm.graph import components, forest
from foldline.llm.vectors import groups

THRESHOLD = 0.93
TILE = 2048
BLOCK = 512
STEP = 8
SLACK = 1e-9


def _valid(batches):
    """Every row, one by one: those that can link with the vector as bytes and a 128-bit digest of it, the others with nulls."""
    for b in batches:
        ids, label = b.column("vec_id"), b.column("label")
        idle = np.ones(b.num_rows, dtype=bool)
        known = np.asarray(pc.and_(ids.is_valid(), label.is_valid()))
        for rows, mat in groups(b, "vec"):
            top = np.abs(mat).max(axis=1)
            keep = known[rows] & (top > 0)
            rows, mat = rows[keep], mat[keep]
            idle[rows] = False
            # dividing by a power of two keeps every bit and lets squares of huge or tiny components be summed
            mat = mat / np.exp2(np.floor(np.log2(np.maximum(top[keep], 1e-300))))[:, None] if len(mat) else mat
            blobs = [x.tobytes() for x in (mat + 0.0).astype("<f8")]
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [ids.take(at), label.take(at), pa.array(np.full(len(rows), mat.shape[1] if len(rows) else 0)),
                 pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in blobs], pa.binary()),
                 pa.array(blobs, pa.binary())], names=["vec_id", "label", "dim", "digest", "vec"])
        at = pa.array(np.flatnonzero(idle))
        blank = pa.nulls(len(at), pa.binary())
        yield pa.RecordBatch.from_arrays([ids.take(at), label.take(at), pa.nulls(len(at), pa.int64()), blank, blank],
                                         names=["vec_id", "label", "dim", "digest", "vec"])


def _unit(blobs: list[bytes], dim: int) -> np.ndarray:
    m = np.frombuffer(b"".join(blobs), dtype="<f8").reshape(-1, dim)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _outer(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        dims = np.asarray(b.column("dim"))
        for d in np.unique(dims):
            u = _unit(b.column("vec").take(pa.array(np.flatnonzero(dims == d))).to_pylist(), int(d))
            total[int(d)] = total.get(int(d), 0) + u.T @ u
    for d, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([m.reshape(-1)], pa.list_(pa.float64()))],
                                         names=["dim", "moments"])


def principal_axes(reps: DataFrame) -> dict[int, np.ndarray]:
    """Axes by vector length, the most important first; one ``dim x dim`` matrix per length and partition is added up."""
    sums: dict[int, np.ndarray] = {}
    for r in reps.mapInArrow(_outer, "dim long, moments array<double>").toLocalIterator():
        sums[r["dim"]] = sums.get(r["dim"], 0) + np.array(r["moments"]).reshape(r["dim"], r["dim"])
    return {d: np.linalg.eigh(m)[1][:, ::-1].copy() for d, m in sums.items()}


def _lead(axes: dict[int, np.ndarray]):
    def run(batches):
        for b in batches:
            dims = np.asarray(b.column("dim"))
            lead = np.zeros(b.num_rows)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                lead[at] = _unit(b.column("vec").take(pa.array(at)).to_pylist(), int(d)) @ axes[int(d)][:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lead)], names=[*b.schema.names, "lead"])
    return run


def _tiles(batches):
    """One row per tile from partitions sorted by tile key."""
    key, rows = None, []

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([key[2]], pa.int64()),
             pa.array([[r["vec_id"] for r in rows]], pa.list_(pa.int64())), pa.array([[r["n"] for r in rows]], pa.list_(pa.int64())),
             pa.array([b"".join(r["vec"] for r in rows)], pa.binary()),
             pa.array([min(r["lead"] for r in rows)]), pa.array([max(r["lead"] for r in rows)])],
            names=["label", "dim", "tile", "ids", "counts", "vecs", "low", "high"])
    for b in batches:
        for r in b.to_pylist():
            new = (r["label"], r["dim"], r["tile"])
            if rows and new != key:
                yield row()
                rows = []
            key = new
            rows.append(r)
    if rows:
        yield row()


def compare_tiles(a: np.ndarray, b: np.ndarray, axes: np.ndarray, t: float, same: bool):
    """Index pairs ``(i, j)`` of unit rows with cosine >= t (i < j if both tiles are the same one), block by block."""
    dim = axes.shape[0]
    pa_, pb = a @ axes, b @ axes
    # norm of what follows each leading part
    rest = lambda p: np.sqrt(np.maximum(0.0, np.cumsum((p * p)[:, ::-1], axis=1)[:, ::-1]))
    ra, rb = rest(pa_), rest(pb)
    for i in range(0, len(a), BLOCK):
        for j in range(i if same else 0, len(b), BLOCK):
            x, y = pa_[i:i + BLOCK], pb[j:j + BLOCK]
            part = x[:, :STEP] @ y[:, :STEP].T
            if dim > STEP:
                open_ = part + np.outer(ra[i:i + BLOCK, STEP], rb[j:j + BLOCK, STEP]) >= t - SLACK
            else:
                open_ = part >= t - SLACK
            if same and i == j:
                open_ &= np.tri(*open_.shape, k=-1, dtype=bool).T
            p, q = np.nonzero(open_)
            acc, at = part[p, q], STEP
            while at < dim and len(p):
                to = min(dim, at * 2)
                acc = acc + np.einsum("ij,ij->i", x[p, at:to], y[q, at:to])
                bound = acc + (ra[i + p, to] * rb[j + q, to] if to < dim else 0.0)
                ok = bound >= t - SLACK
                p, q, acc, at = p[ok], q[ok], acc[ok], to
            if len(p):
                yield i + p, j + q


def _links(axes: dict[int, np.ndarray], t: float):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dim, same = r["dim"], r["tile"] == r["tile2"]
                raw_a = np.frombuffer(r["vecs"], dtype="<f8").reshape(-1, dim)
                raw_b = raw_a if same else np.frombuffer(r["vecs2"], dtype="<f8").reshape(-1, dim)
                ids_a, ids_b = np.array(r["ids"]), np.array(r["ids"] if same else r["ids2"])
                ca, cb = np.array(r["counts"]), np.array(r["counts"] if same else r["counts2"])
                na, nb = (raw_a * raw_a).sum(axis=1), (raw_b * raw_b).sum(axis=1)
                got_a, got_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
                tree_u, tree_v = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
                for i, j in compare_tiles(raw_a / np.sqrt(na)[:, None], raw_b / np.sqrt(nb)[:, None], axes[dim], t, same):
                    cos = np.einsum("ij,ij->i", raw_a[i], raw_b[j]) / np.sqrt(na[i] * nb[j])
                    i, j = i[cos >= t], j[cos >= t]
                    np.add.at(got_a, i, cb[j])
                    np.add.at(got_b, j, ca[i])
                    tree_u, tree_v = forest(np.concatenate([tree_u, ids_a[i]]), np.concatenate([tree_v, ids_b[j]]))
                for ids, got in ((ids_a, got_a), (ids_b, got_b)):
                    at = np.flatnonzero(got)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at], pa.int64()), pa.array(got[at]), pa.nulls(len(at), pa.int64())], names=["u", "n", "v"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree_u, pa.int64()), pa.nulls(len(tree_u), pa.int64()), pa.array(tree_v, pa.int64())], names=["u", "n", "v"])
    return run


def near_duplicates(vectors: DataFrame, t: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors (vec_id, embedding, label)``."""
    with temporary(vectors.sparkSession):
        return stored(_near_duplicates(vectors, t, tile), "result", keep=True)


def _near_duplicates(vectors: DataFrame, t: float, tile: int) -> DataFrame:
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                       F.col("embedding").alias("vec"))
    every = stored(v.mapInArrow(_valid, "vec_id long, label string, dim long, digest binary, vec binary"), "rows")
    rows = every.where("digest is not null")
    # ids are folded first, so that a very common vector is one row before any comparison
    folded = rows.groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"),
                                                        F.max("vec").alias("vec"))
    folded = stored(folded, "folded")
    reps = folded.select(F.col("rep").alias("vec_id"), "label", "dim", "n", "vec")
    axes = principal_axes(reps)
    if axes:
        led = reps.mapInArrow(_lead(axes), "vec_id long, label string, dim long, n long, vec binary, lead double")
        # position along the first axis within the group, from range partitions
        led = stored(led.repartitionByRange("label", "dim", "lead", "vec_id").withColumn("part", F.spark_partition_id()), "led")
        sizes = led.groupBy("label", "dim", "part").agg(F.count(F.lit(1)).alias("m"))
        upto = Window.partitionBy("label", "dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("before", F.coalesce(F.sum("m").over(upto), F.lit(0))).drop("m")
        place = F.row_number().over(Window.partitionBy("label", "dim", "part").orderBy("lead", "vec_id")) - 1
        led = led.withColumn("place", place).join(stored(sizes, "sizes"), ["label", "dim", "part"])
        led = led.withColumn("tile", F.floor((F.col("before") + F.col("place")) / tile).cast("long"))
        tiles = stored(led.select("vec_id", "label", "dim", "tile", "n", "vec", "lead").repartition("label", "dim", "tile")
                       .sortWithinPartitions("label", "dim", "tile", "lead", "vec_id")
                       .mapInArrow(_tiles, "label string, dim long, tile long, ids array<long>, counts array<long>, "
                                           "vecs binary, low double, high double"), "tiles")
        reach = float(np.sqrt(max(0.0, 2 - 2 * t))) + SLACK
        frame = tiles.select("label", "dim", "tile", "low", "high")
        other = frame.select("label", "dim", F.col("tile").alias("tile2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        pairs = frame.join(other, ["label", "dim"]).where(
            (F.col("tile2") >= F.col("tile")) & (F.col("low2") <= F.col("high") + reach) & (F.col("high2") >= F.col("low") - reach))
        pairs = stored(pairs.select("label", "dim", "tile", "tile2"), "pairs")
        body = tiles.select("label", "dim", "tile", "ids", "counts", "vecs")
        body2 = body.select("label", "dim", *[F.col(c).alias(f"{c}2") for c in ("tile", "ids", "counts", "vecs")])
        work = (pairs.join(body, ["label", "dim", "tile"]).join(body2, ["label", "dim", "tile2"])
                .repartition(F.xxhash64("label", "dim", "tile", "tile2")))
        found = stored(work.mapInArrow(_links(axes, t), "u long, n long, v long"), "found")
    else:
        found = stored(rows.sparkSession.createDataFrame([], "u long, n long, v long"), "found")
    counts = found.where("n is not null").groupBy("u").agg(F.sum("n").alias("far"))
    comp = stored(components(found.where("v is not null").select("u", "v")), "components")
    reps = (folded.join(counts, folded["rep"] == counts["u"], "left").join(comp, folded["rep"] == comp["node"], "left")
            .select("label", "dim", "digest", (F.coalesce("far", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                    F.coalesce("component", "rep").alias("component_id")))
    reps = stored(reps, "classes")
    # a very common vector is dealt over salted keys when its class is handed to its copies
    salted = reps.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    linked = (rows.drop("vec").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16)).cast("int"))
              .join(salted, ["label", "dim", "digest", "salt"]).select("vec_id", "n_links", "component_id"))
    alone = every.where("digest is null")
    out = linked.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP7_SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach(u, w) AS (SELECT u, w FROM links UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
comp AS (SELECT u, least(u, min(w)) AS c FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(comp.c, vec_id) AS component_id, coalesce(vec_id = coalesce(comp.c, vec_id), false) AS kept
FROM v LEFT JOIN n ON n.u = vec_id LEFT JOIN comp ON comp.u = vec_id"""

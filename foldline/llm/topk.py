"""Operator 1: exact top-k inner-product search with a ball tree per shard.

Vectors are quantised to ``floor(scale * x)`` and dealt to shards by a hash of their id, about
``shard_rows`` each. Every shard builds a ball tree (median splits on the widest direction) and
searches it with blocks of queries, children in order of their upper bound
``q.centre + |q| * radius``; a query leaves a node whose bound lies below its current k-th score.
The k-th score is shared: a first pass searches every query in its home shard only, and the other shards
start from that score, so most of their nodes are left at the root. Ties go to the smaller id, so a
node whose bound equals the k-th score is still visited. Scores are exact integers.

Queries meet shards in blocks of ``block`` queries (one row per block and shard); each pair of block and
shard returns at most k rows per query, which are merged by a window per query.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do
null ids; vectors of different lengths are searched apart from each other; a query is a distinct id
(of repeated rows the smallest vector) and skips every row with its own id; repeated candidate rows count one
by one; an empty table gives no rows; other columns are ignored. Components must stay below 2**31.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldline.llm.common import stored, table
from foldline.llm.vectors import groups

K = 5
SCALE = 256.0
QUERY_STEP = 50
SHARD_ROWS = 1 << 15
BLOCK = 512
LEAF = 96


class BallTree:
    """Median-split ball tree over integer vectors (held as float64, exact below 2**53)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.nodes: list[tuple] = []                       # (low, high, left child, right child)
        centre, radius, stack = [], [], [(0, len(ids), -1, 0)]
        while stack:
            low, high, parent, side = stack.pop()
            p = points[order[low:high]]
            c = p.mean(axis=0)
            d = np.sqrt(((p - c) ** 2).sum(axis=1))
            here = len(self.nodes)
            self.nodes.append([low, high, -1, -1])
            centre.append(c)
            radius.append(d.max() if len(d) else 0.0)
            if parent >= 0:
                self.nodes[parent][2 + side] = here
            if high - low > leaf and radius[-1] > 0:
                far = p[d.argmax()] - c
                mid = (high - low) // 2
                order[low:high] = order[low:high][np.argpartition(p @ far, mid)]
                stack += [(low, low + mid, here, 0), (low + mid, high, here, 1)]
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.ids, self.points = ids[order], points[order]
        self.top = float(np.abs(points).max()) if len(points) else 0.0

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray):
        """Per query the best ``(score, id)``, at most k, with scores of at least ``floor`` (-inf: none)."""
        n, dim = q.shape
        if n == 0 or len(self.ids) == 0:
            return np.zeros((n, 0)), np.zeros((n, 0), dtype=np.int64)
        exact = dim * self.top * float(np.abs(q).max()) < 2 ** 52
        score = np.full((n, k), -np.inf) if exact else np.full((n, k), -np.inf, dtype=object)
        ids = np.full((n, k), np.iinfo(np.int64).max)
        kth = floor.astype(np.float64).copy()
        norm = np.sqrt((q ** 2).sum(axis=1))
        slack = 1e-9 * (1 + norm * (self.radius.max() + np.sqrt((self.centre ** 2).sum(axis=1)).max()))
        whole = q if exact else q.astype(np.int64).astype(object)
        stack = [(0, np.arange(n), q @ self.centre[0] + norm * self.radius[0])]
        while stack:
            node, act, bound = stack.pop()
            act = act[bound + slack[act] >= kth[act]]
            if not len(act):
                continue
            low, high, left, right = self.nodes[node]
            if left < 0:
                for at in range(0, high - low, 4096):
                    c = slice(low + at, min(high, low + at + 4096))
                    pts = self.points[c] if exact else self.points[c].astype(np.int64).astype(object)
                    s = whole[act] @ pts.T
                    s = np.where(self.ids[c][None, :] == qid[act][:, None], -np.inf, s)
                    both = np.concatenate([score[act], s], axis=1)
                    who = np.concatenate([ids[act], np.broadcast_to(self.ids[c], s.shape)], axis=1)
                    best = np.lexsort((who, -both), axis=1)[:, :k]
                    score[act] = np.take_along_axis(both, best, axis=1)
                    ids[act] = np.take_along_axis(who, best, axis=1)
                kth[act] = np.maximum(kth[act], score[act][:, k - 1].astype(np.float64))
                continue
            kids = []
            for child in (left, right):
                kids.append((child, q[act] @ self.centre[child] + norm[act] * self.radius[child]))
            kids.sort(key=lambda x: x[1].sum())            # the better child is searched first
            stack += [(child, act, b) for child, b in kids]
        return score, ids


def _quantise(scale: float, n_shards: int):
    def run(batches):
        for b in batches:
            ids = np.asarray(b.column("vec_id").fill_null(0))
            known = np.asarray(b.column("vec_id").is_valid())
            for rows, mat in groups(b, "vec"):
                rows, mat = rows[known[rows]], mat[known[rows]]
                q = np.floor(scale * mat)
                if len(q) and np.abs(q).max() >= 2 ** 31:
                    raise ValueError("a quantised component doesn't fit 32 bits")
                own = ids[rows]
                shard = (own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(n_shards)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(np.full(len(own), mat.shape[1])), pa.array(shard.astype(np.int64)),
                     pa.array([x.tobytes() for x in q.astype("<i4")], pa.binary())],
                    names=["vec_id", "dim", "shard", "vec"])
    return run


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype="<i4").reshape(-1, dim).astype(np.float64)


_OUT = "query_id long, vec_id long, score long"


def _answers(qid, score, ids, floor):
    ok = (score > -np.inf) & (score >= floor[:, None])
    at = np.nonzero(ok)
    return pa.table({"query_id": pa.array(qid[at[0]], pa.int64()), "vec_id": pa.array(ids[at], pa.int64()),
                     "score": pa.array([int(x) for x in score[at]], pa.int64())})


def _search(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """left: one shard's vectors; right: the queries that search it, with the score they start from."""
        none = pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        if not left.num_rows or not right.num_rows:
            return none
        dim = key[0].as_py()
        tree = BallTree(left.column("vec_id").to_numpy(), _matrix(left.column("vec").to_pylist(), dim))
        parts = []
        for block in right.to_pylist():
            qid = np.array(block["ids"], dtype=np.int64)
            floor = np.array([-np.inf if x is None else x for x in block["floors"]])
            score, ids = tree.search(qid, _matrix([block["vecs"]], dim), k, floor)
            parts.append(_answers(qid, score, ids, floor))
        return pa.concat_tables(parts)
    return run


def _in_blocks(queries: DataFrame, block: int) -> DataFrame:
    """Rows ``vec_id, dim, shard, vec, floor`` gathered to blocks of one shard and length."""
    def run(batches):
        held: dict[tuple, list] = {}

        def row(key):
            rows = held.pop(key)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
                 pa.array([[r[2] for r in rows]], pa.list_(pa.int64())), pa.array([b"".join(r[1] for r in rows)], pa.binary())],
                names=["dim", "home", "ids", "floors", "vecs"])
        for b in batches:
            for r in b.to_pylist():
                key = (r["dim"], r["shard"])
                held.setdefault(key, []).append((r["vec_id"], r["vec"], r["floor"]))
                if len(held[key]) >= block:
                    yield row(key)
        for key in list(held):
            yield row(key)
    return queries.repartition("dim", "shard").mapInArrow(
        run, "dim long, home long, ids array<long>, floors array<long>, vecs binary")


def top_k(vectors: DataFrame, k: int = K, scale: float = SCALE, query_step: int = QUERY_STEP,
          shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows of every id divisible by ``query_step``."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    n_shards = max(1, -(-v.count() // shard_rows))
    points = stored(v.mapInArrow(_quantise(scale, n_shards), "vec_id long, dim long, shard long, vec binary"), "points")
    queries = (points.where(F.col("vec_id") % query_step == 0).groupBy("vec_id", "dim", "shard")
               .agg(F.min("vec").alias("vec")))
    queries = stored(queries, "queries")

    def searched(blocks: DataFrame) -> DataFrame:
        return points.groupBy("dim", "shard").cogroup(blocks.groupBy("dim", "shard")).applyInArrow(_search(k), _OUT)

    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    home = _in_blocks(queries.withColumn("floor", F.lit(None).cast("long")), block).withColumnRenamed("home", "shard")
    first = stored(searched(home), "first")
    kth = first.withColumn("r", F.row_number().over(rank)).where(F.col("r") == k).select(
        F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    rest = _in_blocks(queries.join(kth, "vec_id", "left"), block)
    rest = rest.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)).cast("array<bigint>")))
    more = searched(rest.where(F.col("shard") != F.col("home")))
    both = first.unionByName(more).withColumn("rank", F.row_number().over(rank).cast("int"))
    return both.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP1_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE:g} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % {QUERY_STEP} = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""

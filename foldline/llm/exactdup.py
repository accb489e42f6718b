"""Operator 11: exact duplicates by an exchange of Golomb-coded fingerprints.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` is one space.

1. The normalised texts are written once, bucketed by block: a block is up to ``BLOCK`` neighbouring rows of one scan
   task, so that all later steps meet a block's rows in one task without shuffling texts.
2. Every block sends its distinct fingerprints (the leading bits of a 64-bit hash, about log2(rows) + ``SPARE`` of
   them), sorted and Golomb-coded, to the owners of their ranges. There are as many owners as keep ``OWNED``
   fingerprints each. A text that fills a block counts once there, so a hot text adds one number per block.
3. An owner merges its pieces and answers each with a bitmap of the fingerprints that another block holds too. The
   bitmaps go back to their blocks, where repeats inside the block are added and the result becomes one bit per row.
4. Rows with their bit set are suspects. Only their texts are shuffled: grouping by the text itself, combined before
   the shuffle, compares bytes. Fingerprints that merely collide end in classes of one row.
5. Classes (fingerprint, SHA-256, smallest id, size) are looked up for the suspects' rows, without texts. Classes of
   more than 1 / ``HOT`` of all rows, of which there can't be more than ``HOT``, are broadcast; the others are joined.

The texts' table is deleted before the result is returned; the result reads two small tables.

Edge cases: a null text counts as empty; empty texts and texts of blanks only (one space) are two classes. A null id is
larger than any other; a class with null ids only has keep_id null. Rows that repeat id and text are one class and one of
them, the first met, stays. Very long texts are single rows of the scan and of the grouping. Other columns take no
part; an empty table gives no rows. Two different texts of one SHA-256 raise an error.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm.common import discard, stored, table
from foldline.llm.golomb import decode, encode, words_of
from foldline.session import checkpoint_dir

BLANKS = r"[\x20\x09-\x0D]+"
BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS        # rows of a block at most
OWNED = 1 << 18                # fingerprints of an owner, about
SPARE = 12                     # bits beyond log2(rows): one fingerprint in 2**12 collides by chance
HOT = 4096


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[str, str]:
    """Step 1: ``(table name, path)`` of ``id, block, pos, doc_id, fp, sha, text``, bucketed by block."""
    spark = docs.sparkSession
    text = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), BLANKS, " ")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("id"))
    d = d.select("id", F.shiftright("id", BLOCK_BITS).alias("block"), F.col("id").bitwiseAND(BLOCK - 1).cast("int").alias("pos"),
                 "doc_id", F.xxhash64("text").alias("fp"), F.unhex(F.sha2("text", 256)).alias("sha"), "text")
    run = uuid.uuid4().hex
    name, path = f"foldline_texts_{run}", f"{checkpoint_dir(spark).rstrip('/')}/foldline-{run}/texts"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "block").saveAsTable(name)
    return name, path


class Ranges:
    """How fingerprints are cut to ``bits`` and dealt to ``owners`` by ranges."""

    def __init__(self, rows: int, partitions: int):
        self.bits = min(62, max(20, math.ceil(math.log2(rows + 1)) + SPARE))
        self.owners = max(partitions, -(-rows // OWNED))

    def cut(self, fp: np.ndarray) -> np.ndarray:
        return (fp.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pieces(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(owner, from, to)`` of the pieces of sorted numbers."""
        top = min(self.bits, 31)
        owner = ((h >> (self.bits - top)) * self.owners) >> top
        who, begin = np.unique(owner, return_index=True)
        return who, begin, np.append(begin[1:], len(h))


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _send(ranges: Ranges):
    def send(t: pa.Table) -> pa.Table:
        h = np.unique(ranges.cut(_column(t, "fp")))
        who, begin, end = ranges.pieces(h)
        codes = [encode(h[b:e]) for b, e in zip(begin, end)]
        return pa.table({"owner": pa.array(who, pa.int64()), "block": pa.array([t.column("block")[0].as_py()] * len(who), pa.int64()),
                         "code": pa.array(codes, pa.binary())})
    return send


def _answer(t: pa.Table) -> pa.Table:
    """An owner's pieces, each with the bitmap of its numbers that occur in another piece too."""
    lists = [decode(c) for c in t.column("code").to_pylist()]
    _, inverse, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    twice = (count > 1)[inverse]
    ends = np.cumsum([len(x) for x in lists])
    bits = [np.packbits(twice[e - len(x):e]).tobytes() for x, e in zip(lists, ends)]
    return pa.table({"block": t.column("block"), "owner": t.column("owner"), "bits": pa.array(bits, pa.binary())})


def _mark(ranges: Ranges):
    def mark(rows: pa.Table, answers: pa.Table) -> pa.Table:
        h, inverse, count = np.unique(ranges.cut(_column(rows, "fp")), return_inverse=True, return_counts=True)
        suspect = count > 1
        by_owner = dict(zip(answers.column("owner").to_pylist(), answers.column("bits").to_pylist()))
        for who, b, e in zip(*ranges.pieces(h)):
            suspect[b:e] |= np.unpackbits(np.frombuffer(by_owner[who], dtype=np.uint8))[:e - b].astype(bool)
        at = _column(rows, "pos")
        bit = np.zeros(int(at.max()) + 1, dtype=bool)
        bit[at] = suspect[inverse]
        return pa.table({"block": rows.column("block").slice(0, 1),
                         "suspects": pa.array([words_of(bit).tolist()], pa.list_(pa.int64()))})
    return mark


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per row of ``docs``."""
    spark = docs.sparkSession
    name, path = _texts(docs, id_col, text_col)
    try:
        texts = spark.table(name)
        rows = texts.count()
        ranges = Ranges(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
        prints = texts.select("block", "pos", "fp")
        sent = prints.groupBy("block").applyInArrow(_send(ranges), "owner long, block long, code binary")
        answers = sent.groupBy("owner").applyInArrow(_answer, "block long, owner long, bits binary")
        marks = stored(prints.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
            _mark(ranges), "block long, suspects array<bigint>"), "marks")
        # a block's bits meet its rows in the block's bucket: only the bits are shuffled
        marked = texts.join(marks.hint("shuffle_hash"), "block").withColumn(
            "suspect", F.expr("shiftright(suspects[pos div 64], pos % 64) & 1 = 1")).drop("suspects")
        members = stored(marked.select("id", "doc_id", "fp", "sha", "suspect"), "members")
        place = F.expr("coalesce(cast(doc_id as decimal(19,0)), 9223372036854775808) * cast(1000000000000000000 as decimal(19,0)) + id"
                       ).cast("decimal(38,0)")
        classes = marked.where("suspect").groupBy("fp", "sha", "text").agg(
            F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min(place).alias("first"))
        one = F.when(F.count(F.lit(1)) == 1, F.sum("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256")))
        classes = stored(classes.groupBy("fp", "sha").agg(F.min("keep_id").alias("keep_id"), one.alias("group_size"),
                                                          F.min("first").alias("first")), "classes")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(spark, path)
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    alone = members.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                                F.lit(True).alias("kept"), sha)
    hot = F.col("group_size") > rows / HOT                     # at most HOT classes
    found = ["doc_id", "keep_id", "group_size", (place == F.col("first")).alias("kept"), sha]
    suspects = members.where("suspect")
    large = F.broadcast(classes.where(hot))
    in_large = suspects.join(large, ["fp", "sha"]).select(*found)
    in_small = suspects.join(large, ["fp", "sha"], "left_anti").join(classes.where(~hot), ["fp", "sha"]).select(*found)
    return alone.unionByName(in_large).unionByName(in_small)


def op11_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
 row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d"""

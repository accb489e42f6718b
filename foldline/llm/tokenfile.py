"""Operator 9: token ids in a byte-aligned variable-length file, ids ranked by frequency.

File format. A file set is a folder of Parquet part files, in order; each row is a block::

    part, block      position in the file set
    first            ids of the same part before this block
    doc_ids, sizes   the block's documents in order and their id counts
    controls         control bytes: four 2-bit codes each, low bits first; code c means c + 1 bytes
    data             the rank of each id, little-endian in 1 to 4 bytes, without separators

beside it a table ``rank -> id`` (at most one row per vocabulary entry). Ranks follow the corpus-wide
frequency, so frequent ids take one byte. Control bytes stand apart from the data, so a block is decoded
by one table lookup per control byte and a numpy gather, without branches per id.

Steps: encode each text once (stored, unsorted, beside the counts of each partition's ids); add the counts (bounded
by the vocabulary); write the blocks range-partitioned by doc_id; read the files back.

Edge cases: null text counts as empty; an empty text is its end id alone; null doc_ids sort first;
rows that repeat a doc_id stay separate, ordered by their ids; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm.common import stored, table
from foldline.llm.textops import slices
from foldline.llm.tokens import encoder

END_ID = 2
BLOCK_IDS = 1 << 20      # ids of a block, about (documents aren't split over blocks)
RANGE_BYTES = 32         # of a document's ids that take part in range bounds

#: Code lengths of the four ids of each control byte.
_LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], dtype=np.int64)


def svb_encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of uint32 values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    padded[:len(v)] = code
    quad = padded.reshape(-1, 4)
    controls = quad[:, 0] | quad[:, 1] << 2 | quad[:, 2] << 4 | quad[:, 3] << 6
    widest = int(code.max(initial=0)) + 1
    used = np.arange(widest, dtype=np.uint8)[None, :] <= code[:, None]
    return controls.tobytes(), v.view(np.uint8).reshape(-1, 4)[:, :widest][used].tobytes()


def svb_decode(controls: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` uint32 values of a block."""
    size = _LENGTHS[np.frombuffer(controls, dtype=np.uint8)].reshape(-1)[:n]
    raw = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(4, dtype=np.uint8)]).astype(np.uint32)
    at = np.cumsum(size) - size
    out = raw[at]
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k] << np.uint32(8 * k)
    return out


def _tokens(path: str, blank: bool, end_id: int):
    def run(batches):
        enc, total = encoder(path, blank), np.zeros(0, dtype=np.int64)
        for b in slices(batches, "text"):
            flat, off = enc.encode(b.column("text").to_pylist())
            flat = np.insert(flat, off[1:], np.uint32(end_id))
            off = off + np.arange(len(off))
            ids = [flat[off[k]:off[k + 1]] for k in range(b.num_rows)]
            got = np.bincount(flat)
            if len(got) > len(total):
                total, got = got.astype(np.int64), total
            total[:len(got)] += got
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([pack_ids(x) for x in ids], pa.binary()), pa.nulls(b.num_rows, pa.binary())],
                names=["doc_id", "ids", "counts"])
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())],
                                             names=["doc_id", "ids", "counts"])
    return run


def pack_ids(ids: np.ndarray) -> bytes:
    """One document's ids in 2 or 4 bytes each, after one byte that tells the width."""
    wide = len(ids) and int(ids.max()) > 0xFFFF
    return (b"\4" if wide else b"\2") + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack_ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"<u{blob[0]}", offset=1)


def _count(batches):
    for b in batches:
        for blob in b.column("counts"):
            total = np.frombuffer(blob.as_py(), dtype=np.int64)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])


def _blocks(rank_of: np.ndarray, block_ids: int):
    def run(batches):
        part, block, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, ids, held = [], [], 0

        def row():
            flat = np.concatenate(ids)
            controls, data = svb_encode(rank_of[flat])
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([first], pa.int64()),
                 pa.array([doc_ids], pa.list_(pa.int64())), pa.array([[len(x) for x in ids]], pa.list_(pa.int64())),
                 pa.array([controls], pa.binary()), pa.array([data], pa.binary())],
                names=["part", "block", "first", "doc_ids", "sizes", "controls", "data"])

        for b in batches:
            for doc_id, blob in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                doc_ids.append(doc_id)
                ids.append(unpack_ids(blob.as_py()))
                held += len(ids[-1])
                if held >= block_ids:
                    yield row()
                    block, first, doc_ids, ids, held = block + 1, first + held, [], [], 0
        if ids:
            yield row()
    return run


BLOCK_SCHEMA = "part long, block long, first long, doc_ids array<long>, sizes array<long>, controls binary, data binary"


def write_token_file(docs: DataFrame, path: str, blank: bool = True, end_id: int = END_ID,
                     block_ids: int = BLOCK_IDS) -> tuple[DataFrame, np.ndarray]:
    """Write the file set below the shared folder; returns its blocks as read back and ``rank -> id``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    toks = stored(rows.mapInArrow(_tokens(path, blank, end_id), "doc_id long, ids binary, counts binary"), "tokens")
    counts = (toks.where("counts is not null").select("counts").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
              .collect())                                     # at most one row per vocabulary entry
    ranked = [r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))]
    id_of = np.array(ranked, dtype=np.uint32)
    rank_of = np.zeros(max(ranked, default=0) + 1, dtype=np.uint32)
    rank_of[id_of] = np.arange(len(ranked), dtype=np.uint32)
    # the range bounds are drawn on the driver: the first bytes of the ids are enough to part rows that repeat a doc_id
    ordered = toks.where("counts is null").select("doc_id", "ids").repartitionByRange(
        F.col("doc_id").asc_nulls_first(), F.substring("ids", 1, RANGE_BYTES)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    return stored(ordered.mapInArrow(_blocks(rank_of, block_ids), BLOCK_SCHEMA), "token_file"), id_of


def _decode(id_of: np.ndarray, before: dict[int, int]):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                sizes = np.array(r["sizes"], dtype=np.int64)
                ids = id_of[svb_decode(r["controls"], r["data"], int(sizes.sum()))].astype("<u4")
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - s:e].tobytes()) for s, e in zip(sizes, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(before[r["part"]] + r["first"] + ends - sizes),
                     pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def read_token_file(blocks: DataFrame, id_of: np.ndarray) -> DataFrame:
    """Per document: where its ids start in the whole sequence, how many, and their crc32."""
    parts = blocks.select("part", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before, total = {}, 0
    for r in parts.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():   # one row per part file
        before[r["part"]] = total
        total += r["n"]
    return blocks.mapInArrow(_decode(id_of, before), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    blocks, id_of = write_token_file(table(spark, sf_dir, "documents"),
                                     str(public_tokenizers.path("byte_bpe_50k.json")))
    return read_token_file(blocks, id_of)

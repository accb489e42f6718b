"""Operator 2: hierarchical multi-length packing of token sequences.

Tiers are powers of two up to ``max_len``. A document's ids (end id included) fill whole windows of
``max_len`` first; what is left goes to the shortest tier that holds it. Each tier is packed from
the longest down: a window opens with a document of its tier and its gap is filled from the shorter
tiers, longest fit first; when nothing fits, one piece is cut to size and its rest is queued again
in its own tier. Windows that stay open at the end of a partition are cut into powers of two, so
no sequence is padded. Sequences of a round are dealt to step groups by attention cost
(sum of squared piece lengths) in snake order, so that groups of a tier have the same count and
nearly the same cost.

Each scan partition packs its own documents in a stream; nothing is shuffled and only one round of
tokens is held. A document longer than a round is held whole while it is cut.

Edge cases: null text counts as empty; an empty text is its end id alone; null doc_id is kept as
null; repeated rows are packed once per row; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm.common import table
from foldline.llm.textops import slices
from foldline.llm.tokens import encoder

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
          "offset long, tier long, step_group long")
END_ID = 1
MAX_LEN = 2048
SHORTEST = 128           # shortest tier that documents are routed to
STEP = 16                # sequences of a step group
ROUND_TOKENS = 1 << 21   # ids held before a round of packing


class Packer:
    """Packs pieces ``(length, key)`` where ``key = (document, start)`` into windows of each tier."""

    def __init__(self, max_len: int, shortest: int):
        self.tiers = [max_len]
        while self.tiers[-1] > shortest:
            self.tiers.append(self.tiers[-1] // 2)
        self.queue: dict[int, list] = {t: [] for t in self.tiers}

    def tier_of(self, length: int) -> int:
        return max(self.tiers[-1], 1 << (length - 1).bit_length())

    def add(self, length: int, key: tuple) -> None:
        bisect.insort(self.queue[self.tier_of(length)], (length, key))

    def _fit(self, below: int, gap: int):
        """The longest queued piece of a tier of at most ``below`` that fits; else any longer one."""
        longer = None
        for t in self.tiers:
            if t > below or not self.queue[t]:
                continue
            q = self.queue[t]
            i = bisect.bisect_right(q, (gap, (float("inf"),)))
            if i:
                return q.pop(i - 1), longer
            longer = longer or (t, 0)
        return None, longer

    def windows(self, last: bool) -> Iterator[tuple[int, list]]:
        """``(tier, pieces)`` of every full window; with ``last`` also the open ones, cut to powers of two."""
        for t in self.tiers:
            q = self.queue[t]
            while q:
                total = sum(x[0] for s in self.tiers if s <= t for x in self.queue[s]) if len(q) < 8 else t
                if total < t and not last:
                    break                                       # wait for more documents
                pieces, gap = [q.pop()], t
                gap -= pieces[0][0]
                while gap:
                    fit, longer = self._fit(t, gap)
                    if fit is None and longer is None:
                        break
                    if fit is None:
                        size, key = self.queue[longer[0]].pop(longer[1])
                        fit = (gap, key)
                        self.add(size - gap, (key[0], key[1] + gap))
                    pieces.append(fit)
                    gap -= fit[0]
                if not gap:
                    yield t, pieces
                    continue
                yield from powers(pieces)


def powers(pieces: list) -> Iterator[tuple[int, list]]:
    """Cut a list of pieces into sequences whose lengths are powers of two, the longest first."""
    left = sum(x[0] for x in pieces)
    todo = list(reversed(pieces))
    while left:
        size = 1 << (left.bit_length() - 1)
        out, gap = [], size
        while gap:
            length, key = todo.pop()
            if length > gap:
                todo.append((length - gap, (key[0], key[1] + gap)))
                length = gap
            out.append((length, key))
            gap -= length
        yield size, out
        left -= size


def deal(windows: list, step: int) -> np.ndarray:
    """Step group of each window: per tier in order of cost, dealt forth and back over the groups."""
    groups = max(1, len(windows) // step)
    order = sorted(range(len(windows)), key=lambda i: (-windows[i][0], -sum(x[0] ** 2 for x in windows[i][1]), i))
    place = np.arange(len(windows))
    snake = np.where((place // groups) % 2 == 0, place % groups, groups - 1 - place % groups)
    out = np.empty(len(windows), dtype=np.int64)
    out[order] = snake
    return out


def _pack_partition(path: str, blank: bool, end_id: int, max_len: int, shortest: int, step: int, round_tokens: int):
    def run(batches):
        enc = encoder(path, blank)
        packer = Packer(max_len, shortest)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        held: dict[int, tuple] = {}          # document number -> (doc_id, ids)
        state = {"doc": 0, "seq": 0, "group": 0, "tokens": 0}

        def flush(full: list, last: bool):
            wins = full + list(packer.windows(last))
            cols: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id",
                                                     "offset", "tier", "step_group")}
            for (tier, pieces), group in zip(wins, deal(wins, step) if wins else []):
                at = 0
                for length, (doc, start) in pieces:
                    doc_id, ids = held[doc]
                    for k, v in (("doc_id", doc_id), ("start", start), ("length", length),
                                 ("ids", ids[start:start + length].tobytes()), ("doc_tokens", len(ids)),
                                 ("sequence_id", base + state["seq"]), ("offset", at), ("tier", tier),
                                 ("step_group", base + state["group"] + int(group))):
                        cols[k].append(v)
                    at += length
                state["seq"] += 1
            state["group"] += max(1, len(wins) // step)
            queued = {key[0] for q in packer.queue.values() for _, key in q}
            for doc in [d for d in held if d not in queued]:
                del held[doc]
            state["tokens"] = sum(len(held[d][1]) for d in held)
            for i in range(0, len(cols["doc_id"]), 4096):
                part = {k: v[i:i + 4096] for k, v in cols.items()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in part.items()], names=list(part))

        full: list = []
        for b in slices(batches, "text"):
            flat, off = enc.encode(b.column("text").to_pylist())
            for k, doc_id in enumerate(b.column("doc_id").to_pylist()):
                ids = np.append(flat[off[k]:off[k + 1]], np.uint32(end_id)).astype("<u4")
                doc, state["doc"] = state["doc"], state["doc"] + 1
                held[doc] = (doc_id, ids)
                whole = len(ids) // max_len
                full += [(max_len, [(max_len, (doc, i * max_len))]) for i in range(whole)]
                if len(ids) > whole * max_len:
                    packer.add(len(ids) - whole * max_len, (doc, whole * max_len))
                state["tokens"] += len(ids)
                if state["tokens"] >= round_tokens:
                    done, full = full, []
                    yield from flush(done, False)
        yield from flush(full, True)
    return run


def pack_documents(docs: DataFrame, path: str, blank: bool = False, end_id: int = END_ID, max_len: int = MAX_LEN,
                   shortest: int = SHORTEST, step: int = STEP, round_tokens: int = ROUND_TOKENS) -> DataFrame:
    """One row per piece with its ``ids`` (little-endian unsigned 32-bit), the sequence and offset it
    lies at, the sequence's ``tier`` (length) and ``step_group``.

    ``path`` names the vocabulary file; ``blank`` says whether its pieces keep the blank before them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pack_partition(path, blank, end_id, max_len, shortest, step, round_tokens), SCHEMA)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "tier", "step_group")

"""Operator 10: language-model scores from a weighted backoff automaton.

Model: n-grams up to ``order`` over word hashes, smoothed by adding ``mu`` times the shorter history's
probability::

    p(w | h) = (count(h w) + mu * p(w | h')) / (count(h) + mu),   h' = h without its oldest word

down to the base ``p(w) = (count(w) + 0.1) / (N + 0.1 * (V + 1))``. As an automaton: every seen history is a
state; a seen ``h w`` is an arc with the weight above; otherwise the failure arc of ``h`` leads to
``h'`` with weight ``mu / (count(h) + mu)``. One left-to-right traversal carries the state (the longest seen
history) and adds up log10 weights.

The automaton is as large as the corpus' n-grams, so no task holds it whole. Texts are written once as
blocks of documents (compressed). Each block asks for the counts of the distinct n-grams it holds: sorted
hashes with its own training counts, cut by leading bits into buckets; a bucket adds the counts of all blocks
and answers each block in the order asked. A block then builds the part of the automaton its own texts
can visit and traverses it. Hot n-grams are one entry per block.

Edge cases: null text counts as empty, an empty text is its end token alone; a null doc_id hashes as empty
text and is kept as null; repeated rows count one by one; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm.common import stored, table
from foldline.llm.textops import U, batch_words, mix, slices

ORDER = 2
MU = 50.0
ADD = 0.1
FOLDS = 10
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20   # bytes of text per bucket of n-grams, about
END = U(0x5EED0E2D00000001)     # the end token
START = U(0x5EED0E2D00000002)   # history before the first word


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def _blocks(batches):
    base, seq = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0
    press = zstandard.ZstdCompressor(level=3)
    for b in slices(batches, "text", BLOCK_BYTES):
        texts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([base + seq], pa.int64()), pa.array([b.column("doc_id").to_pylist()], pa.list_(pa.int64())),
             pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([press.compress(b"".join(texts))], pa.binary())],
            names=["block", "doc_ids", "sizes", "texts"])
        seq += 1


def tokens(sizes: list[int], blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a block's documents in order, each with its end token, and the document offsets."""
    raw = zstandard.decompress(blob, max_output_size=max(1, sum(sizes)))
    off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    texts = pa.array([raw[off[i]:off[i + 1]].decode("utf-8", "surrogatepass") for i in range(len(sizes))], pa.string())
    words, at = batch_words(texts)
    return np.insert(words, at[1:], END), at + np.arange(len(at))


def grams(tok: np.ndarray, off: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each token, for n = 1 .. order; histories before the first
    word are filled with one start token, so an n-gram is cut at the document's start (0: no such n-gram)."""
    first = np.zeros(len(tok), dtype=np.int64)
    starts = off[:-1]
    first[starts[1:]] = np.diff(starts)
    place = np.arange(len(tok)) - np.cumsum(first)
    out = [mix(tok + U(1))]
    for n in range(2, order + 1):
        h = mix(np.full(len(tok), U(n)))
        for back in range(n - 1, -1, -1):
            w = np.where(place >= back, np.roll(tok, back), START)
            h = mix(h * U(0x9FB21C651E98DF25) + w)
        # of the n-grams that reach before the document only the one that starts right at it is kept
        out.append(np.where(place >= n - 2, np.maximum(h, U(1)), U(0)))
    return out


def histories(tok: np.ndarray, off: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the history of n - 1 tokens before each token, as the (n - 1)-gram that is counted for it; 0: none."""
    out = []
    starts = off[:-1]
    for n, g in enumerate(grams(tok, off, order - 1) if order > 1 else [], start=1):
        h = np.roll(g, 1)
        if len(h):
            h[starts] = START if n == 1 else U(0)
        out.append(h)
    return out


def _block_counts(r: dict, order: int):
    """Per n: the sorted distinct n-grams of a block (and, for n = 1, the start) with their training counts."""
    tok, off = tokens(r["sizes"], r["texts"])
    train = np.repeat(np.array([not held_out(d) for d in r["doc_ids"]]), np.diff(off))
    begins = sum(not held_out(d) for d in r["doc_ids"])
    for n, g in enumerate(grams(tok, off, order), start=1):
        keys, inv = np.unique(g, return_inverse=True)
        count = np.bincount(inv, weights=train, minlength=len(keys)).astype(np.int64)
        if n == 1 and order > 1:
            at = np.searchsorted(keys, START)
            keys, count = np.insert(keys, at, START), np.insert(count, at, begins)
        yield n, keys, count


def _cut(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket of sorted keys begins and the last one ends."""
    if not bits:
        return np.array([0, len(keys)])
    edges = np.arange(1, 1 << bits, dtype=U) << U(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _ask(order: int, bits: int):
    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for r in b.to_pylist():
                for n, keys, count in _block_counts(r, order):
                    at = _cut(keys, bits)
                    rows = [(n, i, r["block"], keys[at[i]:at[i + 1]].tobytes(),
                             press.compress(count[at[i]:at[i + 1]].astype("<u4").tobytes()))
                            for i in range(len(at) - 1) if at[i + 1] > at[i]]
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                         pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())],
                        names=["n", "bucket", "block", "keys", "counts"])
    return run


def _answer(batches):
    """Adds the counts of one bucket after the other and answers its blocks; ``total`` and ``seen``
    are the bucket's training count and distinct n-grams, given with its first block."""
    press = zstandard.ZstdCompressor(level=1)

    def flush(key, rows):
        keys = [np.frombuffer(r[1], dtype=U) for r in rows]
        counts = [np.frombuffer(zstandard.decompress(r[2]), dtype="<u4").astype(np.int64) for r in rows]
        every, inv = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inv, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)
        cuts = np.cumsum([0] + [len(k) for k in keys])
        own = (every != START) & (every != U(0))
        sums = [int(total[own].sum())] + [0] * (len(rows) - 1)
        seen = [int((total[own] > 0).sum())] + [0] * (len(rows) - 1)
        for i in range(0, len(rows), 64):
            part = range(i, min(len(rows), i + 64))
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(part), pa.int32()), pa.array([key[1]] * len(part), pa.int64()),
                 pa.array([rows[j][0] for j in part], pa.int64()),
                 pa.array([press.compress(total[inv[cuts[j]:cuts[j + 1]]].astype("<u8").tobytes()) for j in part], pa.binary()),
                 pa.array([sums[j] for j in part], pa.int64()), pa.array([seen[j] for j in part], pa.int64())],
                names=["n", "bucket", "block", "answer", "total", "seen"])
    key, rows = None, []
    for b in batches:
        for n, bucket, block, keys, counts in zip(*[b.column(c).to_pylist() for c in ("n", "bucket", "block", "keys", "counts")]):
            if rows and (n, bucket) != key:
                yield from flush(key, rows)
                rows = []
            key = (n, bucket)
            rows.append((block, keys, counts))
    if rows:
        yield from flush(key, rows)


def traverse(tok, off, order, lookup, n_total: int, v_total: int, mu: float):
    """Per token: its base probability's log10, whether it is known, and the weight of the traversal.

    ``lookup(n, hashes)`` gives training counts. Level by level the state is extended: where ``h w`` is an arc its
    weight replaces the one reached so far, elsewhere the failure weight of ``h`` is added to it."""
    g = grams(tok, off, order)
    c = lookup(1, g[0])
    p = (c + ADD) / (n_total + ADD * (v_total + 1))
    base, known = np.log10(p), c > 0
    weight = base.copy()
    for n, h in enumerate(histories(tok, off, order), start=2):
        state = h != 0
        ch = np.where(state, lookup(n - 1, h), 0)
        arc = np.where(state, lookup(n, g[n - 1]), 0)
        arc = np.where(ch > 0, arc, 0)
        lower = np.power(10.0, weight)
        failed = weight + np.log10(mu / (ch + mu))              # failure arc, then the shorter history's weight
        weight = np.where(arc > 0, np.log10((arc + mu * lower) / (ch + mu)), np.where(ch > 0, failed, weight))
    return base, known, weight


def _score(order: int, n_total: int, v_total: int, mu: float):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                tok, off = tokens(r["sizes"], r["texts"])
                answers: dict[int, list] = {}
                for x in sorted(r["answers"], key=lambda x: (x["n"], x["bucket"])):
                    answers.setdefault(x["n"], []).append(np.frombuffer(zstandard.decompress(x["answer"]), dtype="<u8"))
                known_counts = {}
                for n, g in enumerate(grams(tok, off, order), start=1):
                    keys = np.unique(g)
                    if n == 1 and order > 1:
                        keys = np.insert(keys, np.searchsorted(keys, START), START)
                    known_counts[n] = (keys, np.concatenate(answers[n]).astype(np.float64))

                def lookup(n, h):
                    keys, count = known_counts[n]
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    return np.where(keys[at] == h, count[at], 0.0)

                base, known, weight = traverse(tok, off, order, lookup, n_total, v_total, mu)
                at = off[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array([held_out(d) for d in r["doc_ids"]], pa.bool_()),
                     pa.array(np.diff(off)), pa.array(np.add.reduceat(known.astype(np.int64), at)),
                     pa.array(np.full(len(at), n_total)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(weight, at))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def lm_scores(docs: DataFrame, order: int = ORDER, mu: float = MU) -> DataFrame:
    """Per document: fold, token counts, the base score and the automaton's log10 probability."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = stored(rows.mapInArrow(_blocks, "block long, doc_ids array<long>, sizes array<long>, texts binary"), "blocks")
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total / BUCKET_BYTES))))
    asked = blocks.mapInArrow(_ask(order, bits), "n int, bucket long, block long, keys binary, counts binary")
    answers = (asked.repartition("n", "bucket").sortWithinPartitions("n", "bucket")
               .mapInArrow(_answer, "n int, bucket long, block long, answer binary, total long, seen long"))
    answers = stored(answers, "answers")
    size = answers.where("n = 1").agg(F.sum("total").alias("n"), F.sum("seen").alias("v")).first()
    per_block = answers.groupBy("block").agg(F.collect_list(F.struct("n", "bucket", "answer")).alias("answers"))
    return blocks.join(per_block, "block").mapInArrow(
        _score(order, size["n"] or 0, size["v"] or 0, mu),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))

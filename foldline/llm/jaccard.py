"""Operator 4: n-gram Jaccard join with rare-first prefix filtering.

A document's set are its distinct ``k``-word shingles (64-bit hashes). Two documents link when
``100 * intersection >= percent * union``. The join works on one document per distinct set:

1. *Frequencies.* One pass adds every shingle of every document to a row of ``CELLS`` counters (a count
   sketch: frequent shingles have large counters, whatever the corpus' size). Any fixed order is right for
   prefix filtering; this one puts rare shingles first. The counters are broadcast; their number is a constant.
2. *Prefixes.* In that order a set of n shingles keeps its first ``n - ceil(percent * n / 100) + 1``; two linked
   sets share a prefix shingle. The second pass also keeps a vector of counts (how many shingles
   fall into each hash range, about as many ranges as shingles) for the suffix filter.
3. *Candidates.* Prefix shingles are dealt by hash in packed blocks; repeats inside a block of
   documents are folded first. Shingles of one document only are dropped there. Each other
   shingle proposes its documents with the smallest one of them (a star, not all pairs), filtered by length
   (``min >= percent * max / 100``), by position (what can still follow the shared shingle) and by suffix
   (``sum(min(range counts))`` bounds the intersection).
4. *Verification.* Each proposed pair is verified once on the whole sets; links give components.
5. *More stars.* Shingles whose documents still lie in several components propose stars around other
   documents, ``STARS`` rounds in all; only pairs of different components are verified.
6. *Residue.* What stars did not propose matters between different components only. The shingles whose
   documents still lie in several components gather those with the smallest one (one row per document), a
   large gathering is dealt in blocks that meet pairwise. A task compares the documents of two blocks by the
   same filters in arrays and passes on only the pairs that the suffix filter leaves, verified once. So copies, however
   many, never meet pairwise, pairs below the threshold take no rows, and no link between different components is lost.

Whole sets are computed anew for the documents of proposed pairs; a bit table of their ids (8 bits per document, at
most ``MAX_BITS``) lets the scan skip most others, so texts are never shuffled.

Edge cases: null and empty texts, and texts of blanks, have an empty set and link with nothing; a shorter text
than k words has one shingle; rows with a null doc_id count shingles, link with nothing and have a null
component; rows that repeat a doc_id share a component, reached by the links of any of them; ties
don't occur (links are decided on whole sets, and the smallest id names a component); texts of any length are read in
whole, a very long one by itself; an empty table gives no rows; other columns are ignored. Tables in between are deleted
when they have been read; the result is one stored table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm.common import stored, table, temporary
from foldline.llm.graph import components
from foldline.llm.textops import batch_words, mix, shingle_hashes, slices

K = 4
PERCENT = 85
CELLS = 1 << 22
SLICES = 64              # parts in which counters travel
RANGES = 64              # of the suffix filter, at least
MAX_RANGES = 1 << 16
STARS = 2
MAX_BITS = 1 << 30       # of the bit table of ids that is broadcast
SHARE_BYTES = 8 << 20    # packed prefix bytes that a bucket holds, about
BLOCK = (64, 2048)       # documents of a block of the residue, least and most
BLOCKS = 512             # of which there are about so many
PAIRS = 1 << 20          # pairs compared at a time
PAIR_BYTES = 32 << 20    # of their range counts
SIDE = 1 << 21           # shingles of a block of the residue, about
ALONE = 32               # entries of a shingle that are matched with each other to drop those without a partner


def shingle_sets(batch: pa.RecordBatch, k: int):
    """The sorted distinct shingles of every text of a batch."""
    words, off = batch_words(batch.column("text"))
    for i in range(batch.num_rows):
        yield np.unique(shingle_hashes(words[off[i]:off[i + 1]], k))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


# --- 1. sizes, set digests and counters ---------------------------------------------------

def _first_pass(k: int, cells: int):
    shift, part = np.uint64(64 - (cells.bit_length() - 1)), cells // SLICES

    def run(batches):
        count = np.zeros(cells, dtype=np.uint32)
        for b in slices(batches, "text"):
            n, digest, seen = [], [], []
            for s in shingle_sets(b, k):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                seen.append(s)
            count += np.bincount((np.concatenate(seen) >> shift).astype(np.int64), minlength=cells).astype(np.uint32)
            size = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                 pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary())], names=["doc_id", "n", "digest", "slice", "counts"])
        press = zstandard.ZstdCompressor(level=1)
        for i in range(SLICES):
            own = count[i * part:(i + 1) * part]
            if own.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([i], pa.int64()),
                     pa.array([press.compress(own.tobytes())], pa.binary())], names=["doc_id", "n", "digest", "slice", "counts"])
    return run


def _add_counts(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, blob in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist()):
            own = np.frombuffer(zstandard.decompress(blob), dtype=np.uint32)
            total[i] = total[i] + own if i in total else own.astype(np.uint64)
    for i, own in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([i], pa.int64()), pa.array([zstandard.compress(own.tobytes(), 1)], pa.binary())], names=["slice", "counts"])


def counters(first: DataFrame, cells: int) -> np.ndarray:
    """The added counters: ``cells`` numbers, a constant."""
    out = np.zeros(cells, dtype=np.uint64)
    part = cells // SLICES
    rows = (first.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice")
            .mapInArrow(_add_counts, "slice long, counts binary"))
    for r in rows.collect():
        out[r["slice"] * part:(r["slice"] + 1) * part] = np.frombuffer(zstandard.decompress(r["counts"]), dtype=np.uint64)
    return np.minimum(out, 2 ** 32 - 1).astype(np.uint32)


# --- 2. prefixes --------------------------------------------------------------------------

def range_counts(s: np.ndarray) -> bytes:
    """How many shingles fall into each hash range, in a byte each; a count above 255 makes it four bytes each and one more at the end."""
    m = min(MAX_RANGES, max(RANGES, 1 << max(0, len(s) - 1).bit_length()))
    r = np.bincount((s >> np.uint64(3) & np.uint64(m - 1)).astype(np.int64), minlength=m)
    return r.astype(np.uint8).tobytes() if r.max() < 256 else r.astype("<u4").tobytes() + b"\0"


def _table(blobs: list[bytes]) -> np.ndarray:
    """Range counts of the same length as the rows of one array."""
    size = len(blobs[0])
    rows = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, size)
    return rows if size % 2 == 0 else np.ascontiguousarray(rows[:, :-1]).view("<u4")


def _most(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest possible intersections of sets, row by row; the finer ranges are added up to the coarser ones."""
    width = min(a.shape[1], b.shape[1])
    a, b = (x if x.shape[1] == width else x.reshape(len(x), -1, width).sum(axis=1, dtype=np.uint32) for x in (a, b))
    return np.minimum(a, b).sum(axis=1, dtype=np.int64)

def _prefixes(k: int, percent: int, shared, cells: int, copies):
    """Prefixes and range counts of texts with an id and words; ``sure`` tells that the id is none of the copies."""
    shift = np.uint64(64 - (cells.bit_length() - 1))

    def run(batches):
        count, on = shared.value, np.unpackbits(copies.value).view(bool)
        for b in slices(batches, "text"):
            pre, ranges, size = [], [], []
            for s in shingle_sets(b, k):
                size.append(len(s))
                p = prefix_length(len(s), percent)
                c = count[(s >> shift).astype(np.int64)]
                order = np.lexsort((s, c))[:p]
                pre.append(s[order].tobytes())
                ranges.append(range_counts(s))
            ids = np.asarray(pc.fill_null(b.column("doc_id"), 0)).astype(np.int64)
            out = pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(size, pa.int64()), pa.array(pre, pa.binary()), pa.array(ranges, pa.binary()),
                 pa.array(~on[_place(ids, len(on))])], names=["doc_id", "n", "prefix", "ranges", "sure"])
            yield out.filter(pc.and_(b.column("doc_id").is_valid(), pa.array(np.array(size) > 0)))
    return run


# --- 3. candidates ------------------------------------------------------------------------

_PACKED = "bucket int, grams binary, docs binary, sizes binary, places binary, together boolean"


def _deal(n_buckets: int):
    """Prefix entries in packed blocks by hash bucket. Entries whose shingle repeats within a block go
    on once more as already shared, and only one of them stands for the shingle elsewhere."""
    def pack(gram, doc, size, place, together):
        bucket = (gram >> np.uint64(20)) % np.uint64(n_buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=np.uint64(n_buckets + 1)))
        for at, to in zip(edges, np.append(edges[1:], len(order))):
            o = order[at:to]
            yield int(bucket[o[0]]), gram[o].tobytes(), doc[o].tobytes(), size[o].tobytes(), place[o].tobytes(), together

    def flush(held):
        if not held:
            return
        gram = np.concatenate([h[0] for h in held])
        lens = np.array([len(h[0]) for h in held])
        doc = np.repeat(np.array([h[1] for h in held], dtype=np.int64), lens)
        size = np.repeat(np.array([h[2] for h in held], dtype=np.int32), lens)
        place = np.concatenate([np.arange(x, dtype=np.int32) for x in lens])
        order = np.lexsort((doc, gram))
        gram, doc, size, place = gram[order], doc[order], size[order], place[order]
        new = np.ones(len(gram), dtype=bool)
        new[1:] = gram[1:] != gram[:-1]
        twin = ~new
        twin[:-1] |= ~new[1:]
        rows = list(pack(gram[new], doc[new], size[new], place[new], False))
        rows += list(pack(gram[twin], doc[twin], size[twin], place[twin], True))
        for i in range(0, len(rows), 256):
            cols = list(zip(*rows[i:i + 256]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:5]], pa.array(cols[5])],
                names=["bucket", "grams", "docs", "sizes", "places", "together"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            for doc, size, blob in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("prefix").to_pylist()):
                held.append((np.frombuffer(blob, dtype=np.uint64), doc, size))
                n += len(blob)
                if n >= SHARE_BYTES:
                    yield from flush(held)
                    held, n = [], 0
        yield from flush(held)
    return run


def _partners(group: np.ndarray, doc: np.ndarray, n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Which entries of the shingles ``group`` (sorted) pass the length and positional filter with another document; all of those of
    a shingle with more than ``ALONE`` entries."""
    count = np.bincount(group)[group] if len(group) else group
    out = count > ALONE
    few = np.flatnonzero(~out)
    for i, j in _pairs(group[few]):
        i, j = few[i], few[j]
        ok = (doc[i] != doc[j]) & _fits(n[i], place[i], n[j], place[j], percent)
        out[i[ok]] = out[j[ok]] = True
    return out


def _shared(percent: int):
    """The entries of shingles that several documents hold, from the blocks of one bucket after the other, each with the document
    that its shingle proposes. All entries of a shingle lie in one bucket."""
    def flush(rows):
        cols = [np.concatenate([np.frombuffer(r[i], dtype=t) for r in rows])
                for i, t in enumerate((np.uint64, np.int64, np.int32, np.int32))]
        together = np.repeat(np.array([r[4] for r in rows]), [len(r[0]) // 8 for r in rows])
        gram = cols[0][~together]
        order = np.argsort(gram, kind="stable")
        g = gram[order]
        twin = np.zeros(len(g), dtype=bool)
        twin[1:] = g[1:] == g[:-1]
        twin[:-1] |= twin[1:]
        across = np.zeros(len(g), dtype=bool)
        across[order] = twin
        keep = together.copy()
        keep[np.flatnonzero(~together)[across]] = True
        gram, doc, n, place = (c[keep] for c in cols)
        order = np.lexsort((place, n, mix(doc.view(np.uint64)), gram))       # the first document of a shingle leads it
        gram, doc, n, place = gram[order], doc[order], n[order], place[order]
        once = np.ones(len(gram), dtype=bool)
        once[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1]) | (n[1:] != n[:-1]) | (place[1:] != place[:-1])
        gram, doc, n, place = gram[once], doc[once], n[once], place[once]
        keep = _partners(np.cumsum(np.append(False, gram[1:] != gram[:-1])), doc, n, place, percent) if len(gram) else once
        gram, doc, n, place = gram[keep], doc[keep], n[keep], place[keep]
        first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, dtype=np.int64)
        lead = np.repeat(first, np.diff(np.append(first, len(gram))))
        for i in range(0, len(gram), 1 << 16):
            o, own = slice(i, i + (1 << 16)), lead[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[o].view(np.int64)), pa.array(doc[o]), pa.array(n[o]), pa.array(place[o]),
                 pa.array(doc[own]), pa.array(n[own]), pa.array(place[own])],
                names=["gram", "doc", "n", "place", "lead", "lead_n", "lead_place"])

    def run(batches):
        bucket, rows = None, []
        for b in batches:
            for r in zip(b.column("bucket").to_pylist(), b.column("grams").to_pylist(), b.column("docs").to_pylist(),
                         b.column("sizes").to_pylist(), b.column("places").to_pylist(), b.column("together").to_pylist()):
                if rows and r[0] != bucket:
                    yield from flush(rows)
                    rows = []
                bucket = r[0]
                rows.append(r[1:])
        if rows:
            yield from flush(rows)
    return run


def _fits(n1, p1, n2, p2, percent: int) -> np.ndarray:
    """Length and positional filter of documents of ``n1`` and ``n2`` shingles that share the ones at places ``p1`` and ``p2``."""
    n1, p1, n2, p2 = (x.astype(np.int64) for x in (n1, p1, n2, p2))
    ok = np.minimum(n1, n2) * 100 >= np.maximum(n1, n2) * percent
    return ok & (np.minimum(p1, p2) + np.minimum(n1 - p1, n2 - p2) >= -(-(n1 + n2) * percent // (100 + percent)))


def _plausible(percent: int):
    """Length and positional filter of entries ``n, place`` and the leads of their shingles."""
    least = F.ceil((F.col("n") + F.col("lead_n")) * percent / (100.0 + percent) - 1e-9)
    after = F.least(F.col("n") - F.col("place"), F.col("lead_n") - F.col("lead_place"))
    return ((F.least("n", "lead_n") * 100 >= F.greatest("n", "lead_n") * percent)
            & (F.least("place", "lead_place") + after >= least))


def _possible(ra: list[bytes], rb: list[bytes], percent: int) -> np.ndarray:
    """Which pairs' range counts allow the intersection that the threshold needs."""
    sizes = np.array([[len(x), len(y)] for x, y in zip(ra, rb)], dtype=np.int64).reshape(-1, 2)
    out = np.zeros(len(sizes), dtype=bool)
    for x, y in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes[:, 0] == x) & (sizes[:, 1] == y))
        step = max(1, PAIR_BYTES // int(x + y))
        for i in range(0, len(at), step):
            own = at[i:i + step]
            a, b = _table([ra[k] for k in own]), _table([rb[k] for k in own])
            most = _most(a, b)
            out[own] = 100 * most >= percent * (a.sum(axis=1, dtype=np.int64) + b.sum(axis=1, dtype=np.int64) - most)
    return out


def _suffix(percent: int):
    """Keeps pairs whose range counts allow the intersection that the threshold needs."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                ok = _possible(b.column("ra").to_pylist(), b.column("rb").to_pylist(), percent)
                yield b.select(["a", "b"]).filter(pa.array(ok))
    return run


# --- 4. pairs of blocks -------------------------------------------------------------------

def _pairs(group: np.ndarray):
    """Places ``i < j`` of equal values of a sorted array, about ``PAIRS`` at a time."""
    n = len(group)
    ends = np.searchsorted(group, group, side="right")
    more = ends - np.arange(n) - 1
    done = np.cumsum(more)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, side="right")))
        i = np.repeat(np.arange(at, to), more[at:to])
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(more[at:to]) - more[at:to], more[at:to])
        at = to


def _meet(rows: pa.Table, block: np.ndarray, percent: int):
    """Pairs of rows of one block, in different components, that share a shingle and pass all filters: a row for each document
    that has any, with the documents behind it that it meets."""
    doc, n, c, x, y, side = (np.asarray(rows.column(k)) for k in ("doc", "n", "c", "x", "y", "side"))
    held = rows.column("held").combine_chunks()
    own = np.repeat(np.arange(len(doc)), np.asarray(pc.list_value_length(held)))
    gram, place = (np.asarray(held.flatten().field(k)) for k in ("gram", "place"))
    order = np.lexsort((gram, block[own]))
    own, gram, place = own[order], gram[order], place[order]
    new = np.ones(len(own), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (block[own][1:] != block[own][:-1])
    ranges, seen = rows.column("ranges").to_pylist(), np.zeros(len(doc) ** 2, dtype=bool)
    wide = np.array([len(r) for r in ranges])
    tables, row = {}, np.zeros(len(doc), dtype=np.int64)
    met, named = np.zeros(len(doc), dtype=bool), np.zeros(len(doc), dtype=bool)

    def out(at, others):
        return pa.RecordBatch.from_arrays([*(rows.column(k).combine_chunks().take(pa.array(at)) for k in ("lead", "x", "y", "doc")), others],
                                          names=["lead", "x", "y", "doc", "others"])

    for w in np.unique(wide):
        at = np.flatnonzero(wide == w)
        tables[w], row[at] = _table([ranges[k] for k in at]), np.arange(len(at))
    for i, j in _pairs(np.cumsum(new)):
        p, q = own[i], own[j]
        ok = (c[p] != c[q]) & (doc[p] != doc[q]) & ((x[p] == y[p]) | (side[p] != side[q]))
        ok &= _fits(n[p], place[i], n[q], place[j], percent)
        p, q = p[ok], q[ok]
        codes = np.unique(np.minimum(p, q) * len(doc) + np.maximum(p, q))
        codes = codes[~seen[codes]]
        seen[codes] = True
        p, q = codes // len(doc), codes % len(doc)
        for w, v in np.unique(np.stack([wide[p], wide[q]], axis=1), axis=0):
            at = np.flatnonzero((wide[p] == w) & (wide[q] == v))
            step = max(1, PAIR_BYTES // int(w + v))
            for k in range(0, len(at), step):
                a, b = p[at[k:k + step]], q[at[k:k + step]]
                most = _most(tables[w][row[a]], tables[v][row[b]])
                both = 100 * most >= percent * (n[a].astype(np.int64) + n[b] - most)
                if both.any():
                    a, b = a[both], b[both]                          # a is sorted
                    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                    named[a[first]], met[b] = True, True
                    yield out(a[first], pa.ListArray.from_arrays(pa.array(np.append(first, len(a)), pa.int32()), pa.array(doc[b])))
    rest = np.flatnonzero(met & ~named)
    if len(rest):
        yield out(rest, pa.array([[]] * len(rest), pa.list_(pa.int64())))


def _compare(percent: int):
    """What meets in the blocks that a partition holds, whole blocks of a few thousand rows at a time."""
    def run(batches):
        held: list[pa.RecordBatch] = []
        size, last = 0, None

        def flush():
            rows = pa.Table.from_batches(held)
            key = np.stack([np.asarray(rows.column(k)) for k in ("lead", "x", "y")])
            block = np.cumsum(np.concatenate([[False], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
            return _meet(rows, block, percent)

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([np.asarray(b.column(k)) for k in ("lead", "x", "y")])
            first = tuple(key[:, 0])
            edges = [0] if first != last else []
            edges += list(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1)
            at = 0
            for e in edges:
                if size + e - at >= BLOCK[1]:
                    held += [b.slice(at, e - at)] if e > at else []
                    yield from flush()
                    held, size, at = [], 0, e
            if b.num_rows > at:
                held.append(b.slice(at))
                size += b.num_rows - at
            last = tuple(key[:, -1])
        if held:
            yield from flush()
    return run


# --- 5. verification ----------------------------------------------------------------------

_SLICE = 4096            # bytes of Spark's bitmaps


def _place(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _bits(n: int) -> int:
    """Places of a bit table for ``n`` ids."""
    return 1 << min(MAX_BITS.bit_length() - 1, max(16, (8 * n).bit_length()))


def _bit_table(ids: DataFrame, bits: int) -> np.ndarray:
    """Which of ``bits`` places the ids fall on: one table of at most that many bits per partition, added up slice by slice."""
    def run(batches):
        on = np.zeros(bits, dtype=bool)
        for b in batches:
            on[_place(np.asarray(b.column(0)).astype(np.int64), bits)] = True
        on = np.packbits(on).reshape(-1, _SLICE)
        for at in np.array_split(np.flatnonzero(on.any(axis=1)), max(1, len(on) // 256)):
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([x.tobytes() for x in on[at]], pa.binary())], names=["slice", "bits"])
    out = np.zeros((bits // 8 // _SLICE, _SLICE), dtype=np.uint8)
    for r in ids.mapInArrow(run, "slice long, bits binary").groupBy("slice").agg(F.bitmap_or_agg("bits").alias("bits")).collect():
        out[r["slice"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.reshape(-1)


def _known(shared):
    """The rows whose id falls on a place of the bit table."""
    def run(batches):
        on = np.unpackbits(shared.value).view(bool)
        for b in batches:
            ids = np.asarray(b.column("doc_id")).astype(np.int64)
            yield b.filter(pa.array(on[_place(ids, len(on))]))
    return run


def _sets(k: int, shared, bits: int):
    """The sets of the texts whose id falls on a place of the bit table."""
    def run(batches):
        on = np.unpackbits(shared.value).view(bool)
        for b in batches:
            ids = b.column("doc_id")
            known = np.array(ids.is_valid(), dtype=bool)
            known[known] = on[_place(np.asarray(ids.drop_null()).astype(np.int64), bits)]
            for part in slices([b.filter(pa.array(known))], "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(part, k)], pa.binary())], names=["doc_id", "set"])
    return run


def _verify(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                inter = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _verify_blocks(percent: int):
    """Links of the blocks of a partition by whole sets, a forest of them for each block: documents that it has linked already
    aren't compared again."""
    def links(rows):
        own: dict[int, list[np.ndarray]] = {}
        meets: dict[int, set[int]] = {}
        for doc, others, blob in rows:
            own.setdefault(doc, []).append(np.frombuffer(blob, dtype=np.uint64))
            meets.setdefault(doc, set()).update(others)
        up = {d: d for d in own}

        def root(d):
            while up[d] != d:
                up[d] = d = up[up[d]]
            return d

        for a, others in meets.items():
            todo = sorted(others)
            while todo:
                # few at a time, so that links spare comparisons and memory is bounded
                some, size = [], 0
                while todo and len(some) < 64 and size < SIDE:
                    b = todo.pop()
                    if root(a) != root(b):
                        some += [(b, x) for x in own[b]]
                        size += sum(map(len, own[b]))
                if not some:
                    continue
                flat, sizes = np.concatenate([x for _, x in some]), np.array([len(x) for _, x in some])
                for s in own[a]:
                    hit = s[np.minimum(np.searchsorted(s, flat), len(s) - 1)] == flat
                    inter = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
                    for k in np.flatnonzero(100 * inter >= percent * (len(s) + sizes - inter)):
                        b = some[k][0]
                        x, y = root(a), root(b)
                        if x != y:
                            up[max(x, y)] = min(x, y)
                            yield min(a, b), max(a, b)

    def run(batches):
        last, rows = None, []

        def flush():
            got = list(links(rows))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got)], names=["a", "b"])

        for b in batches:
            for key, row in zip(zip(*(b.column(k).to_pylist() for k in ("lead", "x", "y"))),
                                zip(*(b.column(k).to_pylist() for k in ("doc", "others", "set")))):
                if key != last and rows:
                    yield from flush()
                    rows = []
                last = key
                rows.append(row)
        if rows:
            yield from flush()
    return run


class _Join:
    def __init__(self, docs: DataFrame, k: int, percent: int, n_docs: int):
        self.docs, self.k, self.percent = docs, k, percent
        self.bits = _bits(n_docs)

    def ranges_of(self, ids: DataFrame, ranges: DataFrame) -> DataFrame:
        """The range counts of these documents, and of few others, so that joins shuffle little else."""
        shared = ranges.sparkSession.sparkContext.broadcast(_bit_table(ids, self.bits))
        out = stored(ranges.mapInArrow(_known(shared), "doc_id long, n long, ranges binary"), "ranges")
        shared.destroy()
        return out

    def filtered(self, pairs: DataFrame, ranges: DataFrame) -> DataFrame:
        """The distinct pairs ``a, b`` that the suffix filter leaves."""
        with temporary(self.docs.sparkSession):
            some = stored(pairs.distinct(), "pairs")
            own = self.ranges_of(some.select("a").unionByName(some.select(F.col("b").alias("a"))), ranges)
            r = own.select(F.col("doc_id").alias("a"), F.col("ranges").alias("ra"))
            r2 = own.select(F.col("doc_id").alias("b"), F.col("ranges").alias("rb"))
            return stored(some.join(r, "a").join(r2, "b").mapInArrow(_suffix(self.percent), "a long, b long"), "pairs", keep=True)

    def residue(self, e: DataFrame, ranges: DataFrame) -> DataFrame:
        """Pairs ``a, b`` of different components that share a shingle of ``e`` and pass all filters, one by one."""
        met = self.meeting(_led(e, STARS), ranges).select("doc", F.explode("others").alias("other"))
        return met.select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b"))

    def meeting(self, e: DataFrame, ranges: DataFrame) -> DataFrame:
        """Blocks ``lead, x, y`` of documents of different components that share a shingle of ``e`` and pass all filters: every
        ``doc`` that has any with ``others``, so that a pair stands once in a block and rows grow as documents do."""
        held = e.groupBy("lead", "doc", "n", "c").agg(F.collect_list(F.struct("gram", "place")).alias("held"))
        held = stored(held, "held")
        own = self.ranges_of(held.select("doc"), ranges)
        own = own.select(F.col("doc_id").alias("doc"), F.col("n").cast("int").alias("n"), "ranges").distinct()
        members = stored(held.join(own, ["doc", "n"]), "members")
        size = max(BLOCK[0], min(BLOCK[1], members.count() // BLOCKS))
        # large ones only: their number is bounded by that of the blocks, or a two thousandth of the rows
        parts = F.greatest(F.ceil(F.count(F.lit(1)) / size), F.ceil(F.sum("n") / SIDE))
        large = members.groupBy("lead").agg(parts.alias("parts")).where("parts > 1")
        dealt = members.join(F.broadcast(large), "lead", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        dealt = dealt.withColumn("side", F.pmod(F.xxhash64("doc", "n", "ranges"), F.col("parts")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
        dealt = dealt.select("lead", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "doc", "n", "c",
                             "ranges", "held")
        return _in_blocks(dealt).mapInArrow(_compare(self.percent), "lead long, x int, y int, doc long, others array<long>")

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """The sets of these documents, and of few others."""
        shared = self.docs.sparkSession.sparkContext.broadcast(_bit_table(ids, self.bits))
        out = stored(self.docs.mapInArrow(_sets(self.k, shared, self.bits), "doc_id long, set binary"), "sets")
        shared.destroy()
        return out

    def verified_blocks(self, e: DataFrame, ranges: DataFrame) -> DataFrame:
        """The links of :meth:`meeting` by the whole sets, as a forest for each block: sets meet in blocks, not pair by pair."""
        with temporary(self.docs.sparkSession, shuffles=True):
            with temporary(self.docs.sparkSession):
                met = stored(self.meeting(e, ranges), "met", keep=True)
            sets = self.sets_of(met.select("doc"))
            both = met.join(sets.select(F.col("doc_id").alias("doc"), "set").distinct(), "doc")
            both = _in_blocks(both.select("lead", "x", "y", "doc", "others", "set"))
            return stored(both.mapInArrow(_verify_blocks(self.percent), "a long, b long"), "verified", keep=True)

    def verified(self, make) -> DataFrame:
        """Links among the candidate pairs ``a, b`` that ``make`` returns, by the whole sets, once per pair."""
        spark = self.docs.sparkSession
        with temporary(spark, shuffles=True):
            with temporary(spark):
                some = stored(make().distinct(), "pairs", keep=True)
            sets = self.sets_of(some.select("a").unionByName(some.select(F.col("b").alias("a"))))
            both = (some.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a")
                    .join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b"))
            out = stored(both.mapInArrow(_verify(self.percent), "a long, b long").distinct(), "verified", keep=True)
        return out


def _in_blocks(rows: DataFrame) -> DataFrame:
    by = ["lead", "x", "y"]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def _components(links: DataFrame) -> DataFrame:
    with temporary(links.sparkSession):
        return stored(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components", keep=True)


def _led(e: DataFrame, draw: int) -> DataFrame:
    """The entries of shingles whose documents lie in several components, each with the document that its shingle proposes."""
    first = F.min(F.struct(F.xxhash64(F.lit(draw), "doc").alias("draw"), "doc", "n", "place", "c")).alias("lead")
    lead = stored(e.groupBy("gram").agg(first, F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select(
        "gram", F.col("lead.doc").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.place").alias("lead_place"),
        F.col("lead.c").alias("lead_c")), "lead")
    return e.select("gram", "doc", "n", "place", "c").join(lead, "gram")


def _labelled(links: DataFrame, e: DataFrame, draw: int) -> DataFrame:
    """The entries of shingles whose documents lie in several components of the links, each with its document's component ``c``."""
    with temporary(links.sparkSession):
        comp = _components(links)
        e = e.select("gram", "doc", "n", "place").join(comp.withColumnRenamed("node", "doc"), "doc", "left")
        e = stored(e.withColumn("c", F.coalesce("component", "doc")).drop("component"), "labelled")
        return stored(_led(e, draw), "residue", keep=True)


def jaccard_join(docs: DataFrame, k: int = K, percent: int = PERCENT, cells: int = CELLS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs (doc_id, text)``."""
    with temporary(docs.sparkSession):
        return _jaccard_join(docs, k, percent, cells)


def _jaccard_join(docs: DataFrame, k: int, percent: int, cells: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = stored(rows.mapInArrow(_first_pass(k, cells), "doc_id long, n long, digest binary, slice long, counts binary"), "first")
    shared = spark.sparkContext.broadcast(counters(first, cells))
    sized = first.where("slice is null").select("doc_id", "n", "digest")
    folded = stored(sized.where("n > 0 and doc_id is not null").groupBy("n", "digest").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "folded")
    reps = folded.select(F.col("rep").alias("doc_id")).distinct()

    n_docs = sized.count()
    join = _Join(rows, k, percent, n_docs)
    # one document stands for each set: only rows that may be copies are matched with those documents
    copies = sized.where("n > 0 and doc_id is not null").select("doc_id").distinct().join(reps, "doc_id", "left_anti")
    marks = spark.sparkContext.broadcast(_bit_table(copies, join.bits))
    pre = rows.mapInArrow(_prefixes(k, percent, shared, cells, marks), "doc_id long, n long, prefix binary, ranges binary, sure boolean")
    pre = stored(pre, "prefixes")
    marks.destroy()
    pre = pre.where("sure").unionByName(stored(pre.where("not sure").join(reps, "doc_id", "left_semi"), "unsure")).drop("sure")
    ranges = pre.select("doc_id", "n", "ranges")
    total = pre.agg(F.sum(F.length("prefix"))).first()[0] or 0
    buckets = max(8, -(-total // SHARE_BYTES))
    packed = pre.select("doc_id", "n", "prefix").mapInArrow(_deal(buckets), _PACKED)
    entries = (packed.repartition("bucket").sortWithinPartitions("bucket")
               .mapInArrow(_shared(percent), "gram long, doc long, n int, place int, lead long, lead_n int, lead_place int"))
    entries = stored(entries, "entries")

    links, e = None, entries
    for i in range(STARS):
        star = e.where(F.col("doc") != F.col("lead")) if links is None else e.where(F.col("c") != F.col("lead_c"))
        star = star.where(_plausible(percent)).select(F.least("doc", "lead").alias("a"), F.greatest("doc", "lead").alias("b"))
        star = star if links is None else star.join(links, ["a", "b"], "left_anti")
        new = join.verified(lambda: join.filtered(star, ranges))
        links = new if links is None else links.unionByName(new)
        e = _labelled(links, e, i + 1)

    # what the stars have not proposed matters between different components only
    links = links.unionByName(join.verified_blocks(e, ranges))
    # the rows of an id that occurs with several texts are tied: the id stands for each of their sets
    several = sized.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(
        F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    ties = sized.join(several, "doc_id").join(folded, ["n", "digest"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comp = _components(links.unionByName(ties))

    classes = stored(folded.join(comp, folded["rep"] == comp["node"], "left").select(
        "n", "digest", "rows", F.coalesce("component", "rep").alias("component_id")), "classes")
    # sets of very many rows, at most ``BLOCKS`` of them, are broadcast; the others' rows are few
    many = F.col("rows") > max(1, n_docs // BLOCKS)
    large = classes.where(many).select("n", "digest", F.col("component_id").alias("large"))
    few = classes.where(~many).select("n", "digest", "component_id")
    out = sized.join(F.broadcast(large), ["n", "digest"], "left")
    out = out.where("large is not null").select("doc_id", "n", F.col("large").alias("component_id")).unionByName(
        out.where("large is null").join(few, ["n", "digest"], "left").select("doc_id", "n", "component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return stored(out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")), "result", keep=True)


def rows_of(rows: DataFrame, key: str, keep: DataFrame, every: DataFrame) -> DataFrame:
    """The ``rows`` whose ``key``, a long, is in ``keep``; ``every`` has the keys of all of them. Only rows that a bit table of the other keys holds
    are shuffled."""
    gone = stored(every.join(keep, key, "left_anti").select(key), "gone")
    bits = _bits(gone.count())
    shared = rows.sparkSession.sparkContext.broadcast(_bit_table(gone, bits))

    @F.arrow_udf("boolean")
    def unsure(ids: pa.Array) -> pa.Array:
        at = _place(np.asarray(ids).astype(np.int64), bits)
        return pa.array((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

    marked = rows.withColumn("unsure", unsure(key))
    return marked.where("not unsure").drop("unsure").unionByName(
        marked.where("unsure").drop("unsure").join(keep, key, "left_semi").select(*rows.columns))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {K} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {K} + 2), lambda i: array_to_string(w[i:i + {K - 1}], ' ')) END) AS g FROM d),
e AS (SELECT rid, doc_id, len(g) AS n, unnest(g) AS x FROM s WHERE doc_id IS NOT NULL),
i AS (SELECT a.rid AS r1, b.rid AS r2, any_value(a.doc_id) AS u, any_value(b.doc_id) AS v, any_value(a.n) AS n1, any_value(b.n) AS n2, count(*) AS m
  FROM e a JOIN e b ON a.x = b.x AND a.rid <> b.rid GROUP BY 1, 2),
links AS (SELECT DISTINCT u, v FROM i WHERE 100 * m >= {PERCENT} * (n1 + n2 - m)),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
c AS (SELECT u, least(u, min(v)) AS c FROM reach GROUP BY u)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(c.c, doc_id) AS component_id FROM s LEFT JOIN c ON c.u = doc_id"""

"""Operator 12: periodic runs of words, by the branching-tandem test on an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q and length >= max(``min_words``, 2 q) that no
neighbouring word extends. Texts are cut into batches of bounded size in Spark's scan tasks; the documents of a batch
are analysed together in arrays (the key of a word includes its document, so nothing crosses a document):

1. Ranks by prefix doubling: ``ranks[k][i]`` is the first suffix-array place of all suffixes that share the
   ``2**k`` words from i on. Only places not yet unique are sorted again. The last table is the inverse suffix array
   (ISA); the others answer how far two places agree, to the right or to the left, exactly and without hashing.
2. LCP of neighbouring suffixes; for every LCP interval its bounds (nearest smaller LCP, by a table of
   minima over power-of-two widths) and its children (cut at the places where the LCP equals the interval's depth).
   No tree is built.
3. For each suffix i of all children but the largest, and depth l: if ISA[i + l], or ISA[i - l], lies in the
   interval and the two suffixes part after exactly l words, a branching square of period l starts at i (at i - l).
   Leaving out the largest child bounds the tests by n log n.
4. A branching square is the last square of its run. It is rotated to the left while words l apart agree, which gives
   the run's start; squares that end in the same stretch are merged into one run with the smallest period
   (a stretch of period l that is at least 2 l long and has a smaller period q is the run of q).

A word is dropped by ``collapse`` if any run holds it after that run's first q words.

Edge cases: null and empty texts have no words and no runs (digest columns: sha256 of the empty text; four nulls);
a null id counts as the empty text where it is drawn from; rows that repeat an id or a text are analysed one by
one; ties for the longest run go to the smallest start, then the smallest period; columns other than the id and the text take
no part; an empty table gives no rows. A document is the unit of work: a batch holds about ``SLICE`` bytes
of text or one longer document, and memory is about 4 * log2(longest repeated stretch) + 100 bytes per word of it.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm.common import table
from foldline.llm.textops import slices

MIN_WORDS = 12
SLICE = 2 << 20


def suffix_ranks(word: np.ndarray) -> list[np.ndarray]:
    """Rank tables of ``word`` (see above, 1); unique values must close every document. The last one is the ISA."""
    n = len(word)
    order = np.argsort(word)
    key = word[order]
    new = np.ones(n, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    ranks, step = [rank], 1
    # places whose suffix shares its first words with another one, and the place where their group begins
    lone = new & np.append(new[1:], True)
    open_ = order[~lone]
    while len(open_):
        head = ranks[-1][open_]
        tail = ranks[-1][open_ + step]           # in bounds: a suffix that reaches a closing value is unique by then
        by = np.argsort(head.astype(np.int64) * n + tail)
        open_, head, tail = open_[by], head[by], tail[by]
        group = np.ones(len(open_), dtype=bool)
        group[1:] = head[1:] != head[:-1]
        part = group.copy()
        part[1:] |= tail[1:] != tail[:-1]
        at, begin = np.arange(len(open_)), np.flatnonzero(part)
        base = np.maximum.accumulate(np.where(group, at, 0))
        size = np.diff(np.append(begin, len(open_)))
        rank = ranks[-1].copy()
        rank[open_] = head + np.repeat(begin, size) - base
        ranks.append(rank)
        open_ = open_[np.repeat(size > 1, size)]
        step *= 2
    return ranks


def _agree(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at a and b (a < b, or any two different places) share."""
    n, out = len(ranks[0]), np.zeros(len(a), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        same = ranks[k][np.minimum(a + out, n - 1)] == ranks[k][np.minimum(b + out, n - 1)]
        out += same.astype(np.int64) << k
    return out


def _agree_left(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words before a and b that agree, for a < b. Tables of one level are used once each, from the widest on:
    the count stays below twice the widest, as a stretch that is repeated has a repeated prefix of that width."""
    out = np.zeros(len(a), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        at = a - out - (1 << k)
        same = (at >= 0) & (ranks[k][np.maximum(at, 0)] == ranks[k][np.maximum(b - out - (1 << k), 0)])
        out += same.astype(np.int64) << k
    return out


def _nearest_smaller(lcp: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For the places ``at`` of ``lcp``: the nearest place to the left and to the right with a smaller value. Both lie
    within ``width`` places; ``lcp`` begins and ends with -1."""
    mins = [lcp]
    while 2 << (len(mins) - 1) <= width:
        w, m = 1 << (len(mins) - 1), mins[-1]
        mins.append(np.minimum(m[:len(m) - w], m[w:]))      # [j] covers places j .. j + 2 w - 1
    value, left, right = lcp[at], at.copy(), at + 1
    for k in range(len(mins) - 1, -1, -1):
        w, m = 1 << k, mins[k]
        ok = (right < len(m)) & (m[np.minimum(right, len(m) - 1)] >= value)
        right += ok.astype(np.int64) << k
        low = left - w
        ok = (low >= 0) & (m[np.clip(low, 0, len(m) - 1)] >= value)
        left -= ok.astype(np.int64) << k
    return left - 1, right


def branching_squares(ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``(start, period)`` of the branching squares; some are found twice."""
    isa = ranks[-1].astype(np.int64)
    n = len(isa)
    sa = np.empty(n, dtype=np.int64)
    sa[isa] = np.arange(n)
    near = np.flatnonzero(ranks[0][sa[1:]] == ranks[0][sa[:-1]]) + 1
    lcp = np.full(n + 1, -1, dtype=np.int32)                   # lcp[j] belongs to the places j - 1 and j
    if not len(near):
        return near, near
    lcp[1:n] = 0
    lcp[near] = _agree(ranks, sa[near - 1], sa[near])
    # the longest stretch of places with a positive LCP bounds the width of every interval
    gap = np.flatnonzero(lcp <= 0)
    low, high = _nearest_smaller(lcp, near, int(np.diff(gap).max()))
    depth = lcp[near].astype(np.int64)
    # intervals [low, high - 1]; cuts at `near`; children are the stretches between cuts
    by = np.lexsort((near, high, low))
    cut, low, high, depth = near[by], low[by], high[by], depth[by]
    head = np.ones(len(cut), dtype=bool)
    head[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    interval = np.cumsum(head) - 1
    starts = np.flatnonzero(head)
    last = np.append(starts[1:], len(cut)) - 1
    # children before each cut, and one after the last cut of an interval
    begin = np.concatenate([np.where(head, low, np.append(0, cut[:-1])), cut[last]])
    end = np.concatenate([cut, high[last]])
    owner = np.concatenate([interval, np.arange(len(starts))])
    size = end - begin
    by = np.lexsort((size, owner))                             # the largest child of an interval comes last
    begin, size, owner = begin[by], size[by], owner[by]
    small = np.append(owner[1:] == owner[:-1], False)
    begin, size, owner = begin[small], size[small], owner[small]
    place = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    owner = np.repeat(owner, size)
    i, d, lo, hi = sa[place], depth[starts][owner], low[starts][owner], high[starts][owner]
    found = []
    for a, b in ((i, i + d), (i - d, i)):
        other = np.where(a == i, b, a)
        ok = (other >= 0) & (other < n)
        there = isa[np.clip(other, 0, n - 1)]
        ok &= (there >= lo) & (there < hi)
        found.append((a[ok], d[ok]))
    start, period = (np.concatenate(x) for x in zip(*found))
    parts = ranks[0][start + period] != ranks[0][np.minimum(start + 2 * period, n - 1)]
    return start[parts], period[parts]


def word_runs(word: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all runs, by start, then period."""
    if not len(word):
        return (np.zeros(0, dtype=np.int64),) * 3
    ranks = suffix_ranks(word)
    start, period = branching_squares(ranks)
    end = start + 2 * period
    start = start - _agree_left(ranks, start, start + period)
    long_ = end - start >= np.maximum(min_words, 2 * period)
    start, end, period = start[long_], end[long_], period[long_]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    own = np.ones(len(start), dtype=bool)
    own[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[own], end[own], period[own]
    by = np.lexsort((period, start))
    return start[by], (end - start)[by], period[by]


def planted_tail(n: int, doc_id: str) -> tuple[int, int] | None:
    """``(a, p)`` if the words from ``a`` on are to be replaced by repeats of the ``p`` words there (a fixed rule
    of the query: one id in ten, by crc32), else None."""
    h = zlib.crc32(doc_id.encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


SCHEMA = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")
REAL = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _batch(ids: list, texts: list, min_words: int, planted: bool) -> dict:
    docs: list[list[bytes]] = []
    for doc_id, text in zip(ids, texts):
        words = text.encode("utf-8", "surrogatepass").split() if text else []      # bytes split at \x20 and \x09-\x0D only
        tail = planted_tail(len(words), "" if doc_id is None else str(doc_id)) if planted else None
        if tail:
            a, p = tail
            rest = len(words) - a
            words = words[:a] + (words[a:a + p] * (rest // p + 1))[:rest]
        docs.append(words)
    count = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
    first = np.cumsum(count + 1) - count - 1                    # each document is closed by a value of its own
    flat = pa.array([w for d in docs for w in d], pa.large_binary()).dictionary_encode()
    vocab = len(flat.dictionary) + 1
    word = np.empty(int(count.sum()) + len(docs), dtype=np.int64)
    doc = np.repeat(np.arange(len(docs)), count)
    word[np.arange(len(doc)) + doc] = doc * vocab + np.asarray(flat.indices)
    word[first + count] = np.arange(1, len(docs) + 1) * vocab - 1
    start, length, period = word_runs(word, min_words)
    drop = np.zeros(len(word) + 1, dtype=np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    keep = np.cumsum(drop)[:-1] == 0
    bounds = np.searchsorted(start, np.append(first, len(word)))
    out: dict[str, list] = {k: [] for k in ("n_words", "n_runs", "start", "length", "period", "exponent_milli",
                                            "runs_sha256", "collapsed_sha256", "runs", "collapsed")}
    for k, words in enumerate(docs):
        lo, hi = bounds[k], bounds[k + 1]
        best = None
        runs = []
        if hi > lo:
            runs = list(zip((start[lo:hi] - first[k]).tolist(), length[lo:hi].tolist(), period[lo:hi].tolist()))
            best = min(runs, key=lambda r: (-r[1], r[0], r[2]))
            words = [w for w, stays in zip(words, keep[first[k]:first[k] + count[k]].tolist()) if stays]
        collapsed = b" ".join(words)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        for name, value in zip(out, (int(count[k]), len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                                     hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest(),
                                     [dict(start=s, length=n, period=q) for s, n, q in runs], collapsed)):
            out[name].append(value)
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                  planted: bool = False, texts: bool = False) -> DataFrame:
    """One row per document with its longest run and digests of all runs and of the collapsed text; with ``texts``
    also the runs themselves and the collapsed text. ``planted`` applies the rule of :func:`planted_tail` first."""
    schema = f"{SCHEMA}, {REAL}" if texts else SCHEMA
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")] + (["runs", "collapsed"] if texts else [])

    def analyse(batches):
        arrow = None
        for b in slices(batches, "text", SLICE):
            got = _batch(b.column(0).to_pylist(), b.column(1).to_pylist(), min_words, planted)
            got["doc_id"] = b.column(0).to_pylist()
            if texts:
                got["collapsed"] = [c.decode("utf-8", "surrogatepass") for c in got["collapsed"]]
            arrow = arrow or pa.schema([(n, pa.int64()) for n in names[:7]] + [(n, pa.string()) for n in names[7:9]] + (
                [("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                 ("collapsed", pa.string())] if texts else []))
            yield pa.RecordBatch.from_pydict({n: got[n] for n in names}, schema=arrow)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(analyse, schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(table(spark, sf_dir, "documents"), planted=True)
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")

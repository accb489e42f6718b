"""Operator 5: quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded by ``features``: shares of
character classes, word lengths, repeated words and shingles seen earlier in the text, and hashed byte
pairs. A small network embeds passages (tanh layer), weighs them by gated attention
(``w . (tanh(V h) * sigmoid(U h))``, softmax within the document) and scores the weighted passage
representation; only document labels are needed. It is fitted with Adam on gradients written out below.

Fitting uses a bounded sample: ``TRAIN_DOCS`` documents per class at most, of ``TRAIN_CHARS`` characters at most.
Scoring encodes whole texts of all documents, partition by partition.

Edge cases: null text counts as empty; a text without words is one passage of zero features; null doc_ids are
scored; repeated rows are scored one by one; without training rows of both classes every score is 0.5; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm.common import fold_of, labelled_sample, table
from foldline.llm.textops import hash_spans, mix, slices, text_buffer, word_spans

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
PASSAGE = 64             # words
PAIRS = 48               # hashed byte pairs
HIDDEN, GATE = 24, 12
TRAIN_DOCS = 3000        # of each class
TRAIN_CHARS = 60_000
EPOCHS = 30

_CLASS = np.full(256, 5, dtype=np.int64)               # other visible bytes
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\v\f\r", b".,;:'\"!?-()")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 6
N_CLASS = 7
WIDTH = N_CLASS + 6 + PAIRS


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Passage features of a column of texts and the ``n + 1`` passage offsets of the texts."""
    buf, off = text_buffer(col)
    s, e = word_spans(buf)
    at = np.searchsorted(s, off)
    count = np.maximum(1, -(-np.diff(at) // PASSAGE))
    bags = np.concatenate([[0], np.cumsum(count)])
    n = int(bags[-1])
    x = np.zeros((n, WIDTH))
    if not len(s):
        return x, bags
    words = hash_spans(buf, s, e)
    doc = np.repeat(np.arange(len(count)), np.diff(at))
    place = np.arange(len(s)) - at[doc]
    passage = bags[doc] + place // PASSAGE              # of each word
    size = np.bincount(passage, minlength=n).astype(float)
    full = np.maximum(size, 1)

    first = np.flatnonzero(np.diff(passage, prepend=-1))      # first word of each passage that has words
    owner = np.zeros(len(buf) + 1, dtype=np.int64)
    owner[s[first]] = np.diff(passage[first], prepend=0)
    own = np.cumsum(owner[:-1])
    kinds = np.bincount(own * N_CLASS + _CLASS[buf], minlength=n * N_CLASS)[:n * N_CLASS].reshape(n, N_CLASS)
    chars = np.maximum(kinds.sum(axis=1, keepdims=True), 1)
    x[:, :N_CLASS] = kinds / chars
    length = (e - s).astype(float)
    mean = np.bincount(passage, weights=length, minlength=n) / full
    spread = np.sqrt(np.maximum(0, np.bincount(passage, weights=length ** 2, minlength=n) / full - mean ** 2))
    pair = np.unique(mix(words ^ mix(passage.astype(np.uint64))), return_index=True)[1]
    distinct = np.bincount(passage[pair], minlength=n) / full
    tri = mix(words + mix(np.roll(words, -1) + mix(np.roll(words, -2))))
    tri = np.unique(mix(tri ^ mix(doc.astype(np.uint64))), return_index=True)[1]
    fresh = np.bincount(passage[tri], minlength=n) / full     # shingles not seen earlier in the text
    x[:, N_CLASS:N_CLASS + 6] = np.stack([mean / 8, spread / 4, distinct, fresh, size / PASSAGE, np.log1p(count).repeat(count) / 4], axis=1)
    code = (buf[:-1].astype(np.int64) * 257 + buf[1:] * 31) % 1009 % PAIRS
    pairs = np.bincount(own[:-1] * PAIRS + code, minlength=n * PAIRS)[:n * PAIRS].reshape(n, PAIRS)
    x[:, N_CLASS + 6:] = np.sqrt(pairs / chars)
    return x, bags


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _softmax(e, bags):
    """Within bags; every bag has a passage at least."""
    lens = np.diff(bags)
    a = np.exp(e - np.maximum.reduceat(e, bags[:-1]).repeat(lens))
    return a / np.add.reduceat(a, bags[:-1]).repeat(lens)


def forward(p: dict, x: np.ndarray, bags: np.ndarray) -> dict:
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    a = _softmax((t * g) @ p["w"], bags)
    z = np.add.reduceat(h * a[:, None], bags[:-1], axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"][0])}


def gradients(p: dict, x: np.ndarray, bags: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Of the mean weighted cross entropy."""
    f, lens = forward(p, x, bags), np.diff(bags)
    do = (f["y"] - y) * weight / len(y)
    dz = np.outer(do, p["c"]).repeat(lens, axis=0)
    da = (dz * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.add.reduceat(da * f["a"], bags[:-1]).repeat(lens))
    dtg = np.outer(de, p["w"])
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
    dh = (dz * f["a"][:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
    return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de,
            "c": f["z"].T @ do, "d": np.array([do.sum()])}


def fit(sample: list, seed: int = 7) -> dict | None:
    """The network and the scaling of its inputs; None without both classes."""
    if len({y for _, _, y in sample}) < 2:
        return None
    parts = [features(pa.array([t for _, t, _ in sample[i:i + 64]], pa.string())) for i in range(0, len(sample), 64)]
    x = np.concatenate([p[0] for p in parts])
    bags = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
    y = np.array([s[2] for s in sample], dtype=float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    p = {"W": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN),
         "V": rng.normal(0, 0.2, (HIDDEN, GATE)), "U": rng.normal(0, 0.2, (HIDDEN, GATE)), "w": rng.normal(0, 0.2, GATE),
         "c": rng.normal(0, 0.2, HIDDEN), "d": np.zeros(1)}
    m, v, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 64):
            pick = order[i:i + 64]
            rows = np.concatenate([np.arange(bags[k], bags[k + 1]) for k in pick])
            cut = np.concatenate([[0], np.cumsum(bags[pick + 1] - bags[pick])])
            grad, step = gradients(p, x[rows], cut, y[pick], np.ones(len(pick))), step + 1
            for k in p:
                grad[k] = grad[k] + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return {"mean": mean, "scale": scale, "net": p}


def score(model: dict | None, col: pa.Array) -> np.ndarray:
    if model is None:
        return np.full(len(col), 0.5)
    x, bags = features(col)
    return forward(model["net"], np.clip((x - model["mean"]) / model["scale"], -8, 8), bags)["y"]


def _score(model: dict | None):
    def run(batches):
        for b in slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score(model, b.column("text")))], names=["doc_id", "score"])
    return run


def quality_model(docs: DataFrame, labels: DataFrame) -> dict | None:
    train = fold_of("doc_id", FOLDS) != HELD_OUT
    return fit(labelled_sample(docs, labels, "quality", train, TRAIN_DOCS, TRAIN_CHARS))


def quality_scores(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs (doc_id, text)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_score(model), "doc_id long, score double")
    return out.select("doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, quality_model(docs, table(spark, sf_dir, "labels")))

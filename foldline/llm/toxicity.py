"""Operator 8: toxicity by compression distance.

Two zstandard dictionaries are trained on all windows of the training texts: one on ordinary text, one on toxic
text, the latter followed by the strings that mark toxic text. Separately trained dictionaries also differ
in what they hold of ordinary prose, so a third one, the ordinary one followed by the marking strings, is compared as well;
the ordinary one itself is followed by as many bytes that occur in no text, so offsets of their common part agree and
the two lengths of a window differ by what the marking strings save. Marking strings are runs of character n-grams whose words occur in many distinct contexts in
toxic text and hardly in ordinary text (log-likelihood ratio and rate ratio); counting distinct contexts
instead of occurrences discounts copies.

Every window of ``WINDOW`` words of a text is compressed with each; a document's features are, for the toxic and
for the marked dictionary against the ordinary one, the largest and mean difference, the root-scaled sum, and shares
and counts of windows above some differences. A logistic
regression on training documents that no dictionary has seen turns them into a calibrated score.

Fitting uses a bounded sample: ``TRAIN_DOCS`` documents per class at most, of ``TRAIN_CHARS`` characters at
most. Scoring compresses whole texts of all documents, partition by partition.

Edge cases: null text counts as empty; empty texts have zero features and get the score of those; null doc_ids
are scored; repeated rows are scored one by one; without training rows of both classes every score is 0; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from foldline.llm.common import fit_logistic, fold_of, labelled_rows, table
from foldline.llm.textops import slices

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
WINDOW = 12              # words
TRAIN_DOCS = 3000        # of each class
TRAIN_CHARS = 60_000
DICT_BYTES = 8192
GRAM = 5
MIN_LLR = 20.0
MIN_RATIO = 20.0
_PARAMS = dict(strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=16, chain_log=15, hash_log=15, search_log=4)


def _windows(text: str | None) -> list[bytes]:
    w = (text or "").lower().split()
    return [(" " + " ".join(w[i:i + WINDOW]) + " ").encode("utf-8", "surrogatepass") for i in range(0, len(w), WINDOW)]


def _grams(padded: str) -> set[str]:
    return {padded[i:i + GRAM] for i in range(len(padded) - GRAM + 1)}


def marking_strings(sample: list) -> list[str]:
    """Strings that mark toxic text, the most frequent last."""
    seen = ({}, {})
    contexts: tuple = (defaultdict(set), defaultdict(set))
    for _, text, y in sample:
        w = (text or "").lower().split()
        for a, b, c in zip(["", *w], w, [*w[1:], ""]):
            contexts[y][b].add(zlib.crc32(f"{a} {c}".encode("utf-8", "surrogatepass")))
    count: tuple = (Counter(), Counter())
    for y in (0, 1):
        for word, where in contexts[y].items():
            for g in _grams(f" {word} "):
                count[y][g] += len(where)
    total = [sum(len(v) for v in contexts[y].values()) + 1 for y in (0, 1)]
    base = total[1] / (total[0] + total[1])
    marks = set()
    for g, k in count[1].items():
        o = count[0].get(g, 0)
        ratio = (k / total[1]) / ((o + 1) / total[0])
        llr = k * math.log(k / (k + o) / base) + (o * math.log(o / (k + o) / (1 - base)) if o else 0.0)
        if ratio >= MIN_RATIO and llr >= MIN_LLR:
            marks.add(g)
    runs: Counter = Counter()
    for word, where in contexts[1].items():
        padded, inside = f" {word} ", [False] * (len(word) + 2)
        for i in range(len(padded) - GRAM + 1):
            if padded[i:i + GRAM] in marks:
                inside[i:i + GRAM] = [True] * GRAM
        run = ""
        for ch, on in [*zip(padded, inside), ("", False)]:
            if on:
                run += ch
            elif run:
                runs[run] += len(where)
                run = ""
    return [r for r, _ in sorted(runs.items(), key=lambda x: (-x[1], x[0]))][::-1]


def _trained(windows: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(2 * DICT_BYTES, windows, d=8, k=64).as_bytes()[-DICT_BYTES:]
    except zstandard.ZstdError:                   # too little text to train on
        return b"".join(windows)[-DICT_BYTES:]


def train_dictionaries(sample: list) -> tuple[bytes, bytes, bytes]:
    """``(ordinary, marked, toxic)`` dictionary contents."""
    plain, foul = (_trained([w for _, text, y in sample if y == k for w in _windows(text)]) for k in (0, 1))
    tail = "".join(marking_strings(sample)).encode("utf-8", "surrogatepass")
    blank = bytes(1 + (i * i * 7 + i // 3) % 8 for i in range(len(tail)))    # control characters
    return plain + blank, plain + tail, foul + tail


def _spread(d: np.ndarray, shares: tuple, counts: tuple) -> list[float]:
    return [d.max(), d.mean(), d.sum() / math.sqrt(len(d)), *[(d >= t).mean() for t in shares],
            *[math.log1p((d >= t).sum()) for t in counts]]


class Distance:
    """Window features of texts under the dictionaries."""

    def __init__(self, *contents: bytes):
        self.of = []
        for content in contents:
            d = zstandard.ZstdCompressionDict(content or b"\1" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            log = max(_PARAMS["window_log"], (len(content) + 4096).bit_length())        # all of the content is in reach
            sizes = dict(window_log=log, chain_log=log - 1, hash_log=log - 1)
            p = zstandard.ZstdCompressionParameters(write_content_size=False, write_dict_id=False, write_checksum=False, **_PARAMS | sizes)
            d.precompute_compress(compression_params=p)
            self.of.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress)

    def features(self, text: str | None) -> list[float]:
        windows = _windows(text)
        if not windows:
            return [0.0] * 23
        ordinary, marked, toxic = (np.array([len(c(w)) for w in windows], dtype=np.float64) for c in self.of)
        return [*_spread(ordinary - marked, (1, 2, 3, 4), (2, 3, 4, 5)),
                *_spread(ordinary - toxic, (2, 4, 6, 8), (4, 6, 8, 10)), math.log1p(len(windows))]


def fit(sample: list) -> dict | None:
    """Dictionaries from two thirds of the sample, calibration on the rest; None without both classes."""
    if len({y for _, _, y in sample}) < 2:
        return None
    learn = [s for s in sample if zlib.crc32(f"part {s[0]}".encode()) % 3]
    rest = [s for s in sample if not zlib.crc32(f"part {s[0]}".encode()) % 3]
    if len({y for _, _, y in learn}) < 2 or len({y for _, _, y in rest}) < 2:
        learn = rest = sample
    contents = train_dictionaries(learn)
    distance = Distance(*contents)
    x = np.array([distance.features(t) for _, t, _ in rest])
    y = np.array([s[2] for s in rest], dtype=np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    return {"contents": contents, "mean": mean, "scale": scale, "w": fit_logistic((x - mean) / scale, y, l2=2.0)}


def _score(model: dict | None):
    """Adds ``score`` to the rows; ``text`` stays where it was."""
    def run(batches):
        distance = Distance(*model["contents"]) if model else None
        for b in slices(batches, "text"):
            if model:
                x = (np.array([distance.features(t) for t in b.column("text").to_pylist()]) - model["mean"]) / model["scale"]
                s = 1 / (1 + np.exp(-np.clip(x @ model["w"][:-1] + model["w"][-1], -30, 30)))
            else:
                s = np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, "score"])
    return run


def _fit_rows(batches):
    """The model of the sample's rows, pickled: the sample is bounded and stays in one task, off the driver."""
    rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("draw", "doc_id", "text", "y")))]
    sample = [(doc_id, text, y) for _, doc_id, text, y in sorted(rows, key=lambda r: r[:2])]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sample))], pa.binary())], names=["model"])


def toxicity_model(docs: DataFrame, labels: DataFrame) -> dict | None:
    train = fold_of("doc_id", FOLDS) != HELD_OUT
    sample = labelled_rows(docs, labels, "toxic", train, TRAIN_DOCS, TRAIN_CHARS)
    got = sample.repartition(1).mapInArrow(_fit_rows, "model binary").first()
    return None if got is None else pickle.loads(bytes(got["model"]))


def toxicity_scores(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD, keep=("doc_id",)) -> DataFrame:
    """``held_out, score, predicted`` beside the columns ``keep`` of every row of ``docs (doc_id, text)``."""
    rows = docs.select(*[F.col(c) for c in keep if c not in ("doc_id", "text")],
                       F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_score(model), StructType([*rows.schema.fields, StructField("score", DoubleType())]))
    return out.select(*keep, (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))

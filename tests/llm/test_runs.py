"""Periodic runs: a quadratic brute force over periods, random texts, and the edge cases of the docstring."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from foldline.llm.runs import op12_periodic_runs, periodic_runs, word_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, min_words=12):
    """Every maximal stretch of every period, at least two periods long, then the smallest period of each."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= 2 * q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(min_words, 2 * q))


def closed(words):
    at = {w: k for k, w in enumerate(sorted(set(words)))}
    return np.array([at[w] for w in words] + [len(at)], dtype=np.int64)


@pytest.mark.parametrize("letters,size", [(1, 40), (2, 30), (2, 70), (3, 90), (4, 60)])
def test_runs_of_random_words(letters, size):
    rng = random.Random(letters * 1000 + size)
    for case in range(120):
        words = [rng.randrange(letters) for _ in range(rng.randrange(1, size))]
        if case % 2:
            p = rng.randrange(1, 9)
            a = rng.randrange(len(words))
            words = words[:a] + (words[a:a + p] * 30)[:rng.randrange(1, 60)] + words[a:]
        least = rng.choice((2, 6, 12))
        got = [tuple(map(int, r)) for r in zip(*word_runs(closed(words), least))]
        assert got == brute(words, least), words


def test_fibonacci_and_thue_morse_words():
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(256)]
    for words in (b, thue, [0] * 500, ([0, 1] * 40 + [2]) * 5):
        assert [tuple(map(int, r)) for r in zip(*word_runs(closed(words), 2))] == brute(words, 2)


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, n, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(kept.encode()).hexdigest(), runs, kept)


def _texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + ["é", "😀", "A", "a"]
    out = [(None, "no id " * 9), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "same " * 400), (5, "same " * 400),
           (5, "other"), (6, "a\x1cb a\x1cb \x85 x\xa0y " * 30), (7, "A a " * 20 + "end"), (8, "x y z " * 4 + "x y q " * 4)]
    for i in range(100, 220):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 160))]
        if i % 3 == 0 and words:
            a = rng.randrange(len(words))
            words[a:a] = words[a:a + rng.randrange(1, 20)] * rng.randrange(1, 9)
        out.append((i, rng.choice(("  ", " ", "\n")).join(words)))
    return out


def test_periodic_runs_against_brute_force(spark):
    texts = _texts()
    docs = spark.createDataFrame([(*t, 7, "clash") for t in texts], "doc_id long, text string, n_runs int, runs string")
    got = []
    for r in periodic_runs(docs.repartition(3), planted=True, texts=True).collect():
        got.append((*r[:9], [tuple(x) for x in r["runs"]], r["collapsed"]))
    want = [expected(*t) for t in texts]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(w[2] > 1 for w in want) and any(w[2] == 0 for w in want)


def test_documents_do_not_touch(spark):
    """Equal words on both sides of a document's end are no run, and long documents share no batch."""
    docs = spark.createDataFrame([(1, "a " * 8), (2, "a " * 8), (4, "a b " * 400_000)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in periodic_runs(docs).collect()}
    assert got[1]["n_runs"] == got[2]["n_runs"] == 0
    assert (got[4]["n_runs"], got[4]["start"], got[4]["length"], got[4]["period"]) == (1, 0, 800_000, 2)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op12_periodic_runs(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                                                "runs_sha256", "collapsed_sha256"]

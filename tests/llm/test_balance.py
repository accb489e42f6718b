"""Entropy balancing: overlapping constraints against a numpy solution, limits, and constraints that can't be met."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldline.llm.mixing import entropy_balance, mix_sizes


def _docs(spark, n=400):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice(["en", "fr"]), rng.randrange(1, 50)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, lang string, size long")


def test_two_overlapping_constraints(spark):
    rows, docs = _docs(spark)
    total = sum(r[3] for r in rows)
    want = {"source": {"a": 0.4, "b": 0.2, "c": 0.15, None: 0.25}, "lang": {"en": 0.7, "fr": 0.3}}
    targets = {n: spark.createDataFrame([(c, w * total) for c, w in t.items()], "category string, target double") for n, t in want.items()}
    got = {n: {r["category"]: r["lam"] for r in t.collect()} for n, t in entropy_balance(docs, targets, max_rate=50).items()}
    rate = np.array([np.exp(got["source"][s] + got["lang"][la]) for _, s, la, _ in rows])
    size = np.array([r[3] for r in rows], dtype=float)
    for name, at in (("source", 1), ("lang", 2)):
        for c, w in want[name].items():
            mine = np.array([r[at] == c for r in rows])
            assert abs((size * rate)[mine].sum() - w * total) < 1e-6 * total
    # iterative proportional fitting reaches the same rates (the solution is unique)
    r2 = np.ones(len(rows))
    for _ in range(500):
        for name, at in (("source", 1), ("lang", 2)):
            for c, w in want[name].items():
                mine = np.array([r[at] == c for r in rows])
                r2[mine] *= w * total / (size * r2)[mine].sum()
    assert np.allclose(rate, r2, rtol=1e-6)


def test_limit_inside_the_dual(spark):
    rows, docs = _docs(spark)
    size = {}
    for _, s, la, n in rows:
        size[s, la] = size.get((s, la), 0) + n
    # source a has to grow 1.8 x, but its English documents stop at the limit of 2
    own = {c: sum(v for (s, _), v in size.items() if s == c) for c in ("a", "b", "c", None)}
    goal = {"a": 1.8 * own["a"], "b": 1.0 * own["b"], "c": 1.0 * own["c"], None: 1.0 * own[None]}
    lang = {"en": 1.35 * sum(v for (_, la), v in size.items() if la == "en")}
    lang["fr"] = sum(goal.values()) - lang["en"]
    targets = {n: spark.createDataFrame(list(t.items()), "category string, target double") for n, t in (("source", goal), ("lang", lang))}
    got = {n: {r["category"]: r["lam"] for r in t.collect()} for n, t in entropy_balance(docs, targets, max_rate=2).items()}
    rate = {k: min(2.0, float(np.exp(got["source"][k[0]] + got["lang"][k[1]]))) for k in size}
    for c, t in goal.items():
        assert abs(sum(size[k] * rate[k] for k in size if k[0] == c) - t) < 1e-6 * t
    assert max(rate.values()) == 2.0


def test_impossible_constraints_raise(spark):
    docs = spark.createDataFrame([(1, "a", "en", 10), (2, "b", "fr", 10)], "doc_id long, source string, lang string, size long")
    targets = {"source": spark.createDataFrame([("a", 15.0), ("b", 5.0)], "category string, target double"),
               "lang": spark.createDataFrame([("en", 5.0), ("fr", 15.0)], "category string, target double")}
    with pytest.raises(ValueError):
        entropy_balance(docs, targets, rounds=12)


def test_taken_words_against_brute_force(spark):
    """The whole mix of a small corpus, word by word: whole copies, then one more copy in hash order while it fits."""
    rows, docs = _docs(spark, 60)
    sizes = docs.select("doc_id", "source", "size")
    h = {r["doc_id"]: r["h"] for r in sizes.select("doc_id", F.xxhash64(F.lit("mix"), "doc_id").alias("h")).collect()}
    got = mix_sizes(sizes).collect()
    taken = {r["doc_id"]: r["taken"] for r in got}
    for src in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == src]
        facts = next(r for r in got if r["source"] == src)
        whole = min(3, int(round(facts["target"] / facts["source_size"], 9)))
        gap = facts["target"] - whole * facts["source_size"] if whole < 3 else 0.0
        extra = set()
        order = sorted(mine, key=lambda r: (h[r[0]] % 256, h[r[0]], r[0], r[3]))
        while True:                                             # a draw takes, in order, what fits beside those before it
            run, took = 0, []
            for r in order:
                if r[0] not in extra and 1 <= r[3] <= gap:
                    run += r[3]
                    if run <= gap:
                        took.append(r)
            if not took:
                break
            extra |= {r[0] for r in took}
            gap -= sum(r[3] for r in took)
        for r in mine:
            assert taken[r[0]] == r[3] * (whole + (r[0] in extra)), (src, r)

"""The residue of the Jaccard join: blocks against all pairs, and no rows for pairs below the threshold."""

import numpy as np
import pytest

SCHEMA = "gram long, doc long, n int, place int, c long"


def _near(rng, docs, own):
    """Sets of 100 shingles, ``own`` of them by themselves and the others common to all."""
    common = rng.integers(0, 2 ** 63, 100 - own, dtype=np.uint64)
    return [np.unique(np.concatenate([common, rng.integers(0, 2 ** 63, own, dtype=np.uint64)])) for _ in range(docs)]


@pytest.mark.parametrize("own, linked", [(12, False), (4, True)])
def test_pairs_below_the_threshold_make_no_rows(spark, monkeypatch, own, linked):
    from foldline.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", (8, 16))                 # several blocks meet
    docs = 60
    sets = _near(np.random.default_rng(own), docs, own)
    first = np.intersect1d(sets[0], sets[1])[:3]
    rows = [(int(g), d, len(s), i, d) for d, s in enumerate(sets) for i, g in enumerate(first)]
    ranges = spark.createDataFrame([(d, len(s), jaccard.range_counts(s)) for d, s in enumerate(sets)],
                                   "doc_id long, n long, ranges binary")
    join = jaccard._Join(ranges, jaccard.K, jaccard.PERCENT, docs)
    got = sorted((r["a"], r["b"]) for r in join.residue(spark.createDataFrame(rows, SCHEMA), ranges).collect())
    every = [(a, b) for a in range(docs) for b in range(a + 1, docs)]
    same = [p for p in every if 100 * len(np.intersect1d(sets[p[0]], sets[p[1]])) >= 85 * len(np.union1d(sets[p[0]], sets[p[1]]))]
    assert same == (every if linked else [])
    assert set(got) >= set(same) and (linked or len(got) < len(every) // 10)


def test_range_counts_bound_the_intersection():
    from foldline.llm import jaccard

    rng = np.random.default_rng(5)
    sets = [*_near(rng, 4, 20), rng.integers(0, 2 ** 63, 120, dtype=np.uint64), np.arange(400, dtype=np.uint64)]
    for x in sets:
        for y in sets:
            a, b = (jaccard._table([jaccard.range_counts(np.unique(s))]) for s in (x, y))
            assert jaccard._most(a, b)[0] >= len(np.intersect1d(x, y))
    wide = np.arange(300, dtype=np.uint64) << np.uint64(40)        # all in one range, more than a byte holds
    assert jaccard._table([jaccard.range_counts(wide)]).sum() == 300

"""Rows and rounds of the Jaccard join: what they may not grow with."""

import random

import numpy as np
import pyarrow as pa
import pytest


def _texts(rng, docs, n, own):
    """Texts of ``n`` words, of which ``own`` consecutive ones are by themselves."""
    common = [f"w{i}" for i in range(n)]
    out = []
    for d in range(docs):
        at = rng.randrange(n - own)
        out.append(" ".join(f"x{d}y{i}" if at <= i < at + own else w for i, w in enumerate(common)))
    return out


@pytest.mark.parametrize("own", [1, 7])
def test_near_copies_meet_in_rows_per_document(spark, monkeypatch, own):
    """Many pairs just above or below the threshold make a row for each document of a block, and the same links."""
    from foldline.llm import jaccard

    rows = list(enumerate(_texts(random.Random(own), 90, 100, own)))
    docs, made = spark.createDataFrame(rows, "doc_id long, text string").repartition(2), []
    meeting = jaccard._Join.meeting

    def counted(self, e, ranges):
        from foldline.llm.common import stored
        out = stored(meeting(self, e, ranges), "met", keep=True)
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard._Join, "meeting", counted)
    monkeypatch.setattr(jaccard, "STARS", 1)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_join(docs).collect()}
    sets = {d: {tuple(t.split()[i:i + 4]) for i in range(97)} for d, t in rows}
    comp = {d: d for d in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if all(comp[comp[d]] == comp[d] for d in comp):
            break
    assert got == comp
    assert made[0] <= 8 * 90                                     # of 90 * 89 / 2 pairs: a row for each block of a document


def test_blocks_link_by_whole_sets():
    from foldline.llm.jaccard import _verify_blocks

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 63, 100, dtype=np.uint64)
    near = lambda k: np.unique(np.concatenate([base[k:], rng.integers(0, 2 ** 63, k, dtype=np.uint64)]))
    sets = [near(4) for _ in range(30)] + [near(40) for _ in range(30)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * 60, pa.int64()), pa.array([0] * 60, pa.int32()), pa.array([0] * 60, pa.int32()), pa.array(range(60), pa.int64()),
         pa.array([list(range(a + 1, 60)) for a in range(60)], pa.list_(pa.int64())), pa.array([s.tobytes() for s in sets])],
        names=["lead", "x", "y", "doc", "others", "set"])
    links = [(a, b) for out in _verify_blocks(85)([batch.slice(0, 20), batch.slice(20)]) for a, b in zip(*(c.to_pylist() for c in out.columns))]
    true = {(a, b) for a in range(60) for b in range(a + 1, 60)
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert set(links) <= true and len(links) == 29 and {x for ab in links for x in ab} == set(range(30))


def test_few_links_of_many_partitions_take_no_round(spark, monkeypatch):
    from foldline.llm import graph

    links = [(i, i + 1) for i in range(200) if i % 50]
    df = spark.createDataFrame(links, "u long, v long").repartition(16)
    want = {n: max(x for x in (0, *range(1, 200, 50)) if x <= n) for n in range(1, 201)}
    want = {n: c if n != 200 else 151 for n, c in want.items()}
    rounds, step = [], graph._round
    monkeypatch.setattr(graph, "_round", lambda e: rounds.append(1) or step(e))
    assert {r["node"]: r["component"] for r in graph.components(df).collect()} == want and not rounds
    monkeypatch.setattr(graph, "LINKS", 20)                      # several blocks: rounds go on until all are stars
    assert {r["node"]: r["component"] for r in graph.components(df).collect()} == want


def test_only_rows_that_may_go_are_shuffled(spark):
    from foldline.llm.jaccard import rows_of

    rows = spark.range(0, 3000).selectExpr("id * 8589934592 as row", "repeat(cast(id as string), 3) as text")
    keep = rows.where("row % 3 > 0 or row = 0").select("row")
    got = rows_of(rows, "row", keep, rows.select("row"))
    want = sorted(map(tuple, rows.join(keep, "row", "left_semi").collect()))
    assert got.columns == rows.columns and sorted(map(tuple, got.collect())) == want

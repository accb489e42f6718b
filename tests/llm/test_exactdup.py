"""Exact duplicates: brute force by the normalised text, colliding fingerprints, Golomb codes, edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest

import foldline.llm.exactdup as exactdup
from foldline.llm.exactdup import Ranges, exact_duplicates, op11_exact_duplicates
from foldline.llm.golomb import decode, encode, words_of

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


@pytest.mark.parametrize("size,top", [(0, 1), (1, 1), (1, 2 ** 61), (5, 6), (300, 300), (5000, 2 ** 20), (5000, 2 ** 62)])
def test_golomb_round_trip(size, top):
    rng = random.Random(size)
    values = np.array(sorted(rng.sample(range(min(top, 2 ** 30)), size)), dtype=np.int64)
    if top > 2 ** 30 and size:
        values = np.unique(np.array([rng.randrange(top) for _ in range(size)], dtype=np.int64))
    code = encode(values)
    assert (decode(code) == values).all()
    if size == 5000 and top == 2 ** 20:
        assert len(code) * 8 < size * 10.5          # log2(2**20 / 5000) is 7.7 bits


def test_bit_words():
    bits = np.array([i % 3 == 0 for i in range(130)])
    words = words_of(bits)
    assert len(words) == 3 and all(bool(int(words[i // 64]) >> (i % 64) & 1) == bits[i] for i in range(130))


def test_ranges_cover_all_owners():
    r = Ranges(10 ** 6, 8)
    rng = random.Random(1)
    h = r.cut(np.array([rng.getrandbits(64) for _ in range(4000)], dtype=np.uint64).view(np.int64))
    who, begin, end = r.pieces(np.unique(h))
    assert who.tolist() == list(range(r.owners)) and begin[0] == 0 and (begin[1:] == end[:-1]).all()


def expected(docs):
    groups = {}
    for at, (doc_id, text) in enumerate(docs):
        groups.setdefault(BLANKS.sub(" ", text or ""), []).append((doc_id is None, doc_id or 0, at))
    out = []
    for text, members in groups.items():
        first = min(members)
        keep = None if first[0] else first[1]
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(None if m[0] else m[1], keep, len(members), m == first, sha) for m in members]
    return sorted(out, key=str)


DOCS = [(5, "a b"), (3, "a  b"), (3, "a\t\nb"), (9, "a b "), (1, None), (2, ""), (4, " "), (6, "\n\n"), (None, "a\x0bb"), (None, "only"),
        (None, "only"), (7, "A b"), (-8, "a\x1cb"), (8, "a\xa0b"), (10, "é😀 " * 50_000), (11, "é😀  " * 50_000), (12, "a\rb"), (12, "a\rb")]


def test_exact_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    docs = DOCS + [(100 + i, f"text {rng.randrange(150)}" + " " * rng.randrange(3)) for i in range(600)]
    docs += [(1000 + i, "one text of a third of all rows") for i in range(400)]
    rng.shuffle(docs)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, fp string, block int")
    for parts in (1, 7):
        out = exact_duplicates(df.repartition(parts))
        assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert sorted((tuple(r) for r in out.collect()), key=str) == expected(docs)


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    """Very short fingerprints make almost every row a suspect; bytes decide."""
    class Short(Ranges):
        def __init__(self, rows, partitions):
            self.bits, self.owners = 3, 5

    monkeypatch.setattr(exactdup, "Ranges", Short)
    docs = [(i, f"text {i % 40}") for i in range(200)] + [(500 + i, f"single {i}") for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((tuple(r) for r in exact_duplicates(df).collect()), key=str) == expected(docs)


def test_texts_are_deleted_and_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op11_exact_duplicates(spark, str(tmp_path))
    assert out.count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("foldline_texts")]

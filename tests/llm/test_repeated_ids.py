"""Ids that occur with different rows: near-duplicate operators tie or keep them, row by row."""

from foldline.llm.common import collected, stored, temporary


def test_an_id_with_two_texts_ties_their_components(spark):
    from foldline.llm.jaccard import jaccard_join
    a, b = "one two three four five six seven", "alpha beta gamma delta epsilon zeta eta"
    docs = spark.createDataFrame([(1, a), (2, b), (3, a), (3, b), (4, "something else here altogether now"), (4, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard_join(docs).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (3, 1), (4, 4), (4, 4)]


def test_a_vector_row_is_never_lost(spark):
    from foldline.llm.cosine import near_duplicates
    rows = [(1, [1.0, 0.0], 5), (1, None, 5), (2, [1.0, 0.01], 5), (3, [0.0, 1.0], None), (4, [0.0, 0.0], 5), (5, [float("nan"), 1.0], 5)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)]


def test_components_of_a_long_path(spark):
    from foldline.llm.graph import components
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 600)] + [(1000, 1001)], "u long, v long").repartition(5)
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(601)}, 1000: 1000, 1001: 1000}


def test_tables_of_a_scope_are_deleted(spark):
    df = spark.range(5)
    path = lambda d: d.inputFiles()[0].rsplit("/", 1)[0]
    exists = lambda p: spark._jvm.java.io.File(p.replace("file://", "")).exists()
    with collected() as outer:
        with temporary(spark):
            inner, kept = path(stored(df, "a")), stored(df, "b", keep=True)
            assert exists(inner)
        assert not exists(inner) and kept.count() == 5 and len(outer) == 1

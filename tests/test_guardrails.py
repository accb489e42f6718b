"""Planted-case tests of the leakage audit (a planted leak must be found, a clean column must not)."""

from pyspark.sql import functions as F

from foldline.operators import guardrails as G


def _findings(df, target, key=("id",)):
    rows = G.audit_findings(df, "t", target, G.AuditConfig(key=tuple(key))).collect()
    return {(r["issue_id"], r["column_name"]) for r in rows}, rows


def test_deterministic_and_not_proxy(spark):
    data = [(i, f"c{i % 4}", f"x{i % 3}", i % 3, "yes" if i % 4 < 2 else "no") for i in range(200)]
    df = spark.createDataFrame(data, "id long, proxy string, three string, t3 int, target string")
    df = df.withColumn("proxy", F.when(F.col("target") == "yes", F.concat(F.lit("y"), "proxy")).otherwise(
        F.concat(F.lit("n"), "proxy")))
    found, _ = _findings(df, "target")
    assert ("deterministic_proxy", "proxy") in found
    assert ("deterministic_proxy", "three") not in found  # only 3 values
    assert ("deterministic_proxy", "id") in found          # unique ids map to one target each


def test_three_valued_one_to_one_is_not_a_proxy(spark):
    df = spark.createDataFrame([(i, f"v{i % 3}", str(i % 3)) for i in range(90)], "id long, c string, target string")
    found, _ = _findings(df.drop("id").withColumn("id", F.monotonically_increasing_id()), "target")
    assert ("deterministic_proxy", "c") not in found


def test_high_cardinality_proxy(spark):
    # near-unique column (distinct/rows >= 0.98) where one value has two targets -> warning, not high
    rows = [(i, f"u{i}", "a" if i % 2 else "b") for i in range(100)]
    rows[1] = (1, "u0", "a")  # u0 now carries targets b and a
    df = spark.createDataFrame(rows, "id long, u string, target string").drop("id")
    found, _ = _findings(df, "target", key=())
    assert ("high_cardinality_proxy", "u") in found
    assert ("deterministic_proxy", "u") not in found


def test_path_tokens(spark):
    df = spark.createDataFrame([(i, f"/data/{c}/img_{i}.png", f"/a/b{i}", c) for i, c in
                                enumerate(["cat", "dog"] * 30)], "id long, path string, other string, label string")
    found, _ = _findings(df, "label")
    assert ("path_token_leakage", "path") in found
    assert ("path_token_leakage", "other") not in found


def test_path_tokens_many_targets_exact_join(spark):
    df = spark.createDataFrame([(i, f"/x/t{i}/f", f"t{i}") for i in range(50)], "id long, p string, target string")
    cols = [r[0] for r in G.path_token_columns(df, "target").collect()]
    assert cols == ["p"]


def test_texts_with_tokens_against_brute_force(spark):
    import random

    from foldline.operators.substrings import texts_with_tokens, token_postings
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé😀/") for _ in range(n))
    tokens = sorted({word(rng.randrange(1, 40)) for _ in range(60)} | {"common-beginning-" + str(i) for i in range(40)})
    texts = [("c", word(rng.randrange(0, 30))) for _ in range(200)] + [("d", f"/x/common-beginning-{i}") for i in range(30, 60)]
    texts += [("e", None), ("e", ""), ("e", "common-beginning"), ("d", tokens[-1])]
    tok = spark.createDataFrame([(t,) for t in tokens] + [(None,), ("",), (tokens[0],)], "tok string")
    got = {tuple(r) for r in texts_with_tokens(spark.createDataFrame(texts, "column_name string, value string"), tok).collect()}
    assert got == {(c, v) for c, v in texts if v and any(t in v for t in tokens)}
    posts = token_postings(tok).collect()
    assert len(posts) == len(tokens) and all(r["gram"] in r["tok"] and len(r["gram"]) == r["q"] for r in posts)


def test_temporal_order(spark):
    base = [(i, f"2024-01-{i + 1:02d}") for i in range(20)]
    swapped = list(base)
    swapped[3], swapped[4] = (3, base[4][1]), (4, base[3][1])
    with_null = list(base)
    with_null[5] = (5, None)
    for rows, expect in [(base, False), (swapped, True), (with_null, True), ([(i, None) for i in range(20)], False)]:
        df = spark.createDataFrame([(i, d, "x" if i % 2 else "y") for i, d in rows], "id long, event_date string, target string")
        t = G.temporal_findings(df, "t", ["id"], ["event_date"], n_buckets=3).collect()
        assert bool(t) == expect


def test_time_column_name_trap():
    from pyspark.sql import types as T
    assert G.TIME_COLUMN_PATTERN == r"(date|time|timestamp)"
    import re
    assert re.search(G.TIME_COLUMN_PATTERN, "HeatingUpdate", re.IGNORECASE)  # substring match kept
    _ = T


def test_duplicate_threshold_49_vs_50(spark):
    for n, expect in [(49, False), (50, True)]:
        rows = [(i % (n - 1), "a") for i in range(n)]  # exactly one repeated row
        df = spark.createDataFrame(rows, "k long, target string")
        d = G.duplicate_findings(df, "t").collect()
        assert bool(d) == expect


def test_titanic_like_golden(spark):
    # 2201 rows over 24 distinct combinations -> 2177 repeats, fraction 0.98909587 (reference report)
    rows = [((i % 24) // 8, (i % 24) // 2 % 4, i % 2, "yes" if i % 2 else "no") for i in range(2201)]
    df = spark.createDataFrame(rows, "a int, b int, c int, survived string")
    s = G.duplicate_summary(df).first()
    assert s["duplicates"] == 2201 - 24
    assert s["duplicates"] == 2177 and abs(s["fraction"] - 0.9890958655156747) < 1e-12


def test_audit_document_status_and_missing_target(spark):
    clean = spark.createDataFrame([(i, float(i) * 0.5, "a" if i % 2 else "b") for i in range(10)],
                                  "id long, x double, label string").drop("id")
    doc = G.audit_document(clean, "clean").first()
    assert doc["target"] == "label" and doc["status"] in ("pass", "issues_found")
    wide = spark.createDataFrame([(i, float(i)) for i in range(100)], "a long, b double")
    doc2 = G.audit_document(wide, "nolabel").first()
    assert doc2["status"] == "issues_found" and doc2["issues"][0]["issue_id"] == "missing_target"


def test_cross_fold_duplicates(spark):
    from foldline.operators.splits import kfold
    df = spark.createDataFrame([(i, f"text{i % 10}") for i in range(100)], "id long, text string")
    f = kfold(df, ["id"], k=5, seeds=[42])
    r = G.cross_fold_duplicates(f, ["text"]).first()
    assert r["groups"] == 10 and r["rows"] == 100


def test_numbers_meet_only_the_texts_that_hold_them(spark, monkeypatch):
    """Tokens of one length share most of their parts (order keys): a text meets those it holds, and none after its first."""
    import random

    from foldline.operators import substrings as B
    rng = random.Random(7)
    tokens = sorted({str(rng.randrange(1000000, 1010000)) for _ in range(2000)}) + ["777", "88888888888888888888"]
    texts = [("a", f"/c/{rng.randrange(1000000, 1010000)}/777") for _ in range(50)]
    texts += [("b", f"/c/{rng.randrange(1000000, 1010000)}/1") for _ in range(300)] * 5 + [("b", "x88888888888888888888")]
    met = []
    join = B._met
    monkeypatch.setattr(B, "_met", lambda *a: met.append(join(*a)) or met[-1])
    for limit in (100_000, 1):                        # the second one joins by salted shuffles
        monkeypatch.setattr(B, "BROADCAST_TOKENS", limit)
        met.clear()
        tok = spark.createDataFrame([(t,) for t in tokens], "tok string")
        got = sorted(tuple(r) for r in B.texts_with_tokens(spark.createDataFrame(texts, "column_name string, value string"), tok).collect())
        assert got == sorted({(c, v) for c, v in texts if any(t in v for t in tokens)})
        assert len(met) == 3                          # one round for each token length
        assert sum(m.count() for m in met) <= 50 + 300 + 5


def test_long_texts_take_a_time_in_proportion(spark, monkeypatch):
    """A text of 40,000 characters was split again for each of its grams."""
    import random
    import time

    from foldline.operators import substrings as B
    rng = random.Random(9)
    tokens = ["ab", "\U0001f600x", "x" * 20] + [f"{i}-" for i in range(100, 200)]
    body = "".join(rng.choice("abcd\u00e9\U0001f600 ") for _ in range(40_000)).replace("ab", "a ")
    texts = [("a", body), ("a", body + "ab"), ("a", body + "\U0001f600x"), ("b", body + "x" * 19), ("b", body + "x" * 20), ("b", "150"), ("b", "150-")]
    df = spark.createDataFrame(texts, "column_name string, value string")
    want = sorted((c, v) for c, v in texts if any(t in v for t in tokens))
    t0 = time.time()
    got = sorted(tuple(r) for r in B.texts_with_tokens(df, spark.createDataFrame([(t,) for t in tokens], "tok string")).collect())
    assert got == want and time.time() - t0 < 30
    # a few tokens are looked for in the texts themselves, with the same result
    monkeypatch.setattr(B, "_grams", None)
    few = spark.createDataFrame([(t,) for t in [*tokens[:4], "", None]], "tok string")
    want = {(c, v) for c, v in texts if any(t in v for t in tokens[:4])}
    assert {tuple(r) for r in B.texts_with_tokens(df, few).collect()} == want
    assert {r[0] for r in B.columns_with_tokens(df, few).collect()} == {c for c, _ in want}
    assert B.columns_with_tokens(df, few.where("tok = ''")).count() == 0

"""Fill-in-middle: brute force over code points, and the edge cases of the docstring."""

import hashlib

from foldline.llm.fim import fill_in_middle, op13_fill_in_middle, restored

TEXTS = [(1, "plain words here\nand a second line"), (2, None), (3, ""), (4, "a<S>b"), (5, "x"), (6, "é😀" * 40 + "\r\n\x85 end"),
         (7, "$1 \\2 (.*) {3}+ <P <S M> <M"), (7, "$1 \\2 (.*) {3}+ <P <S M> <M"), (8, "long " * 60_000), (None, "no id here"),
         (9, "<" * 30), (10, "P>S>M>" * 9), (-11, "negative id 𝒳𝒴")]
TEXTS += [(i, f"text number {i} " + "wörd😀 " * (i % 17)) for i in range(100, 400)]


def expected(doc_id, text):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_code_points(spark):
    docs = spark.createDataFrame([(*t, "kept", "gone") for t in TEXTS], "doc_id long, text string, extra string, form string")
    out = fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "extra", "n", "form", "prefix_units", "middle_units", "output"]
    got = sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"])
                  for r in out.collect()), key=str)
    assert got == sorted(((d, t, *expected(d, t)) for d, t in TEXTS), key=str)
    assert {g[3] for g in got} == {"plain", "psm", "spm"}
    back = out.select("text", restored(out["output"], out["form"]).alias("back")).collect()
    assert all(r["back"] == (r["text"] or "") for r in back)


def test_units_of_another_size(spark):
    docs = spark.createDataFrame([(i, "ab" * (i + 1)) for i in range(60)] + [(77, "abc")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fill_in_middle(docs, unit="ab", rate=100, spm_rate=0).collect()}
    assert got[77]["form"] == "plain" and got[77]["output"] == "abc"
    for i in range(60):
        r = got[i]
        p, m = r["prefix_units"], r["middle_units"]
        assert r["n"] == i + 1 and r["output"] == f"<P>{'ab' * p}<S>{'ab' * (i + 1 - p - m)}<M>{'ab' * m}"


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op13_fill_in_middle(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
                                                "restored_sha256"]

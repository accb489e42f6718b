"""Operator 13: fill-in-middle transformation by one counted-quantifier regular expression per row.

A text is ``n`` units, matched left to right (``unit`` is a regular expression; by default one code point).
``regexp_count`` gives ``n``; two draws modulo ``n + 1`` give the cuts a <= b. The row's own pattern

    ``\\A((?:unit){a}+)((?:unit){b-a}+)(.*+)\\z``

captures prefix, middle and suffix in one match: both counted groups are possessive, so they take exactly their
number of units and never give any back, and one ``regexp_replace`` over that match writes the marked text. The
exact text is rebuilt by the inverse match on the markers. Everything is a built-in expression of one scan: no
shuffle, no Python, no state beyond the row.

Draws are the first four 8-digit groups of the hex sha256 of ``<seed>:<decimal id>``, so reruns, retries and other
partitionings agree. ``rate`` of 100 texts are transformed, ``spm_rate`` of 100 of these into the suffix-first form.

Edge cases: null and empty texts, and texts that already hold a marker, stay plain (null counts as empty; cuts null).
A null id draws as the empty text. Rows that repeat an id draw alike; every row is transformed by itself, so ties,
repeated rows and very long texts need no special path (a text is held whole, a few times over, in its own row only).
Cuts may coincide or lie at either end: parts are then empty. A unit pattern must consume at least one character
and hold no capturing group; rows whose text is not a sequence of units stay plain. Other columns pass
through, except those with the names of the result's own columns, which are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm.common import table

CODE_POINT = r"(?s:.)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"      # fixed markers of the contract
RATE, SPM_RATE, SEED = 90, 20, "1"
PSM = f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2"
SPM = f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"


def _draw(digest: Column, i: int) -> Column:
    """The ``i``-th 8-digit group (from 0) of a hex digest as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def restored(output: Column, form: Column) -> Column:
    """The exact text an output was made from. Texts hold no marker, and no marker can arise across a seam
    (a marker starts with ``<`` and ends with ``>``, and holds neither inside), so the first match is the right one."""
    psm = F.regexp_replace(output, F.lit(rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*+)\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*+)\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED,
                   rate: int = RATE, spm_rate: int = SPM_RATE, unit: str = CODE_POINT) -> DataFrame:
    """``docs`` with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_units``, ``middle_units`` and ``output``."""
    own = ("n", "form", "prefix_units", "middle_units", "output", "_draws", "_a", "_b", "_text")
    rest = [c for c in docs.columns if c.lower() not in own]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), ident), 256)
    d = docs.select(*[F.col(f"`{c}`") for c in rest], text.alias("_text"),
                    F.array(*[_draw(digest, i) for i in range(4)]).alias("_draws"))
    d = d.withColumn("n", F.regexp_count("_text", F.lit(unit)).cast("long"))
    cut = lambda i: F.col("_draws")[i] % (F.col("n") + 1)
    d = d.withColumn("_a", F.least(cut(0), cut(1))).withColumn("_b", F.greatest(cut(0), cut(1)))
    marked = F.greatest(*[F.contains("_text", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)])
    covered = F.lit(True) if unit == CODE_POINT else F.col("_text").rlike(rf"\A(?:{unit})*+\z")
    plain = (F.col("n") == 0) | marked | (F.col("_draws")[2] % 100 >= rate) | ~covered
    d = d.withColumn("form", F.when(plain, "plain").when(F.col("_draws")[3] % 100 < spm_rate, "spm").otherwise("psm"))
    counted = lambda k: F.concat(F.lit(f"((?:{unit}){{"), k.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"\A"), counted(F.col("_a")), counted(F.col("_b") - F.col("_a")), F.lit(r"((?s:.*+))\z"))
    turned = F.regexp_replace("_text", pattern, F.when(F.col("form") == "spm", SPM).otherwise(PSM))
    made = F.col("form") != "plain"
    return d.select(*[F.col(f"`{c}`") for c in rest], "n", "form", F.when(made, F.col("_a")).alias("prefix_units"),
                    F.when(made, F.col("_b") - F.col("_a")).alias("middle_units"),
                    F.when(made, turned).otherwise(F.col("_text")).alias("output"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = fill_in_middle(docs)
    return out.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"),
                      F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def _group(i: int) -> str:
    return f"CAST('0x' || substr(g, {8 * i + 1}, 8) AS BIGINT)"


OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS g FROM documents),
c AS (SELECT *, length(t) AS n, {_group(0)} AS h1, {_group(1)} AS h2, {_group(2)} AS h3, {_group(3)} AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain'
  WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || x || '{SUFFIX}' || z || '{MIDDLE}' || y
  WHEN 'spm' THEN '{SUFFIX}' || z || '{PREFIX}' || x || '{MIDDLE}' || y ELSE t END) AS output_sha256,
 sha256(t) AS restored_sha256 FROM p"""

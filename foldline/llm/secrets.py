"""Operator 6 [native]: secret spans, with corpus-wide ownership frequency.

Base spans are found by three patterns (below). Positions come from splitting the text at the matches and
adding lengths up, so everything stays in built-in functions. Beside the base spans, every
mixed token (letters of both cases and digits, ``LIVE_MIN`` or more characters) is a candidate.

Ownership: each value is hashed and counted by distinct repositories (``repo``, by default the document)
and owners (``owner``, by default the source). Counting goes in two steps, (hash, owner) and then
hash, so that a value copied all over the corpus is folded before it is shuffled. A value with
``WIDE_OWNERS`` or more owners is a widely copied example; with fewer it is owner-specific and
looks live. Candidate tokens of live values are added as spans of kind ``live``; base spans always stay,
and ``n_live`` / ``n_example`` count a document's spans of either sort. The verdict is joined back
over salted keys, so a value that fills a third of all rows is dealt to ``SALTS`` tasks at least.

Edge cases: null and empty texts have no spans (counts 0, empty ``spans``, sha256 of the empty string); a null
owner is an owner of its own; null repositories don't count as one; repeated rows are scanned one
by one; an empty table gives no rows; other columns are ignored. Spans are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldline.llm.common import stored, table

# Fixed patterns of the base kinds. `access` and `hex` have their least length inside: a match takes a whole
# run of its characters, so this finds the same spans as dropping short matches afterwards.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("live", TOKEN))
ASSIGN_MIN = 6
LIVE_MIN = 20
WIDE_OWNERS = 3
SALTS = 16


def _found(kind: str, pattern: str):
    """``kind, value, gap, size`` of every match, in order; gap is the text between it and the one before."""
    text, p = F.col("text"), F.lit(pattern)
    value = F.regexp_extract_all(text, p, F.lit(2)) if kind == "assign" else F.regexp_extract_all(text, p, F.lit(0))
    whole = F.regexp_extract_all(text, p, F.lit(0))
    parts = F.zip_with(F.split(text, pattern, -1), F.arrays_zip(whole.alias("w"), value.alias("v")),
                       lambda g, m: F.struct(F.lit(kind).alias("kind"), m["v"].alias("value"),
                                             F.length(g).alias("gap"), F.length(m["w"]).alias("size")))
    return F.when(F.size(whole) > 0, parts).otherwise(F.array().cast(
        "array<struct<kind:string,value:string,gap:int,size:int>>"))


def scan(docs: DataFrame, owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """All matches in long form, one row at least per document (kind null without a match):
    ``rid, doc_id, repo, owner, kind, value, start, end``. Short assignments are dropped."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(repo).cast("string").alias("repo"),
                       F.col(owner).cast("string").alias("owner"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = F.concat(*[_found(k, p) for k, p in KINDS])
    rows = base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "repo", "owner",
                       F.filter(found, lambda m: m["size"].isNotNull()).alias("found"))
    rows = stored(rows.select("rid", "doc_id", "repo", "owner", F.posexplode_outer("found").alias("i", "m"))
                  .select("rid", "doc_id", "repo", "owner", "i", "m.*"), "matches")
    upto = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    hits = rows.where("kind is not null").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
    hits = hits.withColumn("start", F.col("end") - F.col("size"))
    keep = (F.col("kind") != "assign") | (F.length("value") >= ASSIGN_MIN)
    mixed = F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[0-9]")
    hits = hits.where(keep & ((F.col("kind") != "live") | mixed)).drop("i", "gap", "size")
    hits = hits.withColumn("hash", F.sha2("value", 256))
    return stored(hits.select("rid", "doc_id", "repo", "owner", "kind", "start", "end", "hash"), "hits"), rows


def ownership(hits: DataFrame) -> DataFrame:
    """``hash, repos, owners, live``: distinct repositories and owners of every value."""
    # a repository belongs to one owner row of this table, so distinct pairs are counted without a second expansion
    pairs = hits.groupBy("hash", "owner", "repo").count()
    by_owner = pairs.groupBy("hash", "owner").agg(F.count("repo").alias("repos"))
    by_hash = by_owner.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))
    return by_hash.withColumn("live", F.col("owners") < WIDE_OWNERS)


def find_secrets(docs: DataFrame, owner: str = "source", repo: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``(spans, documents)``: every span with its value's ownership, and one row per document."""
    hits, rows = scan(docs, owner, repo)
    verdict = stored(ownership(hits), "ownership")
    salted = verdict.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spans = hits.withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"]).drop("salt")
    spans = stored(spans.where((F.col("kind") != "live") | F.col("live")), "spans")

    order = F.create_map(*[F.lit(x) for i, (k, _) in enumerate(KINDS) for x in (k, i)])
    item = F.struct("start", order[F.col("kind")].alias("n"),
                    F.concat_ws(":", "kind", "start", "end").alias("span"))
    count = lambda c: F.count(F.when(c, 1))
    per = spans.groupBy("rid").agg(
        *[count(F.col("kind") == k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        count(F.col("live")).alias("n_live"), count(~F.col("live")).alias("n_example"),
        F.sort_array(F.collect_list(item)).alias("items"))
    docs_ = rows.select("rid", "doc_id", "i").where("i is null or i = 0").drop("i")
    out = docs_.join(per, "rid", "left")
    base = F.filter("items", lambda x: x["n"] < 3)
    text = lambda a: F.coalesce(F.array_join(F.transform(a, lambda x: x["span"]), ","), F.lit(""))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = out.select("rid", "doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"),
                     F.sha2(text(base), 256).alias("base_sha256"), text(F.col("items")).alias("spans"),
                     zero("n_live"), zero("n_example"))
    return spans, out


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))[1].drop("rid")


def _sql_kind(kind: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    group = 2 if kind == "assign" else 0
    return f"""
 SELECT rid, doc_id, source, '{kind}' AS kind, g[i] AS gap, w[i] AS whole, v[i] AS value, i FROM (
  SELECT rid, doc_id, source, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}', 0) AS w,
   regexp_extract_all(text, '{p}', {group}) AS v, unnest(range(1, len(regexp_extract_all(text, '{p}', 0)) + 1)) AS i FROM d)"""


OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_sql_kind(k, p) for k, p in KINDS)}),
p AS (SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM m),
h AS (SELECT rid, doc_id, source, kind, value, CAST(e - length(whole) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM p
 WHERE (kind <> 'assign' OR length(value) >= {ASSIGN_MIN})
  AND (kind <> 'live' OR (regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')))),
o AS (SELECT value, count(*) < {WIDE_OWNERS} AS live FROM (SELECT DISTINCT value, source FROM h) GROUP BY value),
x AS (SELECT h.*, live, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 ELSE 3 END AS n,
  kind || ':' || s || ':' || e AS span FROM h JOIN o USING (value) WHERE kind <> 'live' OR live),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example,
  string_agg(span, ',' ORDER BY s, n) FILTER (n < 3) AS base, string_agg(span, ',' ORDER BY s, n) AS spans FROM x GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
 sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
 coalesce(n_example, 0) AS n_example FROM d LEFT JOIN a USING (rid)"""

"""Training-data pipeline over ``documents``: five stages, each written as Parquet and reread by the next.

1. ``toxicity``: documents that the compression-distance classifier rejects go.
2. ``near_duplicates``: of every component of the Jaccard join (five-word shingles, similarity 0.8 or more) one document stays, the one whose id
   names it (documents without words are components of their own and stay; of rows that repeat the id of
   a kept document one stays).
3. ``secrets``: base spans and live candidate spans are cut out of the text and replaced by ``<secret>``; no
   document goes.
4. ``mix``: each document is repeated as often as the source mix takes it (zero times: it goes).
5. ``pack``: the pieces of packed sequences, with their ids.

All stages but the last return the columns of ``documents`` (``n_chars`` is recomputed where text changes). Null
texts, ids and sources pass through as each operator's docstring says.

A stage's result is written before the next stage begins, so a stage first deletes the tables that the stage before it
left behind, and the files of its shuffles.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldline.llm.common import collected, released, stored, table
from foldline.llm.jaccard import jaccard_join, rows_of
from foldline.llm.mixing import mix_sizes, WORD
from foldline.llm.packing import pack_documents
from foldline.llm.secrets import find_secrets
from foldline.llm.toxicity import toxicity_model, toxicity_scores
from foldline.session import checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MASK = "<secret>"
NEAR_K, NEAR_PERCENT = 5, 80       # words of a shingle, least similarity; wider than the defaults of the op4 query


_LEFT: list[str] = []              # tables of the latest stage, whose result may not be written yet


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]):
    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        released(spark, _LEFT)
        with collected() as paths:
            out = work(spark, docs, sf_dir)
        _LEFT.extend(paths)
        return out
    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """The stage's input with a row number, stored, so that a decision reaches the very row it is about."""
    return stored(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.7 or more go; texts of any length are scored whole, null ones as empty (they stay unless
    the empty text scores high), repeated rows alike; an empty table gives no rows."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity_scores(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the one with the smallest id (null ids last), then the first met. Rows without words are
    components of their own."""
    d = _numbered(docs)
    # rows are compared under their row number, and a component is named by its smallest id, then row
    comp = jaccard_join(d.select(F.col("row").alias("doc_id"), "text"), k=NEAR_K, percent=NEAR_PERCENT)
    comp = comp.select(F.col("doc_id").alias("row"), "component_id")
    who = stored(d.select("row", "doc_id").join(comp, "row"), "members")
    keep = who.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    return rows_of(d, "row", stored(keep.select(F.col("first.row").alias("row")), "kept"), who.select("row")).select(*COLUMNS)


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans become ``<secret>``, overlapping ones together; every row stays, null and empty texts as they are."""
    d = _numbered(docs)
    spans, _ = find_secrets(d.select(F.col("row").alias("doc_id"), "text", "source"))
    cuts = spans.groupBy(F.col("doc_id").alias("row")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")

    def join(a, x):          # overlapping spans are one cut
        last = F.element_at(a, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        one = F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))
        return F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] > x["start"]),
                      F.concat(F.slice(a, 1, F.size(a) - 1), F.array(wider))).otherwise(F.concat(a, one))

    joined = cuts.select("row", F.aggregate("cuts", none, join).alias("cuts"))
    marked = d.join(joined, "row", "left")
    parts = F.transform("cuts", lambda x, i: F.concat(
        F.substring(F.col("text"), F.when(i > 0, F.col("cuts")[i - 1]["end"]).otherwise(0).cast("int") + 1,
                    (x["start"] - F.when(i > 0, F.col("cuts")[i - 1]["end"]).otherwise(0)).cast("int")), F.lit(MASK)))
    rest = F.substring(F.col("text"), F.element_at("cuts", -1)["end"].cast("int") + 1, F.length("text"))
    text = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(parts, ""), rest))
    out = marked.withColumn("text", text)
    return out.withColumn("n_chars", F.when(F.col("cuts").isNull(), F.col("n_chars")).otherwise(
        F.length("text")).cast("long")).select(*COLUMNS)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row is repeated as often as it is taken (zero times: it goes); a row without words adds nothing and follows its source's rate.
    Rows that repeat an id are taken row by row."""
    d = _numbered(docs)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = stored(d.select(F.col("row").alias("doc_id"), "source", size.alias("size")), "sizes")
    copies = mix_sizes(sizes).where("copies > 0").select(F.col("doc_id").alias("row"), "copies")
    out = d.join(copies, "row")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their ids; every row has one piece at least (its end id)."""
    import public_tokenizers

    return pack_documents(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("pack", pack)]

#: Compression distances can't be expressed in SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written below ``spark.checkpoint.dir`` and reread."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out, path = stage(spark, docs, sf_dir), f"{base}/{i}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs

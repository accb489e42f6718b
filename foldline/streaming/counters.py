"""Serving-side counters and scorers on an event stream (STR-01..04).

Each operator is a function DataFrame → DataFrame that works unchanged on a batch frame
(the "batch twin" checked against SQL) and on a streaming frame from ``readStream``;
streaming runs add a watermark so window state is bounded, and write in append mode
with a checkpoint folder under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.operators.training import fallback_score
from foldline.session import checkpoint_dir

# Fixed latency histogram bucket bounds (seconds), cumulative.
LATENCY_BUCKETS = [0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0]


def _bucket_name(le: float) -> str:
    return "le_" + str(le).replace(".", "_")


def _event_time(events: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    """Watermarked streams need TIMESTAMP event time (a TIMESTAMP_NTZ column is read in the
    session time zone); batch twins keep the wall-clock column as is."""
    if not watermark:
        return events
    e = events
    if dict(e.dtypes).get(ts) == "timestamp_ntz":
        e = e.withColumn(ts, F.col(ts).cast("timestamp"))
    return e.withWatermark(ts, watermark)


def _epoch_seconds(df: DataFrame, c: str) -> Column:
    """Seconds since the epoch; wall-clock (time-zone independent) for TIMESTAMP_NTZ."""
    if dict(df.select(F.col(c).alias("_x")).dtypes)["_x"] == "timestamp_ntz":
        return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(c))
    return F.unix_timestamp(F.col(c))


def request_counts(events: DataFrame, ts: str, path: Column, status: Column, window: str = "10 minutes",
                   watermark: str | None = None) -> DataFrame:
    """STR-01: ``window_start, window_end, path, status, n`` per tumbling window."""
    e = _event_time(events, ts, watermark)
    g = e.groupBy(F.window(ts, window).alias("w"), path.alias("path"), status.alias("status")).agg(
        F.count(F.lit(1)).cast("long").alias("n"))
    return g.select(_epoch_seconds(g, "w.start").alias("window_start"),
                    _epoch_seconds(g, "w.end").alias("window_end"), "path", "status", "n")


def latency_histogram(events: DataFrame, ts: str, latency: Column, window: str = "10 minutes",
                      watermark: str | None = None) -> DataFrame:
    """STR-02: cumulative bucket counts (≤ 0.05 … ≤ 5, +Inf), count and sum per window."""
    e = _event_time(events, ts, watermark)
    aggs = [F.sum(F.when(latency <= le, 1).otherwise(0)).cast("long").alias(_bucket_name(le)) for le in LATENCY_BUCKETS]
    aggs += [F.count(F.lit(1)).cast("long").alias("le_inf"), F.sum(latency).alias("latency_sum")]
    g = e.groupBy(F.window(ts, window).alias("w")).agg(*aggs)
    return g.select(_epoch_seconds(g, "w.start").alias("window_start"), *[c for c in g.columns if c != "w"])


def score_requests(events: DataFrame, key: str, features_json: str) -> DataFrame:
    """STR-03 / TRN-14: parse ``{"k": v, …}`` request features and score with the fallback rule."""
    m = F.from_json(F.col(features_json), "map<string,string>")
    return events.select(key, fallback_score(m).alias("score"))


def start_run_record_sink(records: DataFrame, out_path: str, name: str = "run_records", fmt: str = "json"):
    """STR-04 / SNK-03: append run records partitioned by ``section``, checkpointed for exactly-once."""
    ckpt = f"{checkpoint_dir(records.sparkSession).rstrip('/')}/streams/{name}"
    return (records.writeStream.format(fmt).outputMode("append").partitionBy("section")
            .option("checkpointLocation", ckpt).option("path", out_path).trigger(availableNow=True).start())

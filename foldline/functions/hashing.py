"""Deterministic, engine-independent pseudo-randomness.

Every draw is a function of ``md5(seed | key …)`` so that Spark and DuckDB (the oracle)
produce identical folds, samples and bootstrap indices, on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts) -> Column:
    """``concat_ws('|', parts…)`` with every part cast to string (nulls are skipped)."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def h15(*parts) -> Column:
    """60-bit order key: the first 15 hex digits of md5 as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(hash_key(*parts)), 1, 15), 16, 10).cast("bigint")


def h8(*parts) -> Column:
    """32-bit draw: the first 8 hex digits of md5 as a BIGINT in [0, 2^32)."""
    return F.conv(F.substring(F.md5(hash_key(*parts)), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Uniform double in [0, 1) derived from ``h8``."""
    return h8(*parts) / F.lit(4294967296.0)


SHORT = 64


def compact(text: Column) -> Column:
    """A stand-in for a text of which only equality matters: short texts as they are, longer ones as a SHA-256 with a mark, so
    that both kinds differ in length and whole documents are never shuffled as keys."""
    return F.when(F.length(text) > SHORT, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)


# --- SQL (DuckDB) twins used by the oracle strings -------------------------------------

def sql_key(*parts: str) -> str:
    return "concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


def sql_h15(*parts: str) -> str:
    return f"('0x' || substr(md5({sql_key(*parts)}), 1, 15))::BIGINT"


def sql_h8(*parts: str) -> str:
    return f"('0x' || substr(md5({sql_key(*parts)}), 1, 8))::BIGINT"

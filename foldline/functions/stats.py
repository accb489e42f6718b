"""Closed-form statistical distribution functions as Spark Column expressions.

No scipy: the two-sided Student-t tail for integer degrees of freedom uses the finite
series of Abramowitz & Stegun 26.7.3/26.7.4, evaluated with the ``aggregate``
higher-order function so it stays inside whole-stage codegen (no Python UDF).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _series(m: Column, c2: Column, even: bool) -> Column:
    """1 + sum_{j=1..m} prod_{i<=j} r(i) * c2^j, r(i) = (2i-1)/(2i) (even) or 2i/(2i+1) (odd)."""
    def step(acc, j):
        jj = j.cast("double")
        r = (2 * jj - 1) / (2 * jj) if even else (2 * jj) / (2 * jj + 1)
        t = acc["t"] * r * c2
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    init = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    agg = F.aggregate(F.sequence(F.lit(1), m.cast("int")), init, step, lambda acc: acc["s"])
    return F.when(m >= 1, agg).otherwise(F.lit(1.0))


def t_two_sided_p(t: Column, dof: Column) -> Column:
    """P(|T_dof| >= |t|) for integer dof >= 1; null when t or dof is null / t not finite."""
    nu = dof.cast("double")
    theta = F.atan(F.abs(t) / F.sqrt(nu))
    c2 = F.pow(F.cos(theta), 2)
    s = F.sin(theta)
    even_a = s * _series((dof - 2) / 2, c2, even=True)
    odd_a = F.when(dof == 1, 2 * theta / math.pi).otherwise(
        (2 / math.pi) * (theta + s * F.cos(theta) * _series((dof - 3) / 2, c2, even=False)))
    a = F.when(dof % 2 == 0, even_a).otherwise(odd_a)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - a))
    ok = t.isNotNull() & ~F.isnan(t) & (dof >= 1)
    return F.when(ok, p)


def normal_cdf(z: Column) -> Column:
    """Standard normal CDF (Abramowitz & Stegun 7.1.26 erf approximation, |err| < 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2.0)
    k = 1 / (1 + 0.3275911 * x)
    poly = k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def sql_normal_cdf(z: str) -> str:
    """DuckDB twin of ``normal_cdf`` (same erf approximation)."""
    z = f"({z})"
    x = f"(abs({z}) / sqrt(2.0))"
    k = f"(1.0 / (1.0 + 0.3275911 * {x}))"
    poly = (f"({k} * (0.254829592 + {k} * (-0.284496736 + {k} * (1.421413741 + {k} * (-1.453152027 + "
            f"{k} * 1.061405429)))))")
    erf = f"(1.0 - {poly} * exp(-{x} * {x}))"
    return f"CASE WHEN {z} >= 0 THEN 0.5 * (1 + {erf}) ELSE 0.5 * (1 - {erf}) END"


def sql_t_two_sided_p(t: str, dof: str) -> str:
    """DuckDB twin of ``t_two_sided_p`` (gamma-function form of the same series)."""
    t, dof = f"({t})", f"({dof})"
    th = f"atan(abs({t}) / sqrt({dof}))"
    c2 = f"pow(cos({th}), 2)"
    even_s = (f"list_sum(list_transform(range(0, CAST(({dof} - 2) / 2 AS BIGINT) + 1), "
              f"lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow({c2}, j)))")
    odd_s = (f"list_sum(list_transform(range(0, CAST(({dof} - 3) / 2 AS BIGINT) + 1), "
             f"lambda j: sqrt(pi()) * exp(lgamma(j + 1) - lgamma(j + 1.5)) / 2 * pow({c2}, j)))")
    a = (f"CASE WHEN {dof} % 2 = 0 THEN sin({th}) * {even_s} "
         f"WHEN {dof} = 1 THEN 2 * {th} / pi() "
         f"ELSE 2 / pi() * ({th} + sin({th}) * cos({th}) * {odd_s}) END")
    return f"CASE WHEN {t} IS NULL OR isnan({t}) OR {dof} < 1 THEN NULL ELSE greatest(0.0, least(1.0, 1 - ({a}))) END"

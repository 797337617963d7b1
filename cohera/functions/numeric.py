"""Scalar helpers: safe casts, logs, ranks, rounding rules and great-circle distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

INF = float("inf")
EARTH_RADIUS_KM = 6371.0088  # fixed value
RANK_TOL = 1e-9  # guards 0.9 * 10 against round-off


def to_number(c: Column) -> Column:
    """Numeric cast; unreadable text and NaN become missing."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def positive_log10(c: Column) -> Column:
    return F.when(c > 0, F.log10(c))


def pow10(c: Column) -> Column:
    return F.pow(F.lit(10.0), c)


def is_infinite(c: Column) -> Column:
    return F.abs(c) == F.lit(INF)


def finite_or_null(c: Column) -> Column:
    return F.when(~is_infinite(c) & ~F.isnan(c), c)


def close_to(a: Column, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    b = b if isinstance(b, Column) else F.lit(float(b))
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def conformal_rank(n: Column, alpha) -> Column:
    """ceil((1 - alpha)(n + 1)) with a round-off guard."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.ceil((F.lit(1.0) - a) * (n + F.lit(1)) - F.lit(RANK_TOL)).cast("long")


def lower_rank(n: Column, alpha) -> Column:
    """floor(alpha (n + 1)): the lower rank of cross-validated intervals."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.floor(a * (n + F.lit(1)) + F.lit(RANK_TOL)).cast("long")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    sa = F.sin((p2 - p1) / 2)
    so = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = sa * sa + F.cos(p1) * F.cos(p2) * so * so
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


# Fixed values of the series.
NORMAL_P = 0.3275911
NORMAL_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function (Abramowitz and Stegun 7.1.26, error below 7.5e-8)."""
    a1, a2, a3, a4, a5 = NORMAL_A
    z = F.abs(x) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(NORMAL_P) * z)
    poly = ((((F.lit(a5) * t + F.lit(a4)) * t + F.lit(a3)) * t + F.lit(a2)) * t + F.lit(a1)) * t
    erf = F.lit(1.0) - poly * F.exp(-z * z)
    return F.lit(0.5) * (F.lit(1.0) + F.signum(x) * erf)


def round_by_rule(v: Column, rule: str) -> Column:
    """Number to text by a named rule.

    ``i0`` integer, ``i1`` integer with thousands marks, ``dN`` decimals, ``sN`` significant digits, ``pN`` percent,
    ``uN`` / ``fN`` rounded up / down at N decimals, ``h0`` half-up integer (medians).
    """
    kind, n = rule[0], int(rule[1:])
    if kind == "i":
        r = F.bround(v, 0).cast("long")
        return F.format_number(r, 0) if n else r.cast("string")
    if kind == "h":
        return F.floor(v + F.lit(0.5)).cast("long").cast("string")
    if kind == "d":
        return F.format_string(f"%.{n}f", v)
    if kind == "p":
        return F.format_string(f"%.{n}f", v * 100)
    if kind in "uf":
        s = 10.0**n
        stepped = F.ceil(v * s - F.lit(RANK_TOL)) if kind == "u" else F.floor(v * s + F.lit(RANK_TOL))
        return F.format_string(f"%.{n}f", stepped / F.lit(s))
    if kind == "s":
        digits = F.lit(n - 1) - F.floor(F.log10(F.abs(v))).cast("int")
        scale = F.pow(F.lit(10.0), digits.cast("double"))
        rounded = F.round(v * scale) / scale
        out = F.lit(None).cast("string")
        for d in range(12, -1, -1):
            out = F.when(digits == d, F.format_string(f"%.{d}f", rounded)).otherwise(out)
        out = F.when(digits < 0, F.format_string("%.0f", rounded)).otherwise(out)
        return F.when(v == 0, F.lit("0")).otherwise(out)
    raise ValueError(f"unknown rounding rule {rule}")

"""Distribution functions that Spark SQL lacks, as vectorised NumPy series for Arrow UDFs.

They run on summary rows only (one row per cell), never on data rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erf = np.vectorize(math.erf, otypes=[float])


def beta_inc(a, b, x, terms: int = 300):
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    zc = np.clip(z, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(zc) + q * np.log1p(-zc)) / p
    tiny = 1e-300
    c, d = np.ones_like(zc), 1 - (p + q) * zc / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, terms):
        for num in (
            m * (q - m) * zc / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * zc / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    out = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.where(flip, 1 - out, out)


def beta_quantile(p, a, b, rounds: int = 80):
    p, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(p, a, b))
    lo, hi = np.zeros_like(p), np.ones_like(p)
    for _ in range(rounds):
        mid = (lo + hi) / 2
        left = beta_inc(a, b, mid) < p
        lo, hi = np.where(left, mid, lo), np.where(left, hi, mid)
    return (lo + hi) / 2


def t_cdf(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    finite = np.where(np.isfinite(t), t, 0.0)
    tail = 0.5 * beta_inc(df / 2, np.full_like(df, 0.5), df / (df + finite * finite))
    out = np.where(finite > 0, 1 - tail, tail)
    return np.where(np.isposinf(t), 1.0, np.where(np.isneginf(t), 0.0, out))


def t_quantile(p, df, rounds: int = 200):
    p, df = (np.asarray(v, float) for v in np.broadcast_arrays(p, df))
    lo, hi = np.full(p.shape, -1e4), np.full(p.shape, 1e4)
    for _ in range(rounds):
        mid = (lo + hi) / 2
        left = t_cdf(mid, df) < p
        lo, hi = np.where(left, mid, lo), np.where(left, hi, mid)
    return (lo + hi) / 2


def normal_cdf_np(x):
    return 0.5 * (1 + _erf(np.asarray(x, float) / math.sqrt(2)))


def nct_sf(t, df, nc, nodes: int = 4000):
    """Upper tail of the non-central t: integrate the normal tail over the chi distribution of the scale."""
    out = []
    for tv, dv, nv in zip(np.atleast_1d(t), np.atleast_1d(df), np.atleast_1d(nc)):
        if not np.isfinite([tv, dv, nv]).all():
            out.append(np.nan)
            continue
        s = np.linspace(1e-6, 1 + 10 / math.sqrt(2 * dv) + 2, nodes)  # s = chi / sqrt(df)
        logpdf = math.log(2) + dv / 2 * math.log(dv / 2) - math.lgamma(dv / 2) + (dv - 1) * np.log(s) - dv * s * s / 2
        f = np.exp(logpdf) * (1 - normal_cdf_np(tv * s - nv))
        out.append(float(np.sum((f[1:] + f[:-1]) / 2 * np.diff(s))))
    return np.array(out)


@F.pandas_udf(T.DoubleType())
def t_cdf_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & df.notna() & (df > 0)
    return pd.Series(t_cdf(t.where(ok, 0.0), df.where(ok, 1.0))).where(ok.reset_index(drop=True))


@F.pandas_udf(T.DoubleType())
def t_quantile_udf(p: pd.Series, df: pd.Series) -> pd.Series:
    ok = p.notna() & df.notna() & (df > 0)
    return pd.Series(t_quantile(p.where(ok, 0.5), df.where(ok, 1.0))).where(ok.reset_index(drop=True))


@F.pandas_udf(T.DoubleType())
def beta_quantile_udf(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    ok = p.notna() & a.notna() & b.notna() & (a > 0) & (b > 0)
    got = beta_quantile(p.where(ok, 0.5), a.where(ok, 1.0), b.where(ok, 1.0))
    return pd.Series(got).where(ok.reset_index(drop=True))


@F.pandas_udf(T.DoubleType())
def nct_sf_udf(t: pd.Series, df: pd.Series, nc: pd.Series) -> pd.Series:
    return pd.Series(nct_sf(t, df, nc))


def normal_quantile(p, rounds: int = 70):
    """Inverse of :func:`cohera.functions.numeric.normal_cdf`, the same series, by bisection; infinite at 0 and 1."""
    from cohera.functions.numeric import NORMAL_A, NORMAL_P

    p = np.asarray(p, float)
    lo, hi = np.full(p.shape, -9.0), np.full(p.shape, 9.0)
    for _ in range(rounds):
        mid = (lo + hi) / 2
        t = 1.0 / (1.0 + NORMAL_P * np.abs(mid) / math.sqrt(2.0))
        erf = 1.0 - sum(a * t ** (i + 1) for i, a in enumerate(NORMAL_A)) * np.exp(-mid * mid / 2.0)
        low = 0.5 * (1.0 + np.sign(mid) * erf) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, hi))


@F.pandas_udf(T.DoubleType())
def normal_quantile_udf(p: pd.Series) -> pd.Series:
    return pd.Series(normal_quantile(p.fillna(0.5))).where(p.notna().reset_index(drop=True))

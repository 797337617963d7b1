"""Keyed randomness, content hashes and text keys.

Every random choice is a pure function of (purpose, seed, id): it does not depend on row order, partitioning or
retries, and any engine with MD5 reproduces it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

HASH_BITS = 52  # exact in a double, so hashes can be ranked by the numeric selection operator


def hash_text(purpose, *parts) -> Column:
    """MD5 hex text of ``purpose|part|part``."""
    cols = [F.lit(purpose) if isinstance(purpose, str) else purpose]
    cols += [p.cast("string") for p in parts]
    return F.md5(F.concat_ws("|", *cols))


def hash52(purpose, *parts) -> Column:
    """52-bit integer hash: the default random order."""
    return F.conv(F.substring(hash_text(purpose, *parts), 1, HASH_BITS // 4), 16, 10).cast("long")


def uniform(purpose, *parts) -> Column:
    """Uniform number in (0, 1), never 0 or 1."""
    return (hash52(purpose, *parts).cast("double") + F.lit(0.5)) / F.lit(float(2**HASH_BITS))


def gaussian(purpose, *parts) -> Column:
    """Standard normal number by Box-Muller on two keyed uniforms."""
    u1 = uniform(F.concat(F.lit(f"{purpose}#1")), *parts)
    u2 = uniform(F.concat(F.lit(f"{purpose}#2")), *parts)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * 3.141592653589793) * u2)


def protocol_seed(protocol: Column, seed: Column) -> Column:
    """31-bit seed of (protocol, seed): CRC-32 of ``protocol|seed`` with the top bit cleared."""
    return F.crc32(F.concat_ws("|", protocol, seed.cast("string"))).bitwiseAND(F.lit(0x7FFFFFFF))


# Seed blocks per purpose, disjoint by construction.
MODEL_SEED_BASE = 1000
HOLDOUT_SEED_OFFSET = 500_000
FOLD_SEED_OFFSET = 600_000
FOLD_SEED_STRIDE = 10_000
MAX_SPLIT_SEED = 899
MAX_MEMBERS = 10
MAX_FOLDS = 10


def member_seed(purpose: Column, seed: Column, member: Column, fold: Column) -> Column:
    """Injective (purpose, seed, member, fold) to integer; values outside the collision-free range stop the job."""
    base = F.lit(MODEL_SEED_BASE) + seed * 10 + member
    ok = seed.between(0, MAX_SPLIT_SEED) & member.between(0, MAX_MEMBERS - 1) & fold.between(0, MAX_FOLDS - 1)
    return (
        F.when(ok & (purpose == "full"), base)
        .when(ok & (purpose == "r80"), base + HOLDOUT_SEED_OFFSET)
        .when(ok & (purpose == "cv"), base + FOLD_SEED_OFFSET + fold * FOLD_SEED_STRIDE)
        .otherwise(F.raise_error(F.lit("seed, member or fold out of range, or unknown purpose")).cast("long"))
    )


def array_content_hash(a: Column, digits: int = 8, missing: str | None = "nan") -> Column:
    """16 hex digits of SHA-1 over the fixed-decimal text of an array.

    Decimals are those of the exact binary value, half to even, as C prints them; the JVM rounds its shortest text half up
    instead. Null, NaN and infinite elements become ``missing``; where it is None, they are left out (null) or printed, and
    an array of nulls alone has no hash.
    """

    @F.arrow_udf("string")
    def hashed(arrays: pa.Array) -> pa.Array:
        at = arrays.offsets.to_numpy() if len(arrays) else np.zeros(1, int)
        elements, at = arrays.values.slice(at[0], at[-1] - at[0]), at - at[0]
        x, known = elements.to_numpy(zero_copy_only=False), arrays.is_valid().to_numpy(zero_copy_only=False)
        if missing is None and elements.null_count:
            null = elements.is_null().to_numpy(zero_copy_only=False)
            full, at, x = np.diff(at) > 0, np.concatenate([[0], np.cumsum(~null)])[at], x[~null]
            known = known & ~(full & (np.diff(at) == 0))
        text = ((f"%.{digits}f " * len(x)) % tuple(x.tolist())).split()
        for k in np.flatnonzero(~np.isfinite(x)):
            if missing is not None:
                text[k] = missing
            elif np.isnan(x[k]) and np.signbit(x[k]):
                text[k] = "-nan"
        rows = zip(known.tolist(), at[:-1].tolist(), at[1:].tolist())
        return pa.array([hashlib.sha1(",".join(text[i:j]).encode()).hexdigest()[:16] if ok else None for ok, i, j in rows], pa.string())

    return hashed(a.cast("array<double>"))


def cell_key(*parts, alpha=None) -> Column:
    """Dotted cell key; ``alpha`` becomes ``aNNN`` (thousandths) or ``point``."""
    cols = [F.lit("cell"), *[p.cast("string") for p in parts]]
    if alpha is not None:
        tag = F.concat(F.lit("a"), F.lpad(F.round(alpha * 1000).cast("int").cast("string"), 3, "0"))
        cols.append(F.when(alpha.isNull(), F.lit("point")).otherwise(tag))
    return F.concat_ws(".", *cols)


def split_stem(*parts, seed, fold) -> Column:
    """File stem ``a_b_c_sNN_fN``."""
    return F.concat(
        F.concat_ws("_", *[p.cast("string") for p in parts]),
        F.lit("_s"),
        F.lpad(seed.cast("string"), 2, "0"),
        F.lit("_f"),
        fold.cast("string"),
    )

"""Array (spectral) operators. Band tables are small dimensions; rows keep their arrays and nothing is exploded unless
the result is per position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohera.functions.keys import gaussian
from cohera.operators.selection import quantiles

SUPPORT = 0.01  # fixed value: share of the peak a response must reach


def wide_to_array(df: DataFrame, prefix: str, out: str) -> DataFrame:
    """Columns ``<prefix><number>`` to one array; the numbers must be consecutive."""
    pos = sorted(int(c[len(prefix):]) for c in df.columns if c.startswith(prefix) and c[len(prefix):].isdigit())
    if not pos or pos != list(range(pos[0], pos[0] + len(pos))):
        raise ValueError(f"columns {prefix}* are not a contiguous axis: {pos}")
    cols = [f"{prefix}{p}" for p in pos]
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols])).drop(*cols)


def band_weights(srf: DataFrame, lo: int, hi: int) -> DataFrame:
    """Responses scaled to the band peak, cut at 1 % of it, with a flag whether the support lies inside [lo, hi].

    ``srf``: band, pos, response.
    """
    peak = srf.groupBy("band").agg(F.max("response").alias("_peak"))
    w = srf.join(peak, "band").withColumn("w", F.col("response") / F.col("_peak")).where(F.col("w") >= SUPPORT)
    edge = w.groupBy("band").agg(F.min("pos").alias("_a"), F.max("pos").alias("_b"))
    return w.join(edge, "band").select("band", "pos", "w", ((F.col("_a") >= lo) & (F.col("_b") <= hi)).alias("inside"))


def _bands(weights: DataFrame) -> dict[str, list[tuple[int, float, bool]]]:
    """One entry per band, that is per column of the result."""
    rows = weights.groupBy("band").agg(F.sort_array(F.collect_list(F.struct("pos", "w", "inside"))).alias("s")).orderBy("band").collect()
    return {r.band: [tuple(x) for x in r.s] for r in rows}


def weighted_mean(vec: Column, support: list[tuple[int, float, bool]]) -> Column:
    """Weighted mean over the support (0-based positions); missing if any value is missing or the support leaves the axis."""
    if not all(s[2] for s in support):
        return F.lit(None).cast("double")
    total = sum(w for _, w, _ in support)
    acc = None
    for p, w, _ in support:
        term = F.get(vec, F.lit(p)).cast("double") * F.lit(w)  # a missing value makes the sum missing
        acc = term if acc is None else acc + term
    return acc / F.lit(total)


def band_means(df: DataFrame, vec: str, weights: DataFrame) -> DataFrame:
    """One column per band, row-local."""
    return df.withColumns({b: weighted_mean(F.col(vec), s) for b, s in _bands(weights).items()})


def window_mean(vec: Column, centre: int, half: int = 2) -> Column:
    """Mean of the 2 half + 1 values around a 0-based position; missing if any is missing."""
    part = F.slice(vec, centre - half + 1, 2 * half + 1)
    ok = F.forall(part, lambda v: v.isNotNull() & ~F.isnan(v))
    total = F.aggregate(part, F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double"), F.lit(0.0)))
    return F.when(ok, total / F.lit(2.0 * half + 1))


def weighting_error(df: DataFrame, top: str, bottom: str, weights: DataFrame) -> DataFrame:
    """Ratio of weighted sums against weighted mean of ratios: n, median and 95th percentile relative difference per band."""
    items = []
    for band, s in _bands(weights).items():
        ratio = F.zip_with(F.col(top), F.col(bottom), lambda a, b: a / F.when(b > 0, b))
        items.append(F.struct(
            F.lit(band).alias("band"),
            (weighted_mean(F.col(top), s) / weighted_mean(F.transform(bottom, lambda b: F.when(b > 0, b)), s)).alias("exact"),
            weighted_mean(ratio, s).alias("approx")))
    long = df.select(F.explode(F.array(*items)).alias("e")).select("e.*").where(F.abs("exact") > 1e-4)
    rel = long.withColumn("rel", F.abs(F.col("approx") - F.col("exact")) / F.abs("exact"))
    return quantiles(rel, ["band"], "rel", {"median_rel_diff": 0.5, "p95_rel_diff": 0.95})


def line_fit(vec: Column, lo: int, n: int) -> tuple[Column, Column]:
    """(relative RMS residual of a straight line, mean) over n positions from lo, in closed form."""
    part = F.slice(vec, lo + 1, n)
    xs = [i - (n - 1) / 2 for i in range(n)]
    sxx = sum(x * x for x in xs)
    axis = F.array(*[F.lit(x) for x in xs])
    mean = F.aggregate(part, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.lit(float(n))
    sxy = F.aggregate(F.zip_with(part, axis, lambda v, x: v.cast("double") * x), F.lit(0.0), lambda s, v: s + v)
    syy = F.aggregate(part, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) - mean * mean * n
    rms = F.sqrt(F.greatest(F.lit(0.0), (syy - sxy * sxy / F.lit(sxx)) / F.lit(float(n))))
    return rms / F.abs(mean), mean


def smooth_check(df: DataFrame, complete: Column, rel_rms: Column, value: Column, reference: Column, smooth_below: float = 0.02, tolerance: float = 0.05) -> DataFrame:
    """Adds ``smooth`` (complete and nearly straight), ``within`` (``value`` within ``tolerance`` of ``reference``) and, on
    every row, the shares of rows within it among the smooth and among the complete ones (null if there are none)."""
    rows = df.withColumns({"smooth": complete & (rel_rms < smooth_below), "within": F.abs(value - reference) / F.abs(reference) <= tolerance, "_complete": complete})
    hit = F.col("within").cast("double")
    share = rows.agg(F.avg(F.when(F.col("smooth"), hit)).alias("share_smooth"), F.avg(F.when(F.col("_complete"), hit)).alias("share_complete"))
    return rows.crossJoin(F.broadcast(share)).drop("_complete")  # one row


def resample_curve(curve: DataFrame, key: str, x: str, y: str, step: float = 0.1) -> DataFrame:
    """Irregular curve to unit bins, integral preserving: linear interpolation at fine midpoints, averaged per bin; zero
    outside the curve. A curve's points are a small dimension (hundreds per key). Output: key, bin, value."""
    w = Window.partitionBy(key).orderBy(x, y)
    seg = curve.withColumn("_x1", F.lead(x).over(w)).withColumn("_y1", F.lead(y).over(w)).where(F.col("_x1") > F.col(x))
    first = F.ceil(F.col(x) / step - 0.5).cast("long")
    last = F.ceil(F.col("_x1") / step - 0.5).cast("long") - 1
    seg = seg.withColumn("_f", first).withColumn("_l", last).where(F.col("_l") >= F.col("_f"))
    fine = seg.select(key, x, y, "_x1", "_y1", F.explode(F.sequence("_f", "_l")).alias("_i"))
    at = (F.col("_i") + 0.5) * step
    v = F.col(y) + (F.col("_y1") - F.col(y)) * (at - F.col(x)) / (F.col("_x1") - F.col(x))
    per_bin = round(1 / step)
    b = F.floor(F.col("_i") / F.lit(per_bin)).cast("long").alias("bin")
    return fine.select(key, b, v.alias("_v")).groupBy(key, "bin").agg((F.sum("_v") / F.lit(float(per_bin))).alias("value"))


def curve_summary(srf: DataFrame) -> DataFrame:
    """Centroid, support, full width at half maximum and retained share per band. ``srf``: band, pos, response."""
    peak = srf.groupBy("band").agg(F.max("response").alias("_p"))
    s = srf.join(peak, "band").withColumn("s", F.col("response") / F.col("_p"))
    inside, half = F.col("s") >= SUPPORT, F.col("s") >= 0.5
    return s.groupBy("band").agg(
        (F.sum(F.col("s") * F.col("pos")) / F.sum("s")).alias("centroid"),
        F.min(F.when(inside, F.col("pos"))).alias("support_lo"), F.max(F.when(inside, F.col("pos"))).alias("support_hi"),
        (F.max(F.when(half, F.col("pos"))) - F.min(F.when(half, F.col("pos"))) + 1).alias("fwhm"),
        (F.sum(F.when(inside, F.col("s")).otherwise(0.0)) / F.sum("s")).alias("share_in_support"))


def availability(df: DataFrame, cols: list[str], good: Column) -> DataFrame:
    """Share of rows with a value, overall and among good rows. Output: band, share_all, share_good."""
    agg = df.select(good.alias("_g"), *cols).agg(*[
        F.struct(F.avg(F.col(c).isNotNull().cast("double")).alias("a"), F.avg(F.when(F.col("_g"), F.col(c).isNotNull().cast("double"))).alias("g")).alias(c)
        for c in cols])
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("band"), F.col(f"{c}.a").alias("share_all"), F.col(f"{c}.g").alias("share_good")) for c in cols]))
    return agg.select(items.alias("e")).select("e.*")


def completeness_matrix(df: DataFrame, sets: dict[str, Column], populations: dict[str, Column]) -> DataFrame:
    """``complete/total`` per feature set and population."""
    items = [F.when(F.coalesce(pc, F.lit(False)), F.struct(F.lit(s).alias("feature_set"), F.lit(p).alias("population"), F.coalesce(c, F.lit(False)).alias("ok")))
        for s, c in sets.items() for p, pc in populations.items()]
    long = df.select(F.explode(F.array_compact(F.array(*items))).alias("e")).select("e.*")
    g = long.groupBy("feature_set", "population").agg(F.count_if("ok").alias("complete"), F.count(F.lit(1)).alias("total"))
    return g.withColumn("text", F.concat_ws("/", "complete", "total"))


def ratio_features(blue: list[Column], green: Column, red: Column, edge: Column | None, b490: Column, floor: float = 1e-5) -> dict[str, Column]:
    """Log of the largest blue / green ratio, normalised difference with zero guard, log green / red, log blue / green."""

    def fl(c: Column) -> Column:
        return F.greatest(c, F.lit(floor))

    top = F.greatest(*[fl(b) for b in blue]) if len(blue) > 1 else fl(blue[0])
    out = {"log_mbr": F.log10(top / fl(green))}
    if edge is not None:
        den = edge + red
        out["nd"] = F.when(F.abs(den) > 1e-12, (edge - red) / den).otherwise(F.lit(0.0))
    out["log_g_r"] = F.log10(fl(green) / fl(red))
    out["log_b_g"] = F.log10(fl(b490) / fl(green))
    return out


def add_noise(vec: Column, id_col: Column, mult: float, add: float) -> Column:
    """x exp(mult N1) + add N2 with normals keyed by (id, position): one fixed realisation whatever the order."""

    def noisy(v: Column, j: Column) -> Column:
        return v.cast("double") * F.exp(F.lit(mult) * gaussian("noise-m", id_col, j)) + F.lit(add) * gaussian("noise-a", id_col, j)

    return F.transform(vec, noisy)


def envelope(df: DataFrame, vec: str, cls: str, probs: dict[str, float]) -> DataFrame:
    """Percentiles per class and position."""
    long = df.select(cls, F.posexplode(vec).alias("pos", "v"))
    return quantiles(long, [cls, "pos"], "v", probs)


def label_conflicts(df: DataFrame, content: str, targets: list[str]) -> DataFrame:
    """Sets of identical content whose non-missing labels differ in any target: content, copies, conflict."""
    g = df.groupBy(content).agg(F.count(F.lit(1)).alias("copies"), *[(F.min(t) < F.max(t)).alias(f"_c{i}") for i, t in enumerate(targets)])
    any_conflict = F.lit(False)
    for i in range(len(targets)):
        any_conflict = any_conflict | F.coalesce(F.col(f"_c{i}"), F.lit(False))
    return g.where(F.col("copies") > 1).select(content, "copies", any_conflict.alias("conflict"))

"""Best match of titles in a list of references by edit-distance ratio, without comparing all pairs.

A join on the q-grams of both sides finds the candidates. Two strings of at most M characters with ratio ``r`` or more are
at most (1 - r) M edits apart, and an edit touches q grams, so they share at least M (1 - q (1 - r)) + q - 1 of their
padded grams. Hence the rarest floor(q (1 - r) L) + 1 grams of a string of length L (its prefix) hold one of them, on both
sides. Only prefixes are indexed, rare grams first; pairs whose lengths alone forbid the ratio are dropped; the rest is
measured exactly.

Only the best reference counts, so thresholds fall in steps: a title that finds any reference at a step has its best one
among those found, and only the others go on to the next, wider step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from cohera.session import settle

STEPS = (0.85, 0.7)  # before the threshold asked for
POSTING = 20_000  # references of a gram that meet in one place; the gram's references are dealt over more places beyond
SLACK = 1e-9


def ratio(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / length of the longer string; 1 for two empty ones."""
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def gram_size(least: float) -> int:
    """The longest grams (up to 4) for which the bound on shared grams still says something."""
    return max(1, min(4, math.floor(1 / (1 - least) + SLACK))) if least < 1 else 4


def grams(text: Column, q: int) -> Column:
    """Grams of the padded string; the n-th copy of a gram carries its number, so that a set holds the multiset."""
    padded = F.concat(F.lit("\u0001" * (q - 1)), text, F.lit("\u0002" * (q - 1)))
    n = F.length(text) + (q - 1)
    plain = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(padded, i, F.lit(q))))
    plain = F.coalesce(plain, F.array().cast("array<string>"))
    return F.transform(plain, lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice(plain, 1, i + 1), lambda h: h == g)).cast("string")))


def gram_order(strings: DataFrame, frequency: DataFrame, q: int) -> DataFrame:
    """s, grams: the grams of each distinct string, the rarest among the references first."""
    rows = strings.select("s", F.explode(grams(F.col("s"), q)).alias("g")).join(frequency, "g", "left")
    place = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")
    return rows.groupBy("s").agg(F.transform(F.sort_array(F.collect_list(place)), lambda x: x["g"]).alias("grams"))


def candidates(left: DataFrame, right: DataFrame, least: float, q: int, posting: int = POSTING) -> DataFrame:
    """a, b: every pair that may have a ratio of ``least`` or more, once. ``left``, ``right``: s, grams in one order."""
    count = lambda s: F.floor(F.length(s) * (q * (1 - least)) + SLACK).cast("int") + 1
    prefix = lambda df: df.select("s", F.slice("grams", F.lit(1), count("s")).alias("p"))
    a = prefix(left).select(F.col("s").alias("a"), F.col("p").alias("pa"), F.explode("p").alias("g"))
    b = prefix(right).select(F.col("s").alias("b"), F.col("p").alias("pb"), F.explode("p").alias("g"))
    crowd = b.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > posting)
    crowd = settle(crowd.select("g", F.ceil(F.col("n") / posting).cast("int").alias("deals")))
    keys = ["g"]
    if not crowd.isEmpty():  # the references of a crowded gram lie in several places, and its titles visit each
        deals = F.coalesce("deals", F.lit(1))
        a = a.join(crowd, "g", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("deals")
        b = b.join(crowd, "g", "left").withColumn("deal", F.pmod(F.hash("b"), deals)).drop("deals")
        keys = ["g", "deal"]
    longer, shorter = F.greatest(F.length("a"), F.length("b")), F.least(F.length("a"), F.length("b"))
    near = shorter + SLACK >= longer * least
    first = F.get(F.array_intersect("pa", "pb"), F.lit(0)) == F.col("g")  # a pair is taken at its first shared gram
    return a.join(b, keys).where(near & first).select("a", "b")


def best_matches(titles: DataFrame, refs: DataFrame, least: float = 0.6, steps: tuple[float, ...] = STEPS, posting: int = POSTING) -> DataFrame:
    """The best reference of each distinct title with a ratio of ``least`` or more: title, ref, ratio.

    ``titles``, ``refs``: one column ``title`` / ``ref`` (normalised). Of equal ratios the reference that sorts first wins.
    Nulls match nothing. ``least`` is above 0 and at most 1.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    open_titles = settle(titles.select(F.col("title").alias("s")).where("s is not null").distinct())
    known = settle(refs.select(F.col("ref").alias("s")).where("s is not null").distinct())
    found, ordered = None, {}
    for step in [*(x for x in sorted(steps, reverse=True) if x > least), least]:
        q = gram_size(step)
        if q not in ordered:
            frequency = settle(known.select(F.explode(grams(F.col("s"), q)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")))
            ordered[q] = (frequency, settle(gram_order(known, frequency, q)))
        frequency, right = ordered[q]
        pairs = candidates(gram_order(open_titles, frequency, q), right, step, q, posting).withColumn("ratio", ratio("a", "b"))
        pairs = pairs.where(F.col("ratio") >= (least if step == least else step - SLACK))
        best = pairs.groupBy("a").agg(F.min_by(F.struct("b", "ratio"), F.struct((-F.col("ratio")).alias("d"), "b")).alias("m"))
        part = settle(best.select(F.col("a").alias("title"), F.col("m.b").alias("ref"), F.col("m.ratio").alias("ratio")))
        found = part if found is None else found.unionByName(part)
        if step != least:
            open_titles = settle(open_titles.join(part.select(F.col("title").alias("s")), "s", "left_anti"))
    return found

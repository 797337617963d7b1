"""Name and text normalisation."""

from __future__ import annotations

from functools import cache
from unicodedata import normalize

from pyspark.sql import Column, DataFrame, functions as F

PLANES = 0x30000  # code points that have decompositions lie below


@cache
def foldings() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition has ASCII in it: those with one ASCII character, these characters, and
    the others (ligatures and the like) with their ASCII text. Built from the Unicode rule, not written down."""
    one, plain, more = [], [], {}
    for code in range(0x80, PLANES):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        ascii_part = "".join(x for x in normalize("NFKD", c) if x.isascii())
        if len(ascii_part) == 1:
            one.append(c)
            plain.append(ascii_part)
        elif ascii_part:
            more[c] = ascii_part
    return "".join(one), "".join(plain), more

# Misspelt names, station and compass suffixes.
TYPO_FIXES = {"gulf of mexcio": "gulf of mexico", "loosdtrechtse": "loosdrechtse"}
STATION_SUFFIX = r"\s*(#\s*\d+|nr\.?\s*\d+)$"
COMPASS_SUFFIX = r"\s+(oost|west|noord|zuid|north|south|east)$"


def fold_accents(c: Column) -> Column:
    """Every character's compatibility decomposition without its non-ASCII part (accents go, letters stay)."""
    one, plain, more = foldings()
    long = F.create_map(*[F.lit(x) for pair in more.items() for x in pair])
    chars = F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(long, x), x))
    spelled = F.when(c.rlike("[" + "".join(more) + "]"), F.array_join(chars, "")).otherwise(c)  # few texts have any
    return F.regexp_replace(F.translate(spelled, one, plain), r"[^\x00-\x7F]", "")


def normalise_name(c: Column, typos: dict[str, str] = TYPO_FIXES) -> Column:
    s = F.trim(F.regexp_replace(F.lower(fold_accents(c)), r"\s+", " "))
    for bad, good in typos.items():
        s = F.replace(s, F.lit(bad), F.lit(good))
    return F.trim(F.regexp_replace(F.regexp_replace(s, STATION_SUFFIX, ""), COMPASS_SUFFIX, ""))


def region_nodes(df: DataFrame, name: str, region: str, out: str = "node") -> DataFrame:
    """``name [region]`` for names used in several regions. The per-name test is one small aggregate."""
    multi = df.groupBy(name).agg((F.min(region) < F.max(region)).alias("_multi"))
    node = F.when(F.col("_multi"), F.concat(F.col(name), F.lit(" ["), F.col(region), F.lit("]"))).otherwise(F.col(name))
    return df.join(multi, name).withColumn(out, node).drop("_multi")


def normalise_title(c: Column) -> Column:
    """Lower case, no markup, letters and digits only, single blanks."""
    s = F.regexp_replace(F.lower(fold_accents(c)), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9]+", " "), r"\s+", " "))

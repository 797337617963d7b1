"""Cleaning, labels, population filters and table expectations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def keep_unless_flagged(*flags: str) -> Column:
    """True unless a flag equals 1; a missing flag means not flagged."""
    bad = F.lit(False)
    for f in flags:
        bad = bad | (F.coalesce(F.col(f), F.lit(0)) == 1)
    return ~bad


def map_with_override(key: Column, mapping: dict[str, str], override_key: Column, overrides: dict[str, str], strict: bool = False) -> Column:
    """Dictionary lookup with overrides applied last; unmapped keys give null, or fail the job if ``strict``."""

    def lookup(c: Column, m: dict[str, str]) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(v) for kv in m.items() for v in kv]), c)

    base = lookup(key, mapping)
    out = F.coalesce(lookup(override_key, overrides), base) if overrides else base
    if not strict:
        return out
    lost = F.raise_error(F.concat(F.lit("unmapped value: "), key.cast("string"))).cast("string")
    return F.when(out.isNull() & key.isNotNull(), lost).otherwise(out)


def grid_cell(v: Column, step: float = 10.0) -> Column:
    return (F.floor(v / F.lit(step)) * F.lit(step)).cast("int")


def cell_label(df: DataFrame, lat: str, lon: str, labels: DataFrame, key: str, overrides: dict, label: str = "label", step: float = 10.0, other: str = "other") -> DataFrame:
    """Adds the label of the grid cell a row lies in (``labels``: lat_cell, lon_cell, name; one row per cell).

    Rows without coordinates take the override of their ``key`` or stay null; cells without a label give ``other``.
    """
    place = df.withColumns({"_la": grid_cell(F.col(lat), step), "_lo": grid_cell(F.col(lon), step)})
    names = labels.select(F.col("lat_cell").alias("_la"), F.col("lon_cell").alias("_lo"), F.col("name").alias("_name"))
    out = place.join(names, ["_la", "_lo"], "left")
    missing = F.col(lat).isNull() | F.col(lon).isNull()
    manual = F.lit(None).cast("string")
    for k, v in overrides.items():
        manual = F.when(F.col(key) == k, F.lit(v)).otherwise(manual)
    return out.withColumn(label, F.when(missing, manual).otherwise(F.coalesce("_name", F.lit(other)))).drop("_la", "_lo", "_name")


def censored(value: Column, limit: Column, share: float = 0.95) -> Column:
    return F.coalesce((value > 0) & (value >= F.lit(share) * limit), F.lit(False))


def rounded_to_half(value: Column) -> Column:
    two = value * F.lit(2.0)
    near = F.bround(two, 0)
    return F.coalesce((value > 0) & (F.abs(two - near) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(near)), F.lit(False))


def label_cascade(df: DataFrame, table: DataFrame, pair: tuple[str, str], label: str) -> DataFrame:
    """Label by (dataset, method), else by a method name with one meaning, else ``ambiguous`` / ``unmatched`` /
    ``missing``; ``<label>_source`` tells which rule decided. ``table``: dataset, method, label."""
    a, m = pair
    by_pair = table.groupBy(a, m).agg(F.min(label).alias("_pair"))
    by_name = table.groupBy(m).agg(
        F.when(F.count_distinct(label) == 1, F.min(label)).otherwise("ambiguous").alias("_name")
    )
    j = df.join(by_pair, [a, m], "left").join(by_name, m, "left")
    value = (
        F.when(F.col(m).isNull(), "missing").when(F.col("_pair").isNotNull(), F.col("_pair"))
        .when(F.col("_name").isNotNull(), F.col("_name")).otherwise("unmatched")
    )
    source = (
        F.when(F.col(m).isNull(), "method missing").when(F.col("_pair").isNotNull(), "dataset+method")
        .when(F.col("_name").isNotNull(), "method name only").otherwise("not in table")
    )
    return j.withColumn(label, value).withColumn(f"{label}_source", source).drop("_pair", "_name")


class Populations:
    """Named row filters; a leading ``~`` negates, an optional target list limits a filter to some targets."""

    def __init__(self):
        self._rules: dict[str, tuple[Callable[[], Column], set[str] | None]] = {"primary": (lambda: F.lit(True), None)}

    def register(self, name: str, rule: Callable[[], Column], targets: set[str] | None = None) -> None:
        self._rules[name] = (rule, targets)

    def apply(self, df: DataFrame, name: str, target: str | None = None) -> DataFrame:
        negate, plain = name.startswith("~"), name.lstrip("~")
        if plain not in self._rules:
            raise ValueError(f"unknown population {name}")
        rule, targets = self._rules[plain]
        if targets is not None and target not in targets:
            raise ValueError(f"population {name} is defined only for {sorted(targets)}")
        keep = F.coalesce(rule(), F.lit(False))
        return df.where(~keep if negate else keep)


def complete(*cols: str) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    return ok


def complete_array(a: Column) -> Column:
    return F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v))


def nonpositive_then_floor(a: Column, floor: float = 1e-5) -> tuple[Column, Column]:
    """(any value <= 0, values floored): the flag is taken before flooring."""
    return F.exists(a, lambda v: v <= 0), F.transform(a, lambda v: F.greatest(v.cast("double"), F.lit(floor)))


def select_cells(df: DataFrame, alpha: float | None = None, drop_descriptive: bool = True, **wanted) -> DataFrame:
    """Cell rows by scalar or list arguments; alpha within 1e-9; descriptive splits keep point rows only."""
    d = df
    if drop_descriptive:
        d = d.where(~F.col("descriptive_only") | (F.col("method") == "point"))
    for col, v in wanted.items():
        if v is not None:
            d = d.where(F.col(col).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(col) == v)
    return d if alpha is None else d.where(F.abs(F.col("alpha") - F.lit(float(alpha))) < 1e-9)


def expectations(df: DataFrame, **rules: Column) -> DataFrame:
    """One aggregation: rows and, per rule, the number of rows that break it. Output: rule, violations."""
    from cohera.sources.sinks import stack

    agg = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return agg.select(F.expr(stack(["rows", *rules]).replace("(name, value)", "(rule, violations)")))

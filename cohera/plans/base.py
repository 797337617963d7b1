"""Query registry and a small composer for the equivalent SQL texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, sql: str, *needs: str) -> None:
    """Register a named common table expression for the SQL side."""
    _PARTS[name] = (needs, sql.strip())


def sql(final: str, *needs: str) -> str:
    """``final`` with the CTEs it needs, in dependency order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for m in _PARTS[n][0]:
            visit(m)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return final.strip()
    body = ",\n".join(f"{n} AS MATERIALIZED ({_PARTS[n][1]})" for n in order)
    final = final.strip()
    if final.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {body},\n{final[15:]}"
    if final.upper().startswith("WITH "):
        return f"WITH {body},\n{final[5:]}"
    return f"WITH {body}\n{final}"


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rnd(c, digits: int = 6) -> Column:
    """Round a computed float so that the order of additions cannot show."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rnd(c, digits) for c in cols})

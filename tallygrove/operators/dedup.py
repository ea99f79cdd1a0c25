"""One row per key, chosen by an explicit order."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_by(df: DataFrame, keys: list[str], order: list[str], largest: bool = True) -> DataFrame:
    """Each key's row with the largest (or smallest) values of ``order``, other columns breaking ties.

    An aggregate, not a window: rows of a key meet in each map task first, so a
    key with very many versions is shuffled as a few rows.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    whole = F.struct(*order, *rest)
    found = df.groupBy(*keys).agg((F.max if largest else F.min)(whole).alias("row"))
    return found.select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in df.columns])


def latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    return best_by(df, keys, version)


def first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return best_by(df, keys, order, largest=False)


def prefer_consolidated(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows whose ``column`` is null or '' where a key has any, else all its rows; without keys all rows are one."""
    whole = F.col(column).isNull() | (F.col(column) == "")
    found = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(whole).alias("_any"))
    if keys:
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        flagged = df.join(found, reduce(and_, same))
    else:
        flagged = df.crossJoin(F.broadcast(found))  # one row
    return flagged.filter(~F.col("_any") | whole).drop("_any", *[f"_{k}" for k in keys])


def union_by_name(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def set_sizes(a: Column, b: Column) -> tuple[Column, Column]:
    return F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))

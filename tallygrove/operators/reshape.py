"""Pivots, unpivots and dense grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivoted(df: DataFrame, rows: str, columns: str, values: list[str], value: str) -> DataFrame:
    """Sums of ``value``, one column for each of the given values in their order, 0 where there is none.

    Values are given, so no job has to find them first.
    """
    return df.groupBy(rows).pivot(columns, values).agg(F.sum(value)).na.fill(0, values)


def unpivoted(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def densified(df: DataFrame, left: str, right: str, value: str) -> DataFrame:
    """A row for every pair of a left and a right value that occur, 0 where the pair doesn't.

    Both domains are distinct values of dimensions (years, types), so their
    product is as small as the result.
    """
    grid = df.select(left).distinct().crossJoin(df.select(right).distinct())
    sums = df.groupBy(left, right).agg(F.sum(value).alias(value))
    return grid.join(sums, [left, right], "left").select(left, right, F.coalesce(value, F.lit(0)).cast("long").alias(value))


def percent_of(column: str, total: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(F.col(column).cast("double"), total.cast("double")) * 100, F.lit(0.0)), 6)

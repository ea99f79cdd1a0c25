"""Additive measures of works, and the ratios made from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 6


def long(c: Column) -> Column:
    return c.cast("long")


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """a / b * scale; 0 where b is 0 or null."""
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")) * scale, F.lit(0.0)), PLACES)


def additive(routes: Iterable[str], languages: Iterable[str]) -> list[Column]:
    """Counts and sums that add up over any partition of the works."""
    return [
        long(F.count("*")).alias("doc_count"),
        F.sum("fwci").alias("fwci_sum"),
        F.sum("percentile").alias("percentile_sum"),
        long(F.count_if(F.col("percentile") >= 0.9)).alias("top_10_sum"),
        long(F.count_if(F.col("percentile") >= 0.99)).alias("top_1_sum"),
        *[long(F.count_if(F.col("oa") == r)).alias(f"oa_{r.lower()}") for r in routes],
        *[long(F.count_if(F.col("lang") == x)).alias(f"lang_{x.lower()}") for x in languages],
    ]


def sums(columns: Iterable[str]) -> list[Column]:
    return [F.sum(c).alias(c) for c in columns]


def with_ratios(df: DataFrame, routes: Iterable[str], languages: Iterable[str], keep: Iterable[str]) -> DataFrame:
    """Means and shares in percent, percentiles stored from 0 to 1."""
    n = F.col("doc_count")
    return df.select(
        *keep,
        n,
        ratio(F.col("fwci_sum"), n).alias("fwci_avg"),
        ratio(F.col("percentile_sum"), n, 100).alias("percentile_avg"),
        ratio(F.col("top_10_sum"), n, 100).alias("pct_top_10"),
        ratio(F.col("top_1_sum"), n, 100).alias("pct_top_1"),
        *[ratio(F.col(f"oa_{r.lower()}"), n, 100).alias(f"pct_oa_{r.lower()}") for r in routes],
        *[ratio(F.col(f"lang_{x.lower()}"), n, 100).alias(f"pct_lang_{x.lower()}") for x in languages],
    )


def weighted(value: str, weight: str = "doc_count") -> Column:
    """Mean of a column of means, by weight."""
    return ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def growth(first: Column, last: Column, years: Column) -> Column:
    """Compound annual growth in percent; 0 without two different years."""
    return F.when((years > 0) & (first > 0), F.round((F.pow(last / first, F.lit(1.0) / years) - 1) * 100, PLACES)).otherwise(F.lit(0.0))

"""Temporal bins of equal volume, sliding windows, and assignment of years to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, year: str = "year") -> DataFrame:
    return df.filter(F.col(year).isNotNull()).groupBy(F.col(year).cast("int").alias("year")).agg(F.count("*").cast("long").alias("n"))


def equal_volume(df: DataFrame, k: int = 20, year: str = "year") -> DataFrame:
    """bin_id, y_start, y_end from lower quantiles of the years; equal cuts fall together.

    Works on the histogram, so its windows see one row per year, never the corpus.
    """
    up = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = Window.partitionBy()
    counts = histogram(df, year).select("year", F.sum("n").over(up).alias("upto"), F.sum("n").over(all_).alias("total"), F.min("year").over(all_).alias("first"))
    rank = F.floor((F.col("total") - 1) * F.col("j") / k)
    cuts = counts.crossJoin(df.sparkSession.range(1, k + 1).withColumnRenamed("id", "j")).filter(F.col("upto") > rank).groupBy("j").agg(F.min("year").alias("cut"), F.min("first").alias("first"))
    line = Window.orderBy("cut")
    ends = cuts.select("cut", "first").distinct()
    return ends.select((F.row_number().over(line) - 1).cast("int").alias("bin_id"), F.coalesce(F.lag("cut").over(line) + 1, "first").cast("int").alias("y_start"), F.col("cut").cast("int").alias("y_end"))


def sliding(first_last: DataFrame, size: int = 3, step: int = 1) -> DataFrame:
    """All whole windows between year_min and year_max; one row in, its windows out."""
    starts = F.when(F.col("year_max") - size + 1 >= F.col("year_min"), F.sequence("year_min", F.col("year_max") - size + 1, F.lit(step)))
    return first_last.select(F.posexplode(starts).alias("bin_id", "y_start")).select("bin_id", "y_start", (F.col("y_start") + size - 1).alias("y_end"))


def assign(df: DataFrame, bins: DataFrame, year: str = "year", last: bool = True) -> DataFrame:
    """Each row's bin: the last that holds its year (or the first); -1 for none.

    Bins are turned into one row per year they hold, so the join is on equal
    years and not on ranges.
    """
    years = bins.select("bin_id", F.explode(F.sequence("y_start", "y_end")).alias("_year"))
    one = years.groupBy("_year").agg((F.max if last else F.min)("bin_id").alias("bin_id"))
    return df.join(one, df[year] == one["_year"], "left").drop("_year").withColumn("bin_id", F.coalesce("bin_id", F.lit(-1)))


def members(df: DataFrame, bins: DataFrame, year: str = "year") -> DataFrame:
    """Each row once for every window that holds its year."""
    years = bins.select("bin_id", F.explode(F.sequence("y_start", "y_end")).alias("_year"))
    return df.join(years, df[year] == years["_year"]).drop("_year")

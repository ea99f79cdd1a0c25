"""Journal metrics by year and over the whole period, for journals, countries and all, in one pass.

Scores are means over documents, unknown impact counting as 0; percentiles are
from 0 to 100 here, as the harvested records have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import LANGUAGES, ROUTES


def _mean(total: Column, n: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(total.cast("double"), n.cast("double")), F.lit(0.0)), 2)


def metrics(fwci: str = "fwci", percentile: str = "percentile", oa: str = "oa_status", lang: str = "language") -> list[Column]:
    n = F.count("*")
    value = F.coalesce(F.col(percentile), F.lit(0.0))
    known = F.coalesce(F.col(lang), F.lit("unknown"))
    part = lambda condition: _mean(F.count_if(condition) * 100, n)
    return [
        n.cast("long").alias("num_documents"),
        _mean(F.sum(F.coalesce(F.col(fwci), F.lit(0.0))), n).alias("fwci_avg"),
        part(value >= 90).alias("pct_top_10"),
        part(value >= 99).alias("pct_top_1"),
        _mean(F.sum(value), n).alias("avg_percentile"),
        *[part(F.col(oa) == r).alias(f"pct_oa_{r}") for r in ROUTES],
        *[part(known == x).alias(f"pct_lang_{x}") for x in LANGUAGES],
        part(~known.isin(*LANGUAGES)).alias("pct_lang_other"),
    ]


def levels(works: DataFrame, journal: str = "journal_id", country: str = "country_code", year: str = "year") -> DataFrame:
    """level (journal, country, all), period (a year, or first-last), keys and metrics: six tables in one aggregate."""
    sets = [[journal, year], [journal], [country, year], [country], [year], []]
    found = works.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, (journal, country, year))).agg(
        *metrics(), F.min(F.col(year)).alias("_first"), F.max(F.col(year)).alias("_last"), F.grouping(journal).alias("_j"), F.grouping(country).alias("_c"), F.grouping(year).alias("_y")
    )
    level = F.when(F.col("_j") == 0, "journal").when(F.col("_c") == 0, "country").otherwise("all")
    period = F.when(F.col("_y") == 0, F.col("_first").cast("string")).otherwise(F.concat_ws("-", F.col("_first").cast("string"), F.col("_last").cast("string")))
    names = [c for c in found.columns if c.startswith(("num_", "fwci", "pct_", "avg_"))]
    return found.filter("num_documents > 0").select(level.alias("level"), F.when(F.col("_y") == 0, "annual").otherwise("period").alias("kind"), period.alias("period"), journal, country, *names)


def written(spark_table: DataFrame, root: str) -> None:
    """The levels as tables ``{root}/{level}_{kind}``, written in one pass by partition."""
    spark_table.withColumn("part", F.concat_ws("_", "level", "kind")).drop("level", "kind").write.mode("overwrite").partitionBy("part").parquet(root)

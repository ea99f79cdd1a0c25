"""Institutions: metrics, ranks and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import ratio


def metrics(works: DataFrame, members: DataFrame, sizes: DataFrame, names: DataFrame) -> DataFrame:
    """year, institution: documents, guarded means, and works with more than one country.

    ``sizes`` has the number of countries of each work.
    """
    rows = works.join(members, "id").join(sizes, "id")
    found = rows.groupBy("year", "inst").agg(
        F.count("*").cast("long").alias("doc_count"),
        ratio(F.sum("fwci"), F.count("*")).alias("fwci_avg"),
        ratio(F.count_if(F.col("percentile") >= 0.9), F.count("*"), 100).alias("pct_top_10"),
        F.count_if(F.col("n_countries") > 1).cast("long").alias("intl_collab"),
        F.count_if(F.col("oa") == "F").cast("long").alias("open_docs"),
    )
    return found.join(names, "inst", "left")


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; the rank limit is applied before rows are shuffled."""
    line = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(line).cast("long")).filter(F.col("rank") <= n)


def segments(base: DataFrame, country: str, top: int = 1000, of_country: int = 500, of_region: int = 100) -> DataFrame:
    """Global, one country's and every region's leaders, each row tagged with its segment."""
    order = [F.desc("doc_count"), F.col("inst"), F.col("year")]
    world = base.orderBy(*order).limit(top).withColumn("segment", F.lit("global"))
    home = base.filter(F.col("country") == country).orderBy(*order).limit(of_country).withColumn("segment", F.lit("country"))
    near = first_n(base, ["region"], order, of_region).drop("rank").withColumn("segment", F.lit("region"))
    return world.unionByName(home).unionByName(near).distinct()


def ranked(base: DataFrame, n: int | None = None) -> DataFrame:
    """Institutions over all years: documents and means weighted by them."""
    found = base.groupBy("inst", "inst_name", "country").agg(F.sum("doc_count").alias("docs"), ratio(F.sum(F.col("fwci_avg") * F.col("doc_count")), F.sum("doc_count")).alias("fwci_avg"), ratio(F.sum(F.col("pct_top_10") * F.col("doc_count")), F.sum("doc_count")).alias("pct_top_10"))
    return found.orderBy(F.desc("docs"), "inst").limit(n) if n else found


def aligned(base: DataFrame, n: int = 15) -> DataFrame:
    """Institutions with most works of a kind (open ones here), their share, and a label."""
    found = base.groupBy("inst", "inst_name", "country").agg(F.sum("open_docs").alias("aligned"), F.sum("doc_count").alias("docs")).filter("aligned > 0")
    label = F.concat("inst_name", F.lit(" ("), F.col("country"), F.lit(")"))
    return found.select("inst", label.alias("label"), "aligned", ratio(F.col("aligned"), F.col("docs"), 100).alias("pct")).orderBy(F.desc("aligned"), "inst").limit(n)

"""The logical view of scholarly works over the order tables.

Orders stand for works, line items for references, suppliers for institutions,
nations for countries, regions for world blocs, customers for sources.  Impact
is normalised by year and topic, the percentile by the year's largest value, so
both come from small groups that join back by broadcast where AQE sees fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import row_count, table
from ..sources.work import dealt

ROUTES = ("F", "O", "P")
LANGUAGES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
ALL_MEASURES = ["doc_count", "fwci_sum", "percentile_sum", "top_10_sum", "top_1_sum", *[f"oa_{r.lower()}" for r in ROUTES], *[f"lang_{x.lower()}" for x in LANGUAGES]]


def works(spark: SparkSession, d: str) -> DataFrame:
    """id, year, topic, price, oa, lang, source_id, fwci, percentile"""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("topic"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("oa"), F.col("o_custkey").alias("source_id"))
    lang = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("lang"))
    base = orders.join(lang, "source_id")
    means = base.groupBy("year", "topic").agg(F.avg("price").alias("mean"), F.max("price").alias("most"))
    tops = means.groupBy("year").agg(F.max("most").alias("top"))
    return base.join(means.drop("most"), ["year", "topic"]).join(tops, "year").select("id", "year", "topic", "price", "oa", "lang", "source_id", (F.col("price") / F.col("mean")).alias("fwci"), (F.col("price") / F.col("top")).alias("percentile"))


def bare_works(spark: SparkSession, d: str) -> DataFrame:
    """id, year, topic, source_id of the same works: without measures nothing is averaged. Dealt by id as ``_lines`` are."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("topic"), F.col("o_custkey").alias("source_id"))
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"))
    return dealt(orders.join(known, "source_id"), row_count(spark, f"{d}/lineitem.parquet"), "id")


def _lines(spark: SparkSession, d: str, *columns: Column, by: str = "id") -> DataFrame:
    """Columns of the line items, whose tasks are bounded in rows; dealt by id, what goes by work needs no other shuffle."""
    return dealt(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), *columns), row_count(spark, f"{d}/lineitem.parquet"), by)


def places(spark: SparkSession, d: str) -> DataFrame:
    """supplier, country key, country, region"""
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("inst"), F.col("s_name").alias("inst_name"), F.col("s_nationkey").alias("n_nationkey"))
    nation = table(spark, d, "nation")
    region = table(spark, d, "region")
    return supplier.join(nation, "n_nationkey").join(region, nation["n_regionkey"] == region["r_regionkey"]).select("inst", "inst_name", F.col("n_nationkey").alias("country_id"), F.col("n_name").alias("country"), F.col("r_name").alias("region"))


def work_institutions(spark: SparkSession, d: str) -> DataFrame:
    """id, inst: distinct"""
    return _lines(spark, d, F.col("l_suppkey").alias("inst")).distinct()


def work_countries(spark: SparkSession, d: str) -> DataFrame:
    """id, country_id, country, region: distinct"""
    lines = _lines(spark, d, F.col("l_suppkey").alias("inst"), by="inst").join(places(spark, d), "inst").select("id", "country_id", "country", "region")
    return dealt(lines, row_count(spark, f"{d}/lineitem.parquet"), "id").distinct()


def work_references(spark: SparkSession, d: str) -> DataFrame:
    """id, ref: distinct"""
    return _lines(spark, d, F.col("l_partkey").alias("ref")).distinct()


#: The same views in SQL.
SQL = """
w0 AS (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INT) AS year, o_orderpriority AS topic, o_totalprice AS price, o_orderstatus AS oa,
              c_mktsegment AS lang, o_custkey AS source_id FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT *, price / avg(price) OVER (PARTITION BY year, topic) AS fwci, price / max(price) OVER (PARTITION BY year) AS percentile FROM w0),
pl AS (SELECT s_suppkey AS inst, s_name AS inst_name, n_nationkey AS country_id, n_name AS country, r_name AS region
       FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
wi AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS inst FROM lineitem),
wc AS (SELECT DISTINCT l_orderkey AS id, country_id, country, region FROM lineitem JOIN pl ON l_suppkey = inst),
wr AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS ref FROM lineitem)
"""


def sql_measures() -> str:
    return ", ".join(
        [
            "count(*) AS doc_count", "sum(fwci) AS fwci_sum", "sum(percentile) AS percentile_sum",
            "count(*) FILTER (percentile >= 0.9) AS top_10_sum", "count(*) FILTER (percentile >= 0.99) AS top_1_sum",
            *[f"count(*) FILTER (oa = '{r}') AS oa_{r.lower()}" for r in ROUTES],
            *[f"count(*) FILTER (lang = '{x}') AS lang_{x.lower()}" for x in LANGUAGES],
        ]
    )


def sql_ratio(a: str, b: str = "doc_count", scale: int = 1) -> str:
    return f"round(coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0) * {scale}, 0), 6)"


def sql_ratios() -> str:
    return ", ".join(
        [
            "CAST(doc_count AS BIGINT) AS doc_count", f"{sql_ratio('fwci_sum')} AS fwci_avg", f"{sql_ratio('percentile_sum', scale=100)} AS percentile_avg",
            f"{sql_ratio('top_10_sum', scale=100)} AS pct_top_10", f"{sql_ratio('top_1_sum', scale=100)} AS pct_top_1",
            *[f"{sql_ratio(f'oa_{r.lower()}', scale=100)} AS pct_oa_{r.lower()}" for r in ROUTES],
            *[f"{sql_ratio(f'lang_{x.lower()}', scale=100)} AS pct_lang_{x.lower()}" for x in LANGUAGES],
        ]
    )

"""Queries over the entity cube and the journal metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import additive, ratio, weighted, with_ratios
from ..functions.dims import LANGUAGES as HARVESTED, ROUTES as HARVESTED_ROUTES
from ..operators import cube as C
from ..operators import periodic
from ..operators import reshape as R
from ..sources.readers import table
from .works import ALL_MEASURES, LANGUAGES, ROUTES, SQL, sql_measures, sql_ratio, sql_ratios, work_countries, works

_MEANS = ["fwci_avg", "percentile_avg", "pct_top_10", "pct_top_1", "pct_oa_f"]


def _ratios(df: DataFrame, keys: list[str]) -> DataFrame:
    return with_ratios(df, ROUTES, LANGUAGES, keys)


def _by(df: DataFrame, keys: list[str]) -> DataFrame:
    return _ratios(C.by(df, keys, ROUTES, LANGUAGES), keys)


def _cube(spark: SparkSession, d: str) -> DataFrame:
    return C.cube(works(spark, d), work_countries(spark, d), ROUTES, LANGUAGES, ALL_MEASURES)


def _shared(spark: SparkSession, d: str) -> DataFrame:
    base = C.with_share(_cube(spark, d))
    return _ratios(base, ["entity_type", "entity_name", "year", "topic", "world_doc_count", "share"])


_CUBE_SQL = f"""WITH {SQL},
members AS (SELECT id, 'Mundo' AS entity_type, 'Mundo' AS entity_name FROM w
            UNION ALL SELECT DISTINCT id, 'Region', region FROM wc UNION ALL SELECT DISTINCT id, 'Country', country FROM wc),
c0 AS (SELECT entity_type, entity_name, year, topic, {sql_measures()} FROM w JOIN members USING (id) GROUP BY ALL),
c1 AS (SELECT *, sum(doc_count) FILTER (entity_type = 'Mundo') OVER (PARTITION BY year, topic) AS world FROM c0),
c AS (SELECT entity_type, entity_name, year, topic, CAST(world AS BIGINT) AS world_doc_count, {sql_ratio("doc_count", "world", 100)} AS share, {sql_ratios()} FROM c1)
"""


def _weighted_sql(m: str) -> str:
    return f"{sql_ratio(f'sum({m} * doc_count)', 'sum(doc_count)')} AS {m}"


def world_year_topic(spark, d):
    return _by(works(spark, d), ["year", "topic"])


def country_year_topic(spark, d):
    return _by(C.full_count(works(spark, d), work_countries(spark, d).select("id", "country").distinct()), ["country", "year", "topic"])


def region_year_topic(spark, d):
    return _by(C.full_count(works(spark, d), work_countries(spark, d).select("id", "region").distinct()), ["region", "year", "topic"])


_ORDER = ["AMERICA", "EUROPE", "ASIA", "AFRICA", "MIDDLE EAST"]


def first_region_year_topic(spark, d):
    return _by(C.full_count(works(spark, d), C.first_region(work_countries(spark, d), _ORDER)), ["region", "year", "topic"])


def entity_cube(spark, d):
    return _shared(spark, d)


def entity_grouping_sets(spark, d):
    found = C.grouping_sets(works(spark, d), additive(ROUTES, LANGUAGES), [["topic", "year"], ["year"], ["topic"], []])
    return _ratios(found, ["topic", "year", "grouping_id"])


def entity_kpis(spark, d):
    return C.kpis(C.in_period(_shared(spark, d), 1996, 2000), _MEANS)


def entity_trends(spark, d):
    return C.trends(_shared(spark, d), _MEANS)


def cagr(spark, d):
    return C.cagr(_cube(spark, d), 1995, 2000)


def quadrants(spark, d):
    return C.quadrants(_shared(spark, d).filter("entity_type = 'Region'"))


def summary_countries(spark, d):
    cells = C.in_period(_cube(spark, d).filter("entity_type = 'Country'"), 1997)
    return _ratios(C.reaggregate(cells, ["entity_name"], ALL_MEASURES), ["entity_name"])


def summary_themes(spark, d):
    cells = _cube(spark, d).filter("entity_type = 'Mundo'")
    return _ratios(C.reaggregate(cells, ["topic"], ALL_MEASURES), ["topic"])


_THEMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def topic_pivot(spark, d):
    return R.pivoted(_cube(spark, d).filter("year >= 1998"), "entity_name", "topic", _THEMES, "doc_count")


def annual_pivot(spark, d):
    years = [str(y) for y in range(1995, 2002)]
    rows = _cube(spark, d).select("entity_name", F.col("year").cast("string").alias("year"), "doc_count")
    return R.pivoted(rows, "entity_name", "year", years, "doc_count")


def oa_unpivot(spark, d):
    routes = [f"oa_{r.lower()}" for r in ROUTES]
    yearly = _cube(spark, d).filter("entity_type = 'Region'").groupBy("entity_name", "year").agg(F.sum("doc_count").alias("docs"), *[F.sum(r).alias(r) for r in routes])
    shares = yearly.select("entity_name", "year", *[R.percent_of(r, F.col("docs")).alias(r) for r in routes])
    return R.unpivoted(shares, ["entity_name", "year"], routes, "route", "share")


def sunburst_rows(spark, d):
    return C.sunburst(_shared(spark, d).filter("entity_type = 'Mundo'"))


def hierarchy_distinct(spark, d):
    return C.hierarchy(table(spark, d, "part"), ["p_brand", "p_type"])


def topic_evolution(spark, d):
    """The three largest themes, year by year."""
    cells = _cube(spark, d).filter("entity_type = 'Mundo'")
    top = cells.groupBy("topic").agg(F.sum("doc_count").alias("n")).orderBy(F.desc("n"), "topic").limit(3)
    return cells.join(top, "topic", "left_semi").groupBy("topic", "year").agg(F.sum("doc_count").alias("docs"))


# ---- metrics of journals, countries and the whole, as one family of grouping sets ----------


def annual_metrics(spark, d):
    return _by(works(spark, d), ["year"])


def period_metrics(spark, d):
    span = works(spark, d).agg(*additive(ROUTES, LANGUAGES), F.concat(F.min("year").cast("string"), F.lit("-"), F.max("year").cast("string")).alias("period"))
    return _ratios(span, ["period"])


def journal_metrics(spark, d):
    found = C.grouping_sets(works(spark, d), additive(ROUTES, LANGUAGES), [["source_id", "year"], ["source_id"]])
    return _ratios(found, ["source_id", "year", "grouping_id"])


def _source_country(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_nationkey").alias("home"), (F.col("c_acctbal") > 0).alias("indexed"))


def country_metrics(spark, d):
    sources = _source_country(spark, d)
    found = C.grouping_sets(works(spark, d).join(sources.select("source_id", "home"), "source_id"), additive(ROUTES, LANGUAGES), [["home", "year"], ["home"]])
    indexed = sources.groupBy("home").agg(ratio(F.count_if("indexed"), F.count("*"), 100).alias("pct_indexed"))
    return _ratios(found.join(indexed, "home"), ["home", "year", "grouping_id", "pct_indexed"])


def journal_kpis(spark, d):
    c = table(spark, d, "customer")
    return c.agg(
        F.count("*").cast("long").alias("journals"),
        F.round(F.sum("c_acctbal"), 2).alias("works"),
        F.round(F.avg("c_acctbal"), 6).alias("mean_works"),
        ratio(F.count_if(F.col("c_acctbal") > 0), F.count("*"), 100).alias("pct_open"),
        F.count_distinct("c_nationkey").cast("long").alias("countries"),
    )


def country_stats(spark, d):
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").cast("long").alias("journals"), F.round(F.avg("c_acctbal"), 6).alias("mean_works"), ratio(F.count_if(F.col("c_acctbal") > 0), F.count("*"), 100).alias("pct_open"))
    return rows.select(F.col("c_nationkey").cast("int").alias("country"), "journals", "mean_works", "pct_open")


def oa_vs_impact(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("journal"), F.round("c_acctbal", 2).alias("impact"), F.when(F.col("c_acctbal") > 0, "Open").otherwise("Closed").alias("access"))


def year_range(spark, d):
    from ..sources.readers import year_range as bounds

    return bounds(works(spark, d))


def regional_summary(spark, d):
    """Regions and the world over five years, with the regions' share."""
    cells = C.in_period(_shared(spark, d), 1996, 2000).filter("entity_type <> 'Country'")
    return cells.groupBy("entity_name").agg(F.sum("doc_count").alias("docs"), weighted("fwci_avg").alias("fwci_avg"), weighted("pct_top_10").alias("pct_top_10"), ratio(F.sum("doc_count"), F.sum("world_doc_count"), 100).alias("share"))


_OA = {"F": "gold", "O": "closed", "P": "green"}
_LANG = {"AUTOMOBILE": "en", "BUILDING": "fr", "MACHINERY": "es"}


def metric_levels(spark, d):
    """Journals, countries and all, by year and period, in the harvest's own columns."""
    pick = lambda pairs, c: F.element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), F.col(c))
    rows = works(spark, d).join(_source_country(spark, d).select("source_id", F.col("home").alias("country_code")), "source_id")
    rows = rows.select("year", F.col("source_id").alias("journal_id"), "country_code", "fwci", (F.col("percentile") * 100).alias("percentile"), pick(_OA, "oa").alias("oa_status"), pick(_LANG, "lang").alias("language"))
    return periodic.levels(rows)


QUERIES = {f.__name__: f for f in (
    world_year_topic, country_year_topic, region_year_topic, first_region_year_topic, entity_cube, entity_grouping_sets, entity_kpis, entity_trends, cagr, quadrants,
    summary_countries, summary_themes, topic_pivot, annual_pivot, oa_unpivot, sunburst_rows, hierarchy_distinct, topic_evolution, annual_metrics, period_metrics,
    journal_metrics, country_metrics, journal_kpis, country_stats, oa_vs_impact, year_range, regional_summary, metric_levels,
)}

_LIST = ", ".join(f"'{x}'" for x in _ORDER)


def _grouped(keys: str, source: str = "w", extra: str = "") -> str:
    return f"WITH {SQL}{extra}, g AS (SELECT {keys}, {sql_measures()} FROM {source} GROUP BY ALL) SELECT {keys}, {sql_ratios()} FROM g"




def _part(condition: str) -> str:
    return f"round(CAST(count(*) FILTER ({condition}) * 100 AS DOUBLE) / count(*), 2)"


_LEVELS = f"""WITH {SQL}, x AS (SELECT year, source_id AS journal_id, c_nationkey AS country_code, fwci, percentile * 100 AS percentile,
    CASE oa WHEN 'F' THEN 'gold' WHEN 'O' THEN 'closed' WHEN 'P' THEN 'green' END AS oa_status,
    coalesce(CASE lang WHEN 'AUTOMOBILE' THEN 'en' WHEN 'BUILDING' THEN 'fr' WHEN 'MACHINERY' THEN 'es' END, 'unknown') AS language
    FROM w JOIN customer ON c_custkey = source_id)
SELECT CASE WHEN grouping(journal_id) = 0 THEN 'journal' WHEN grouping(country_code) = 0 THEN 'country' ELSE 'all' END AS level,
    CASE WHEN grouping(year) = 0 THEN 'annual' ELSE 'period' END AS kind, CASE WHEN grouping(year) = 0 THEN CAST(min(year) AS VARCHAR) ELSE min(year) || '-' || max(year) END AS period,
    journal_id, country_code, count(*) AS num_documents, round(sum(fwci) / count(*), 2) AS fwci_avg, {_part("percentile >= 90")} AS pct_top_10, {_part("percentile >= 99")} AS pct_top_1,
    round(sum(percentile) / count(*), 2) AS avg_percentile, {", ".join(f"{_part(f'oa_status = {chr(39)}{r}{chr(39)}')} AS pct_oa_{r}" for r in HARVESTED_ROUTES)},
    {", ".join(f"{_part(f'language = {chr(39)}{x}{chr(39)}')} AS pct_lang_{x}" for x in HARVESTED)}, {_part("language NOT IN (" + ", ".join(f"'{x}'" for x in HARVESTED) + ")")} AS pct_lang_other
FROM x GROUP BY GROUPING SETS ((journal_id, year), (journal_id), (country_code, year), (country_code), (year), ())"""

ORACLES = {
    "world_year_topic": _grouped("year, topic"),
    "country_year_topic": _grouped("country, year, topic", "w JOIN (SELECT DISTINCT id, country FROM wc) USING (id)"),
    "region_year_topic": _grouped("region, year, topic", "w JOIN (SELECT DISTINCT id, region FROM wc) USING (id)"),
    "first_region_year_topic": _grouped("region, year, topic", "w JOIN fr USING (id)", f", fr AS (SELECT id, arg_min(region, list_position([{_LIST}], region)) AS region FROM wc GROUP BY id)"),
    "entity_cube": _CUBE_SQL + "SELECT * FROM c",
    "entity_grouping_sets": f"WITH {SQL}, g AS (SELECT topic, year, CAST(grouping(topic, year) AS BIGINT) AS grouping_id, {sql_measures()} FROM w GROUP BY GROUPING SETS ((topic, year), (year), (topic), ())) SELECT topic, year, grouping_id, {sql_ratios()} FROM g",
    "entity_kpis": _CUBE_SQL + f"SELECT entity_type, entity_name, CAST(sum(doc_count) AS BIGINT) AS docs, {', '.join(map(_weighted_sql, _MEANS))}, {sql_ratio('sum(doc_count)', 'sum(world_doc_count)', 100)} AS share FROM c WHERE year BETWEEN 1996 AND 2000 GROUP BY ALL",
    "entity_trends": _CUBE_SQL + f"SELECT entity_type, entity_name, year, CAST(sum(doc_count) AS BIGINT) AS docs, {', '.join(map(_weighted_sql, _MEANS))} FROM c GROUP BY ALL",
    "cagr": _CUBE_SQL + """, y AS (SELECT entity_type, entity_name, year, sum(doc_count) AS docs FROM c0 WHERE year BETWEEN 1995 AND 2000 GROUP BY ALL),
        e AS (SELECT entity_type, entity_name, CAST(arg_min(docs, year) AS BIGINT) AS first_docs, CAST(arg_max(docs, year) AS BIGINT) AS last_docs, CAST(max(year) - min(year) AS BIGINT) AS years FROM y GROUP BY ALL)
        SELECT *, CASE WHEN years > 0 THEN round((pow(last_docs / first_docs, 1.0 / years) - 1) * 100, 6) ELSE 0.0 END AS cagr FROM e""",
    "quadrants": _CUBE_SQL + f""", q AS (SELECT entity_name, CAST(sum(doc_count) AS BIGINT) AS docs, {sql_ratio('sum(fwci_avg * doc_count)', 'sum(doc_count)')} AS impact FROM c WHERE entity_type = 'Region' GROUP BY ALL),
        m AS (SELECT median(docs) AS median_docs FROM q)
        SELECT entity_name, docs, impact, median_docs, (CASE WHEN docs >= median_docs THEN 'large' ELSE 'small' END) || '-' || (CASE WHEN impact >= 1 THEN 'high' ELSE 'low' END) AS quadrant FROM q, m""",
    "summary_countries": _CUBE_SQL + f", s AS (SELECT entity_name, {', '.join(f'sum({m}) AS {m}' for m in ALL_MEASURES)} FROM c0 WHERE entity_type = 'Country' AND year >= 1997 GROUP BY ALL) SELECT entity_name, {sql_ratios()} FROM s",
    "summary_themes": _CUBE_SQL + f", s AS (SELECT topic, {', '.join(f'sum({m}) AS {m}' for m in ALL_MEASURES)} FROM c0 WHERE entity_type = 'Mundo' GROUP BY ALL) SELECT topic, {sql_ratios()} FROM s",
    "topic_pivot": _CUBE_SQL + "SELECT entity_name, " + ", ".join(f"CAST(coalesce(sum(doc_count) FILTER (topic = '{t}'), 0) AS BIGINT) AS \"{t}\"" for t in _THEMES) + " FROM c0 WHERE year >= 1998 GROUP BY entity_name",
    "annual_pivot": _CUBE_SQL + "SELECT entity_name, " + ", ".join(f"CAST(coalesce(sum(doc_count) FILTER (year = {y}), 0) AS BIGINT) AS \"{y}\"" for y in range(1995, 2002)) + " FROM c0 GROUP BY entity_name",
    "oa_unpivot": _CUBE_SQL + ", y AS (SELECT entity_name, year, sum(doc_count) AS docs, sum(oa_f) AS oa_f, sum(oa_o) AS oa_o, sum(oa_p) AS oa_p FROM c0 WHERE entity_type = 'Region' GROUP BY ALL) " + " UNION ALL ".join(f"SELECT entity_name, year, '{r}' AS route, {sql_ratio(r, 'docs', 100)} AS share FROM y" for r in ("oa_f", "oa_o", "oa_p")),
    "sunburst_rows": _CUBE_SQL + f"SELECT topic, CAST(sum(doc_count) AS BIGINT) AS docs, {_weighted_sql('fwci_avg')} FROM c WHERE entity_type = 'Mundo' GROUP BY topic ORDER BY docs DESC, topic LIMIT 35",
    "hierarchy_distinct": "SELECT DISTINCT p_brand, p_type FROM part WHERE p_brand <> '' AND p_type <> ''",
    "topic_evolution": _CUBE_SQL + ", t AS (SELECT topic FROM c0 WHERE entity_type = 'Mundo' GROUP BY topic ORDER BY sum(doc_count) DESC, topic LIMIT 3) SELECT topic, year, CAST(sum(doc_count) AS BIGINT) AS docs FROM c0 WHERE entity_type = 'Mundo' AND topic IN (SELECT topic FROM t) GROUP BY ALL",
    "annual_metrics": _grouped("year"),
    "period_metrics": f"WITH {SQL}, g AS (SELECT min(year) || '-' || max(year) AS period, {sql_measures()} FROM w) SELECT period, {sql_ratios()} FROM g",
    "journal_metrics": f"WITH {SQL}, g AS (SELECT source_id, year, CAST(grouping(source_id, year) AS BIGINT) AS grouping_id, {sql_measures()} FROM w GROUP BY GROUPING SETS ((source_id, year), (source_id))) SELECT source_id, year, grouping_id, {sql_ratios()} FROM g",
    "country_metrics": f"WITH {SQL}, s AS (SELECT c_custkey AS source_id, c_nationkey AS home, c_acctbal > 0 AS indexed FROM customer), i AS (SELECT home, {sql_ratio('count(*) FILTER (indexed)', 'count(*)', 100)} AS pct_indexed FROM s GROUP BY home), g AS (SELECT home, year, CAST(grouping(home, year) AS BIGINT) AS grouping_id, {sql_measures()} FROM w JOIN s USING (source_id) GROUP BY GROUPING SETS ((home, year), (home))) SELECT home, year, grouping_id, pct_indexed, {sql_ratios()} FROM g JOIN i USING (home)",
    "metric_levels": _LEVELS,
    "journal_kpis": f"SELECT count(*) AS journals, round(sum(c_acctbal), 2) AS works, round(avg(c_acctbal), 6) AS mean_works, {sql_ratio('count(*) FILTER (c_acctbal > 0)', 'count(*)', 100)} AS pct_open, count(DISTINCT c_nationkey) AS countries FROM customer",
    "country_stats": f"SELECT CAST(c_nationkey AS INT) AS country, count(*) AS journals, round(avg(c_acctbal), 6) AS mean_works, {sql_ratio('count(*) FILTER (c_acctbal > 0)', 'count(*)', 100)} AS pct_open FROM customer GROUP BY ALL",
    "oa_vs_impact": "SELECT c_custkey AS journal, round(c_acctbal, 2) AS impact, CASE WHEN c_acctbal > 0 THEN 'Open' ELSE 'Closed' END AS access FROM customer",
    "year_range": f"WITH {SQL} SELECT coalesce(min(year), 2000) AS year_min, coalesce(max(year), 2025) AS year_max FROM w",
    "regional_summary": _CUBE_SQL + f"SELECT entity_name, CAST(sum(doc_count) AS BIGINT) AS docs, {_weighted_sql('fwci_avg')}, {_weighted_sql('pct_top_10')}, {sql_ratio('sum(doc_count)', 'sum(world_doc_count)', 100)} AS share FROM c WHERE entity_type <> 'Country' AND year BETWEEN 1996 AND 2000 GROUP BY entity_name",
}

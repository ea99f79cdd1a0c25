"""What panels and reports are drawn from: cards, trends, details, rankings, counters, maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import ratio, weighted
from ..functions.text import doi_url
from ..operators import collaboration as N
from ..operators import community
from ..operators import cube as C
from ..operators import matching as M
from ..operators import reshape as R
from ..operators import search as S
from ..operators import tracking as K
from ..sources.readers import table
from .impact import _CUBE_SQL, _shared, _weighted_sql
from .works import SQL, sql_ratio, work_countries, works

ENTITY = "NATION_2"


def entity_card(spark, d):
    """One entity's figures for a period, beside the world's."""
    cells = C.in_period(_shared(spark, d), 1996, 1999).filter(F.col("entity_name").isin(C.WORLD, ENTITY))
    return C.kpis(cells, ["fwci_avg", "pct_top_10"]).select("entity_name", "docs", "fwci_avg", "pct_top_10", "share")


def metric_trend(spark, d):
    return C.trends(C.in_period(C.of_entity(_shared(spark, d), ENTITY), last=2000), ["fwci_avg", "pct_top_10"]).drop("entity_type")


def entity_detail(spark, d):
    """An entity's routes and languages as rows of name and share."""
    routes = ["pct_oa_f", "pct_oa_o", "pct_oa_p", "pct_lang_building"]
    one = C.of_entity(_shared(spark, d), ENTITY).agg(*[weighted(r).alias(r) for r in routes]).withColumn("entity", F.lit(ENTITY))
    return R.unpivoted(one, ["entity"], routes, "measure", "share").filter("share > 0")


def diagnosis(spark, d):
    """World and entity: documents, growth, impact, leaders, openness."""
    cells = _shared(spark, d).filter(F.col("entity_name").isin(C.WORLD, ENTITY))
    return C.kpis(cells, ["fwci_avg", "pct_top_10", "pct_oa_f"]).join(C.cagr(cells, 1995, 2000).select("entity_name", "cagr"), "entity_name").drop("entity_type")


def ordered_table(spark, d):
    """Entities in their customary order, with their place in it."""
    cells = _shared(spark, d).groupBy("entity_type", "entity_name").agg(F.sum("doc_count").alias("doc_count"))
    return C.ordered_entities(cells)


def cascade(spark, d):
    """Types below a chosen brand."""
    return C.below(table(spark, d, "part"), {"p_brand": "Brand#11"}, "p_type")


def partner_map(spark, d):
    """A country's partners, with their share of its collaborations."""
    found = N.partners(N.pairs(work_countries(spark, d), "id", "country")).filter(F.col("node") == ENTITY)
    total = found.agg(F.sum("n").alias("total"))
    return found.crossJoin(F.broadcast(total)).select("partner", "n", ratio(F.col("n"), F.col("total"), 100).alias("pct"))


def network_communities(spark, d):
    """Communities of the hundred strongest collaborations."""
    edges = N.top_pairs(N.pairs(work_countries(spark, d), "id", "country"), 100).select(F.lit(0).alias("net"), "a", "b", F.col("n").cast("double").alias("weight"))
    nodes = edges.select("net", F.explode(F.array("a", "b")).alias("id")).distinct()
    return community.detect(nodes, edges, "net")


def front_counters(spark, d):
    rows = table(spark, d, "events").select(F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("bin_id"), F.col("event_type").alias("cluster"), "user_id")
    return rows.agg(F.count_distinct("bin_id").cast("long").alias("bins"), F.count_distinct("cluster").cast("long").alias("clusters"), F.count_distinct("user_id").cast("long").alias("members"), F.max("bin_id").cast("long").alias("last_bin"))


def yearly_share(spark, d):
    """Regions' shares of the year's works."""
    cells = _shared(spark, d)
    world = cells.filter("entity_type = 'Mundo'").groupBy("year").agg(F.sum("doc_count").alias("total"))
    rows = cells.filter("entity_type = 'Region'").groupBy("entity_name", "year").agg(F.sum("doc_count").alias("docs"))
    return rows.join(world, "year", "left").select("entity_name", "year", "docs", ratio(F.col("docs"), F.col("total"), 100).alias("share"))


def _search(spark, d):
    found = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 9 > 0, doi_url(F.concat(F.lit("10.1/"), F.col("user_id").cast("string")))).alias("doi"))
    corpus = table(spark, d, "customer").select(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("abstract"), doi_url(F.concat(F.lit(" 10.1/"), (F.col("c_custkey") * 2).cast("string"))).alias("doi"))
    return M.match_corpus(found, corpus, "doi", [S.Exclusion(["build*"])])


def match_kept(spark, d):
    return _search(spark, d)["matched"].select("doi", "title")


def match_residue(spark, d):
    return _search(spark, d)["residue"].select("event_id", "doi")


def match_report(spark, d):
    return _search(spark, d)["coverage"]


def cluster_sizes_kept(spark, d):
    """Clusters of at least five members."""
    rows = works(spark, d).select(F.col("source_id").alias("cluster"), F.col("year").alias("bin_id"))
    return K.sizes(rows).filter("size >= 5")


QUERIES = {f.__name__: f for f in (
    entity_card, metric_trend, entity_detail, diagnosis, ordered_table, cascade, partner_map, network_communities, front_counters, yearly_share, match_kept, match_residue, match_report, cluster_sizes_kept,
)}

_PAIR = f"WITH {SQL}, p AS (SELECT x.country AS a, y.country AS b, count(*) AS n FROM wc x JOIN wc y ON x.id = y.id AND x.country < y.country GROUP BY ALL), u AS (SELECT b AS partner, n FROM p WHERE a = '{ENTITY}' UNION ALL SELECT a, n FROM p WHERE b = '{ENTITY}')"
_MATCH = """WITH f AS (SELECT event_id, CASE WHEN user_id % 9 > 0 THEN 'https://doi.org/10.1/' || user_id END AS doi FROM events),
k AS (SELECT 'https://doi.org/10.1/' || (c_custkey * 2) AS doi, c_name AS title, c_mktsegment AS abstract FROM customer)"""

ORACLES = {
    "entity_card": _CUBE_SQL + f"SELECT entity_name, CAST(sum(doc_count) AS BIGINT) AS docs, {_weighted_sql('fwci_avg')}, {_weighted_sql('pct_top_10')}, {sql_ratio('sum(doc_count)', 'sum(world_doc_count)', 100)} AS share FROM c WHERE year BETWEEN 1996 AND 1999 AND entity_name IN ('Mundo', '{ENTITY}') GROUP BY entity_name",
    "metric_trend": _CUBE_SQL + f"SELECT entity_name, year, CAST(sum(doc_count) AS BIGINT) AS docs, {_weighted_sql('fwci_avg')}, {_weighted_sql('pct_top_10')} FROM c WHERE year <= 2000 AND entity_name = '{ENTITY}' GROUP BY ALL",
    "entity_detail": _CUBE_SQL + ", x AS (" + " UNION ALL ".join(f"SELECT '{ENTITY}' AS entity, '{m}' AS measure, {sql_ratio(f'sum({m} * doc_count)', 'sum(doc_count)')} AS share FROM c WHERE entity_name = '{ENTITY}'" for m in ("pct_oa_f", "pct_oa_o", "pct_oa_p", "pct_lang_building")) + ") SELECT * FROM x WHERE share > 0",
    "diagnosis": _CUBE_SQL + f""", k AS (SELECT entity_name, CAST(sum(doc_count) AS BIGINT) AS docs, {_weighted_sql('fwci_avg')}, {_weighted_sql('pct_top_10')}, {_weighted_sql('pct_oa_f')}, {sql_ratio('sum(doc_count)', 'sum(world_doc_count)', 100)} AS share FROM c WHERE entity_name IN ('Mundo', '{ENTITY}') GROUP BY entity_name),
        y AS (SELECT entity_name, year, sum(doc_count) AS docs FROM c0 WHERE year BETWEEN 1995 AND 2000 GROUP BY ALL), g AS (SELECT entity_name, arg_min(docs, year) AS a, arg_max(docs, year) AS z, max(year) - min(year) AS n FROM y GROUP BY ALL)
        SELECT k.*, CASE WHEN n > 0 THEN round((pow(z / a, 1.0 / n) - 1) * 100, 6) ELSE 0.0 END AS cagr FROM k JOIN g USING (entity_name)""",
    "ordered_table": _CUBE_SQL + "SELECT entity_type, entity_name, CAST(sum(doc_count) AS BIGINT) AS doc_count FROM c0 GROUP BY ALL",
    "cascade": "SELECT DISTINCT p_type FROM part WHERE p_brand = 'Brand#11'",
    "partner_map": _PAIR + f", s AS (SELECT partner, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY ALL) SELECT partner, n, {sql_ratio('n', '(SELECT sum(n) FROM s)', 100)} AS pct FROM s",
    "front_counters": "SELECT count(DISTINCT floor((day(ts) - 1) / 7)) AS bins, count(DISTINCT event_type) AS clusters, count(DISTINCT user_id) AS members, CAST(max(floor((day(ts) - 1) / 7)) AS BIGINT) AS last_bin FROM events",
    "yearly_share": _CUBE_SQL + f", t AS (SELECT year, sum(doc_count) AS total FROM c0 WHERE entity_type = 'Mundo' GROUP BY year), r AS (SELECT entity_name, year, CAST(sum(doc_count) AS BIGINT) AS docs FROM c0 WHERE entity_type = 'Region' GROUP BY ALL) SELECT entity_name, year, docs, {sql_ratio('docs', 'total', 100)} AS share FROM r LEFT JOIN t USING (year)",
    "match_kept": _MATCH + " SELECT doi, title FROM k WHERE doi IN (SELECT doi FROM f) AND NOT regexp_matches(lower(title || ' ' || abstract), '(^|[^\\p{L}\\p{N}_])build')",
    "match_residue": _MATCH + " SELECT event_id, doi FROM f WHERE doi IS NULL OR doi NOT IN (SELECT doi FROM k)",
    "match_report": _MATCH + f", a AS (SELECT count(*) AS total, count(*) - count(doi) AS without_key, count(doi) AS with_key, count(*) FILTER (doi IN (SELECT doi FROM k)) AS matched FROM f) SELECT *, with_key - matched AS unmatched, {sql_ratio('matched', 'greatest(with_key, 1)', 100)} AS coverage_pct FROM a",
    "cluster_sizes_kept": f"WITH {SQL} SELECT year AS bin_id, source_id AS cluster, count(*) AS size FROM w GROUP BY ALL HAVING count(*) >= 5",
}

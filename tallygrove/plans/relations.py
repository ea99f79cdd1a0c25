"""Queries over sources, institutions, collaboration, types, and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import ratio
from ..operators import collaboration as N
from ..operators import dedup as D
from ..operators import institutions as I
from ..operators import matching as M
from ..operators import reshape as R
from ..operators import sketches as H
from ..sources.readers import table
from .works import SQL, bare_works, places, sql_ratio, work_countries, work_institutions, work_references, works


def top_journals(spark, d):
    """The hundred sources with most works since 1998, with their latest names."""
    names = table(spark, d, "customer").groupBy(F.col("c_custkey").alias("source_id")).agg(F.max_by("c_name", F.struct("c_acctbal", "c_name")).alias("name"))
    counts = works(spark, d).filter("year >= 1998").groupBy("source_id").agg(F.count("*").cast("long").alias("articles"))
    return counts.orderBy(F.desc("articles"), "source_id").limit(100).join(names, "source_id", "left")


def _pairs(spark, d):
    return N.pairs(work_countries(spark, d), "id", "country")


def collaboration_pairs(spark, d):
    return N.top_pairs(_pairs(spark, d))


def collaboration_by_year(spark, d):
    rows = work_countries(spark, d).join(works(spark, d).select("id", "year"), "id")
    return N.pairs(rows, "id", "region", ["year"])


def partner_totals(spark, d):
    return N.partners(_pairs(spark, d))


def node_strength(spark, d):
    return N.drawn(N.strength(_pairs(spark, d)))


def node_degree(spark, d):
    return N.strength(_pairs(spark, d))


def _institutions(spark, d):
    sizes = work_countries(spark, d).groupBy("id").agg(F.count_distinct("country").alias("n_countries"))
    return I.metrics(works(spark, d), work_institutions(spark, d), sizes, places(spark, d).select("inst", "inst_name", "country", "region"))


def institution_metrics(spark, d):
    return _institutions(spark, d)


def institution_segments(spark, d):
    return I.segments(_institutions(spark, d), "NATION_2")


def institution_rank(spark, d):
    return I.ranked(_institutions(spark, d), 30)


def regional_top_k(spark, d):
    found = I.ranked(_institutions(spark, d)).join(places(spark, d).select("inst", "region"), "inst")
    return I.first_n(found, ["region"], [F.desc("docs"), F.col("inst")], 5).select("region", "inst", "docs", "rank")


def regional_mean(spark, d):
    """Unweighted means of institutions' ratios by region."""
    return _institutions(spark, d).groupBy("region").agg(F.round(F.avg("fwci_avg"), 6).alias("fwci_avg"), F.round(F.avg("pct_top_10"), 6).alias("pct_top_10"), F.count("*").cast("long").alias("n"))


def sdg_share(spark, d):
    return I.aligned(_institutions(spark, d))


def _typed(spark, d):
    """id, kind: the distinct kinds of line items of a work"""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("kind")).distinct()


def doc_type_dist(spark, d):
    """By year, country and type; '' stands for all countries."""
    lists = work_countries(spark, d).groupBy("id").agg(F.collect_set("country").alias("c"))
    rows = works(spark, d).select("id", "year").join(_typed(spark, d), "id").join(lists, "id", "left")
    member = F.explode(F.concat(F.array(F.lit("")), F.coalesce("c", F.array().cast("array<string>"))))
    return rows.select("year", "kind", member.alias("country")).groupBy("year", "country", "kind").agg(F.count("*").cast("long").alias("n"))


def sector_dist(spark, d):
    """By year, region ('' for all) and brand sector: distinct sectors of a work times its distinct regions."""
    sectors = work_references(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("ref"), F.col("p_type").alias("sector")), "ref").groupBy("id").agg(F.collect_set("sector").alias("s"))
    regions = work_countries(spark, d).groupBy("id").agg(F.collect_set("region").alias("r"))
    rows = works(spark, d).select("id", "year").join(sectors, "id").join(regions, "id", "left")
    rows = rows.select("year", F.explode("s").alias("sector"), F.concat(F.array(F.lit("")), F.coalesce("r", F.array().cast("array<string>"))).alias("r"))
    return rows.select("year", "sector", F.explode("r").alias("region")).groupBy("year", "region", "sector").agg(F.count("*").cast("long").alias("n"))


def type_distribution(spark, d):
    """Types over all countries: the consolidated rows where there are any."""
    return D.prefer_consolidated(doc_type_dist(spark, d), [], "country").groupBy("kind").agg(F.sum("n").alias("n"))


def type_densified(spark, d):
    rows = works(spark, d).select("id", "year").join(_typed(spark, d), "id")
    return R.densified(rows.groupBy("year", "kind").agg(F.count("*").cast("long").alias("n")), "year", "kind", "n")


def dedup_latest(spark, d):
    return D.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])


def dedup_first(spark, d):
    return D.first(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_partkey"], ["l_linenumber", "l_quantity"])


def semi_ids(spark, d):
    wanted = table(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("source_id"))
    return M.in_list(works(spark, d), "source_id", wanted).select("id", "source_id", "year")


def anti_missing(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    return M.missing(works(spark, d).select("id", "year"), "id", lines)


def coverage_report(spark, d):
    keys = table(spark, d, "events").select(F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("k"))
    return M.coverage(keys, "k", table(spark, d, "customer").select(F.col("c_custkey").alias("k")))


def approx_distinct(spark, d):
    return work_countries(spark, d).groupBy("country").agg(F.approx_count_distinct("id").alias("works"))


def exact_distinct(spark, d):
    return work_countries(spark, d).groupBy("country").agg(F.count_distinct("id").cast("long").alias("works"))


def _arrays(spark, d):
    return work_countries(spark, d).groupBy("id").agg(F.collect_set("country").alias("c"))


_LEVELS = [["country", "year", "topic"], ["country", "year"], ["country"], ["year", "topic"], ["topic"], []]


def sketch_levels(spark, d):
    """Distinct works of every level from one table of cells, beside exact counts: whether each is within 5 percent."""
    rows = work_countries(spark, d).select("id", "country").join(bare_works(spark, d).select("id", "year", "topic"), "id")
    keys = ["country", "year", "topic"]
    found = H.levels(H.sketched(rows, keys, "id"), _LEVELS)
    # a work's rows are in one task, so it is made distinct in each level there
    level = lambda s: F.struct(*[(F.col(c) if c in s else F.lit(None)).alias(c) for c in keys], F.lit(sum((c not in s) << i for i, c in enumerate(reversed(keys)))).cast("long").alias("grouping_id"))
    each = rows.select("id", F.explode(F.array(*[level(s) for s in _LEVELS])).alias("level")).select("id", "level.*").distinct()
    exact = each.groupBy(*keys, "grouping_id").agg(F.count("id").alias("works"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*keys, "grouping_id")]
    near = F.abs(F.col("estimate") - F.col("works")) <= 0.05 * F.col("works")
    return found.alias("x").join(exact.alias("y"), same).select(*[f"y.{c}" for c in keys], F.col("y.grouping_id").cast("long").alias("grouping_id"), F.col("works").cast("long").alias("works"), near.alias("near"))


def array_has(spark, d):
    return _arrays(spark, d).filter(F.array_contains("c", "NATION_6")).select("id")


def array_overlap(spark, d):
    return _arrays(spark, d).filter(F.arrays_overlap("c", F.array(F.lit("NATION_6"), F.lit("NATION_17")))).select("id", F.size("c").cast("long").alias("n_countries"))


def international(spark, d):
    """Works of more than one country, by year."""
    rows = works(spark, d).select("id", "year").join(_arrays(spark, d), "id")
    return rows.groupBy("year").agg(F.count_if(F.size("c") > 1).cast("long").alias("intl"), F.count("*").cast("long").alias("docs"), ratio(F.count_if(F.size("c") > 1), F.count("*"), 100).alias("pct"))


def country_filter_period(spark, d):
    """The export's selection: one country's works in a period, latest version of each."""
    rows = works(spark, d).filter(F.col("year").between(1997, 1998)).join(_arrays(spark, d).filter(F.array_contains("c", "NATION_2")), "id")
    return D.latest(rows.select("id", "year", F.round("price", 2).alias("price")), ["id"], ["year"])


def union_missing_columns(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    b = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.lit("region").alias("kind"))
    return D.union_by_name(a, b)


def status_counts(spark, d):
    return works(spark, d).groupBy("oa", "lang").agg(F.count("*").cast("long").alias("n"))


QUERIES = {f.__name__: f for f in (
    top_journals, collaboration_pairs, collaboration_by_year, partner_totals, node_strength, node_degree, institution_metrics, institution_segments, institution_rank, regional_top_k,
    regional_mean, sdg_share, doc_type_dist, sector_dist, type_distribution, type_densified, dedup_latest, dedup_first, semi_ids, anti_missing, coverage_report, approx_distinct,
    exact_distinct, sketch_levels, array_has, array_overlap, international, country_filter_period, union_missing_columns, status_counts,
)}

_PAIRS = f"WITH {SQL}, p AS (SELECT x.country AS a, y.country AS b, count(*) AS n FROM wc x JOIN wc y ON x.id = y.id AND x.country < y.country GROUP BY ALL)"
_INST = f"""WITH {SQL}, z AS (SELECT id, count(DISTINCT country) AS n_countries FROM wc GROUP BY id),
i AS (SELECT year, inst, count(*) AS doc_count, {sql_ratio('sum(fwci)', 'count(*)')} AS fwci_avg, {sql_ratio('count(*) FILTER (percentile >= 0.9)', 'count(*)', 100)} AS pct_top_10,
             count(*) FILTER (n_countries > 1) AS intl_collab, count(*) FILTER (oa = 'F') AS open_docs FROM w JOIN wi USING (id) JOIN z USING (id) GROUP BY ALL),
ii AS (SELECT i.*, inst_name, country, region FROM i LEFT JOIN pl USING (inst)),
rk AS (SELECT inst, inst_name, country, CAST(sum(doc_count) AS BIGINT) AS docs, {sql_ratio('sum(fwci_avg * doc_count)', 'sum(doc_count)')} AS fwci_avg, {sql_ratio('sum(pct_top_10 * doc_count)', 'sum(doc_count)')} AS pct_top_10 FROM ii GROUP BY ALL)
"""
_BACK = ", u AS (SELECT a AS node, b AS partner, n FROM p UNION ALL SELECT b, a, n FROM p)"
_TYPED = f"WITH {SQL}, t AS (SELECT DISTINCT l_orderkey AS id, l_returnflag AS kind FROM lineitem)"

ORACLES = {
    "top_journals": f"WITH {SQL}, c AS (SELECT source_id, count(*) AS articles FROM w WHERE year >= 1998 GROUP BY ALL ORDER BY articles DESC, source_id LIMIT 100) SELECT source_id, articles, c_name AS name FROM c LEFT JOIN customer ON c_custkey = source_id",
    "collaboration_pairs": _PAIRS + " SELECT * FROM p ORDER BY n DESC, a, b LIMIT 1000",
    "collaboration_by_year": f"WITH {SQL}, r AS (SELECT DISTINCT id, region FROM wc) SELECT year, x.region AS a, y.region AS b, count(*) AS n FROM r x JOIN r y ON x.id = y.id AND x.region < y.region JOIN w ON w.id = x.id GROUP BY ALL",
    "partner_totals": _PAIRS + _BACK + " SELECT node, partner, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY ALL",
    "node_strength": _PAIRS + _BACK + ", s AS (SELECT node, CAST(sum(n) AS BIGINT) AS strength FROM u GROUP BY ALL) SELECT node, strength, round(10 + 40 * sqrt(strength / max(strength) OVER ()), 6) AS size FROM s",
    "node_degree": _PAIRS + _BACK + " SELECT node, CAST(sum(n) AS BIGINT) AS strength, count(*) AS degree FROM u GROUP BY ALL",
    "institution_metrics": _INST + "SELECT * FROM ii",
    "institution_segments": _INST + """SELECT DISTINCT * FROM (
        SELECT * FROM (SELECT *, 'global' AS segment FROM ii ORDER BY doc_count DESC, inst, year LIMIT 1000)
        UNION ALL SELECT * FROM (SELECT *, 'country' AS segment FROM ii WHERE country = 'NATION_2' ORDER BY doc_count DESC, inst, year LIMIT 500)
        UNION ALL SELECT *, 'region' AS segment FROM ii QUALIFY row_number() OVER (PARTITION BY region ORDER BY doc_count DESC, inst, year) <= 100)""",
    "institution_rank": _INST + "SELECT * FROM rk ORDER BY docs DESC, inst LIMIT 30",
    "regional_top_k": _INST + "SELECT region, inst, docs, row_number() OVER (PARTITION BY region ORDER BY docs DESC, inst) AS rank FROM rk JOIN (SELECT inst, region FROM pl) USING (inst) QUALIFY rank <= 5",
    "regional_mean": _INST + "SELECT region, round(avg(fwci_avg), 6) AS fwci_avg, round(avg(pct_top_10), 6) AS pct_top_10, count(*) AS n FROM ii GROUP BY ALL",
    "sdg_share": _INST + f", s AS (SELECT inst, inst_name, country, CAST(sum(open_docs) AS BIGINT) AS aligned, sum(doc_count) AS docs FROM ii GROUP BY ALL HAVING sum(open_docs) > 0) SELECT inst, inst_name || ' (' || country || ')' AS label, aligned, {sql_ratio('aligned', 'docs', 100)} AS pct FROM s ORDER BY aligned DESC, inst LIMIT 15",
    "doc_type_dist": _TYPED + ", m AS (SELECT id, '' AS country FROM w UNION ALL SELECT DISTINCT id, country FROM wc) SELECT year, country, kind, count(*) AS n FROM w JOIN t USING (id) JOIN m USING (id) GROUP BY ALL",
    "sector_dist": f"WITH {SQL}, s AS (SELECT DISTINCT id, p_type AS sector FROM wr JOIN part ON p_partkey = ref), m AS (SELECT id, '' AS region FROM w UNION ALL SELECT DISTINCT id, region FROM wc) SELECT year, region, sector, count(*) AS n FROM w JOIN s USING (id) JOIN m USING (id) GROUP BY ALL",
    "type_distribution": _TYPED + " SELECT kind, count(*) AS n FROM w JOIN t USING (id) GROUP BY kind",
    "type_densified": _TYPED + ", c AS (SELECT year, kind, count(*) AS n FROM w JOIN t USING (id) GROUP BY ALL) SELECT y.year, k.kind, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT year FROM c) y CROSS JOIN (SELECT DISTINCT kind FROM c) k LEFT JOIN c ON c.year = y.year AND c.kind = k.kind",
    "dedup_latest": "SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "dedup_first": "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_quantity) = 1",
    "semi_ids": f"WITH {SQL} SELECT id, source_id, year FROM w WHERE source_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
    "anti_missing": f"WITH {SQL} SELECT id, year FROM w WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id)",
    "coverage_report": f"WITH k AS (SELECT CASE WHEN user_id % 10 <> 0 THEN user_id END AS k FROM events), a AS (SELECT count(*) AS total, count(*) - count(k) AS without_key, count(k) AS with_key, count(*) FILTER (k IN (SELECT c_custkey FROM customer)) AS matched FROM k) SELECT *, with_key - matched AS unmatched, {sql_ratio('matched', 'greatest(with_key, 1)', 100)} AS coverage_pct FROM a",
    "sketch_levels": f"WITH {SQL} SELECT country, year, topic, grouping(country, year, topic) AS grouping_id, count(DISTINCT id) AS works, TRUE AS near FROM wc JOIN w USING (id) GROUP BY GROUPING SETS ((country, year, topic), (country, year), (country), (year, topic), (topic), ())",
    "exact_distinct": f"WITH {SQL} SELECT country, count(DISTINCT id) AS works FROM wc GROUP BY country",
    "array_has": f"WITH {SQL} SELECT DISTINCT id FROM wc WHERE country = 'NATION_6'",
    "array_overlap": f"WITH {SQL} SELECT id, count(DISTINCT country) AS n_countries FROM wc GROUP BY id HAVING bool_or(country IN ('NATION_6', 'NATION_17'))",
    "international": f"WITH {SQL}, z AS (SELECT id, count(DISTINCT country) AS k FROM wc GROUP BY id) SELECT year, count(*) FILTER (k > 1) AS intl, count(*) AS docs, {sql_ratio('count(*) FILTER (k > 1)', 'count(*)', 100)} AS pct FROM w JOIN z USING (id) GROUP BY year",
    "country_filter_period": f"WITH {SQL} SELECT id, year, round(price, 2) AS price FROM w WHERE year BETWEEN 1997 AND 1998 AND id IN (SELECT id FROM wc WHERE country = 'NATION_2')",
    "union_missing_columns": "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, NULL AS kind FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT), NULL, 'region' FROM region",
    "status_counts": f"WITH {SQL} SELECT oa, lang, count(*) AS n FROM w GROUP BY ALL",
}

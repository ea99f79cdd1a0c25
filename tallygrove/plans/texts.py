"""Queries over texts: search predicates, JSON, identifiers, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import json as J
from ..functions import text as X
from ..operators import collaboration as N
from ..operators import export as E
from ..operators import search as S
from ..sources.readers import table
from .works import SQL, places, work_countries, work_references, works

#: A boolean query in the syntax that the reader takes, over words of the test corpus.
QUERY = (
    '( TITLE-ABS-KEY ( "of the" OR tion* OR (ver W/3 zu) ) AND SUBJTERMS ( 2740 ) AND SUBJAREA ( MEDI ) '
    "AND NOT ( TITLE-ABS-KEY ( quevi* OR mouse ) AND NOT TITLE-ABS ( que ) ) AND NOT TITLE-ABS-KEY ( zzz ) )"
)


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("abstract"), "lang")


def token_filter(spark, d):
    docs = _docs(spark, d)
    return docs.filter(X.has_token(F.col("title"), "the") | X.has_token(F.col("abstract"), "que")).select("id")


def sandbox(spark, d):
    """The first thousand by id of one language with a token in title or abstract."""
    docs = _docs(spark, d).filter("lang = 'en'")
    return docs.filter(X.has_token(F.col("title"), "the") | X.has_token(F.col("abstract"), "with")).select("id", "lang").orderBy("id").limit(1000)


def wildcard_filter(spark, d):
    docs = _docs(spark, d)
    return docs.filter(S.wildcard(F.col("abstract"), "enti*") | S.wildcard(F.col("abstract"), "t?e of")).select("id")


def proximity_filter(spark, d):
    docs = _docs(spark, d)
    return docs.filter(S.near(F.col("abstract"), "the", "with", 3)).select("id")


_RULES = [S.Exclusion(["enti*", "(la W/2 que)"], ["avec"]), S.Exclusion(["mouse", "qu?"], [])]


def exclusion_filter(spark, d):
    return S.exclude(_docs(spark, d), _RULES).select("id")


def query_parse(spark, d):
    """What the reader makes of a query, as rows."""
    q = S.parse(QUERY)
    rows = [("term", 0, t) for t in q.terms] + [("code", 0, c) for c in q.codes]
    for i, rule in enumerate(q.exclusions):
        rows += [("exclude", i, t) for t in rule.exclude] + [("reinclude", i, t) for t in rule.reinclude]
    return spark.createDataFrame(rows, "kind string, rule int, value string")


def query_select(spark, d):
    return S.select(_docs(spark, d), S.parse(QUERY)).select("id")


def json_fields(spark, d):
    rows = table(spark, d, "events")
    return rows.select("event_id", J.nested(F.col("props"), "$.k", "long", -1).alias("k"), J.nested(F.col("props"), "$.none", "string", "missing").alias("none"))


def json_default(spark, d):
    rows = table(spark, d, "events")
    parsed = J.parsed_or_text(F.col("props"), "k long")
    return rows.groupBy(F.coalesce(parsed["k"], F.lit(0)).alias("k")).agg(F.count("*").cast("long").alias("n"), F.round(F.sum("value"), 6).alias("value"))


def json_written(spark, d):
    rows = table(spark, d, "nation")
    return rows.select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("record"))


def string_normalise(spark, d):
    rows = table(spark, d, "customer")
    key = F.concat(F.lit(" HTTPS://DOI.ORG/10.1/"), "c_name", F.lit(" "))
    return rows.select("c_custkey", X.doi_url(key).alias("doi"), X.identifier_tail(key).alias("tail"), F.initcap(F.lower("c_mktsegment")).alias("title"))


def slug_hash(spark, d):
    rows = table(spark, d, "part")
    return rows.select("p_partkey", X.slug_column(F.col("p_name")).alias("slug"), X.short_hash(F.col("p_name")).alias("hash"))


def author_short(spark, d):
    rows = table(spark, d, "part").withColumn("who", F.replace(F.col("p_name"), F.lit("_"), F.lit(" ")))
    return rows.select("p_partkey", X.short_author(F.col("who")).alias("author"))


def dates(spark, d):
    rows = table(spark, d, "orders")
    day = F.to_date("o_orderdate")
    return rows.select("o_orderkey", F.year(day).alias("year"), F.substring(day.cast("string"), 1, 4).alias("year_text"), F.date_format(day, "dd MMMM yyyy").alias("written"), F.date_add(day, 30).cast("string").alias("later"), F.datediff(F.make_date(F.year(day), F.lit(12), F.lit(31)), day).cast("long").alias("days_left"))


def number_text(spark, d):
    rows = table(spark, d, "customer")
    return rows.select("c_custkey", F.round("c_acctbal", 1).alias("rounded"), F.coalesce(F.col("c_name").try_cast("double"), F.lit(0.0)).alias("coerced"), F.sqrt(F.abs("c_acctbal")).cast("long").alias("root"))


def hex_grid(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("r"), (F.col("n_nationkey") % 5).alias("c"))
    x, y = G.hex_center(F.col("r"), F.col("c"))
    corner = G.hex_polygon(x, y)
    return rows.select("n_nationkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(F.element_at(corner, 2)["x"], 6).alias("x1"), F.round(F.element_at(corner, 2)["y"], 6).alias("y1"), F.size(corner).cast("long").alias("corners"))


def _cited(spark, d):
    refs = work_references(spark, d).groupBy("id").agg(F.array_sort(F.collect_set(F.concat(F.lit("https://x.org/W"), F.col("ref").cast("string")))).alias("referenced_works"))
    base = works(spark, d).select("id", F.col("year").alias("publication_year"), F.col("topic").alias("title"), F.when(F.col("oa") == "F", "gold").when(F.col("oa") == "O", "closed").alias("oa_status"), F.lower("lang").alias("type"), (F.col("id") % 7).alias("cited_by_count"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://doi.org/10/"), F.col("id").cast("string"))).alias("doi"), F.array(F.lit("Ada B Lovelace"), F.lit("Plato")).alias("author_names"), F.lit('{"primary_location":{"source":{"display_name":"J","issn":["1-2","3"]}}}').alias("raw_data"))
    return base.join(refs, "id", "left")


def citation_text(spark, d):
    rows = _cited(spark, d)
    return rows.select("id", E.citation_block(rows).alias("block"))


def search_text(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("eid"), F.col("o_orderpriority").alias("title"), F.lit("Nellen L.; Sarkis Y.").alias("author_names"), F.to_date("o_orderdate").cast("string").alias("coverDate"), F.col("o_custkey").cast("string").alias("citedby_count"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("10/x")).alias("doi"), F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("openaccess"))
    return rows.select("eid", E.search_block(rows).alias("block"))


def markdown_table(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("region"))
    return E.markdown_rows(rows)


def _network(spark, d):
    edges = N.pairs(work_countries(spark, d), "id", "country")
    return N.strength(edges), edges


def vos_export(spark, d):
    nodes, edges = _network(spark, d)
    items = E.network_items(nodes, "node", "node", F.lit(0), "strength", "country").select(F.lit("item").alias("kind"), F.col("item").alias("object"))
    links = E.network_links(edges, "a", "b", "n").select(F.lit("link").alias("kind"), F.col("link").alias("object"))
    return items.unionByName(links)


def vos_document(spark, d):
    nodes, edges = _network(spark, d)
    return E.network_document(E.network_items(nodes, "node", "node", F.lit(0), "strength"), E.network_links(edges, "a", "b", "n"))


def country_labels(spark, d):
    rows = places(spark, d)
    return rows.select("inst", F.concat("inst_name", F.lit(" ("), "country", F.lit(")")).alias("label"), F.coalesce(F.nullif("region", F.lit("")), F.lit("Other")).alias("region"))


QUERIES = {f.__name__: f for f in (
    token_filter, sandbox, wildcard_filter, proximity_filter, exclusion_filter, query_parse, query_select, json_fields, json_default, json_written, string_normalise, slug_hash,
    author_short, dates, number_text, hex_grid, citation_text, search_text, markdown_table, vos_export, vos_document, country_labels,
)}

_EDGE = r"(^|[^\p{L}\p{N}_])"
_END = r"([^\p{L}\p{N}_]|$)"


def _near(a: str, b: str, n: int, source: str) -> str:
    """Ids of documents with two tokens near each other."""
    return f"""SELECT DISTINCT x.id FROM (SELECT id, unnest(regexp_extract_all(lower(abstract), '[\\p{{L}}\\p{{N}}_]+')) AS w, generate_subscripts(regexp_extract_all(lower(abstract), '[\\p{{L}}\\p{{N}}_]+'), 1) AS i FROM {source}) x
    JOIN (SELECT id, unnest(regexp_extract_all(lower(abstract), '[\\p{{L}}\\p{{N}}_]+')) AS w, generate_subscripts(regexp_extract_all(lower(abstract), '[\\p{{L}}\\p{{N}}_]+'), 1) AS i FROM {source}) y
    ON x.id = y.id AND x.i <> y.i AND abs(x.i - y.i) <= {n} WHERE x.w {a} AND y.w {b}"""


_DOCS = "d AS (SELECT doc_id AS id, left(text, 60) AS title, text AS abstract, lang FROM documents), f AS (SELECT *, lower(concat_ws(' ', title, abstract, '', '')) AS everything, lower(concat_ws(' ', title, abstract)) AS short FROM d)"
_TOKEN = "list_contains(regexp_split_to_array(lower({}), '[^a-z0-9]+'), '{}')"


def _wild(column: str, pattern: str) -> str:
    return f"regexp_matches(lower({column}), '{_EDGE}{pattern}')"


_PAIRS = f"WITH {SQL}, p AS (SELECT x.country AS a, y.country AS b, count(*) AS n FROM wc x JOIN wc y ON x.id = y.id AND x.country < y.country GROUP BY ALL), u AS (SELECT a AS node, n FROM p UNION ALL SELECT b, n FROM p), s AS (SELECT node, CAST(sum(n) AS BIGINT) AS strength FROM u GROUP BY node), items AS (SELECT '{{\"id\":\"' || node || '\",\"label\":\"' || node || '\",\"cluster\":0,\"weight\":' || strength || ',\"type\":\"KIND\"}}' AS o FROM s), links AS (SELECT '{{\"source_id\":\"' || a || '\",\"target_id\":\"' || b || '\",\"strength\":' || n || '}}' AS o FROM p)"

ORACLES = {
    "token_filter": f"WITH {_DOCS} SELECT id FROM d WHERE {_TOKEN.format('title', 'the')} OR {_TOKEN.format('abstract', 'que')}",
    "sandbox": f"WITH {_DOCS} SELECT id, lang FROM d WHERE lang = 'en' AND ({_TOKEN.format('title', 'the')} OR {_TOKEN.format('abstract', 'with')}) ORDER BY id LIMIT 1000",
    "wildcard_filter": f"WITH {_DOCS} SELECT id FROM d WHERE {_wild('abstract', 'enti.*')} OR {_wild('abstract', 't.e of' + _END)}",
    "proximity_filter": f"WITH {_DOCS} {_near(chr(61) + ' ' + chr(39) + 'the' + chr(39), chr(61) + ' ' + chr(39) + 'with' + chr(39), 3, 'd')}",
    "exclusion_filter": f"""WITH {_DOCS}, fe AS (SELECT id, everything AS abstract FROM f), nr AS ({_near("= 'la'", "= 'que'", 2, 'fe')})
        SELECT id FROM f WHERE NOT (({_wild('everything', 'enti.*')} OR id IN (SELECT id FROM nr)) AND NOT {_wild('everything', 'avec' + _END)})
        AND NOT ({_wild('short', 'mouse' + _END)} OR {_wild('short', 'qu.' + _END)})""",
    "query_select": f"""WITH {_DOCS}, fe AS (SELECT id, everything AS abstract FROM f), nr AS ({_near("= 'ver'", "= 'zu'", 3, 'fe')})
        SELECT id FROM f WHERE ({_wild('everything', 'of the' + _END)} OR {_wild('everything', 'tion.*')} OR id IN (SELECT id FROM nr))
        AND NOT ({_wild('short', 'quevi.*')} OR {_wild('short', 'mouse' + _END)}) AND NOT {_wild('everything', 'que' + _END)} AND NOT {_wild('everything', 'zzz' + _END)}""",
    "json_fields": "SELECT event_id, coalesce(TRY_CAST(props ->> '$.k' AS BIGINT), -1) AS k, coalesce(props ->> '$.none', 'missing') AS none FROM events",
    "json_default": "SELECT coalesce(TRY_CAST(props ->> '$.k' AS BIGINT), 0) AS k, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL",
    "json_written": "SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' AS record FROM nation",
    "string_normalise": "SELECT c_custkey, 'https://doi.org/10.1/' || lower(c_name) AS doi, c_name || ' ' AS tail, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS title FROM customer",
    "slug_hash": "SELECT p_partkey, lower(replace(trim(p_name), ' ', '_')) AS slug, left(md5(p_name), 8) AS hash FROM part",
    "author_short": "WITH w AS (SELECT p_partkey, replace(p_name, '_', ' ') AS who, list_filter(regexp_split_to_array(replace(p_name, '_', ' '), '\\s+'), lambda p: p <> '') AS p FROM part) SELECT p_partkey, CASE WHEN len(p) >= 2 THEN p[-1] || ' ' || p[1][1] || '.' ELSE who END AS author FROM w",
    "dates": "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT o_orderkey, CAST(year(day) AS INT) AS year, left(CAST(day AS VARCHAR), 4) AS year_text, strftime(day, '%d %B %Y') AS written, CAST(day + 30 AS VARCHAR) AS later, datediff('day', day, make_date(year(day), 12, 31)) AS days_left FROM o",
    "number_text": "SELECT c_custkey, round(c_acctbal, 1) AS rounded, coalesce(TRY_CAST(c_name AS DOUBLE), 0.0) AS coerced, CAST(floor(sqrt(abs(c_acctbal))) AS BIGINT) AS root FROM customer",
    "hex_grid": "WITH g AS (SELECT n_nationkey, sqrt(3.0) * ((n_nationkey % 5) + 0.5 * (n_regionkey % 2)) AS x, 1.5 * n_regionkey AS y FROM nation) SELECT n_nationkey, round(x, 6) AS x, round(CAST(y AS DOUBLE), 6) AS y, round(x + cos(radians(150)), 6) AS x1, round(y + sin(radians(150)), 6) AS y1, CAST(7 AS BIGINT) AS corners FROM g",
    "citation_text": f"""WITH {SQL}, r AS (SELECT id, string_agg('W' || ref, '; ' ORDER BY 'https://x.org/W' || ref) AS refs FROM wr GROUP BY id)
        SELECT id, 'Lovelace A., Plato' || chr(10) || 'AUTHOR FULL NAMES: Ada B Lovelace; Plato' || chr(10) || chr(10) || topic || chr(10) || '(' || year || ') J, Cited ' || (id % 7) || ' times.'
        || (CASE WHEN id % 2 = 0 THEN chr(10) || 'DOI: 10/' || id ELSE '' END) || chr(10) || 'https://openalex.org/' || id || chr(10) || chr(10) || 'ISSN: 1-2' || chr(10)
        || 'DOCUMENT TYPE: ' || upper(lang[1]) || lower(lang[2:]) || chr(10) || 'PUBLICATION STAGE: Final' || (CASE WHEN oa = 'F' THEN chr(10) || 'OPEN ACCESS: Gold Open Access' ELSE '' END)
        || coalesce(chr(10) || 'REFERENCES: ' || refs, '') || chr(10) || 'SOURCE: OpenAlex' || chr(10) AS block FROM w LEFT JOIN r USING (id)""",
    "search_text": """SELECT CAST(o_orderkey AS VARCHAR) AS eid, 'Nellen L., Sarkis Y.' || chr(10) || 'AUTHOR FULL NAMES: Nellen L.; Sarkis Y.' || chr(10) || chr(10) || o_orderpriority || chr(10)
        || '(' || year(o_orderdate) || ') [No source], Cited ' || o_custkey || ' times.' || (CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'DOI: 10/x' || chr(10) || 'https://www.scopus.com/inward/record.uri?scp=' || o_orderkey || '&origin=inward' ELSE chr(10) END)
        || chr(10) || chr(10) || 'PUBLICATION STAGE: Final' || (CASE WHEN o_orderstatus = 'F' THEN chr(10) || 'OPEN ACCESS: All Open Access' ELSE '' END) || chr(10) || 'SOURCE: Scopus' || chr(10) AS block FROM orders""",
    "markdown_table": "SELECT '| ' || n_nationkey || ' | ' || n_name || ' | ' || (CASE WHEN n_regionkey > 0 THEN CAST(n_regionkey AS VARCHAR) ELSE '' END) || ' |' AS line FROM nation",
    "vos_export": _PAIRS.replace("KIND", "country") + " SELECT 'item' AS kind, o AS object FROM items UNION ALL SELECT 'link', o FROM links",
    "vos_document": _PAIRS.replace("KIND", "node") + """ SELECT '{"network":{"items":[' || (SELECT string_agg(o, ',' ORDER BY o) FROM items) || '],"links":[' || (SELECT string_agg(o, ',' ORDER BY o) FROM links) || ']}}' AS document""",
    "country_labels": f"WITH {SQL} SELECT inst, inst_name || ' (' || country || ')' AS label, coalesce(nullif(region, ''), 'Other') AS region FROM pl",
}

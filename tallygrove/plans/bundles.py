"""Summary bundle, harvest plans, hierarchies with fallbacks, text vectors, and small relational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bins as B
from ..operators import cube as C
from ..operators import harvest as H
from ..operators import reshape as R
from ..operators import vectors as V
from ..sources import pages as P
from ..sources.readers import row_count, scan, table, year_range
from ..sources.work import Work
from .impact import _CUBE_SQL, _THEMES, _cube, _ratios
from .works import ALL_MEASURES, SQL, sql_ratios, works

YEARS = (1995, 2001)
RECENT = 1998
#: Rows of a part in the harvest plan over the order tables.
MOST = 100
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")
DIM = 32


def _kind(spark, d, kind: str) -> DataFrame:
    return _cube(spark, d).filter(F.col("entity_type") == kind)


def summary_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The seven tables of a subject: countries and themes by year and in all, and entities by theme: by year, in all, recent."""
    countries, world, cells = _kind(spark, d, "Country"), _kind(spark, d, "Mundo"), _cube(spark, d)
    dated = cells.withColumn("year_entity", F.concat_ws("_", "year", "entity_name"))
    return {
        "countries": _ratios(C.reaggregate(countries, ["year", "entity_name"], ALL_MEASURES), ["year", "entity_name"]),
        "themes": _ratios(C.reaggregate(world, ["year", "topic"], ALL_MEASURES), ["year", "topic"]),
        "countries_total": _ratios(C.reaggregate(countries, ["entity_name"], ALL_MEASURES), ["entity_name"]),
        "pivot_annual": R.pivoted(dated, "year_entity", "topic", _THEMES, "doc_count"),
        "pivot_full": R.pivoted(cells, "entity_name", "topic", _THEMES, "doc_count"),
        "pivot_recent": R.pivoted(cells.filter(F.col("year") >= RECENT), "entity_name", "topic", _THEMES, "doc_count"),
        "themes_total": _ratios(C.reaggregate(world, ["topic"], ALL_MEASURES), ["topic"]),
    }


def _bundled(name: str):
    def query(spark, d):
        return summary_tables(spark, d)[name]

    return query


def _harvestable(spark, d) -> DataFrame:
    month = F.element_at(F.array(*map(F.lit, H.MONTHS)), F.month("o_orderdate"))
    return table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), month.alias("month"), F.col("o_orderpriority").alias("kind"))


def harvest_plan(spark, d):
    """Years, months and kinds that a harvest of at most ``MOST`` rows a part is split into."""
    parts = H.yearly(H.counted(_harvestable(spark, d), ["year", "month", "kind"]), *YEARS, kinds=PRIORITIES, most=MOST)
    rows = []
    for scope, n in parts:
        at = dict(scope.equal) | {column: "other" for column, _ in scope.without}
        rows.append((at["year"], at.get("month"), at.get("kind"), n))
    return spark.createDataFrame(rows, "year int, month string, kind string, n long")


def harvest_gathered(spark, d):
    """Overlapping parts of one search, each row once, that of the earliest part."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("eid"), F.year("o_orderdate").alias("year"))
    parts = [rows.filter(F.col("year").between(a, a + 1)).withColumn("found_in", F.lit(a)) for a in range(1994, 1998)]
    return H.gather(parts, "eid", "orders", "year 1994-1998", 1994, 1998).rows


def harvest_pages(spark, d):
    """Documents as page files by language and source, fetched into a store in two runs: what headers announce and what came in.

    The second run resumes: it adds only the chunks that the first, a search for one language, left.
    """
    schema, by = "doc_id long, text string, lang string, source string", ["lang", "source"]
    folder, store = (f"{Work(spark, 'harvest').folder}/{name}" for name in ("pages", "store"))
    P.write_pages(table(spark, d, "documents").select("doc_id", "text", *by), folder, by, size=1000)
    P.fetch(spark, folder, schema, by, store, F.col("lang") == "en")
    P.fetch(spark, folder, schema, by, store)
    came = P.stored(spark, schema, store).groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"), F.count("text").alias("texts"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars")
    )
    listed = P.headers(spark, folder, "lang string, source string", by).select(*by, F.col("count").alias("announced"))
    return P.joined(listed, came, by)


def theme_names(spark, d):
    """Works by source under its name, or under its id where the source has none."""
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.when(F.col("c_nationkey") < 10, F.col("c_name")).when(F.col("c_nationkey") < 15, F.lit("")).alias("name"))
    return named(works(spark, d), names.filter("name is not null"), "source_id", "name").groupBy("name").agg(F.count("*").cast("long").alias("n"))


def named(rows: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with the name of their key; a key that has none, or an empty one, stands for itself."""
    found = rows.join(names.select(key, F.col(name).alias("_name")), key, "left")
    return found.withColumn(name, F.coalesce(F.nullif("_name", F.lit("")), F.col(key).cast("string"))).drop("_name")


def any_name(spark, d):
    """Any of the names of a key: one, as names follow from keys."""
    return table(spark, d, "customer").groupBy(F.col("c_custkey").alias("source_id")).agg(F.any_value("c_name").alias("name"))


def table_rows(spark, d):
    """Rows of each table, from the files' footers."""
    names = ("customer", "lineitem", "orders", "part", "supplier")
    return spark.createDataFrame([(n, row_count(spark, f"{d}/{n}.parquet")) for n in names], "name string, n long")


def windows_distinct(spark, d):
    """Windows of several plans, each once."""
    span = year_range(works(spark, d))
    ends = [B.sliding(span), B.sliding(span, 3, 2), B.sliding(span, 2, 1)]
    out = ends[0]
    for more in ends[1:]:
        out = out.unionByName(more)
    return out.select("y_start", "y_end").distinct()


def first_titles(spark, d):
    """The first works of each theme by id, without a measure."""
    from pyspark.sql import Window

    line = Window.partitionBy("topic").orderBy("id")
    return works(spark, d).select("topic", "id", F.row_number().over(line).cast("long").alias("place")).filter("place <= 3")


def callback_filter(spark, d):
    """Rows that a caller's function chooses, pushed down like any predicate."""
    return scan(spark, d, "orders", lambda df: (df["o_totalprice"] > 1000) & (df["o_orderstatus"] != "P"), ["o_orderkey", "o_orderstatus"])


def text_vectors(spark, d):
    """Document vectors: the mean of their tokens' signed places, as unit vectors; places that aren't 0."""
    found = V.text_embedded(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", DIM)
    rows = found.select("doc_id", F.posexplode("embedding").alias("dim", "x")).filter("x <> 0")
    return rows.select("doc_id", F.col("dim").cast("long").alias("dim"), (F.round("x", 5) + 0.0).alias("x"))


def hierarchy_recovered(spark, d):
    """Brands and types; tables that aren't there are passed over."""
    from ..sources.readers import first_of, read_or_none

    return first_of(
        lambda: read_or_none(spark, f"{d}/topic_hierarchy.parquet"),
        lambda: table(spark, d, "part").filter("p_size > 1000").select("p_brand", "p_type"),
        lambda: C.hierarchy(table(spark, d, "part"), ["p_brand", "p_type"]),
    )


QUERIES = {f.__name__: f for f in (
    harvest_plan, harvest_gathered, harvest_pages, theme_names, any_name, table_rows, windows_distinct, first_titles, callback_filter, text_vectors, hierarchy_recovered,
)}
QUERIES |= {f"summary_{name}": _bundled(name) for name in ("countries_total", "pivot_annual", "pivot_full", "pivot_recent")}
QUERIES |= {"summary_countries_annual": _bundled("countries"), "summary_themes_annual": _bundled("themes")}

_PIVOT = ", ".join(f"CAST(coalesce(sum(doc_count) FILTER (topic = '{t}'), 0) AS BIGINT) AS \"{t}\"" for t in _THEMES)


def _summed(kind: str, keys: str) -> str:
    return _CUBE_SQL + f", s AS (SELECT {keys}, {', '.join(f'sum({m}) AS {m}' for m in ALL_MEASURES)} FROM c0 WHERE entity_type = '{kind}' GROUP BY ALL) SELECT {keys}, {sql_ratios()} FROM s"


_KINDS = ", ".join(f"'{p}'" for p in PRIORITIES)
ORACLES = {
    "harvest_plan": f"""WITH o AS (SELECT CAST(year(o_orderdate) AS INT) AS year, strftime(o_orderdate, '%b') AS month, CASE WHEN o_orderpriority IN ({_KINDS}) THEN o_orderpriority ELSE 'other' END AS kind FROM orders WHERE year(o_orderdate) BETWEEN {YEARS[0]} AND {YEARS[1]}),
        s AS (SELECT *, count(*) OVER (PARTITION BY year) AS ny, count(*) OVER (PARTITION BY year, month) AS nm FROM o)
        SELECT year, CASE WHEN ny > {MOST} THEN month END AS month, CASE WHEN ny > {MOST} AND nm > {MOST} THEN kind END AS kind, count(*) AS n FROM s GROUP BY ALL""",
    "harvest_pages": "SELECT nullif(lang, '') AS lang, nullif(source, '') AS source, count(*) AS announced, count(*) AS rows, count(DISTINCT doc_id) AS ids, count(text) AS texts, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM documents GROUP BY ALL",
    "harvest_gathered": "SELECT o_orderkey AS eid, CAST(year(o_orderdate) AS INT) AS year, CAST(greatest(year(o_orderdate) - 1, 1994) AS INT) AS found_in FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1998",
    "theme_names": f"WITH {SQL} SELECT CASE WHEN c_nationkey < 10 AND c_name <> '' THEN c_name ELSE CAST(source_id AS VARCHAR) END AS name, count(*) AS n FROM w JOIN customer ON c_custkey = source_id GROUP BY ALL",
    "any_name": "SELECT c_custkey AS source_id, any_value(c_name) AS name FROM customer GROUP BY c_custkey",
    "table_rows": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("customer", "lineitem", "orders", "part", "supplier")),
    "windows_distinct": f"WITH {SQL}, y AS (SELECT min(year) AS a, max(year) AS z FROM w), x AS (SELECT unnest(range(a, z - 1)) AS s, 2 AS k FROM y UNION ALL SELECT unnest(range(a, z)), 1 FROM y) SELECT DISTINCT CAST(s AS INT) AS y_start, CAST(s + k AS INT) AS y_end FROM x",
    "first_titles": f"WITH {SQL} SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY id) AS place FROM w QUALIFY place <= 3",
    "callback_filter": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'P'",
    "text_vectors": f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM documents WHERE text IS NOT NULL),
        h AS (SELECT doc_id, CAST('0x' || left(md5(token), 6) AS BIGINT) % {DIM} AS dim, CASE WHEN right(md5(token), 1) < '8' THEN 1 ELSE -1 END AS s FROM t),
        v AS (SELECT doc_id, dim, sum(s) AS x FROM h GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY doc_id)
        SELECT doc_id, dim, round(x / norm, 5) + 0.0 AS x FROM v JOIN n USING (doc_id) WHERE x <> 0""",
    "hierarchy_recovered": "SELECT DISTINCT p_brand, p_type FROM part WHERE p_brand <> '' AND p_type <> ''",
    "summary_countries_annual": _summed("Country", "year, entity_name"),
    "summary_themes_annual": _summed("Mundo", "year, topic"),
    "summary_countries_total": _summed("Country", "entity_name"),
    "summary_pivot_annual": _CUBE_SQL + f"SELECT year || '_' || entity_name AS year_entity, {_PIVOT} FROM c0 GROUP BY ALL",
    "summary_pivot_full": _CUBE_SQL + f"SELECT entity_name, {_PIVOT} FROM c0 GROUP BY ALL",
    "summary_pivot_recent": _CUBE_SQL + f"SELECT entity_name, {_PIVOT} FROM c0 WHERE year >= {RECENT} GROUP BY ALL",
}

"""Rows as documents for other tools: citation text, tables, networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import source_of
from ..functions.text import identifier_tail, safe_join, short_author


# The words of the citation format, in the order of its lines.
BANNER = "Scopus\nEXPORT DATE: "
NO_AUTHORS, FULL_NAMES, NO_TITLE, NO_SOURCE = "[No authors]", "AUTHOR FULL NAMES: ", "[No title]", "[No source]"
DOI, DOI_URL = "DOI: ", "https://doi.org/"
WORK_URL = "https://openalex.org/"
RECORD_URL = ("https://www.scopus.com/inward/record.uri?scp=", "&origin=inward")
AFFILIATIONS, ABSTRACT, PUBLISHER, ISSN = "AFFILIATIONS: ", "ABSTRACT: ", "PUBLISHER: ", "ISSN: "
LANGUAGE, TYPE, STAGE = "LANGUAGE OF ORIGINAL DOCUMENT: ", "DOCUMENT TYPE: ", "PUBLICATION STAGE: Final"
OPEN, OPEN_KIND, ALL_OPEN = "OPEN ACCESS: ", " Open Access", "OPEN ACCESS: All Open Access"
AUTHOR_KEYWORDS, INDEX_KEYWORDS, REFERENCES = "AUTHOR KEYWORDS: ", "INDEX KEYWORDS: ", "REFERENCES: "
WORK_SOURCE, SEARCH_SOURCE = "SOURCE: OpenAlex", "SOURCE: Scopus"


def _filled(c: Column) -> Column:
    """Null for null and blank."""
    return F.when(F.trim(c.cast("string")) != "", c.cast("string"))


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), _filled(value))


def _lines(*lines: Column) -> Column:
    """Lines that aren't null."""
    return F.concat_ws("\n", *lines)


def source_line(year: Column, source: Column, volume: Column, issue: Column, pages: Column, cited: Column) -> Column:
    parts = [
        F.concat(F.lit("("), F.coalesce(year.cast("string"), F.lit("")), F.lit(") "), source),
        F.coalesce(F.concat(F.lit(", "), _filled(volume)), F.lit("")),
        F.coalesce(F.concat(F.lit(" ("), _filled(issue), F.lit(")")), F.lit("")),
        F.coalesce(F.concat(F.lit(", pp. "), _filled(pages)), F.lit("")),
        F.coalesce(F.concat(F.lit(", Cited "), cited.cast("long").cast("string"), F.lit(" times.")), F.lit("")),
    ]
    return F.concat(*parts)


def citation_block(df: DataFrame) -> Column:
    """One work as a block of labelled lines; labels without a value are left out.

    Columns that a table lacks count as null.
    """
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    col = lambda c: F.col(c) if c in kinds else F.lit(None).cast("string")
    many = lambda c: F.col(c) if kinds.get(c) == "array" else F.array().cast("array<string>")
    names = F.filter(many("author_names"), lambda x: x.isNotNull())
    short = F.array_join(F.transform(names, short_author), ", ")
    tails = lambda c: F.array_join(F.transform(F.filter(many(c), lambda x: x.isNotNull()), identifier_tail), "; ")
    source = source_of(col("raw_data"))
    pages = F.concat(_filled(col("first_page")), F.coalesce(F.concat(F.lit("-"), _filled(col("last_page"))), F.lit("")))
    oa = F.when(col("oa_status") != "closed", F.concat(F.initcap(_filled(col("oa_status"))), F.lit(OPEN_KIND)))
    return _lines(
        F.coalesce(_filled(short), F.lit(NO_AUTHORS)),
        F.concat(F.lit(FULL_NAMES), safe_join(many("author_names"))),
        F.coalesce(tails("author_ids"), F.lit("")),
        F.coalesce(col("title"), F.lit(NO_TITLE)),
        source_line(col("publication_year"), source["name"], col("volume"), col("issue"), pages, col("cited_by_count")),
        _line(DOI, F.replace(col("doi"), F.lit(DOI_URL), F.lit(""))),
        F.concat(F.lit(WORK_URL), F.coalesce(identifier_tail(col("id").cast("string")), F.lit(""))),
        F.lit(""),
        _line(AFFILIATIONS, safe_join(many("institution_names"))),
        _line(ABSTRACT, col("abstract")),
        _line(PUBLISHER, source["publisher"]),
        _line(ISSN, source["issn"]),
        _line(LANGUAGE, col("language")),
        _line(TYPE, F.initcap(col("type"))),
        F.lit(STAGE),
        _line(OPEN, oa),
        _line(AUTHOR_KEYWORDS, safe_join(many("keywords"))),
        _line(INDEX_KEYWORDS, safe_join(many("concepts"))),
        _line(REFERENCES, tails("referenced_works")),
        F.lit(WORK_SOURCE),
        F.lit(""),
    )


def search_block(df: DataFrame) -> Column:
    """One search result as a block; numbers and flags arrive as text."""
    kinds = {f.name for f in df.schema}
    col = lambda c: F.col(c).cast("string") if c in kinds else F.lit(None).cast("string")
    names = F.replace(F.replace(_filled(col("author_names")), F.lit(";"), F.lit(",")), F.lit(" ,"), F.lit(","))
    record = F.concat(F.lit(RECORD_URL[0]), F.coalesce(col("eid"), F.lit("")), F.lit(RECORD_URL[1]))
    return _lines(
        F.coalesce(names, F.lit(NO_AUTHORS)),
        F.concat(F.lit(FULL_NAMES), F.coalesce(_filled(col("author_names")), F.lit(""))),
        F.coalesce(col("author_ids"), F.lit("")),
        F.coalesce(col("title"), F.lit(NO_TITLE)),
        source_line(F.substring(col("coverDate"), 1, 4), F.coalesce(col("publicationName"), F.lit(NO_SOURCE)), col("volume"), col("issueIdentifier"), col("pageRange"), col("citedby_count").try_cast("long")),
        _line(DOI, col("doi")),
        F.when(_filled(col("doi")).isNotNull(), record).otherwise(F.lit("")),
        F.lit(""),
        _line(AFFILIATIONS, F.replace(col("affilname"), F.lit(";"), F.lit("; "))),
        _line(ABSTRACT, col("description")),
        _line(ISSN, col("issn")),
        _line(TYPE, col("subtypeDescription")),
        F.lit(STAGE),
        F.when(F.lower(col("openaccess")).isin("1", "true", "1.0"), F.lit(ALL_OPEN)),
        F.lit(SEARCH_SOURCE),
        F.lit(""),
    )


def header(date: Column) -> Column:
    return F.concat(F.lit(BANNER), F.date_format(date, "dd MMMM yyyy"), F.lit("\n"))


def markdown_rows(df: DataFrame) -> DataFrame:
    """``line`` of each row; ``markdown_head`` has the two lines above."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_head(columns: list[str]) -> list[str]:
    return [f"| {' | '.join(columns)} |", f"| {' | '.join(['---'] * len(columns))} |"]


def network_items(nodes: DataFrame, key: str, label: str, cluster: Column, weight: str, kind: str = "node") -> DataFrame:
    """A JSON object per node. A network file lists items and links; they are written as two sets of lines, so neither is gathered in one row."""
    item = F.to_json(F.struct(F.col(key).cast("string").alias("id"), F.coalesce(F.col(label).cast("string"), F.col(key).cast("string")).alias("label"), cluster.alias("cluster"), F.col(weight).alias("weight"), F.lit(kind).alias("type")))
    return nodes.select(F.col(key).cast("string").alias("id"), item.alias("item"))


def network_links(edges: DataFrame, source: str, target: str, weight: str) -> DataFrame:
    link = F.to_json(F.struct(F.col(source).cast("string").alias("source_id"), F.col(target).cast("string").alias("target_id"), F.col(weight).alias("strength")))
    return edges.select(link.alias("link"))


def network_document(items: DataFrame, links: DataFrame) -> DataFrame:
    """The whole network in one row, for networks small enough to be drawn."""
    a = items.agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("a"))
    b = links.agg(F.array_join(F.array_sort(F.collect_list("link")), ",").alias("b"))
    return a.crossJoin(b).select(F.concat(F.lit('{"network":{"items":['), "a", F.lit('],"links":['), "b", F.lit("]}}")).alias("document"))

"""Readers: tables, artefacts, JSON lines, and tolerant loading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import slug, slug_column

# Words that stay small in a readable name, and where subjects of unknown place stand.
SMALL_WORDS = ("and", "or", "of", "for", "to", "in", "on", "with", "by", "at")
NOWHERE = ("Cached Data (Offline)", "Local Cache")
ARTEFACTS = ("main", "collaboration", "institutions", "types", "inst_types", "journals")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_or_none(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame | None:
    """A Parquet table, pruned to ``columns``; None if it isn't there."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return None
    return found.select(*columns) if columns else found


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table: no column is asked for, so only footers are read."""
    return spark.read.parquet(path).count()


def scan(spark: SparkSession, folder: str, name: str, where: Callable[[DataFrame], Column] | None = None, columns: list[str] | None = None) -> DataFrame:
    """A table's rows that the caller's function chooses, and columns; both reach the scan."""
    found = table(spark, folder, name)
    found = found.filter(where(found)) if where else found
    return found.select(*columns) if columns else found


def first_of(*sources: Callable[[], DataFrame | None]) -> DataFrame | None:
    """The first source that is there and has rows; later ones aren't asked for."""
    for source in sources:
        found = source()
        if found is not None and not found.isEmpty():
            return found
    return None


def artefact(spark: SparkSession, root: str, subject: str, kind: str) -> DataFrame | None:
    """A subject's cached table of one kind."""
    if kind not in ARTEFACTS:
        raise ValueError(f"unknown artefact {kind!r}; known: {', '.join(ARTEFACTS)}")
    return read_or_none(spark, f"{root}/{slug(subject)}/{kind}")


def readable(name: Column) -> Column:
    """A subject's name from its slug: words in capitals but for small ones."""
    return F.array_join(F.transform(F.split(name, "_"), lambda w: F.when(w.isin(*SMALL_WORDS), w).otherwise(F.initcap(w))), " ")


def hierarchy_from_artefacts(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """domain, field, subfield of the subjects that have a main table under ``root``; ``known`` (the same columns) places those it lists."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root).select("path")
    slugs = paths.select(F.regexp_extract("path", r"/([^/]+)/main(?:\.parquet)?(?:/|$)", 1).alias("slug")).filter("slug <> ''").distinct()
    placed = (known if known is not None else spark.createDataFrame([], "domain string, field string, subfield string")).select("domain", "field", F.col("subfield").alias("name"), slug_column(F.col("subfield")).alias("slug"))
    domain, field = map(F.lit, NOWHERE)
    return slugs.join(placed, "slug", "left").select(F.coalesce("domain", domain).alias("domain"), F.coalesce("field", field).alias("field"), F.coalesce("name", readable(F.col("slug"))).alias("subfield"))


def cached_metrics(spark: SparkSession, root: str, level: str, period: str) -> DataFrame | None:
    """Metric tables by level (latam, country, journal) and period (annual, period)."""
    return read_or_none(spark, f"{root}/{level}_{period}")


def year_range(works: DataFrame, year_col: str = "year", least: int = 2000, most: int = 2025) -> DataFrame:
    """Exact first and last year, over all rows; the defaults where there is none."""
    return works.agg(F.coalesce(F.min(year_col), F.lit(least)).cast("int").alias("year_min"), F.coalesce(F.max(year_col), F.lit(most)).cast("int").alias("year_max"))


def tolerant(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Those of the wanted columns that there are."""
    return df.select(*[c for c in wanted if c in df.columns])


def reindexed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order: missing ones null, extra ones dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def nulls_for_empty(df: DataFrame) -> DataFrame:
    """Stores without nulls write '' and []; both become null on load."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(c != "", c)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.when(F.size(c) > 0, c)
        out.append(c.alias(f.name))
    return df.select(*out)


def journals(raw: DataFrame) -> DataFrame:
    """Journal records, flattened with defaults: nested values may be structs or JSON text."""

    def nested(column: str, path: str, kind: str, default) -> Column:
        if column not in raw.columns:
            return F.lit(default).cast(kind)
        value = F.get_json_object(column, f"$.{path}") if isinstance(raw.schema[column].dataType, T.StringType) else F.get_json_object(F.to_json(column), f"$.{path}")
        return F.coalesce(F.expr("null") if value is None else value.try_cast(kind), F.lit(default).cast(kind))

    flag = lambda c: (F.coalesce(F.col(c).try_cast("boolean"), F.lit(False)) if c in raw.columns else F.lit(False)).alias(c)
    number = lambda c: (F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in raw.columns else F.lit(0.0)).alias(c)
    keep = [c for c in ("id", "display_name", "country_code") if c in raw.columns]
    return raw.select(
        *keep,
        number("works_count"),
        number("cited_by_count"),
        nested("summary_stats", "2yr_mean_citedness", "double", 0.0).alias("mean_citedness"),
        nested("summary_stats", "h_index", "double", 0.0).alias("h_index"),
        nested("open_access", "is_oa", "boolean", False).alias("is_oa"),
        *[flag(c) for c in ("is_in_doaj", "is_core", "is_indexed_in_scopus")],
    )

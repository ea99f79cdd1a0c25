"""The entity cube: world, region and country by year and topic."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import additive, growth, ratio, sums, weighted

WORLD = "Mundo"
TYPES = ("Mundo", "Region", "Country")


def by(works: DataFrame, keys: list[str], routes: Iterable[str], languages: Iterable[str]) -> DataFrame:
    """Additive measures by any keys: one partial and one final hash aggregate."""
    return works.groupBy(*keys).agg(*additive(routes, languages))


def full_count(works: DataFrame, members: DataFrame) -> DataFrame:
    """Every work once for each of its members (countries, regions)."""
    return works.join(members, "id")


def first_region(countries: DataFrame, order: list[str]) -> DataFrame:
    """One bloc for each work: the first of ``order`` that any of its countries is in."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), F.col("region")), F.lit(len(order) + 1))
    best = countries.groupBy("id").agg(F.min_by("region", F.struct(rank, "region")).alias("region"))
    return best


def region_of(country: Column, blocs: dict[str, list[str]]) -> Column:
    """The bloc that lists a country, else 'Other'."""
    pairs = [F.lit(x) for bloc, codes in blocs.items() for c in codes for x in (c, bloc)]
    return F.coalesce(F.element_at(F.create_map(*pairs), country), F.lit("Other"))


def cube(works: DataFrame, countries: DataFrame, routes: Iterable[str], languages: Iterable[str], measures: list[str]) -> DataFrame:
    """entity_type, entity_name, year, topic and measures, in one pass over works and their countries.

    A work counts once in the world, once in each of its regions and countries.
    The members of a work are made within one row, so works are read once and
    measured in one aggregate.
    """
    member = lambda kind, name: F.struct(F.lit(kind).alias("entity_type"), name.alias("entity_name"))
    regions = F.transform(F.array_distinct(F.transform("c", lambda c: c["region"])), lambda r: member(TYPES[1], r))
    named = F.transform(F.array_distinct(F.transform("c", lambda c: c["country"])), lambda c: member(TYPES[2], c))
    lists = countries.groupBy("id").agg(F.collect_set(F.struct("country", "region")).alias("c"))
    rows = works.join(lists, "id", "left").withColumn("c", F.coalesce("c", F.array().cast(lists.schema["c"].dataType)))
    rows = rows.withColumn("entity", F.explode(F.concat(F.array(member(TYPES[0], F.lit(WORLD))), regions, named))).select("*", "entity.*").drop("c", "entity")
    return by(rows, ["entity_type", "entity_name", "year", "topic"], routes, languages)


def with_share(cube_: DataFrame) -> DataFrame:
    """Each cell's share of the world's cell of that year and topic, in percent: a window over the cube, not a join."""
    world = F.sum(F.when(F.col("entity_type") == TYPES[0], F.col("doc_count"))).over(Window.partitionBy("year", "topic"))
    return cube_.withColumn("world_doc_count", world.cast("long")).withColumn("share", ratio(F.col("doc_count"), world, 100))


def grouping_sets(works: DataFrame, measures: list[Column], sets: list[list[str]]) -> DataFrame:
    """Native grouping sets: one expand and one aggregate; ``grouping_id`` names the set."""
    keys = sorted({k for s in sets for k in s})
    ordered = [[F.col(k) for k in s] for s in sets]
    return works.groupingSets(ordered, *[F.col(k) for k in keys]).agg(*measures, F.grouping_id().cast("long").alias("grouping_id"))


def of_entity(cube_: DataFrame, name: str) -> DataFrame:
    """An entity's cells; some names stand for others."""
    alias = {"World": WORLD, "México": "MX", "Mexico": "MX"}
    return cube_.filter(F.col("entity_name") == alias.get(name, name))


def in_period(df: DataFrame, first: int | None = None, last: int | None = None, year: str = "year") -> DataFrame:
    if first is not None:
        df = df.filter(F.col(year) >= first)
    return df if last is None else df.filter(F.col(year) <= last)


def kpis(cube_: DataFrame, means: list[str]) -> DataFrame:
    """For each entity: documents, weighted means, and the share of the world over the cells where it has rows."""
    return cube_.groupBy("entity_type", "entity_name").agg(F.sum("doc_count").alias("docs"), *[weighted(m).alias(m) for m in means], ratio(F.sum("doc_count"), F.sum("world_doc_count"), 100).alias("share"))


def trends(cube_: DataFrame, means: list[str]) -> DataFrame:
    return cube_.groupBy("entity_type", "entity_name", "year").agg(F.sum("doc_count").alias("docs"), *[weighted(m).alias(m) for m in means])


def cagr(cube_: DataFrame, first: int = 2010, last: int = 2025) -> DataFrame:
    """Growth between an entity's first and last year with documents."""
    yearly = in_period(cube_, first, last).groupBy("entity_type", "entity_name", "year").agg(F.sum("doc_count").alias("docs")).filter("docs > 0")
    ends = yearly.groupBy("entity_type", "entity_name").agg(F.min_by("docs", "year").alias("first_docs"), F.max_by("docs", "year").alias("last_docs"), (F.max("year") - F.min("year")).cast("long").alias("years"))
    return ends.withColumn("cagr", growth(F.col("first_docs"), F.col("last_docs"), F.col("years")))


def reaggregate(cube_: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Sums of additive measures over coarser keys; ratios are made anew from them."""
    return cube_.groupBy(*keys).agg(*sums(measures))


def quadrants(cube_: DataFrame, value: str = "fwci_avg", split: float = 1.0) -> DataFrame:
    """Entities by volume above or below the median and weighted impact above or below ``split``."""
    rows = cube_.groupBy("entity_name").agg(F.sum("doc_count").alias("docs"), weighted(value).alias("impact"))
    middle = rows.agg(F.median("docs").alias("median_docs"))
    high = F.when(F.col("impact") >= split, "high").otherwise("low")
    large = F.when(F.col("docs") >= F.col("median_docs"), "large").otherwise("small")
    return rows.crossJoin(F.broadcast(middle)).select("entity_name", "docs", "impact", "median_docs", F.concat(large, F.lit("-"), high).alias("quadrant"))


def ordered_entities(df: DataFrame) -> DataFrame:
    """World, then regions by name, then countries by volume."""
    place = F.when(F.col("entity_type") == TYPES[0], 0).when(F.col("entity_type") == TYPES[1], 1).otherwise(2)
    return df.orderBy(place, F.when(place == 2, -F.col("doc_count")), "entity_name")


def hierarchy(df: DataFrame, levels: list[str]) -> DataFrame:
    """Distinct non-empty paths."""
    found = df.select(*levels).distinct()
    for level in levels:
        found = found.filter(F.col(level).isNotNull() & (F.col(level).cast("string") != ""))
    return found


def below(df: DataFrame, chosen: dict[str, str], level: str) -> DataFrame:
    """Values of a level under the chosen values of the levels above, in order."""
    for key, value in chosen.items():
        df = df.filter(F.col(key) == value)
    return df.select(level).distinct().orderBy(level)


def sunburst(cube_: DataFrame, n: int = 35) -> DataFrame:
    """The n largest themes with documents and weighted impact."""
    rows = cube_.groupBy("topic").agg(F.sum("doc_count").alias("docs"), weighted("fwci_avg").alias("fwci_avg"))
    return rows.orderBy(F.desc("docs"), "topic").limit(n)

"""Networks of countries that publish together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs(members: DataFrame, key: str, member: str, extra: list[str] | None = None) -> DataFrame:
    """Unordered pairs of distinct members of a key, counted.

    Members of one key are an array in one row, so pairs are made in place: no
    self-join, and a key's pairs are bounded by its own members.
    """
    extra = extra or []
    lists = members.groupBy(key, *extra).agg(F.array_sort(F.collect_set(member)).alias("m")).filter(F.size("m") > 1)
    one = lists.select(*extra, F.posexplode("m").alias("i", "a"), "m")
    two = one.select(*extra, "a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    return two.groupBy(*extra, "a", "b").agg(F.count("*").cast("long").alias("n"))


def top_pairs(counts: DataFrame, n: int = 1000) -> DataFrame:
    return counts.orderBy(F.desc("n"), "a", "b").limit(n)


def partners(counts: DataFrame) -> DataFrame:
    """Pair counts seen from both ends."""
    back = counts.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")
    return counts.unionByName(back).groupBy(F.col("a").alias("node"), F.col("b").alias("partner")).agg(F.sum("n").alias("n"))


def strength(edges: DataFrame, weight: str = "n") -> DataFrame:
    """Weight and number of incident edges."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), weight)
    return ends.groupBy("node").agg(F.sum(weight).alias("strength"), F.count("*").cast("long").alias("degree"))


def drawn(strengths: DataFrame) -> DataFrame:
    """Marker size of a node, by the root of its strength against the largest."""
    most = strengths.agg(F.max("strength").alias("most"))
    return strengths.crossJoin(F.broadcast(most)).select("node", "strength", F.round(10 + 40 * F.sqrt(F.col("strength") / F.col("most")), 6).alias("size"))

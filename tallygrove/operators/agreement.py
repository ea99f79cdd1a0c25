"""How far two partitions of the same things agree."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOISE = -1


def clean(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows that both partitions place, noise left out."""
    return df.na.drop(subset=[a, b]).filter((F.col(a) != NOISE) & (F.col(b) != NOISE))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return clean(df, a, b).groupBy(a, b).agg(F.count("*").cast("long").alias("n"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, mi, and both entropies, in nats, from the contingency table."""
    table = contingency(df, a, b)
    total = table.agg(F.sum("n").alias("total"))
    rows, columns = (table.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in (a, b))
    cells = table.join(rows, a).join(columns, b).crossJoin(F.broadcast(total))
    mi = F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col(f"n_{a}") * F.col(f"n_{b}"))))
    entropy = lambda side, name: side.crossJoin(F.broadcast(total)).agg((-F.sum(F.col(f"n_{name}") / F.col("total") * F.log(F.col(f"n_{name}") / F.col("total")))).alias(f"h_{name}"))
    return cells.agg(F.max("total").alias("n"), mi.alias("mi")).crossJoin(entropy(rows, a)).crossJoin(entropy(columns, b))


def log_factorial(x: np.ndarray) -> np.ndarray:
    """Logarithms of factorials: a table of the first, Stirling's series for the others."""
    x = np.asarray(x, np.float64)
    first = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 64)))])
    y = np.maximum(x, 63) + 1
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return np.where(x < 64, first[np.minimum(x, 63).astype(np.int64)], series)


def expected_mi(rows: list[int], columns: list[int]) -> float:
    """Mean mutual information of random partitions with these sizes: a hypergeometric sum for each pair of distinct sizes."""
    n = sum(rows)
    out = 0.0
    for (a, many_a), (b, many_b) in product(Counter(rows).items(), Counter(columns).items()):
        k = np.arange(max(1, a + b - n), min(a, b) + 1)
        chance = np.exp(log_factorial(a) + log_factorial(b) + log_factorial(n - a) + log_factorial(n - b) - log_factorial(n) - log_factorial(k) - log_factorial(a - k) - log_factorial(b - k) - log_factorial(n - a - b + k))
        out += many_a * many_b * float((k / n * np.log(n * k / (a * b)) * chance).sum())
    return out


def _log_factorial(x: Column) -> Column:
    """As ``log_factorial``, of a column."""
    first = F.array(*[F.lit(float(v)) for v in log_factorial(np.arange(64))])
    y = F.greatest(x, F.lit(64)).cast("double") + 1
    series = (y - 0.5) * F.log(y) - y + float(0.5 * np.log(2 * np.pi)) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return F.when(x < 64, F.get(first, x.cast("int"))).otherwise(series)


def adjusted(df: DataFrame, a: str, b: str, least: int = 10) -> DataFrame:
    """ami: adjusted mutual information in one row; null for ``least`` or fewer rows.

    The mean over random partitions needs sizes only: distinct sizes of one
    side (fewer than the square root of twice the rows, however many clusters)
    meet those of the other, and each pair's hypergeometric sum is exploded and aggregated.
    """
    spark = df.sparkSession
    table = contingency(df, a, b).select(F.col(a).alias("a"), F.col(b).alias("b"), "n")
    total = F.broadcast(table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")))
    sides = {c: table.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in ("a", "b")}
    cells = table.join(sides["a"], "a").join(sides["b"], "b").crossJoin(total)
    mi = cells.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("n_a").cast("double") * F.col("n_b")))).alias("mi"))
    share = lambda c: F.col(f"n_{c}") / F.col("total")
    entropy = {c: side.crossJoin(total).agg((-F.sum(share(c) * F.log(share(c)))).alias(f"h_{c}"), F.count("*").alias(f"clusters_{c}")) for c, side in sides.items()}
    sizes = {c: side.groupBy(F.col(f"n_{c}").alias(f"size_{c}")).agg(F.count("*").alias(f"many_{c}")) for c, side in sides.items()}
    pairs = sizes["a"].crossJoin(sizes["b"]).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "size_a", "size_b").crossJoin(total)
    x, y, n, k = F.col("size_a"), F.col("size_b"), F.col("total"), F.col("k")
    ways = pairs.withColumn("fixed", _log_factorial(x) + _log_factorial(y) + _log_factorial(n - x) + _log_factorial(n - y) - _log_factorial(n))
    rows = ways.withColumn("k", F.explode(F.sequence(F.greatest(F.lit(1), x + y - n), F.least(x, y))))
    chance = F.exp(F.col("fixed") - _log_factorial(k) - _log_factorial(x - k) - _log_factorial(y - k) - _log_factorial(n - x - y + k))
    term = F.col("many_a") * F.col("many_b") * k / n * F.log(n * k / (x.cast("double") * y)) * chance
    expected = rows.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("expected"))
    parts = mi.crossJoin(entropy["a"]).crossJoin(entropy["b"]).crossJoin(expected).crossJoin(total)
    below = (F.col("h_a") + F.col("h_b")) / 2 - F.col("expected")
    trivial = (F.col("clusters_a") == F.col("clusters_b")) & F.col("clusters_a").isin(F.lit(1), n)
    value = (F.col("mi") - F.col("expected")) / F.when(F.abs(below) > 1e-15, below).otherwise(1e-15)
    return parts.select(F.when(n > least, F.when(trivial, 1.0).otherwise(value)).alias("ami"))


def adjusted_mi(df: DataFrame, a: str, b: str, least: int = 10) -> float | None:
    return adjusted(df, a, b, least).first()["ami"]


def pairwise(df: DataFrame, columns: list[str]) -> DataFrame:
    """pair, ami of every two partitions."""
    pairs = [adjusted(df, a, b).select(F.lit(f"ami_{a}_vs_{b}").alias("pair"), "ami") for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return reduce(DataFrame.unionByName, pairs)

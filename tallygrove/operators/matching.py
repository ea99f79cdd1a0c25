"""Semi and anti joins, and reports of what matched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import ratio


def in_list(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """One semi-join, however long the list."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def missing(df: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Rows whose key isn't known; null keys are missing too."""
    return df.join(known.select(key), key, "left_anti")


def coverage(found: DataFrame, key: str, corpus: DataFrame) -> DataFrame:
    """Totals, rows without key, matched and unmatched rows, and the share of keys that match."""
    known = corpus.select(key).distinct().withColumn("hit", F.lit(True))
    c = found.select(key).join(known, key, "left").agg(
        F.count("*").cast("long").alias("total"),
        F.count_if(F.col(key).isNull()).cast("long").alias("without_key"),
        F.count(key).cast("long").alias("with_key"),
        F.count("hit").cast("long").alias("matched"),
    )
    return c.select("*", (F.col("with_key") - F.col("matched")).alias("unmatched"), ratio(F.col("matched"), F.greatest("with_key", F.lit(1)), 100).alias("coverage_pct"))


def merged(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """Left joins of several labelled partitions onto the first one's keys."""
    names = list(frames)
    out = frames[names[0]]
    for name in names[1:]:
        out = out.join(frames[name], key, "left")
    return out


def match_corpus(found: DataFrame, corpus: DataFrame, key: str, rules: list) -> dict[str, DataFrame]:
    """Search results against a corpus: matched corpus rows after local exclusions, unmatched results, and the report.

    Both sides carry ``key`` in one normal form. Matched rows are the corpus's
    own, one for each key (the smallest row of repeated ones).
    """
    from .dedup import first
    from .search import exclude

    hits = in_list(corpus.filter(F.col(key).isNotNull()), key, found)
    return {"matched": exclude(first(hits, [key], [c for c in hits.columns if c != key][:1]), rules), "residue": missing(found, key, corpus), "coverage": coverage(found, key, corpus)}

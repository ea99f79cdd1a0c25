"""Clusters followed from one bin to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NOISE = -1


def transitions(df: DataFrame, cluster: str = "cluster", bin_: str = "bin_id", key: str = "id", least: float = 0.05) -> DataFrame:
    """Pairs of clusters of consecutive bins whose members overlap by a Jaccard above ``least``.

    Members meet by an equi-join on id and next bin, so clusters that share
    nothing are never paired. Consecutive are the bins that occur.
    """
    rows = df.filter(F.col(cluster).isNotNull() & (F.col(cluster) != NOISE)).select(F.col(bin_).alias("bin"), F.col(cluster).alias("c"), F.col(key).alias("k")).distinct()
    bins = df.select(F.col(bin_).alias("bin")).distinct()  # few, so one ordered window
    after = bins.select("bin", F.lead("bin").over(Window.orderBy("bin")).alias("to")).filter("to is not null")
    sizes = rows.groupBy("bin", "c").agg(F.count("*").alias("size"))
    now = rows.join(after, "bin").select(F.col("bin").alias("from_bin"), F.col("to").alias("to_bin"), F.col("c").alias("from_cluster"), "k")
    then = rows.select(F.col("bin").alias("to_bin"), F.col("c").alias("to_cluster"), "k")
    shared = now.join(then, ["to_bin", "k"]).groupBy("from_bin", "to_bin", "from_cluster", "to_cluster").agg(F.count("*").cast("long").alias("shared_docs"))
    for side in ("from", "to"):
        shared = shared.join(sizes.select(F.col("bin").alias(f"{side}_bin"), F.col("c").alias(f"{side}_cluster"), F.col("size").alias(f"{side}_size")), [f"{side}_bin", f"{side}_cluster"])
    jaccard = F.col("shared_docs") / (F.col("from_size") + F.col("to_size") - F.col("shared_docs"))
    return shared.select("from_bin", "to_bin", "from_cluster", "to_cluster", jaccard.alias("jaccard"), "shared_docs").filter(F.col("jaccard") > least)


def sankey(moves: DataFrame) -> DataFrame:
    """Links between numbered nodes; nodes are clusters in bins, numbered in the order of their labels."""
    label = lambda side: F.concat(F.lit("B"), F.col(f"{side}_bin").cast("string"), F.lit("_C"), F.col(f"{side}_cluster").cast("string"))
    rows = moves.select(label("from").alias("source_label"), label("to").alias("target_label"), F.col("shared_docs").alias("value"))
    nodes = rows.select(F.explode(F.array("source_label", "target_label")).alias("label")).distinct()
    numbered = nodes.select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("long").alias("i"))
    out = rows
    for side in ("source", "target"):
        out = out.join(numbered.withColumnsRenamed({"label": f"{side}_label", "i": side}), f"{side}_label")
    return out.select("source", "target", "value", "source_label", "target_label")


def sizes(df: DataFrame, cluster: str = "cluster", bin_: str = "bin_id") -> DataFrame:
    return df.groupBy(bin_, cluster).agg(F.count("*").cast("long").alias("size"))


def small_bins(df: DataFrame, cluster: str, bin_: str = "bin_id", least: int = 50) -> DataFrame:
    """Bins of fewer rows than ``least`` are one cluster, 0."""
    small = df.groupBy(F.col(bin_).alias("_bin")).agg(F.count("*").alias("_n")).filter(F.col("_n") < least)
    return df.join(small, F.col(bin_).eqNullSafe(F.col("_bin")), "left").withColumn(cluster, F.when(F.col("_n").isNotNull(), F.lit(0)).otherwise(F.col(cluster))).drop("_bin", "_n")

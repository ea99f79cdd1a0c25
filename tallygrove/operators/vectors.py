"""Vectors: norms, search, coverage, and embeddings of graph nodes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector over its norm; as it is if that is 0."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def template(title: Column, abstract: Column) -> Column:
    """The text that an embedding model reads."""
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit(" [SEP] Abstract: "), F.coalesce(abstract, F.lit("")))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 2048) -> DataFrame:
    """Of each query the k rows of largest cosine, itself left out: query, neighbour, cosine, rank.

    Exact: vectors are gathered to blocks, pairs of blocks are one matrix
    product each, and a block pair gives k rows per query at most, cut in the
    final order, so equal cosines go by id in whatever block they are.  Blocks of
    rows stream past the blocks of queries without being shuffled again: those
    are broadcast where Spark's own threshold allows, else read once for each
    partition of rows.  Rows without a vector (null, empty, or with a null in it)
    are neither queries nor neighbours.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(df: DataFrame, side: str) -> DataFrame:
        real = df.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(vector_col, lambda x: x.isNull()))
        parts = F.pmod(F.xxhash64(id_col), F.lit(max(1, -(-real.count() // block))))
        dealt = real.select(parts.alias("part"), F.struct(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).alias("row")).repartition(tasks, "part")
        return dealt.groupBy("part").agg(F.collect_list("row").alias(side)).select(side)

    def best(batches):
        for pdf in batches:
            for q, r in zip(pdf["q"], pdf["r"]):
                a, b = (np.array([x["v"] for x in side], np.float64) for side in (q, r))
                a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (a, b))
                names, others = np.array([x["id"] for x in q]), np.array([x["id"] for x in r])
                by_id = np.argsort(others, kind="stable")
                others, b = others[by_id], b[by_id]
                cosine = a @ b.T
                cosine[names[:, None] == others[None, :]] = -np.inf
                near = np.round(cosine, 9)
                top = np.argsort(-near, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"query": np.repeat(names, top.shape[1]), "neighbour": others[top].ravel(), "cosine": np.take_along_axis(cosine, top, 1).ravel(), "near": np.take_along_axis(near, top, 1).ravel()}).query("near > -2")

    pairs = blocks(rows, "r").crossJoin(blocks(queries, "q")).select("q", "r")
    found = pairs.mapInPandas(best, f"query {kind}, neighbour {kind}, cosine double, near double")
    line = Window.partitionBy("query").orderBy(F.desc("near"), "neighbour")
    return found.withColumn("rank", F.row_number().over(line).cast("long")).filter(F.col("rank") <= k).drop("near")


def text_embedded(df: DataFrame, key: str, text_col: str, dim: int) -> DataFrame:
    """key, embedding: the mean of a text's token vectors as a unit vector; each token is a signed place, both from its digest.

    The stand-in for a language model's vectors, in built-in functions.  A text
    without tokens has the zero vector; texts of one key are one text.
    """
    token = F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(f"({TOKEN})"), F.lit(1)))
    digests = df.select(key, token.alias("_token")).select(key, F.md5("_token").alias("_m"))
    place = F.pmod(F.conv(F.substring("_m", 1, 6), 16, 10).cast("int"), F.lit(dim))
    sums = digests.groupBy(key, place.alias("_at")).agg(F.sum(F.when(F.substring("_m", 32, 1) < "8", 1).otherwise(-1)).cast("double").alias("_x"))
    filled = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_at", "_x"))).alias("_places"))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("_places", i), F.lit(0.0)))
    return df.select(key).distinct().join(filled, key, "left").select(key, unit(numbers).alias("embedding"))


def reduced(df: DataFrame, vector_col: str, dim: int, out: str = "reduced") -> DataFrame:
    """Principal components of vectors of equal length: the learned reduction; its covariance is summed on the cluster."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("_dense", array_to_vector(F.col(vector_col).cast("array<double>")))
    model = PCA(k=dim, inputCol="_dense", outputCol="_main").fit(rows.filter(F.col("_dense").isNotNull()))
    return model.transform(rows).withColumn(out, vector_to_array("_main")).drop("_dense", "_main")


def projected(df: DataFrame, vector_col: str, size: int, dim: int) -> DataFrame:
    """Random projection of vectors of ``size`` to ``dim``, by digest signs: the stand-in for a learned reduction."""
    scale = float(dim) ** -0.5
    signs = [[scale if hashlib.md5(f"{i}:{j}".encode()).hexdigest()[0] < "8" else -scale for j in range(size)] for i in range(dim)]
    return df.withColumn("projected", F.array(*[dot(F.col(vector_col), F.array(*map(F.lit, row))) for row in signs]))


def coverage(rows: DataFrame, models: dict[str, str]) -> DataFrame:
    """Rows in all and rows with a vector of each model."""
    return rows.agg(F.count("*").cast("long").alias("total"), *[F.count_if(F.coalesce(F.size(c) > 0, F.lit(False))).cast("long").alias(f"with_{m}") for m, c in models.items()])


def window(store: DataFrame, first: int, last: int, column: str, year: str = "year") -> DataFrame:
    """Ids and non-empty vectors of one model in a range of years; other models' columns aren't read."""
    return store.filter(F.col(year).between(first, last)).select("id", column).filter(F.size(column) > 0)

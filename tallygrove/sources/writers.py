"""Writers: overwrite, append with schema reconciliation, CSV, JSON, text, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import read_or_none, reindexed


def overwrite(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested values as JSON text; columns of type null as text."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.NullType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def append(df: DataFrame, path: str) -> None:
    """A true append: the first batch sets the schema, later ones are fitted to it; on conflict a value becomes null, not an error."""
    rows = flat(df)
    known = read_or_none(df.sparkSession, path)
    if known is not None:
        fitted = []
        for f in known.schema:
            c = F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
            fitted.append(c.alias(f.name))
        rows = rows.select(*fitted)
    rows.write.mode("append").parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key isn't stored yet: an interrupted harvest goes on where it stopped."""
    known = read_or_none(df.sparkSession, path, [key])
    append(df if known is None else df.join(known.distinct(), key, "left_anti"), path)


def create_store(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """An empty table, unless there is one."""
    if read_or_none(spark, path) is None:
        spark.createDataFrame([], schema).write.parquet(path)


def add_column(spark: SparkSession, path: str, target: str, name: str, kind: str) -> None:
    """Write the store anew under ``target`` with one more column, null so far; as it is if it has the column."""
    store = spark.read.parquet(path)
    (store if name in store.columns else store.withColumn(name, F.lit(None).cast(kind))).write.mode("overwrite").parquet(target)


def csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def text(lines: DataFrame, path: str) -> None:
    """One column of blocks, one file line per line of a block."""
    lines.select(F.col(lines.columns[0]).alias("value")).write.mode("overwrite").text(path)


__all__ = ["add_column", "append", "append_new", "create_store", "csv", "flat", "json", "overwrite", "reindexed", "text"]

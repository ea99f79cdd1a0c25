"""A source of page files, as a harvest leaves them, and a store that resumes from it.

Pages lie in folders by chunk, ``year=2020/country=PERU/...``.  The first line of
a page is its header as JSON: ``count`` rows of the chunk, this ``page`` of
``pages``, its ``rows``; each other line is a record.  The format ``pages`` reads
them on the executors, one task for each page.  Conditions on the columns that
name a chunk (comparisons, lists, null tests) are pushed down: folders that they
exclude aren't even listed.  ``headers`` reads first lines only, so a search's
size is known before it is fetched.

``fetch`` adds chunks to a Parquet store.  A chunk is committed by name after
its rows are written, and its rows replace those of an earlier attempt, so a run
that dies is simply run again; chunks with pages still missing wait.

Defined results: a null chunk value is a chunk of its own, an empty one counts
as null; a field that a record
lacks is null, one that the schema lacks is ignored; a page without records has
no rows; repeated records stay.
"""

from __future__ import annotations

import io
import json
import operator
import posixpath
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
)

#: How Spark names the folder of a null value.
NOTHING = "__HIVE_DEFAULT_PARTITION__"
_HEADER = "count long, page long, pages long, rows long"
_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def _fits(condition, value) -> bool:
    if isinstance(condition, IsNull):
        return value is None
    if isinstance(condition, EqualNullSafe):
        return value == condition.value
    if value is None:
        return False
    if isinstance(condition, In):
        return value in condition.value
    return isinstance(condition, IsNotNull) or _COMPARED[type(condition)](value, condition.value)


@dataclass
class Page(InputPartition):
    path: str
    chunk: dict


class PageReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.folder, self.by = schema, options["path"], [c for c in options.get("by", "").split(",") if c]
        self.header = options.get("header", "false").lower() == "true"
        self.only = {tuple(c) for c in json.loads(options["only"])} if "only" in options else None
        self.conditions: list = []

    def pushFilters(self, filters):
        for condition in filters:
            known = isinstance(condition, (In, IsNull, IsNotNull, EqualNullSafe, *_COMPARED))
            if known and len(condition.attribute) == 1 and condition.attribute[0] in self.by:
                self.conditions.append(condition)
            else:
                yield condition

    def _store(self):
        from pyarrow import fs

        uri = self.folder
        if uri.startswith("file:"):
            return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
        return fs.FileSystem.from_uri(uri)

    def _value(self, column: str, text: str):
        if text == NOTHING:
            return None
        kind = self.schema[column].dataType
        return int(text) if isinstance(kind, T.IntegralType) else unquote(text)

    def _pages(self, store, folder: str, chunk: dict):
        from pyarrow import fs

        level = self.by[len(chunk)] if len(chunk) < len(self.by) else None
        for info in store.get_file_info(fs.FileSelector(folder)):
            name = posixpath.basename(info.path)
            if name.startswith(("_", ".")):
                continue
            if info.type == fs.FileType.Directory:
                below = chunk
                if level is not None:
                    value = self._value(level, name.split("=", 1)[1])
                    if not all(_fits(c, value) for c in self.conditions if c.attribute[0] == level):
                        continue
                    below = chunk | {level: value}
                yield from self._pages(store, info.path, below)
            elif level is None and (self.only is None or tuple(chunk[c] for c in self.by) in self.only):
                yield Page(info.path, chunk)

    def partitions(self):
        return sorted(self._pages(*self._store(), {}), key=lambda p: p.path)

    def read(self, partition: Page | None):
        if partition is None:  # no page is wanted
            return
        import pyarrow as pa
        from pyarrow import json as pj
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        inner = pa.schema([f for f in schema if f.name not in self.by])
        with self._store()[0].open_input_file(partition.path) as file:
            stream = io.BufferedReader(file)
            first = stream.readline()
            body = first if self.header else stream.read()
        if not body.strip():
            return
        # one block: a record may be of any length
        table = pj.read_json(io.BytesIO(body), read_options=pj.ReadOptions(block_size=len(body) + 1), parse_options=pj.ParseOptions(explicit_schema=inner, unexpected_field_behavior="ignore"))
        chunk = {c: pa.array([partition.chunk[c]] * table.num_rows, schema.field(c).type) for c in self.by}
        columns = [chunk[f.name] if f.name in chunk else table.column(f.name).cast(f.type) for f in schema]
        yield from pa.Table.from_arrays(columns, schema=schema).to_batches()


class PageSource(DataSource):
    """Options: path; by, the columns that name a chunk, by comma; header, to read headers; only, chunks as a JSON list of lists."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self):
        raise ValueError("the schema of pages must be given: the columns of a chunk and those of the records")

    def reader(self, schema: T.StructType) -> PageReader:
        return PageReader(schema, dict(self.options))


def _located(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def pages(spark: SparkSession, folder: str, schema: str, by: list[str], **options: str) -> DataFrame:
    """The records of all pages, or of those that filters on ``by`` leave."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
    return spark.read.format("pages").schema(schema).options(by=",".join(by), **options).load(_located(spark, folder))


def headers(spark: SparkSession, folder: str, chunk_schema: str, by: list[str]) -> DataFrame:
    """Each chunk: rows by its headers, pages, and pages that are there."""
    found = pages(spark, folder, f"{chunk_schema}, {_HEADER}", by, header="true")
    return found.groupBy(*by).agg(F.max("count").alias("count"), F.max("pages").alias("pages"), F.count_distinct("page").alias("there"))


def joined(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Rows of ``a`` with those of ``b`` of the same chunk; a null value is one."""
    other = {c: f"of {c}" for c in by}
    return a.join(b.withColumnsRenamed(other), reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"`{o}`")) for c, o in other.items()]), how).drop(*other.values())


def write_pages(rows: DataFrame, folder: str, by: list[str], size: int = 200) -> None:
    """Pages of some ``size`` records for each chunk; a chunk of any number of rows is dealt by hash, none is sorted or gathered."""
    for c in (c for c in by if isinstance(rows.schema[c].dataType, T.StringType)):
        rows = rows.withColumn(c, F.nullif(F.col(c), F.lit("")))  # folders have no name for an empty value
    inner = [c for c in rows.columns if c not in by]
    dealt = rows.select(*by, F.to_json(F.struct(*inner), {"ignoreNullFields": "false"}).alias("record"), F.monotonically_increasing_id().alias("at"))
    many = dealt.groupBy(*by).agg(F.count("*").alias("count")).withColumn("pages", F.ceil(F.col("count") / size))
    paged = joined(dealt, many, by).select(*by, "record", "count", "pages", F.pmod(F.xxhash64("record", "at"), F.col("pages")).alias("page"))
    held = paged.groupBy(*by, "page").agg(F.max("count").alias("count"), F.max("pages").alias("pages"), F.sort_array(F.collect_list("record")).alias("records"))
    header = F.to_json(F.struct("count", "page", F.col("pages"), F.size("records").cast("long").alias("rows")))
    # a page that no record fell to is not there; the pages that are there are the chunk's
    there = held.groupBy(*by).agg(F.count("*").alias("filled"))
    held = joined(held, there, by).select(*by, "page", "count", F.col("filled").alias("pages"), "records")
    held.select(*by, "page", F.concat_ws("\n", F.array(header), "records").alias("value")).write.partitionBy(*by, "page").text(folder)


def committed(spark: SparkSession, store: str, chunk_schema: str) -> DataFrame:
    """The names of the chunks that a store holds."""
    log = spark._jvm.org.apache.hadoop.fs.Path(f"{store}-committed")
    if not log.getFileSystem(spark._jsc.hadoopConfiguration()).exists(log):
        return spark.createDataFrame([], chunk_schema)
    return spark.read.schema(chunk_schema).json(f"{store}-committed")


def fetch(spark: SparkSession, folder: str, schema: str, by: list[str], store: str, where: Column | None = None) -> int:
    """Add the complete chunks that the store lacks, of those that ``where`` names; how many were added.

    Chunk names come to the driver: there are as many as values of their columns, not rows.
    """
    kinds = spark.createDataFrame([], schema).select(*by).schema
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    found, have = headers(spark, folder, names, by), committed(spark, store, names)
    if where is not None:
        found = found.filter(where)
    missing = joined(found.filter("there = pages"), have, by, "left_anti").select(*by).collect()
    if not missing:
        return 0
    rows = pages(spark, folder, schema, by, only=json.dumps([list(r) for r in missing]))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(store)
    spark.createDataFrame(missing, kinds).coalesce(1).write.mode("append").json(f"{store}-committed")
    return len(missing)


def stored(spark: SparkSession, schema: str, store: str) -> DataFrame:
    return spark.read.schema(schema).parquet(store)

"""Token counts by a digest cache.

The cache is a folder of Parquet batches, one sub-folder per tokenizer version
(a digest of its file, library and settings), each row a text's digest and its
count.  A run joins the digests of its texts to the stored counts, encodes
each distinct text that is missing once, and appends those as one more batch.
A batch counts only when its writer has committed it, so a run that dies
leaves nothing half stored; two runs at once may store a text twice, which
changes no result.

Only digests are shuffled to find what is missing.  Texts move only if they
are missing; copies are combined before they do.  Digests of a thousandth of all
rows or more, of which there are a thousand at most, are joined where the rows
are, so no task gets a hot text's rows.

Defined results: null text is an empty text; equal rows have equal counts and
each is returned; null and repeated ids pass through; other columns are ignored;
an empty table gives none and stores nothing; texts may have any length that a row can.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .shared import in_arrow, pieces, settle, strings_of, table, work_folder

#: Missing digests up to this number (48 MB at most) are brought to the rows; beyond it rows are shuffled to them.
BROADCAST_DIGESTS = 1 << 19
#: A digest with this share of all rows, or a larger one, is hot.
HOT_SHARE = 1000
STORED = "digest binary, n_tokens long"


def _store(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def batches_of(spark: SparkSession, cache: str, version: str) -> list[str]:
    """Folders of the committed batches of a version."""
    store, path = _store(spark, f"{cache}/version={version}")
    if not store.exists(path):
        return []
    found = [x.getPath().toString() for x in store.listStatus(path) if x.isDirectory()]
    return sorted(x for x in found if store.exists(_store(spark, f"{x}/_SUCCESS")[1]))


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """digest, n_tokens of all batches; None if there is none."""
    found = batches_of(spark, cache, version)
    return spark.read.schema(STORED).parquet(*found).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")) if found else None


def _encoded(batches, tokenizer: str, plain: bool):
    ids = tokens.encoder(tokenizer, plain)
    for rows, _, _ in pieces(batches, "text"):
        counts = [len(x) for x in ids(strings_of(rows.column("text")))]
        yield pa.RecordBatch.from_arrays([rows.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])


def fill(rows: DataFrame, seen: DataFrame, cache: str, tokenizer: str, plain: bool = False) -> int:
    """Store counts of all texts that the cache lacks; returns how many there were.

    ``rows``: digest, text; ``seen``: their distinct digests, settled.
    """
    spark, version = rows.sparkSession, tokens.version(tokenizer, plain)
    known = stored(spark, cache, version)
    missing = seen.select("digest")
    if known is not None:
        missing = settle(missing.join(known, "digest", "left_anti"), "missing-digests")
    n = missing.count()
    if not n:
        return 0
    texts = rows.select("digest", "text")
    if known is not None:
        texts = texts.join(F.broadcast(missing) if n <= BROADCAST_DIGESTS else missing, "digest", "left_semi")
    found = texts.dropDuplicates(["digest"]).transform(in_arrow, partial(_encoded, tokenizer=tokenizer, plain=plain), STORED)
    found.write.parquet(f"{cache}/version={version}/{uuid.uuid4().hex}")
    return n


def token_counts(
    docs: DataFrame, tokenizer: str, cache: str, text_col: str = "text", id_col: str = "doc_id", limit: int = 512, plain: bool = False, normalise: Callable[[Column], Column] = lambda text: text
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.

    ``tokenizer`` is the path of a .json or .model file, present on every
    executor.  ``cache`` is a folder that outlives the run.  ``normalise`` makes
    of a text what its digest is taken of and what is encoded; it must be
    something that the tokenizer does not tell apart, and byte-level BPE tells
    everything apart, so by default only null is made empty.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), normalise(text).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    seen = settle(rows.groupBy("digest").agg(F.count("*").alias("copies")), "digests")
    fill(rows, seen, cache, tokenizer, plain)
    known = stored(spark, cache, tokens.version(tokenizer, plain))
    if known is None:  # no rows at all
        known = spark.createDataFrame([], STORED)
    counted = settle(seen.join(known, "digest"), "counted-digests")
    total = seen.agg(F.sum("copies")).first()[0] or 0
    is_hot = F.col("copies") * HOT_SHARE >= total
    hot = counted.filter(is_hot).select(F.col("digest").alias("hot_digest"), F.col("n_tokens").alias("hot_tokens"))
    near = rows.drop("text").join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    # a row that is settled already gets a key of its own, which no digest equals, so such rows spread
    key = F.when(F.col("hot_tokens").isNull(), F.col("digest")).otherwise(F.encode(F.monotonically_increasing_id().cast("string"), "utf-8"))
    far = near.withColumn("digest", key).join(counted.filter(~is_hot).select("digest", "n_tokens"), "digest", "left")
    n_tokens = F.coalesce("hot_tokens", "n_tokens")
    return far.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents, over a cache that is empty at first."""
    return token_counts(table(spark, sf_dir, "documents"), tokens.public("byte_bpe_50k.json"), work_folder(spark, "token-cache"))

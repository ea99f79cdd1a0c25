"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame that is written as Parquet and read again as the
next one's docs.  All but the last return the columns of ``documents``.

1. language_id drops texts in no learned language: those without a letter, and
   those whose best language has less than ``MIN_SCORE`` of the probability.
2. simhash keeps one document of each group of near-duplicates, that with the
   smallest id.
3. suffix_dedup removes bytes of strings of 200 bytes that occur twice.  A
   character that loses some of its bytes goes whole; a document that loses all
   its text goes; n_chars is counted anew.
4. decontaminate drops documents that hold a twentieth or more of benchmark text.
5. packing returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm import decontaminate, langid, packing, simhash, suffix
from tallygrove.llm.shared import settle, table

#: Far below what any text of a learned language gets; the mean over positions is near 0.25 where nothing fits.
MIN_SCORE = 0.3

#: Neither a trained network nor suffix arrays nor BPE are SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.keep_known(docs, model, MIN_SCORE)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.clean(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.packed_pieces(docs, packing.default_tokenizer()))


STAGES = [
    ("language_id", language_id),
    ("simhash", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""Terms that stand for a cluster, by tf-idf."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from ..sources.work import Work

#: Function words of the languages of the corpus; callers give their own list.
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "that", "for", "with", "on", "as", "by", "at", "an", "are", "was", "be", "or", "it", "from")


#: Rows that are brought to the texts instead of shuffled with them.
NEAR = 1 << 20


def _small(kept: DataFrame) -> DataFrame:
    return F.broadcast(kept) if kept.count() <= NEAR else kept


def cluster_terms(docs: DataFrame, cluster: str, text: str = "text", key: str = "id", stop_words: tuple[str, ...] = STOP_WORDS, features: int = 1000, top: int = 10) -> DataFrame:
    """cluster, term, weight, rank: words and pairs of words of at least two letters, without stop words.

    A cluster's vocabulary is its ``features`` most frequent terms; weights are
    tf * (ln((1 + n) / (1 + df)) + 1), each text's weights of norm 1, summed.

    Only what can be in the vocabulary is counted and shuffled: pairs of words
    that are as frequent as the last of the ``features`` most frequent words,
    then terms of the vocabulary, as one row for each text.
    """
    work = Work(docs.sparkSession, "terms")
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1)), lambda w: (F.length(w) >= 2) & ~w.isin(*stop_words))
    rows = work.keep(docs.filter(F.col(text).isNotNull() & F.col(cluster).isNotNull()).select(F.col(cluster).alias("c"), F.col(key).alias("k"), words.alias("w")), "words")
    line = Window.partitionBy("c").orderBy(F.desc("total"), "term")
    singles = rows.select("c", "k", F.explode("w").alias("term"))
    total = work.keep(singles.groupBy("c", "term").agg(F.count("*").alias("total")), "singles")
    # the last total of a full vocabulary of words: a pair below it isn't in the vocabulary, nor is one of a word below it
    last = total.withColumn("r", F.row_number().over(line)).filter(F.col("r") <= features).groupBy("c").agg(F.when(F.count("*") == features, F.min("total")).otherwise(0).alias("floor"))
    often = work.keep(total.join(last, "c").filter("total >= floor").select("c", "term"), "often")
    near = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = rows.select("c", "k", F.explode(F.filter(near, lambda p: p["b"].isNotNull())).alias("p")).select("c", "k", "p.a", "p.b")
    for side in ("a", "b"):
        pairs = pairs.join(_small(often).withColumnRenamed("term", side), ["c", side], "left_semi")
    pairs = pairs.select("c", "k", F.concat("a", F.lit(" "), "b").alias("term"))
    totals = total.unionByName(pairs.groupBy("c", "term").agg(F.count("*").alias("total")))
    vocabulary = work.keep(totals.withColumn("r", F.row_number().over(line)).filter(F.col("r") <= features).select("c", "term", "r"), "vocabulary")
    held = singles.unionByName(pairs).join(_small(vocabulary), ["c", "term"]).groupBy("c", "k", "r").agg(F.count("*").alias("tf"))
    tf = work.keep(held.groupBy("c", "k").agg(F.collect_list(F.struct("r", "tf")).alias("f")), "tf")  # a row for each text
    df = tf.select("c", F.explode("f.r").alias("r")).groupBy("c", "r").agg(F.count("*").alias("df"))
    n = rows.groupBy("c").agg(F.count("*").alias("n"))
    idf = work.keep(df.join(n, "c").select("c", "r", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    x = lambda rows: rows.withColumn("e", F.explode("f")).withColumn("r", F.col("e.r")).join(_small(idf), ["c", "r"]).withColumn("x", F.col("e.tf") * F.col("idf"))
    norms = x(tf).groupBy("c", "k").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    sums = x(tf.join(norms, ["c", "k"])).groupBy("c", "r").agg(F.round(F.sum(F.col("x") / F.col("norm")), 6).alias("weight"))
    named = sums.join(vocabulary, ["c", "r"]).select(F.col("c").alias(cluster), "term", "weight")
    order = Window.partitionBy(cluster).orderBy(F.desc("weight"), "term")
    return named.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)


def labels(terms: DataFrame, cluster: str) -> DataFrame:
    """A deterministic name: the three heaviest terms; keywords: all."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    found = terms.groupBy(cluster).agg(F.transform(ordered, lambda x: x["term"]).alias("t"))
    return found.select(cluster, F.array_join(F.slice("t", 1, 3), " / ").alias("label"), F.array_join("t", ", ").alias("keywords"))


def top_titles(docs: DataFrame, cluster: str, title: str, cited: str, key: str, n: int = 5) -> DataFrame:
    line = Window.partitionBy(cluster).orderBy(F.desc(cited), key)
    return docs.withColumn("rank", F.row_number().over(line).cast("long")).filter(F.col("rank") <= n).select(cluster, "rank", key, title, cited)

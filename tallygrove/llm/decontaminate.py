"""Benchmark decontamination by winnowing.

Every text is cut into words.  Of the ``k``-gram hashes in each window of
``span`` words the smallest (the last of equal ones) is selected; what windows
next to each other select is mostly one place, so about two places in
``span - k + 2`` are.  These are a text's fingerprints.  A window that two texts
share selects the same place in both, so every shared span of ``span`` words or
more is found at a shared fingerprint.

Fingerprints of the benchmark and of the corpus are joined, and a hit is then
extended to both sides: ``span - k`` words are missing, and each way to part them
between left and right gives one run of ``span`` words.  Runs are joined word for
word with those of the benchmark, so hashes choose what is compared and the words
decide; what the runs of a place cover together is hit.  A run is one row of the
benchmark's side, whatever surrounds it, so neither a common phrase nor a common
run pairs the surroundings of both sides.  Equal surroundings are one row.

A benchmark text of fewer than ``span`` words is one window of its own length.
Corpus fingerprints that the benchmark doesn't have are left out where they
arise: its fingerprints are a mapped set, of any size.

A passage that a third of all texts quote is one row until its answer is joined
back to its places; there it is a hot key of the left side, which adaptive
execution splits.

Defined results: null text has no words; an item without words has no window;
a null item id contaminates but is not listed; repeated rows (equal ids
included) are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .counts import Counts, hashed, stored, without
from .shared import RangeHash, in_arrow, lower_ascii, mix, pieces, runs, settle, table

SPAN = 13
K = 7

_WORD = np.ones(256, bool)
_WORD[0x00:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False
_FACTOR = np.uint64(0x9FB21C651E98DF25)
#: What joins the places of a corpus text with those of the benchmark.
_KEY = ("n", "fp", "lead", "context")
#: What a run of n equal words is known by.
_RUN = ("n", "fp", "other_lead", "other")
_PLACES = "at array<long>, n array<int>, fp array<long>, lead array<int>, context array<string>"


class Words:
    """The words of a piece: where they are, their hashes, and the number of words before each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lowered = lower_ascii(data)
        self.starts, self.ends, self.before = runs(_WORD[lowered], offsets)
        self.hashes, self.flat = RangeHash(lowered).of(self.starts, self.ends), lowered.tobytes()

    def text(self, first: int, end: int) -> str:
        return b" ".join([self.flat[a:b] for a, b in zip(self.starts[first:end].tolist(), self.ends[first:end].tolist())]).decode()


def winnowed(hashes: np.ndarray, before: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that windows of n words select, and the hashes of the k-grams there."""
    k, top = min(k, n), len(hashes) - n + 1
    if top < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        gram = gram * _FACTOR + hashes[i : i + len(gram)]
    gram = mix(gram + np.uint64(n))
    least, place = gram[:top].copy(), np.arange(top)
    for i in range(1, n - k + 1):
        other = gram[i : i + top]
        better = other <= least
        np.copyto(least, other, where=better)
        np.copyto(place, np.arange(i, i + top), where=better)
    row_end = np.repeat(before[1:], np.diff(before))  # of each word's row
    chosen = np.unique(place[np.arange(top) + n <= row_end[:top]])
    return chosen, gram[chosen]


def _places(words: Words, n: int, k: int, wanted: Counts | None = None) -> list:
    """(row, place in the row, n, fingerprint, words before the place in the context, context) of selected places."""
    at, fp = winnowed(words.hashes, words.before, n, k)
    if wanted is not None:
        hit = wanted.of(mix(fp), mix(fp)) > 0
        at, fp = at[hit], fp[hit]
    row = np.searchsorted(words.before, at, "right") - 1
    reach = n - min(k, n)
    first = np.maximum(at - reach, words.before[row])
    end = np.minimum(at + n, words.before[row + 1])
    return [row, at - words.before[row], np.full(len(at), n, np.int32), fp.view(np.int64), (at - first).astype(np.int32), [words.text(a, b) for a, b in zip(first.tolist(), end.tolist())]]


def _item_places(batches, span: int, k: int):
    for rows, data, offsets in pieces(batches, "text"):
        sizes = np.minimum(np.diff(Words(data, offsets).before), span)
        for n in np.unique(sizes[sizes > 0]):
            keep = np.flatnonzero(sizes == n)
            part = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in keep])
            row, _, *rest = _places(Words(part, np.concatenate([[0], np.cumsum(np.diff(offsets)[keep])])), int(n), k)
            yield pa.RecordBatch.from_arrays([rows.column("item_id").take(pa.array(keep[row])), *[pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.int64(), pa.int32(), pa.string()))]], ["item_id", *_KEY])


def item_fingerprints(items: DataFrame, text_col: str = "text", id_col: str = "item_id", span: int = SPAN, k: int = K) -> DataFrame:
    """item_id, n words of a window, fingerprint fp, and its surroundings: lead words and what follows, as context."""
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.transform(in_arrow, partial(_item_places, span=span, k=k), "item_id string, n int, fp long, lead int, context string")


def _scan(batches, wanted: Counts, lengths: list[int], k: int):
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string())
    for rows, data, offsets in pieces(batches, "text"):
        words = Words(data, offsets)
        found = [_places(words, n, k, wanted) for n in lengths]
        row = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(row, kind="stable")
        cut = pa.array(np.searchsorted(row[order], np.arange(rows.num_rows + 1)).astype(np.int32))
        columns = [[x for f in found for x in (f[i].tolist() if isinstance(f[i], np.ndarray) else f[i])] for i in range(1, 6)]
        lists = [pa.ListArray.from_arrays(cut, pa.array([column[i] for i in order], kind)) for column, kind in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays([rows.column("rid"), rows.column("doc_id"), pa.array(np.diff(words.before).astype(np.int64)), *lists], ["rid", "doc_id", "n_words", "at", *_KEY])


def windows(places: DataFrame, k: int = K, extra: tuple[str, ...] = ()) -> DataFrame:
    """Each way to extend a place's gram to n words: other_lead words to the left, the rest to the right; other is what stands there."""
    size = F.least(F.col("n"), F.lit(k))
    split = lambda i: F.when(
        (F.col("lead") >= i) & (F.size("words") - F.col("lead") + i >= F.col("n")),
        F.struct(i.alias("other_lead"), F.array_join(F.slice("words", F.col("lead") - i + 1, F.col("n")), " ").alias("other")),
    )
    found = places.select(*extra, *_KEY).distinct().withColumn("words", F.split("context", " "))
    found = found.withColumn("w", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.col("n") - size), split), lambda w: w.isNotNull())))
    return found.select(*extra, *_KEY, "w.other_lead", "w.other")


def matches(asked: DataFrame, known: DataFrame, k: int = K) -> DataFrame:
    """Surroundings asked for (n, fp, lead, context) with each known run of n words in them: it is ``other``, lo to hi about the fingerprint.

    A run is one row of the known ones, whatever stands around it, so no surroundings are paired.
    """
    runs = windows(known, k).select(*_RUN).distinct()
    return windows(asked, k).join(runs, list(_RUN)).select(*_KEY, "other_lead", "other", (-F.col("other_lead")).alias("lo"), (F.col("n") - F.col("other_lead")).alias("hi"))


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text", item_id_col: str = "item_id", span: int = SPAN, k: int = K) -> DataFrame:
    """For each row of ``docs``: rid, doc_id, n_words, n_hit, n_items, items (sorted ids).

    ``rid`` names the input row of this call, so repeated ids stay apart.
    """
    known = settle(item_fingerprints(items, item_text_col, item_id_col, span, k), "winnow-items")
    wanted = stored(known.select("fp", F.col("fp").alias("again")).distinct())
    lengths = sorted(r[0] for r in known.select("n").distinct().collect())  # at most ``span`` rows
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    scanned = settle(rows.transform(in_arrow, partial(_scan, wanted=wanted, lengths=lengths, k=k), f"rid long, doc_id {kind}, n_words long, {_PLACES}"), "winnow-docs")
    places = scanned.filter(F.size("at") > 0).select("rid", F.explode(F.arrays_zip("at", *_KEY)).alias("p")).select("rid", "p.*")
    matched = settle(matches(places, known, k), "winnow-matches")
    # the items that hold a run stand together as one list; all runs of a place hold its gram, so together they are one run
    holders = windows(known, k, ("item_id",)).groupBy(*_RUN).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    answers = matched.join(holders, list(_RUN)).groupBy(*_KEY).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = places.join(answers, list(_KEY)).select("rid", F.struct((F.col("at") + F.col("lo")).alias("from"), (F.col("at") + F.col("hi")).alias("to")).alias("run"), "items")
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))
    unite = lambda acc, r: F.struct(
        F.greatest(acc["end"], r["to"]).alias("end"),
        (acc["total"] + F.greatest(F.lit(0).cast("long"), r["to"] - F.greatest(acc["end"], r["from"]))).alias("total"),
    )
    total = F.aggregate(F.array_sort(F.collect_set("run")), start, unite)["total"]
    by_row = hits.groupBy("rid").agg(total.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return (
        scanned.select("rid", "doc_id", "n_words")
        .join(by_row, "rid", "left")
        .select("rid", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> Column:
    """At least one hit word, and one word in twenty or more."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns.

    The verdict is the text's, so it goes by two 64-bit hashes of it; texts are
    filtered where they are and never shuffled.
    """
    text = F.col(f"`{text_col}`").cast("string")
    key = hashed(text.isNull(), text)
    judged = contamination(docs.select(F.struct(key[0].alias("k1"), key[1].alias("k2")).alias("key"), text.alias("text")), items, "text", "key").filter(contaminated())
    return without(docs, key, stored(judged.select("doc_id.k1", "doc_id.k2")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


_TOKENS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TOKENS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_TOKENS.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {SPAN}) AS n, array_to_string(w[i : i + least(len(w), {SPAN}) - 1], ' ') AS gram
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {SPAN} + 2, 2))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT rid, i, n, item_id FROM dw JOIN bw USING (n, gram)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

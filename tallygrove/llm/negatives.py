"""Hard negatives by rotated one-bit codes.

Every vector is put on whole numbers, rotated (random signs and Hadamard
transforms, twice) and kept as the signs of its coordinates, one bit each, with
its length and its alignment: the inner product of the rotated vector and the
unit vector of its code.  The index is a table of these beside the numbers.

An anchor's rotated coordinates are rounded to ``PLANES`` bits, so its product
with a code comes from a popcount for each bit.  A row is its alignment times
its code plus a remainder at right angles to it, and by Cauchy-Schwarz the
remainder adds no more than its length times that of the anchor's part at right
angles to the code; rounding adds no more than the length of what it took away.
So the score lies in an interval that never fails, and only rows whose interval
reaches what is asked for are scored, in whole numbers.

Anchors go through all rows in blocks, which are mapped files; rows aren't
shuffled.  A chunk of rows hands on the best few of each anchor.

Defined results: rows without an id, a label or a vector, or with a component
that is null or not finite, take no part.  Shorter vectors count as followed by
zeros.  Rows that share an id with an anchor are that anchor, and of several such
the one with the smallest label, then vector, asks; other repeated rows count as
often as they stand there.  Scores beyond 2**53 in size are refused.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .eliasfano import pack, unpack
from .shared import Opened, in_arrow, put_file, settle, table, work_folder

SCALE = 256
PLANES = 6
#: Rows of a chunk, rows of a step, and anchors of a block.
CHUNK, STEP, ANCHORS = 1 << 16, 1 << 12, 1 << 8
INDEX = "vec_id long, label long, numbers array<double>, code binary, length double, alignment double"
_EXACT = 2.0**53


# ---- codes --------------------------------------------------------------------------------


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows, padded to a power of two of at least 64, by a fixed random rotation."""
    size = max(64, 1 << max(0, x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng(13)
    for _ in range(2):
        y *= rng.integers(0, 2, size) * 2.0 - 1.0
        half = 1
        while half < size:
            z = y.reshape(len(y), -1, 2, half)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(len(y), size)
            half *= 2
        y /= np.sqrt(size)
    return y


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits in words, lengths, alignments."""
    y = rotated(x)
    bits = np.packbits(y >= 0, axis=1, bitorder="little").view(np.uint64)
    return bits, np.sqrt((x * x).sum(1)), np.abs(y).sum(1) / np.sqrt(y.shape[1])


class Planes:
    """Anchors' rotated coordinates rounded to a few bits: a word row for each bit."""

    def __init__(self, x: np.ndarray):
        y = rotated(x)
        self.size = y.shape[1]
        self.low = y.min(1, initial=0)
        self.step = np.maximum((y.max(1, initial=0) - self.low) / ((1 << PLANES) - 1), 1e-300)
        level = np.clip(np.rint((y - self.low[:, None]) / self.step[:, None]), 0, (1 << PLANES) - 1).astype(np.uint8)
        self.total = level.sum(1, dtype=np.int64)
        self.bits = np.stack([np.packbits(level >> i & 1, axis=1, bitorder="little").view(np.uint64) for i in range(PLANES)])
        self.lost = np.sqrt(((y - self.low[:, None] - self.step[:, None] * level) ** 2).sum(1))
        self.length = np.sqrt((x * x).sum(1))

    def bounds(self, code: np.ndarray, length: np.ndarray, alignment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of each row with each anchor."""
        inside = np.zeros((len(code), len(self.low)), np.int64)
        for i in range(PLANES):
            both = code[:, None, :] & self.bits[i][None, :, :]
            inside += np.bitwise_count(both).sum(2, dtype=np.int64) << i
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)[:, None]
        near = (self.low * (2 * ones - self.size) + self.step * (2 * inside - self.total)) / np.sqrt(self.size)
        across = np.sqrt(np.maximum(self.length**2 - np.maximum(np.abs(near) - self.lost, 0) ** 2, 0))
        rest = np.sqrt(np.maximum(length**2 - alignment**2, 0))[:, None]
        wide = alignment[:, None] * self.lost + rest * across
        wide += 1e-6 * (1 + length[:, None] * self.length)  # what floating point may lose
        middle = alignment[:, None] * near
        return middle - wide, middle + wide


# ---- the index ----------------------------------------------------------------------------


def _lists(column: pa.Array, size: int) -> np.ndarray:
    """Rows of numbers, followed by zeros up to ``size``."""
    column = pa.concat_arrays([column.cast(pa.large_list(pa.float64()))])
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    many = np.diff(offsets)
    if len(many) and (many == size).all():
        return values[offsets[0] : offsets[-1]].reshape(len(many), size)
    out = np.zeros((len(many), size))
    for i, (s, e) in enumerate(zip(offsets[:-1], offsets[1:])):
        out[i, : e - s] = values[s:e]
    return out


def _indexed(batches, size: int):
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            x = np.floor(_lists(part.column("vector"), size) * SCALE)
            bits, length, alignment = codes(x)
            numbers = pa.ListArray.from_arrays(np.arange(0, x.size + 1, max(1, size))[: len(x) + 1].astype(np.int32) if size else np.zeros(len(x) + 1, np.int32), x.ravel())
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), part.column("label"), numbers, pa.array([r.tobytes() for r in bits], pa.binary()), pa.array(length), pa.array(alignment)],
                ["vec_id", "label", "numbers", "code", "length", "alignment"],
            )


def index(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """The index of all rows that take part, as a table."""
    taken = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    taken = taken.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", real))
    size = taken.agg(F.max(F.size("vector"))).first()[0] or 0
    return settle(taken.transform(in_arrow, partial(_indexed, size=size), INDEX), "codes")


# ---- blocks of anchors --------------------------------------------------------------------


def _write(group: pa.Table, folder: str) -> pa.Table:
    block = group.column("block")[0].as_py()
    columns = {name: group.column(name).combine_chunks() for name in group.column_names}
    size = max((len(x) for x in columns["numbers"]), default=0)
    arrays = {"vec_id": columns["vec_id"].to_numpy(), "label": columns["label"].to_numpy(), "numbers": _lists(columns["numbers"], size).ravel()}
    if "positives" in columns:  # (id, score) in rank order
        rows = [[(p["id"], p["score"]) for p in x.as_py()] for x in columns["positives"]]
        most = max(map(len, rows))
        filled = np.array([[*r, *[(0, 0)] * (most - len(r))] for r in rows], np.int64).reshape(len(rows), most, 2)
        arrays |= {"many": np.array([len(r) for r in rows], np.int64), "positive": filled[:, :, 0].ravel(), "score": filled[:, :, 1].ravel()}
    put_file(f"{folder}/{block}", pack(arrays, size=size))
    return pa.table({"block": pa.array([block], pa.int64())})


class Blocks:
    """Anchors in mapped files of about ``ANCHORS`` each."""

    def __init__(self, anchors: DataFrame, name: str):
        n = max(1, -(-anchors.count() // ANCHORS))
        self.folder, self.files = work_folder(anchors.sparkSession, name), Opened(4)
        folder = self.folder
        dealt = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
        found = dealt.groupBy("block").applyInArrow(lambda group: _write(group, folder), "block long").collect()  # a number for each block
        self.names = sorted(r.block for r in found)

    def __iter__(self):
        for name in self.names:
            arrays, values = self.files.get(f"{self.folder}/{name}", unpack)
            yield arrays, np.array(arrays["numbers"]).reshape(len(arrays["vec_id"]), values["size"])


# ---- search -------------------------------------------------------------------------------


class _Chunk:
    """Rows of the index that a task goes through at once."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches).combine_chunks()
        column = lambda name: rows.column(name).combine_chunks()
        numbers = column("numbers")
        self.x = _lists(numbers, max((len(x) for x in numbers[:1]), default=0))
        self.vec_id, self.label, self.length, self.alignment = (column(c).to_numpy() for c in ("vec_id", "label", "length", "alignment"))
        self.code = np.frombuffer(b"".join(column("code").to_pylist()), np.uint64).reshape(len(rows), -1)

    def steps(self):
        for at in range(0, len(self.vec_id), STEP):
            yield slice(at, at + STEP)

    def scores(self, rows: np.ndarray, anchors: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Whole-number products of pairs of rows and anchors; exact, since every partial sum is below 2**53."""
        out = np.empty(len(rows), np.int64)
        for at in range(0, len(rows), STEP):
            r, q = self.x[rows[at : at + STEP]], x[anchors[at : at + STEP]]
            if (np.abs(r) * np.abs(q)).sum(1).max(initial=0) >= _EXACT:
                raise OverflowError("a score beyond 2**53")
            out[at : at + STEP] = np.einsum("ij,ij->i", r, q).astype(np.int64)
        return out


def _chunks(batches):
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            held.append(batch.slice(at, CHUNK))
            size += held[-1].num_rows
            if size >= CHUNK:
                yield _Chunk(held)
                held, size = [], 0
    if size:
        yield _Chunk(held)


def _best(of: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int, kept: tuple | None, n: int) -> tuple[tuple, np.ndarray]:
    """The first ``k`` of each ``of`` among these and those kept before, and the last score of those that have so many (else the least)."""
    if kept is not None:
        of, score, vec_id = (np.concatenate(x) for x in zip(kept, (of, score, vec_id)))
    order = np.lexsort((vec_id, -score, of))
    of, score, vec_id = of[order], score[order], vec_id[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    keep = rank < k
    least = np.full(n, np.iinfo(np.int64).min)
    least[of[rank == k - 1]] = score[rank == k - 1]
    return (of[keep], score[keep], vec_id[keep]), least


def _positives(batches, anchors: Blocks, k: int):
    for chunk in _chunks(batches):
        for arrays, x in anchors:
            planes, n = Planes(x), len(x)
            kept, least = None, np.full(n, np.iinfo(np.int64).min)
            for rows in chunk.steps():
                low, high = planes.bounds(chunk.code[rows], chunk.length[rows], chunk.alignment[rows])
                fit = (chunk.label[rows][:, None] == arrays["label"]) & (chunk.vec_id[rows][:, None] != arrays["vec_id"])
                low[~fit], high[~fit] = -np.inf, -np.inf
                # k rows reach their least scores at least, so what can't reach the k-th of these isn't among the first k
                reach = np.maximum(np.partition(low, -k, 0)[-k] if len(low) >= k else -np.inf, least)
                row, at = np.nonzero(fit & (high >= reach))
                row += rows.start
                kept, least = _best(at, chunk.scores(row, at, x), chunk.vec_id[row], k, kept, n)
            at, score, vec_id = kept
            yield pa.RecordBatch.from_arrays([pa.array(arrays["vec_id"][at]), pa.array(vec_id), pa.array(score)], ["anchor_id", "positive_id", "positive_score"])


def _negatives(batches, anchors: Blocks, k: int, low_share: int, high_share: int):
    for chunk in _chunks(batches):
        for arrays, x in anchors:
            planes, n, most = Planes(x), len(x), len(arrays["positive"]) // len(x)
            many, positive, goal = (np.array(arrays[name]) for name in ("many", "positive", "score"))
            goal, there = goal.reshape(n, most), np.arange(most) < many[:, None]
            kept, least = None, np.full(n * most, np.iinfo(np.int64).min)
            for rows in chunk.steps():
                low, high = planes.bounds(chunk.code[rows], chunk.length[rows], chunk.alignment[rows])
                apart = (chunk.label[rows][:, None] != arrays["label"]) & (chunk.vec_id[rows][:, None] != arrays["vec_id"])
                wanted = np.zeros_like(apart)
                for p in range(most):
                    floor = np.maximum(goal[:, p] * (low_share / 100), least.reshape(n, most)[:, p])
                    wanted |= there[:, p] & (high >= floor) & (low <= goal[:, p] * (high_share / 100))
                row, at = np.nonzero(apart & wanted)
                row += rows.start
                score = chunk.scores(row, at, x)
                found = []
                for p in range(most):
                    fit = np.flatnonzero(there[at, p] & (low_share * goal[at, p] <= 100 * score) & (100 * score <= high_share * goal[at, p]))
                    found.append((at[fit] * most + p, score[fit], chunk.vec_id[row[fit]]))
                kept, least = _best(*(np.concatenate(c) for c in zip(*found)), k, kept, n * most)
            of, score, vec_id = kept
            ids = [arrays["vec_id"][of // most], (of % most).astype(np.int32), positive[of], vec_id, goal.ravel()[of], score]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in ids], ["anchor_id", "slot", "positive_id", "negative_id", "positive_score", "negative_score"])


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low_share: int = 80, high_share: int = 100, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Of each anchor (``is_anchor`` over ``vec_id`` and ``label``) the first
    ``positives`` rows of its label, and for each of them the first
    ``negatives`` rows of other labels whose score is between the given
    percentages of the positive's.  Higher scores come first, equal ones by id.
    """
    known = index(rows, id_col, label_col, vector_col)
    asked = known.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "numbers")).alias("first")).select("vec_id", "first.label", "first.numbers")
    asked = settle(asked, "anchors")
    line = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = known.transform(in_arrow, partial(_positives, anchors=Blocks(asked, "anchors"), k=positives), "anchor_id long, positive_id long, positive_score long")
    near = near.withColumn("slot", F.row_number().over(line)).filter(F.col("slot") <= positives)
    item = F.struct("slot", F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))
    lists = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(item)).alias("positives"))  # ``positives`` entries each
    asked = settle(asked.join(lists, "vec_id"), "anchors")
    work = partial(_negatives, anchors=Blocks(asked, "anchors"), k=negatives, low_share=low_share, high_share=high_share)
    found = known.transform(in_arrow, work, "anchor_id long, slot int, positive_id long, negative_id long, positive_score long, negative_score long")
    line = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", shifted.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, r.vec_id, q.label = r.label AS same, CAST(list_dot_product(q.x, r.x) AS BIGINT) AS score FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5"""

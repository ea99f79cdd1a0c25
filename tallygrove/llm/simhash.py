"""SimHash near-duplicates, verified through pivot distance tables.

A fingerprint's Hamming distances to many fixed reference fingerprints (the
pivots) are its coordinates.  By the triangle inequality two fingerprints
within ``radius`` bits differ by at most ``radius`` in every coordinate, so a
pair with a larger difference anywhere is discarded unseen; the pairs that
survive are verified bit by bit.

Pairs are only formed within buckets: the 64 bits are cut into blocks, and
fingerprints within ``radius`` bits agree on at least ``blocks - radius`` whole
blocks, so every choice of so many blocks is one bucket key and no link is
lost.  In a bucket, rows are swept in the order of their first coordinate.
A bucket above ``BUCKET`` rows is dealt out as pairs of sub-buckets, so a row
is copied once for each ``BUCKET`` rows.  Where that is more than its neighbours
in the free bits of the bucket's key are (``DENSE``), the neighbours are listed
instead: fingerprints within three bits are those one of which is within one
bit, the other within two of some value, so each value's are a star, and the
rows are a fixed number for each fingerprint, however large the bucket.  Equal
fingerprints are one node from the start, and links of a task leave it as stars
of its own components, so a group of copies never becomes all its pairs.

Defined results: null text has no words and fingerprint zero, which links like
any other; a null document id gets a fingerprint and a component but never
names one; repeated rows are returned as often as they stand there; ids may be
of any type with an order; other columns are ignored.  ``keep_first`` decides
row by row: unlike texts of one id are judged apart, and of repeated rows one
stays.
"""

from __future__ import annotations

from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .counts import hashed, having, stored, without
from .shared import in_arrow, mix, pieces, settle, table

RADIUS = 3
BLOCKS = 5
PIVOTS = 32
BUCKET = 4096
#: Rows of a bucket above which a row has fewer neighbours in its free bits (39 of them: 781 within two) than the bucket has sub-buckets.
DENSE = 781 * BUCKET
SEED = 42
SHINGLE = 3
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit by bit the majority of the shingles' XXH64."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(flat, SEED)]
    else:
        hashes = [digest(flat[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])]
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches, shingle: int):
    for rows, data, offsets in pieces(batches, "text"):
        flat = data.tobytes()
        found = np.array([fingerprint(flat[a:b], shingle) for a, b in zip(offsets[:-1], offsets[1:])], np.uint64)
        yield pa.RecordBatch.from_arrays([*[c for c, f in zip(rows.columns, rows.schema) if f.name != "text"], pa.array(found.view(np.int64))], [*[f.name for f in rows.schema if f.name != "text"], "fp"])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and its 64-bit fingerprint as a long."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(in_arrow, partial(_fingerprints, shingle=shingle), f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int, blocks: int) -> list[int]:
    """The bits of every choice of blocks that near fingerprints may agree on."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(block, blocks - radius)]


PIVOT_TABLE = mix(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def sweep(cell: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the links between fingerprints of the same cell: (centre, member)."""
    values, node = np.unique(fp, return_inverse=True)
    distance = np.bitwise_count(values[:, None] ^ PIVOT_TABLE[None, :]).astype(np.int8)
    order = np.lexsort((distance[node, 0], cell))
    cell, node = cell[order], node[order]
    first = distance[node, 0]
    root = np.arange(len(values))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    at, shift = np.arange(len(cell)), 1
    while True:
        at = at[at + shift < len(cell)]
        at = at[(cell[at] == cell[at + shift]) & (first[at + shift] - first[at] <= radius)]
        if not len(at):
            break
        a, b = node[at], node[at + shift]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        for block in range(0, len(a), 1 << 16):
            x, y = a[block : block + (1 << 16)], b[block : block + (1 << 16)]
            near = np.abs(distance[x] - distance[y]).max(axis=1) <= radius
            x, y = x[near], y[near]
            near = np.bitwise_count(values[x] ^ values[y]) <= radius
            for p, q in zip(x[near].tolist(), y[near].tolist()):
                p, q = top(p), top(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
        while not np.array_equal(root, up := root[root]):
            root[:] = up
        shift += 1
    member = np.flatnonzero(root != np.arange(len(root)))
    return values[root[member]], values[member]


def _links(batches, radius: int, rows_at_once: int = 1 << 18):
    """Cells arrive whole and in order; a buffer is swept when its last cell is complete."""
    held: list[np.ndarray] = []
    size = 0

    def flush(rows: np.ndarray):
        change = np.any(rows[1:, :4] != rows[:-1, :4], axis=1)
        centre, member = sweep(np.concatenate([[0], np.cumsum(change)]), rows[:, 4].astype(np.int64).view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(centre.view(np.int64)), pa.array(member.view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1))
        size += batch.num_rows
        if size >= rows_at_once:
            rows = np.concatenate(held)
            before = np.flatnonzero(np.any(rows[:, :4] != rows[-1, :4], axis=1))
            end = int(before[-1]) + 1 if len(before) else 0
            if end:
                yield flush(rows[:end])
            held, size = [rows[end:]], len(rows) - end
    if size:
        yield flush(np.concatenate(held))


def _stars(rows: DataFrame, radius: int, chosen: list[int]) -> DataFrame:
    """Links of whole buckets by values near their fingerprints: (a, b), linear in the rows."""
    inner = radius // 2
    free = F.create_map(*[x for m in chosen for x in (F.lit(_signed(m)), F.array(*[F.lit(i) for i in range(64) if not m >> i & 1]))])

    def flips(most: int) -> F.Column:
        """Every choice of at most so many of the free bits: (bits, n of them, the highest one's place)."""
        choice = lambda bits, n, top: F.struct(bits.alias("bits"), F.lit(n).alias("n"), top.alias("top"))
        out = [F.array(choice(F.lit(0).cast("long"), 0, F.lit(-1)))]
        for n in range(1, most + 1):
            more = lambda c, n=n: F.transform(F.filter(F.element_at(free, F.col("mask")), lambda i: i > c["top"]), lambda i: choice(c["bits"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)), n, i))
            out.append(F.flatten(F.transform(out[-1], more)))
        return F.concat(*out)

    near = rows.select("mask", "fp", F.explode(flips(radius - inner)).alias("c")).select("mask", F.col("fp").bitwiseXOR(F.col("c.bits")).alias("x"), "fp", F.col("c.n").alias("n"))
    near = settle(near, "simhash-near")
    centres = near.filter(F.col("n") <= inner).groupBy("mask", "x").agg(F.min("fp").alias("a"))
    return near.join(centres, ["mask", "x"]).filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bucket: int = BUCKET, dense: int = DENSE) -> DataFrame:
    """Distinct fingerprints fp -> links (a, b) whose closure is that of all pairs within ``radius`` bits."""
    chosen = masks(radius, blocks)
    rows = settle(fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in chosen])).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp"), "simhash-keys")
    sizes = settle(rows.groupBy("mask", "part").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-buckets")
    parts = F.ceil(F.col("n") / bucket)
    own = F.pmod(F.xxhash64("fp", F.lit(7)), parts)
    cells = rows.join(sizes.filter(F.col("n") <= dense), ["mask", "part"]).select("mask", "part", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    cells = cells.select("mask", "part", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    cell = ["mask", "part", "x", "y"]
    swept = cells.repartition(*cell).sortWithinPartitions(*cell).transform(in_arrow, partial(_links, radius=radius), "a long, b long")
    large = sizes.filter(F.col("n") > dense)
    if large.isEmpty():
        return swept
    return swept.unionByName(_stars(rows.join(large.select("mask", "part"), ["mask", "part"]), radius, chosen))


def _labels(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct (fp, ...) -> the same and label, the fingerprint that names its component."""
    named = components(links(distinct, radius)).select(F.col("node").alias("fp"), "label")
    return distinct.join(named, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id: the smallest id among documents that links reach."""
    found = settle(fingerprints(docs, text_col, id_col, shingle), "simhash-fingerprints")
    distinct = settle(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    labelled = settle(_labels(distinct, radius), "simhash-labels")
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    return found.join(labelled.join(least, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component, that with the smallest id; rows without an id stay.

    A row is known by the hashes of its id and text.  Of rows of one component
    with the smallest id, that with the smallest hashes stays, and of rows with
    equal id and text one.  Rows that stay are looked up where they are; only
    those that are repeated whole are shuffled, to make them one.
    """
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    key = hashed(id_.isNull(), id_.cast("string"), text.isNull(), text)
    rows = docs.select(id_.alias("doc_id"), text.alias("text"), key[0].alias("k1"), key[1].alias("k2"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = settle(rows.transform(in_arrow, partial(_fingerprints, shingle=shingle), f"doc_id {kind}, k1 long, k2 long, fp long"), "simhash-fingerprints")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "k1", "k2"))).alias("first")
    distinct = settle(found.groupBy("fp").agg(first), "simhash-distinct")
    leaders = settle(_labels(distinct, radius).groupBy("label").agg(F.min("first").alias("first")).filter("first is not null").select("first.*"), "simhash-leaders")
    nameless = found.filter("doc_id is null").select("k1", "k2").distinct()
    kept = having(docs, key, stored(leaders.select("k1", "k2").unionByName(nameless)))
    repeated = settle(found.filter("doc_id is not null").groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").join(leaders, ["k1", "k2"], "left_semi").select("k1", "k2"), "simhash-repeated")
    if repeated.isEmpty():
        return kept
    known = stored(repeated)
    twice = having(kept, key, known)
    return without(kept, key, known).unionByName(twice.dropDuplicates([id_col, text_col]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

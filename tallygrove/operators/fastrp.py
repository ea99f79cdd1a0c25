"""Embeddings of graph nodes by fast random projection.

Where tasks can map files of the shared folder, a round looks its neighbours up
there (``gathered``).  Elsewhere it is a product of a blocked sparse matrix and
blocks of vectors, as follows.

Nodes are dealt to blocks by ranges of their names, since names that are near
often have neighbours in common, and numbered within them; a block's vectors are
one binary value.  Edges are packed once: by the block of their far end, ordered
by their near end, in rows of bounded length; a block with many edges is several
cells, each with a copy of its vectors.  A round joins these rows to the blocks,
adds vectors up by near end in numpy, and shuffles the partial sums once, to the
near ends' blocks, where they stream into one accumulator of a block's size.
Dimensions don't meet before the length is taken, so a large graph goes through
the rounds a few dimensions at a time: only these are shuffled at once.  Signs are
kept as bits; sums of the last round are appended to one table in buckets of
blocks, where a block's dimensions meet again without a shuffle.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import mounted
from ..sources.work import Work
from . import gathered

#: Bytes of a block of vectors, edges of a packed row, and edges whose vectors are gathered at once.
BLOCK_BYTES, EDGES, STEP = 1 << 23, 1 << 20, 1 << 13
#: Bytes of all edges' vectors from which dimensions are divided, and the most parts they are divided into.
PART_BYTES, PARTS = 1 << 31, 8
#: Vectors of all nodes up to this many bytes are brought to the edges instead of shuffled with them.
BROADCAST_BYTES = 1 << 25
_LOW = np.int64(0xFFFFFFFF)


def _start(group: pa.Table, dim: int) -> pa.Table:
    """block, names, degrees, r: a block's nodes in order, and bits for their random signs from digests of node and dimension."""
    group = group.sort_by("at")
    names = group.column("node").combine_chunks()
    positive = group.column("positive").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    bits = np.packbits(positive.reshape(-1, dim), axis=1)
    return pa.table({"block": group.column("block")[:1], "names": pa.array([names.to_pylist()], pa.list_(pa.string())), "degrees": [group.column("n").to_numpy().tobytes()], "r": [bits.tobytes()]})


def _signs(r, dim: int, first: int, last: int) -> np.ndarray:
    """Dimensions ``first`` to ``last`` of a block's random signs, scaled."""
    bits = np.frombuffer(r.as_buffer(), np.uint8).reshape(-1, -(-dim // 8))
    return np.where(np.unpackbits(bits, axis=1, count=dim)[:, first:last], dim**-0.5, -(dim**-0.5))


def _packed(batches):
    """block, src, dst: sorted edges in rows that keep to a block of far ends."""
    held, block, size = [], None, 0

    def out():
        src, dst = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([src.tobytes()]), pa.array([dst.astype(np.int32).tobytes()])], ["block", "src", "dst"])

    for batch in batches:
        blocks, src, dst = (c.to_numpy() for c in batch.columns)
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        for s, e in zip([0, *cuts], [*cuts, len(blocks)]):
            if size and (blocks[s] != block or size >= EDGES):
                yield out()
                held, size = [], 0
            if e > s:
                block = blocks[s]
                held.append((src[s:e], dst[s:e]))
                size += e - s
    if size:
        yield out()


def _sent(batches, dim: int, signs=None):
    """block, kind, at, x: sums of far ends' vectors (with ``signs``, of what it makes of bits) for each near end, in rows of one block."""
    for batch in batches:
        for src, dst, v in zip(*(batch.column(c) for c in ("src", "dst", "v"))):
            src, dst = np.frombuffer(src.as_buffer(), np.int64), np.frombuffer(dst.as_buffer(), np.int32)
            vectors = signs(v) if signs else np.frombuffer(v.as_buffer(), np.float64).reshape(-1, dim)
            for s in range(0, len(src), STEP):
                near = src[s : s + STEP]
                head = np.flatnonzero(np.diff(near, prepend=-1))
                sums = np.add.reduceat(vectors[dst[s : s + STEP]], head)
                near = near[head]
                cuts = np.flatnonzero(np.diff(near >> 32)) + 1
                for a, e in zip([0, *cuts], [*cuts, len(near)]):
                    values = [[near[a] >> 32], [1], [(near[a:e] & _LOW).astype(np.int32).tobytes()], [sums[a:e].tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(values[0], pa.int64()), pa.array(values[1], pa.int32()), *map(pa.array, values[2:])], ["block", "kind", "at", "x"])


def _summed(batches, dim: int, signs):
    """block, v: means of the partial sums that follow a block's first row, plus its signs."""
    block = None

    def out():
        v = total / degrees[:, None] + own
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([v.tobytes()])], ["block", "v"])

    for batch in batches:
        for name, kind, at, x in zip(*batch.columns):
            if kind.as_py() == 0:
                if block is not None:
                    yield out()
                block, own, degrees = name.as_py(), signs(x), np.frombuffer(at.as_buffer(), np.int64)
                total = np.zeros_like(own)
            else:
                total[np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(x.as_buffer(), np.float64).reshape(-1, dim)  # a row has each node once
    if block is not None:
        yield out()


def _named(names: pa.Table, parts: pa.Table) -> pa.Table:
    """node, v of a block, whose dimensions come in parts."""
    schema = pa.schema([("node", pa.string()), ("v", pa.list_(pa.float64()))])
    if not names.num_rows:
        return schema.empty_table()
    nodes = names.column("names").combine_chunks().values
    parts = parts.sort_by("first")
    found = [np.frombuffer(v.as_buffer(), np.float64).reshape(len(nodes), -1) for v in parts.column("v")]
    batches = []
    for s in range(0, len(nodes), STEP):
        v = np.concatenate([x[s : s + STEP] for x in found], axis=1)
        length = np.sqrt((v * v).sum(1, keepdims=True))
        v = v / np.where(length > 0, length, 1.0)
        rows = pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], np.int32), v.ravel())
        batches.append(pa.RecordBatch.from_arrays([nodes[s : s + STEP], rows], schema=schema))
    return pa.Table.from_batches(batches, schema)


def fastrp(edges: DataFrame, dim: int = 128, rounds: int = 3, asked: Column | None = None) -> DataFrame:
    """node, v: ``rounds`` times the mean of the neighbours plus the node's own random signs, as a unit vector.

    ``edges``: src, dst as text; an edge listed twice counts twice, and edges without one end are left out.  Signs come
    from a digest of node and dimension, so they are the same in every run and engine.  ``asked``: a condition on ``node``;
    the vectors of the others are not returned.
    """
    spark = edges.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    work = Work(spark, "fastrp")
    real = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst")
    links = work.keep(real, "links")
    counted = work.keep(links.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n")), "nodes")
    n, ends = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n and mounted(spark, work.folder):
        return gathered.vectors(work, links, counted, n, dim, rounds, F.lit(True) if asked is None else asked)
    found = _by_shuffles(work, links, counted, n, ends, dim, rounds)
    return found if asked is None else found.filter(asked)


def _by_shuffles(work: Work, links: DataFrame, counted: DataFrame, n: int, ends: int, dim: int, rounds: int) -> DataFrame:
    """The same where tasks can't map files of the shared folder."""
    spark = work.spark
    width = -(-dim // min(PARTS, dim, max(1, -(-8 * dim * ends // PART_BYTES))))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // max(1, BLOCK_BYTES // (8 * width))))
    buckets = min(blocks, max(tasks, blocks // 4))
    ranged = counted.repartitionByRange(blocks, "node").sortWithinPartitions("node")
    place = F.monotonically_increasing_id()  # a partition's number, and the row's in it
    nodes = work.keep(ranged.select("node", "n", F.shiftright(place, 33).alias("block"), place.bitwiseAND((1 << 33) - 1).alias("at")), "numbered")
    code = lambda side: nodes.select(F.col("node").alias(side), (F.shiftleft("block", 32) + F.col("at")).alias(f"{side}_at"))
    half = work.keep(links.join(code("src"), "src").select("src_at", "dst"), "half")
    coded = work.keep(half.join(code("dst"), "dst").select("src_at", "dst_at"), "coded")
    work.drop("links", "half")
    cells = work.keep(nodes.groupBy("block").agg(F.sum("n").alias("rows")).select("block", F.expr(f"rows div {EDGES} + 1").alias("parts")), "cells")
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = coded.select(F.explode(F.array(way("src_at", "dst_at"), way("dst_at", "src_at"))).alias("e")).select("e.src", "e.dst", F.shiftright("e.dst", 32).alias("block"))
    cell = lambda part: (F.shiftleft("block", 24) + part).alias("cell")
    celled = both.join(cells, "block").select(cell(F.pmod(F.xxhash64("src"), "parts")), "src", F.col("dst").bitwiseAND(int(_LOW)).alias("dst"))
    packed = work.keep(celled.repartition("cell").sortWithinPartitions("cell", "src").mapInArrow(_packed, "block long, src binary, dst binary"), "edges").withColumnRenamed("block", "cell")
    work.drop("coded")
    positive = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.substring(F.md5(F.concat("node", F.lit(":"), i.cast("string"))), 1, 1) < "8")
    digests = nodes.repartition(max(tasks, buckets), "block").withColumn("positive", positive)  # named, since few bytes make many digests
    start = work.keep(digests.groupBy("block").applyInArrow(lambda group: _start(group, dim), "block long, names array<string>, degrees binary, r binary"), "start")
    own = start.select("block", F.lit(0).alias("kind"), F.col("degrees").alias("at"), F.col("r").alias("x"))
    copied = lambda df: df.join(cells, "block").select(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "v").select(cell(F.col("part")), "v")
    for first in range(0, dim, width):
        last = min(dim, first + width)
        signs, size = partial(_signs, dim=dim, first=first, last=last), last - first
        now = start.select("block", F.col("r").alias("v"))
        for turn in range(max(1, rounds)):
            near = F.broadcast(copied(now)) if 8 * size * n <= BROADCAST_BYTES else copied(now)
            sent = packed.join(near, "cell").select("cell", "src", "dst", "v").mapInArrow(partial(_sent, dim=size, signs=None if turn else signs), "block long, kind int, at binary, x binary")
            ahead = sent.unionByName(own) if rounds else own
            dealt = (ahead.repartition("block") if turn < rounds - 1 else ahead.repartition(buckets, "block")).sortWithinPartitions("block", "kind")
            found = dealt.mapInArrow(partial(_summed, dim=size, signs=signs), "block long, v binary")
            if turn < rounds - 1:
                now = work.keep(found, "vectors", rolling=True)
            else:
                parts = work.append(found.withColumn("first", F.lit(first)), "parts", buckets, "block")
        work.drop("vectors")
    names = work.append(start.select("block", "names").repartition(buckets, "block"), "names", buckets, "block")
    work.drop("edges", "start", "numbered", "nodes")
    return names.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(_named, "node string, v array<double>")

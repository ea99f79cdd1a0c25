"""Hierarchical multi-length packing.

A document's ids are cut at the longest window; what remains goes to the tier
of the smallest context size that holds it.  From the longest tier down, every
remainder opens a window of its tier's size, and the gap behind it is filled
from shorter tiers: first with whole remainders (best fit), then with one that
is cut to the gap.  So a window is full at a power of two and needs no padding
until a block of documents runs out of remainders; those last ones share
windows that are padded.  A block's windows, long ones first, go to the step
group that has the fewest tokens so far, so groups of a block draw on all tiers
and differ by one window of the longest tier at most.

A block is a bounded run of documents within a task.  Nothing is shuffled, no
task holds more than a block, and a block wastes at most one padded window.

Defined results: null text is an empty text (its one id is the end id); other
columns are ignored; repeated rows are packed as often as they stand there; null
ids pass through; texts may have any length that a row can, of whatever characters.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from functools import partial
from heapq import heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .shared import in_arrow, pieces, strings_of, table

TIERS = (64, 128, 256, 512, 1024)
END_ID = 0
#: Ids of one block of documents; a longer document is a block of its own.
BLOCK_IDS = 1 << 20
STEP_TOKENS = 1 << 15


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text and the end id; special strings inside texts are the tokens that the file's library makes of them."""
    return [np.array([*ids, END_ID], np.uint32) for ids in tokens.encoder(path)(texts)]


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces (document, start, length, window, offset, tier) of one block; windows are counted from 0."""
    longest = tiers[-1]
    out: list[tuple[int, int, int, int, int, int]] = []
    window = 0
    rest: list[tuple[int, int, int]] = []  # (length, document, start), sorted
    for doc, n in enumerate(lengths):
        whole = n - n % longest
        for start in range(0, whole, longest):
            out.append((doc, start, longest, window, 0, longest))
            window += 1
        if n % longest:
            rest.append((n % longest, doc, whole))
    rest.sort()
    last: list[tuple[int, int, int]] = []
    while rest:
        n, doc, start = rest.pop()
        tier = next(t for t in tiers if t >= n)
        if sum_of_shorter(rest, tier - n) < tier - n:
            last.append((n, doc, start))
            continue
        out.append((doc, start, n, window, 0, tier))
        at = n
        while at < tier:
            fit = bisect_right(rest, (tier - at, 1 << 62, 0)) - 1
            if fit >= 0:
                n, doc, start = rest.pop(fit)
            else:  # none fits whole: cut the shortest
                n, doc, start = rest.pop(0)
                insort(rest, (n - (tier - at), doc, start + tier - at))
                n = tier - at
            out.append((doc, start, n, window, at, tier))
            at += n
        window += 1
    at = 0
    for n, doc, start in last:  # what can't fill a window of its own tier any more
        while n:
            now = min(n, longest - at)
            out.append((doc, start, now, window, at, longest))
            n, start, at = n - now, start + now, at + now
            if at == longest:
                window, at = window + 1, 0
    return out


def balanced(sizes: list[int], step_tokens: int) -> list[int]:
    """A group for each window: as many groups as come nearest to ``step_tokens`` each, filled evenly."""
    groups = [(0, g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for window in sorted(range(len(sizes)), key=lambda w: -sizes[w]):
        tokens, group = groups[0]
        out[window] = group
        heapreplace(groups, (tokens + sizes[window], group))
    return out


def sum_of_shorter(rest: list[tuple[int, int, int]], enough: int) -> int:
    """Ids that wait, counted up to ``enough``."""
    total = 0
    for n, _, _ in reversed(rest):
        total += n
        if total >= enough:
            break
    return total


def _pack_batches(batches, path: str, tiers: tuple[int, ...], step_tokens: int, kind: pa.DataType):
    from pyspark import TaskContext

    base, used, steps = TaskContext.get().partitionId() << 33, 0, 0

    def packed(ids: list, arrays: list[np.ndarray]) -> pa.RecordBatch:
        nonlocal used, steps
        rows = pack([len(x) for x in arrays], tiers)
        sizes = [0] * (max(r[3] for r in rows) + 1)
        for _, _, _, window, _, tier in rows:
            sizes[window] = tier
        step = balanced(sizes, step_tokens)
        cols = [np.array(x, np.int64) for x in zip(*rows)]
        crc = [zlib.crc32(arrays[d][s : s + n]) for d, s, n, *_ in rows]
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([ids[d] for d in cols[0]], kind), pa.array(cols[1]), pa.array(cols[2]), pa.array(crc, pa.int64()),
                pa.array(np.array([len(x) for x in arrays], np.int64)[cols[0]]), pa.array(cols[3] + (base + used)), pa.array(cols[4]),
                pa.array(cols[5].astype(np.int32)), pa.array([base + steps + step[w] for w in cols[3]], pa.int64()),
                pa.array([arrays[d][s : s + n].view(np.int32) for d, s, n, *_ in rows], pa.list_(pa.int32())),
            ],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "ids"],
        )
        used, steps = used + len(sizes), steps + max(step) + 1
        return out

    ids, arrays, held = [], [], 0
    for rows, _, _ in pieces(batches, "text"):
        more = encode(strings_of(rows.column("text")), path)
        for name, array in zip(rows.column("doc_id").to_pylist(), more):
            ids.append(name)
            arrays.append(array)
            held += len(array)
            if held >= BLOCK_IDS:
                yield packed(ids, arrays)
                ids, arrays, held = [], [], 0
    if arrays:
        yield packed(ids, arrays)


def packed_pieces(docs: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: where its ids come from, where they go, and the ids.

    ``tokenizer`` is the path of a byte-level BPE file, present on every executor.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    return rows.transform(
        in_arrow,
        partial(_pack_batches, path=tokenizer, tiers=tiers, step_tokens=step_tokens, kind=to_arrow_type(kind)),
        f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids array<int>",
    )


def default_tokenizer() -> str:
    return tokens.public("byte_bpe_50k.json")


def digest(pieces_: DataFrame) -> DataFrame:
    return pieces_.drop("ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(packed_pieces(table(spark, sf_dir, "documents"), default_tokenizer()))

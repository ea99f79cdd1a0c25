"""Rounds of fast random projection by looking up neighbours in files that tasks map.

Nodes are dealt to blocks by a hash of their name and stand there by degree, the
highest first.  A block's nodes, its lists of neighbours and its vectors are
files of the shared folder, so a round reads what it needs in place and nothing
is shuffled.  Few vectors are kept: signs as bits, those of the first round
as whole numbers (sums of signs), and of the round before the last only those of
more than ``DEGREE`` neighbours, since a few neighbours are added up again as
fast.  The last round is worked out where its rows are read.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import Files, mounted, put
from ..sources.work import Work

#: Nodes of a block in a large graph and in a small one, and the blocks that a graph is cut into before they become large.
NODES, FEW_NODES, BLOCKS = 1 << 16, 1 << 12, 64
#: Neighbours up to which a node's vector of the round before the last isn't kept, and those up to which a sum of signs and own ones is a byte.
DEGREE, BYTE = 32, 63
#: Edges that are coded, looked up, and added up at once; nodes of a batch, and tasks that read a block.
EDGES, CHUNK, STEP, ROWS, SLICES = 1 << 20, 1 << 14, 1 << 9, 1 << 10, 4
#: Digests that are worked out at once.
HASHED = 1 << 14


_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)


def _leading_bits(words: np.ndarray) -> np.ndarray:
    """The first bit of the MD5 digests of messages of one block; words: 16 rows of little-endian words, a column each."""
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f = np.empty_like(a)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, f)
            f |= b
            f ^= c
        f += a
        f += words[g]
        f += _SINES[i]
        turn = _TURNS[i // 16, i % 4]
        np.left_shift(f, turn, a)
        f >>= np.uint32(32) - turn
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return (a + np.uint32(0x67452301)) & np.uint32(0x80) != 0


def _signs(flat: bytes, ends: np.ndarray, dim: int) -> np.ndarray:
    """Bits for positive signs of names that stand end to end: where the digest of name, colon and dimension begins with a bit of 0."""
    tails = [f":{i}".encode() for i in range(dim)]
    positive, sizes = np.empty((len(ends) - 1, dim), bool), np.diff(ends)
    step = max(1, HASHED // max(dim, 1))
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        if size + len(tails[-1]) >= 56:  # more than a block
            for i in rows.tolist():
                name = flat[ends[i] : ends[i + 1]]
                positive[i] = [hashlib.md5(name + t).digest()[0] < 128 for t in tails]
            continue
        ending = b"".join((bytes(size) + t + b"\x80").ljust(56, b"\0") + (8 * (size + len(t))).to_bytes(8, "little") for t in tails)
        names = np.frombuffer(flat, np.uint8)[ends[rows][:, None] + np.arange(size)]
        for s in range(0, len(rows), step):
            some = rows[s : s + step]
            block = np.tile(np.frombuffer(ending, np.uint8).reshape(-1, 64), (len(some), 1, 1))
            block[:, :, :size] = names[s : s + step, None]
            positive[some] = ~_leading_bits(np.ascontiguousarray(block.reshape(-1, 64).view("<u4").T)).reshape(-1, dim)
    return np.packbits(positive, axis=1)


def _nodes(group: pa.Table, folder: str, dim: int) -> pa.Table:
    """Writes a block's nodes, by degree, and where each hash of a name stands."""
    block = group.column("block")[0].as_py()
    group = group.sort_by([("n", "descending"), ("node", "ascending")])
    key = group.column("key").to_numpy()
    order = np.argsort(key)
    names = pa.concat_arrays(group.column("node").cast(pa.large_string()).chunks)
    ends = np.frombuffer(names.buffers()[1], np.int64, len(names) + 1, 8 * names.offset)
    put(f"{folder}/find/{block}", key=key[order], at=order.astype(np.int32))
    flat = np.frombuffer(names.buffers()[2] or b"", np.uint8)
    put(f"{folder}/nodes/{block}", bits=_signs(flat.tobytes(), ends, dim), asked=group.column("asked").to_numpy(), ends=ends, names=flat)
    return pa.table({"block": pa.array([block], pa.int64()), "n": pa.array([len(key)], pa.int64()), "clash": [bool((np.diff(key[order]) == 0).any())]})


def _coded(batches, folder: str, starts: np.ndarray):
    """block, src, dst: edges both ways in numbers, by the block of their near end."""
    files, blocks, held, size = Files(folder), len(starts) - 1, [], 0
    kind = np.int32 if starts[-1] < 1 << 31 else np.int64

    def out():
        key = np.concatenate([x for side in zip(*held) for x in side])
        block = np.mod(key, blocks)
        order = np.argsort(block, kind="stable")
        cut = np.searchsorted(block[order], np.arange(blocks + 1))
        ids = np.empty(len(key), np.int64)
        for b in np.flatnonzero(np.diff(cut)):
            rows, known = order[cut[b] : cut[b + 1]], files.get(f"find/{b}")
            ids[rows] = starts[b] + known["at"][np.searchsorted(known["key"], key[rows])]
        near, far = ids, np.concatenate([ids[len(ids) // 2 :], ids[: len(ids) // 2]])
        order = np.argsort(near)
        near, far = near[order], far[order].astype(kind)
        cut = np.searchsorted(near, starts)
        for b in np.flatnonzero(np.diff(cut)):
            part = slice(cut[b], cut[b + 1])
            values = [pa.array([int(b)], pa.int64()), pa.array([(near[part] - starts[b]).astype(np.int32).tobytes()]), pa.array([far[part].tobytes()])]
            yield pa.RecordBatch.from_arrays(values, ["block", "src", "dst"])

    for batch in batches:
        held.append(tuple(c.to_numpy() for c in batch.columns))
        size += batch.num_rows
        if size >= EDGES:
            yield from out()
            held, size = [], 0
    if size:
        yield from out()


def _lists(group: pa.Table, folder: str, starts: np.ndarray) -> pa.Table:
    """Writes a block's lists of neighbours, in order."""
    block = group.column("block")[0].as_py()
    src = np.frombuffer(b"".join(group.column("src").to_pylist()), np.int32)
    dst = np.frombuffer(b"".join(group.column("dst").to_pylist()), np.int32 if starts[-1] < 1 << 31 else np.int64)
    order = np.lexsort((dst, src))
    put(f"{folder}/lists/{block}", cut=np.searchsorted(src[order], np.arange(starts[block + 1] - starts[block] + 1)), dst=dst[order])
    return pa.table({"block": pa.array([block], pa.int64())})


class _Graph:
    """Vectors of nodes by number, not scaled."""

    def __init__(self, folder: str, starts: np.ndarray, dim: int):
        self.files, self.starts, self.dim = Files(folder), starts, dim

    def parts(self, ids: np.ndarray):
        """Each block of some ordered nodes, which of them are in it, and their places there."""
        cut = np.searchsorted(ids, self.starts)
        for b in np.flatnonzero(np.diff(cut)):
            part = slice(cut[b], cut[b + 1])
            yield b, part, ids[part] - self.starts[b]

    def degrees(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ordered nodes: where their lists begin in their blocks, and their lengths."""
        first, n = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        for b, part, at in self.parts(ids):
            cut = self.files.get(f"lists/{b}")["cut"]
            first[part], n[part] = cut[at], cut[at + 1] - cut[at]
        return first, n

    def own(self, ids: np.ndarray) -> np.ndarray:
        """The signs of ordered nodes."""
        bits = np.empty((len(ids), -(-self.dim // 8)), np.uint8)
        for b, part, at in self.parts(ids):
            bits[part] = self.files.get(f"nodes/{b}")["bits"][at]
        return np.unpackbits(bits, axis=1, count=self.dim) * 2.0 - 1.0

    def vectors(self, turn: int, ids: np.ndarray) -> np.ndarray:
        """Of ordered nodes, after so many rounds."""
        if not turn:
            return self.own(ids)
        v, few = np.empty((len(ids), self.dim)), []
        for b, part, at in self.parts(ids):
            known = self.files.get(f"{turn}/{b}")
            high = known["high"]
            least = int(np.searchsorted(at, len(high)))
            rows = v[part]
            rows[:least] = high[at[:least]]
            if turn == 1:
                rows[least:] = known["low"][at[least:] - len(high)]
                cut = self.files.get(f"lists/{b}")["cut"]
                rows /= (cut[at + 1] - cut[at])[:, None]
            elif least < len(at):
                few.append(np.arange(part.start + least, part.stop))
        if few:
            few = np.concatenate(few)
            v[few] = self.means(turn, ids[few])
        return v

    def means(self, turn: int, ids: np.ndarray) -> np.ndarray:
        """The mean of the neighbours' vectors after the round before, plus the own signs, of ordered nodes."""
        first, n = self.degrees(ids)
        out, ends = np.zeros((len(ids), self.dim)), np.cumsum(n)
        for s in range(0, int(ends[-1]), CHUNK):
            edge = np.arange(s, min(s + CHUNK, ends[-1]))
            row = np.searchsorted(ends, edge, "right")
            place = first[row] + edge - (ends - n)[row]
            dst = np.empty(len(edge), np.int64)
            for b, part, _ in self.parts(ids[row]):
                dst[part] = self.files.get(f"lists/{b}")["dst"][place[part]]
            near, which = np.unique(dst, return_inverse=True)
            v = self.vectors(turn - 1, near)
            for x in range(0, len(edge), STEP):  # what the processor's cache holds
                at = row[x : x + STEP]
                head = np.flatnonzero(np.diff(at, prepend=-1))
                out[at[head]] += np.add.reduceat(v[which[x : x + STEP]], head)
        out /= n[:, None]
        out += self.own(ids)
        return out


def _round(batches, folder: str, starts: np.ndarray, dim: int, turn: int, least: int):
    """Writes what is kept of blocks after a round: in the first one sums, in others the vectors of more than ``least`` neighbours."""
    graph = _Graph(folder, starts, dim)
    for batch in batches:
        for b in batch.column(0).to_pylist():
            ids = np.arange(starts[b], starts[b + 1])
            n = graph.degrees(ids)[1]
            high = int((n > (BYTE if turn == 1 else least)).sum())
            found = np.empty((high, dim), np.int64 if turn == 1 else np.float64)
            low = np.empty((len(ids) - high if turn == 1 else 0, dim), np.int8)
            for kept, offset in ((found, 0), (low, high)):
                for s in range(0, len(kept), ROWS):
                    rows = slice(offset + s, offset + min(s + ROWS, len(kept)))
                    v = graph.means(turn, ids[rows])
                    kept[s : s + ROWS] = np.rint(v * n[rows, None]) if turn == 1 else v
            put(f"{folder}/{turn}/{b}", high=found, low=low)
        yield batch


def _found(batches, folder: str, starts: np.ndarray, dim: int, rounds: int):
    """node, v: the unit vectors of a slice of a block's nodes."""
    graph = _Graph(folder, starts, dim)
    for batch in batches:
        for b, s in (divmod(x, SLICES) for x in batch.column(0).to_pylist()):
            nodes = graph.files.get(f"nodes/{b}")
            flat, ends = nodes["names"].tobytes(), nodes["ends"]
            ids = np.flatnonzero(nodes["asked"])[s::SLICES]
            for at in (ids[x : x + ROWS] for x in range(0, len(ids), ROWS)):
                v = graph.means(rounds, starts[b] + at) if rounds else graph.own(starts[b] + at)
                length = np.sqrt((v * v).sum(1, keepdims=True))
                v /= np.where(length > 0, length, 1.0)
                names = pa.array([flat[x:y].decode() for x, y in zip(ends[at].tolist(), ends[at + 1].tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(np.arange(0, v.size + 1, dim, np.int32), v.ravel())], ["node", "v"])


def _list(keys: DataFrame, folder: str, starts: np.ndarray) -> None:
    """Writes the lists of neighbours from edges between hashes of names."""
    blocks = len(starts) - 1
    coded = keys.mapInArrow(partial(_coded, folder=folder, starts=starts), "block long, src binary, dst binary")
    coded.repartition(blocks, "block").groupBy("block").applyInArrow(lambda group: _lists(group, folder, starts), "block long").collect()


def vectors(work: Work, links: DataFrame, counted: DataFrame, n: int, dim: int, rounds: int, asked: Column) -> DataFrame:
    """node, v of the nodes that are asked for. links: src, dst; counted: node, n, its ends among links; positive: signs of a node."""
    spark = work.spark
    blocks = max(1, min(BLOCKS, -(-n // FEW_NODES)), -(-n // NODES))
    for seed in range(1, 9):  # another hash if one is that of two names
        place = work.place("files")
        folder = mounted(spark, place)
        key = lambda c: F.xxhash64(F.lit(seed), c).alias(c)  # noqa: B023, E731
        rows = counted.select("node", "n", asked.alias("asked"), key("node").alias("key")).withColumn("block", F.pmod("key", F.lit(blocks)))
        found = rows.repartition(blocks, "block").groupBy("block").applyInArrow(lambda group: _nodes(group, folder, dim), "block long, n long, clash boolean").collect()  # a row for each block
        if not any(r.clash for r in found):
            break
    else:
        raise ValueError("two names of nodes share eight hashes")
    del rows
    work.drop("nodes")
    sizes = np.zeros(blocks + 1, np.int64)
    for r in found:
        sizes[r.block + 1] = r.n
    starts = np.cumsum(sizes)
    _list(links.select(key("src"), key("dst")), folder, starts)
    work.drop("links")
    work.clear(f"{place}/find")
    each = spark.range(0, blocks, 1, blocks)
    for turn in range(1, rounds):
        # the last round goes through these once more for few neighbours only
        least = DEGREE if turn == rounds - 1 else 0
        each.mapInArrow(partial(_round, folder=folder, starts=starts, dim=dim, turn=turn, least=least), "id long").count()
        if turn > 2:
            work.clear(f"{place}/{turn - 2}")
    return spark.range(0, blocks * SLICES, 1, blocks * SLICES).mapInArrow(partial(_found, folder=folder, starts=starts, dim=dim, rounds=rounds), "node string, v array<double>")

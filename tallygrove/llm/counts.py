"""Sets and counts of 128-bit keys in memory-mapped files of the shared folder.

A key is two independent 64-bit hashes.  Keys are cut by the upper bits of the
first into shards of bounded size.  Tasks hand on their keys counted, as one
block per shard, or, where there are more than ``FAN`` shards, per range of
shards; ranges are split in further rounds, so the number of blocks follows the
number of keys and not tasks times shards.  One task per shard unites its keys
and writes a file of sorted ones; many shards are then put end to end in a few
files, since a look-up visits most of them.  Any task can then look keys up, whatever the
size of the whole: nothing is collected, broadcast or joined.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .eliasfano import EliasFano, pack, unpack
from .shared import Opened, in_arrow, local_path, map_file, mix, put_file, put_parts, remove_folder, work_folder

SHARD_KEYS = 1 << 20
#: Blocks that a task makes of what it has gathered.
FAN = 256
GATHER = 1 << 21
#: Files that keys are looked up in: a look-up visits most of them, so their number doesn't go with the shards.
FILES = 32
#: What a shard holds.
ARRAYS = {"keys": np.uint64, "second": np.uint64, "counts": np.uint32}
BLOCKS = "shard int, block binary"
_U = np.uint64


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (((keys >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)


def _parting(shards: int, fan: int) -> tuple[int, int]:
    """How many parts a range is split into in each further round, and their number: as few as will do, so the first ranges are many, and so are the tasks that split them."""
    rounds, parts = 0, 1
    while fan ** (rounds + 1) < shards:
        rounds += 1
    while rounds and parts**rounds * fan < shards:
        parts += 1
    return parts, rounds


def widest(shards: int, fan: int = FAN) -> int:
    """Shards of one block in the first round."""
    parts, rounds = _parting(shards, fan)
    return parts**rounds


def narrower(width: int, shards: int, fan: int = FAN) -> int:
    """Shards of one block in the next round."""
    return width // _parting(shards, fan)[0]


def united(keys: np.ndarray, second: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each is there."""
    order = np.argsort(keys, kind="stable")
    k, s = keys[order], second[order]
    same = k[1:] == k[:-1]
    if (s[1:][same] != s[:-1][same]).any():  # one first hash of two texts
        order = np.lexsort((second, keys))
        k, s = keys[order], second[order]
        same = k[1:] == k[:-1]
    head = np.flatnonzero(np.concatenate([[True], ~same | (s[1:] != s[:-1])])) if len(k) else np.zeros(0, np.int64)
    many = np.diff(np.append(head, len(k))) if counts is None else np.add.reduceat(counts[order], head) if len(head) else counts
    return k[head], s[head], many.astype(np.int64)


def blocks_of(keys: np.ndarray, second: np.ndarray, counts: np.ndarray, shards: int, width: int):
    """United keys as one block for each range of ``width`` shards; it is named by the first of them."""
    at = shard_of(keys, shards) // width
    cut = np.searchsorted(at, np.arange(-(-shards // width) + 1))
    for i in np.flatnonzero(np.diff(cut)):
        part = slice(cut[i], cut[i + 1])
        arrays, values = EliasFano.encode(keys[part] - keys[cut[i]], "keys")
        many = counts[part]
        block = pack(arrays | {"first": keys[cut[i] : cut[i] + 1], "second": second[part], "counts": many.astype(np.min_scalar_type(int(many.max())))}, **values)
        yield pa.RecordBatch.from_arrays([pa.array([i * width], pa.int32()), pa.array([block], pa.binary())], ["shard", "block"])


def opened_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    arrays, values = unpack(np.frombuffer(block, np.uint8))
    keys = EliasFano(arrays, values, "keys")
    return keys.get(np.arange(keys.n)) + arrays["first"][0], arrays["second"], arrays["counts"].astype(np.int64)


class Gathering:
    """Keys that a task holds until there are ``GATHER`` of them."""

    def __init__(self, shards: int, width: int | None = None, most: int = GATHER):
        self.shards, self.most = shards, most
        self.width = widest(shards) if width is None else width
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, second: np.ndarray, counts: np.ndarray | None = None):
        """Blocks, if this fills what is held."""
        self.held.append((keys, second, np.ones(len(keys), np.int64) if counts is None else counts))
        self.size += len(keys)
        if self.size >= self.most:
            yield from self.rest()

    def rest(self):
        if self.size:
            yield from blocks_of(*united(*(np.concatenate(x) for x in zip(*self.held))), self.shards, self.width)
        self.held, self.size = [], 0


def _split(batches, shards: int, width: int):
    held = Gathering(shards, width)
    for batch in batches:
        for block in batch.column("block").to_pylist():
            yield from held.add(*opened_block(block))
    yield from held.rest()


def dealt(blocks: DataFrame, shards: int, fan: int = FAN) -> DataFrame:
    """Blocks of ranges of shards, split until each is of one shard."""
    width = widest(shards, fan)
    while width > 1:
        width = narrower(width, shards, fan)
        blocks = blocks.repartition("shard").transform(in_arrow, partial(_split, shards=shards, width=width), BLOCKS)
    return blocks


class Counts:
    """Keys and their counts, in the files of a folder; a file is one shard, or each array of ``width`` of them."""

    def __init__(self, folder: str, shards: int, width: int = 1):
        self.folder, self.shards, self.width, self.files = folder, shards, width, Opened()

    def _file(self, i: int) -> dict[str, np.ndarray]:
        if self.width == 1:
            return self.files.get(f"{self.folder}/{i}", lambda data: unpack(data)[0])
        return {name: self.files.get(f"{self.folder}/{i}-{name}", lambda data, kind=kind: data.view(kind)) for name, kind in ARRAYS.items()}

    def of(self, keys: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The count of each key; 0 if it is not there."""
        out = np.zeros(len(keys), np.int64)
        if not len(keys):
            return out
        order = np.argsort(keys)
        cut = np.searchsorted(shard_of(keys[order], self.shards) // self.width, np.arange(-(-self.shards // self.width) + 1))
        for i in np.flatnonzero(np.diff(cut)):
            known = self._file(i)
            names, checks, counts = known["keys"], known["second"], known["counts"]
            rows = order[cut[i] : cut[i + 1]]
            if not len(names):
                continue
            at = np.minimum(np.searchsorted(names, keys[rows]), len(names) - 1)
            same = names[at] == keys[rows]
            rows, at = rows[same], at[same]
            while len(rows):  # keys that share their first hash stand side by side
                hit = checks[at] == second[rows]
                out[rows[hit]] = counts[at[hit]]
                rows, at = rows[~hit], at[~hit] + 1
                more = np.flatnonzero(at < len(names))
                more = more[names[at[more]] == keys[rows[more]]]
                rows, at = rows[more], at[more]
        return out


def write_shard(folder: str, shard: int, keys: np.ndarray, second: np.ndarray, counts: np.ndarray) -> None:
    put_file(f"{folder}/{shard}", pack({"keys": keys, "second": second, "counts": np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)}))


def _merge(group: pa.Table, folder: str, least: int) -> pa.Table:
    keys, second, counts = united(*(np.concatenate(x) for x in zip(*map(opened_block, group.column("block").to_pylist()))))
    keep = counts >= least
    shard = group.column("shard")[0].as_py()
    write_shard(folder, shard, keys[keep], second[keep], counts[keep])
    return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([int(keep.sum())], pa.int64())})


def _end_to_end(batches, folder: str, to: str, shards: int, width: int):
    """Files of ``width`` shards; shards are ranges of keys, so the keys of a file are in order too."""
    for batch in batches:
        for i in batch.column(0).to_pylist():
            for name in ARRAYS:
                put_parts(f"{to}/{i}-{name}", (unpack(map_file(f"{folder}/{shard}"))[0][name] for shard in range(i * width, min((i + 1) * width, shards))))
        yield batch


def counted(blocks: DataFrame, shards: int, name: str, least: int = 2) -> Counts:
    """Unite the blocks of all tasks; keys that occur fewer than ``least`` times are left out."""
    spark = blocks.sparkSession
    out = Counts(work_folder(spark, name), shards)
    found = dealt(blocks, shards).groupBy("shard").applyInArrow(lambda group: _merge(group, out.folder, least), "shard int, n long").collect()  # one row per shard
    none = np.zeros(0, np.uint64)
    for i in set(range(shards)) - {r[0] for r in found}:
        write_shard(out.folder, i, none, none, none)
    if shards <= FILES or local_path(out.folder) is None:  # what isn't mounted is read whole, so it stays small
        return out
    width = -(-shards // FILES)
    files, folder = -(-shards // width), work_folder(spark, f"{name}-files")
    spark.range(0, files, 1, files).transform(in_arrow, partial(_end_to_end, folder=out.folder, to=folder, shards=shards, width=width), "id long").collect()
    remove_folder(spark, out.folder)
    return Counts(folder, shards, width)


# ---- sets of keys -------------------------------------------------------------------------


def hashed(*values: Column) -> list[Column]:
    """Two independent 64-bit hashes of some values."""
    return [F.xxhash64(F.lit(seed), *values) for seed in (0x2545F491, 0x1B873593)]


def _pair(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(mix(pc.fill_null(c, 0).to_numpy().astype(np.int64).view(np.uint64)) for c in batch.columns[-2:])


def _keys(batches, shards: int):
    held = Gathering(shards)
    for batch in batches:
        yield from held.add(*_pair(batch))
    yield from held.rest()


def stored(keys: DataFrame) -> Counts:
    """The keys of a table of two longs each, and how often each stands there."""
    shards = max(1, -(-keys.count() // SHARD_KEYS))
    return counted(keys.transform(in_arrow, partial(_keys, shards=shards), BLOCKS), shards, "keys", least=1)


def _filtered(batches, known: Counts, inside: bool):
    for batch in batches:
        hit = known.of(*_pair(batch)) > 0
        yield pa.RecordBatch.from_arrays(batch.columns[:-2], schema=pa.schema([batch.schema.field(i) for i in range(batch.num_columns - 2)])).filter(pa.array(hit if inside else ~hit))


def _by_place(df: DataFrame) -> DataFrame:
    """Columns named by their places, so that none has the name of one that is added."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def having(df: DataFrame, key: list[Column], known: Counts, inside: bool = True) -> DataFrame:
    """The rows whose key (two longs over the columns of ``df``) is in the set, or is not, in place: no row is shuffled."""
    found = _by_place(df.select("*", *key)).transform(in_arrow, partial(_filtered, known=known, inside=inside), _by_place(df).schema)
    return found.toDF(*df.columns)


def without(df: DataFrame, key: list[Column], known: Counts) -> DataFrame:
    return having(df, key, known, inside=False)

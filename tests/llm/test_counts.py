"""Counts and sets of keys, and the hashes they go by."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallygrove.llm import counts as C
from tallygrove.llm import shared

from .fixtures import doubled


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096])
def test_doubling_words_are_told_apart(n):
    a, b = doubled(n)
    data = np.frombuffer(a + b, np.uint8)
    for which in (0, 1):
        x, y = shared.RangeHash(data, which).of(np.array([0, n]), np.array([n, 2 * n]))
        assert x != y


def test_range_hashes_go_by_bytes_alone(monkeypatch):
    monkeypatch.setattr(shared, "_STEP", 100)
    rng = random.Random(1)
    part = bytes(rng.randrange(256) for _ in range(150))
    found = set()
    for before in (0, 1, 99, 100, 257):
        data = np.frombuffer(bytes(rng.randrange(256) for _ in range(before)) + part + b"end", np.uint8)
        found.add(int(shared.RangeHash(data).of(np.array([before]), np.array([before + 150]))[0]))
    assert len(found) == 1


@pytest.mark.parametrize("fan", [2, 256])
def test_counts_over_rounds_of_blocks(spark, fan):
    """Many tasks, shards and rounds; first hashes that several keys share."""
    shards, rng = 13, np.random.default_rng(2)
    keys = rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2)
    second = rng.integers(0, 3, 300, dtype=np.uint64)
    keys[:20] = keys[0]

    def work(batches):
        for batch in batches:
            for seed in batch.column(0).to_pylist():
                rows = np.random.default_rng(seed).integers(0, 300, 200)
                held = C.Gathering(shards, C.widest(shards, fan), most=90)
                yield from held.add(keys[rows], second[rows])
                yield from held.rest()

    blocks = spark.range(12, numPartitions=3).mapInArrow(work, C.BLOCKS)
    known = C.dealt(blocks, shards, fan)
    assert all((C.shard_of(C.opened_block(bytes(r.block))[0], shards) == r.shard).all() for r in known.collect())
    folder = C.work_folder(spark, "test")
    known.groupBy("shard").applyInArrow(lambda g: C._merge(g, folder, 1), "shard int, n long").collect()
    none = np.zeros(0, np.uint64)
    for i in range(shards):
        if not shared.os.path.exists(shared.local_path(f"{folder}/{i}")):
            C.write_shard(folder, i, none, none, none)
    wanted = Counter()
    for seed in range(12):
        rows = np.random.default_rng(seed).integers(0, 300, 200)
        wanted.update(zip(keys[rows].tolist(), second[rows].tolist()))
    ask = np.append(keys, keys[:5]), np.append(second, [np.uint64(9)] * 5)
    assert C.Counts(folder, shards).of(*ask).tolist() == [wanted[k, s] for k, s in zip(ask[0].tolist(), ask[1].tolist())]


def test_blocks_follow_the_keys_and_not_the_shards():
    keys = np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2)
    held = C.Gathering(100_000)
    held.add(keys, keys)
    assert not list(held.add(keys, keys)) and len(list(held.rest())) <= C.FAN


def test_open_files_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "map_file", lambda uri: np.zeros(100, np.uint8))  # as if it were not mounted
    held = shared.Opened(most=50, most_bytes=1000)
    for i in range(200):
        held.get(str(i), lambda data: data)
        assert len(held.held) <= 10 and held.size <= 1000


def test_having_and_without(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, None), (2, "b")], "_key long, c0 string")
    key = C.hashed(df["_key"].isNull(), df["_key"])
    known = C.stored(df.filter("_key = 2 or _key is null").select(*key))
    assert sorted(map(tuple, C.having(df, key, known).collect()), key=repr) == [(2, "b"), (2, "b"), (None, None)]
    assert [tuple(r) for r in C.without(df, key, known).collect()] == [(1, "a")]
    assert C.without(df, key, C.stored(df.limit(0).select(*key))).count() == 4


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "local-cluster[3,2,1000]"

    with pytest.raises(ValueError):
        shared.shared_root(Session)


def test_a_folder_without_scheme_is_of_the_default_file_system(spark):
    assert shared.shared_root(spark).startswith("file:") and shared.local_path("hdfs://x/y") is None
    assert shared.local_path(shared.shared_root(spark) + "/a").endswith("/a")
    assert pa.__version__


def test_a_lookup_visits_few_files_however_many_shards(spark):
    """Keys that share their first hash, shards without keys, and a last file of fewer shards."""
    shards, rng = 150, np.random.default_rng(4)
    keys = rng.integers(0, 2**62, 4000, dtype=np.uint64) * np.uint64(4)
    keys[C.shard_of(keys, shards) == 70] = keys[0]
    second = rng.integers(0, 3, 4000, dtype=np.uint64)

    def work(batches):
        for batch in batches:
            for seed in batch.column(0).to_pylist():
                rows = np.random.default_rng(seed).integers(0, 4000, 3000)
                held = C.Gathering(shards, C.widest(shards))
                yield from held.add(keys[rows], second[rows])
                yield from held.rest()

    known = C.counted(spark.range(6, numPartitions=2).mapInArrow(work, C.BLOCKS), shards, "test", least=1)
    wanted = Counter()
    for seed in range(6):
        rows = np.random.default_rng(seed).integers(0, 4000, 3000)
        wanted.update(zip(keys[rows].tolist(), second[rows].tolist()))
    ask = np.append(keys, keys[:5]), np.append(second, [np.uint64(9)] * 5)
    assert known.of(*ask).tolist() == [wanted[k, s] for k, s in zip(ask[0].tolist(), ask[1].tolist())]
    assert len(known.files.held) <= len(C.ARRAYS) * C.FILES


@pytest.mark.parametrize("shards, fan", [(1, 256), (256, 256), (257, 256), (847, 256), (70000, 256), (22, 3), (13, 2)])
def test_first_ranges_are_many_and_each_lies_in_one_of_the_round_before(shards, fan):
    width = C.widest(shards, fan)
    ranges = -(-shards // width)
    assert ranges <= fan and (ranges == shards or ranges > fan / 3)
    while width > 1:
        after = C.narrower(width, shards, fan)
        assert width % after == 0 and 1 < width // after <= fan
        width = after
    assert width == 1

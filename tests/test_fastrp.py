import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallygrove.operators import fastrp as P


def brute(edges, dim, rounds):
    links = [e for a, b in edges for e in ((a, b), (b, a))]
    names = sorted({a for a, _ in links})
    own = {x: np.array([1 if hashlib.md5(f"{x}:{i}".encode()).hexdigest()[0] < "8" else -1 for i in range(dim)]) * dim**-0.5 for x in names}
    degree, now = Counter(a for a, _ in links), own
    for _ in range(rounds):
        total = {x: np.zeros(dim) for x in names}
        for a, b in links:
            total[a] = total[a] + now[b]
        now = {x: total[x] / degree[x] + own[x] for x in names}
    return {x: v / (np.linalg.norm(v) or 1) for x, v in now.items()}


def graph(seed, n):
    """A hub, edges listed twice, loops, names that sort unlike numbers."""
    rng = random.Random(seed)
    edges = [(f"W{rng.randrange(n)}", f"W{rng.randrange(n)}") for _ in range(3 * n)]
    return edges + edges[:20] + [("Ω hub", f"W{i}") for i in range(n)] + [("W1", "W1")]


@pytest.mark.parametrize("block, edges, near", [(1 << 24, 1 << 20, 1 << 25), (2048, 64, 1 << 25), (2048, 64, 0), (128, 8, 0)])
def test_blocks_of_any_size_equal_brute_force(spark, monkeypatch, block, edges, near):
    monkeypatch.setattr(P, "BLOCK_BYTES", block)
    monkeypatch.setattr(P, "EDGES", edges)
    monkeypatch.setattr(P, "BROADCAST_BYTES", near)
    rows = graph(1, 150)
    found = {r.node: r.v for r in P.fastrp(spark.createDataFrame(rows, "src string, dst string"), 12, 3).collect()}
    wanted = brute(rows, 12, 3)
    assert set(found) == set(wanted)
    assert all(np.allclose(found[x], wanted[x], atol=1e-9) for x in wanted)


def test_lost_ends_other_columns_and_no_edges(spark):
    rows = [("a", "b", 1), (None, "b", 2), ("c", None, 3)]
    df = spark.createDataFrame(rows, "src string, dst string, block int")
    assert {r.node for r in P.fastrp(df, 4, 1).collect()} == {"a", "b"}
    assert P.fastrp(df.limit(0), 4, 2).collect() == []


def test_no_row_for_a_dimension_and_one_exchange_of_sums(spark):
    """What is shuffled in a round is a number of rows that goes with blocks, not with nodes times dimensions."""
    rows = graph(2, 400)
    text = P.fastrp(spark.createDataFrame(rows, "src string, dst string"), 32, 2)._jdf.queryExecution().toString()
    assert "Generate" not in text and "explode" not in text


def test_long_rows_are_cut(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(P, "EDGES", 10)
    monkeypatch.setattr(P, "STEP", 4)
    rng = np.random.default_rng(0)
    block = np.sort(rng.integers(0, 3, 90))
    src = np.concatenate([np.sort(rng.integers(0, 40, (block == b).sum())) + (rng.integers(0, 2) << 32) for b in range(3)])
    dst = rng.integers(0, 5, 90)
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 7]) for c in (block, src, dst)], ["b", "s", "d"]) for i in range(0, 90, 7)]
    packed = list(P._packed(iter(batches)))
    assert len(packed) > 6
    v = rng.normal(size=(5, 3))
    joined = [pa.RecordBatch.from_arrays([*p.columns, pa.array([v.tobytes()])], ["block", "src", "dst", "v"]) for p in packed]
    got = np.zeros((1 << 1, 40, 3))
    for batch in P._sent(iter(joined), 3):
        at = np.frombuffer(batch.column("at")[0].as_buffer(), np.int32)
        got[batch.column("block")[0].as_py(), at] += np.frombuffer(batch.column("x")[0].as_buffer(), np.float64).reshape(-1, 3)
    wanted = np.zeros_like(got)
    np.add.at(wanted, (src >> 32, src & 0xFFFFFFFF), v[dst])
    assert np.allclose(got, wanted)


@pytest.mark.parametrize("dim, parts, rounds", [(12, 5, 3), (9, 2, 1), (3, 8, 0)])
def test_dimensions_in_parts_equal_brute_force(spark, monkeypatch, dim, parts, rounds):
    """A large graph goes through the rounds a few dimensions at a time; their number need not divide evenly."""
    monkeypatch.setattr(P, "PART_BYTES", 1)
    monkeypatch.setattr(P, "PARTS", parts)
    monkeypatch.setattr(P, "BLOCK_BYTES", 1024)
    monkeypatch.setattr(P, "EDGES", 256)
    rows = graph(3, 80)
    found = {r.node: r.v for r in P.fastrp(spark.createDataFrame(rows, "src string, dst string"), dim, rounds).collect()}
    wanted = brute(rows, dim, rounds)
    assert set(found) == set(wanted)
    assert all(np.allclose(found[x], wanted[x], atol=1e-9) for x in wanted)


def test_signs_are_bits_and_the_last_join_has_no_shuffle(spark):
    plan = P.fastrp(spark.createDataFrame(graph(4, 60), "src string, dst string"), 16, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan

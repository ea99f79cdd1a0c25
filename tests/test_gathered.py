import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallygrove.operators import fastrp as P
from tallygrove.operators import gathered as G

from .test_fastrp import brute, graph


@pytest.fixture
def folder(monkeypatch):
    """What the last round is given, to run it here."""
    caught = {}

    def spy(f, **options):
        caught.update(options if f is found else {})
        return partial(f, **options)

    found, partial = G._found, G.partial
    monkeypatch.setattr(G, "partial", spy)
    return caught


@pytest.mark.parametrize("rounds", [0, 1, 2, 3, 4])
def test_files_equal_brute_force_and_nothing_is_shuffled_at_the_end(spark, monkeypatch, folder, rounds):
    """Several blocks; a hub's sums don't fit a byte, some nodes' vectors are kept before the last round and some are not; lists longer than a step."""
    monkeypatch.setattr(G, "FEW_NODES", 40)
    monkeypatch.setattr(G, "DEGREE", 7)
    rows = graph(5, 150)
    df = P.fastrp(spark.createDataFrame(rows, "src string, dst string"), 12, rounds)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    found, wanted = {r.node: r.v for r in df.collect()}, brute(rows, 12, rounds)
    assert set(found) == set(wanted)
    assert all(np.allclose(found[x], wanted[x], atol=1e-9) for x in wanted)
    for name, value in (("CHUNK", 50), ("STEP", 7), ("ROWS", 3)):
        monkeypatch.setattr(G, name, value)
    starts = folder["starts"]
    assert len(starts) > 3
    slices = pa.RecordBatch.from_arrays([pa.array(range((len(starts) - 1) * G.SLICES))], ["id"])
    here = {x: v for batch in G._found([slices], **folder) for x, v in zip(batch.column("node").to_pylist(), batch.column("v").to_pylist())}
    assert set(here) == set(wanted) and all(np.allclose(here[x], wanted[x], atol=1e-9) for x in wanted)


def test_only_what_is_asked_for_and_the_same_by_shuffles(spark, monkeypatch):
    rows = graph(6, 60)
    df, asked = spark.createDataFrame(rows, "src string, dst string"), F.col("node").startswith("W1")
    wanted = {x: v for x, v in brute(rows, 8, 2).items() if x.startswith("W1")}
    here = {r.node: r.v for r in P.fastrp(df, 8, 2, asked).collect()}
    monkeypatch.setattr(P, "mounted", lambda spark, uri: None)
    there = {r.node: r.v for r in P.fastrp(df, 8, 2, asked).collect()}
    for found in (here, there):
        assert set(found) == set(wanted) and all(np.allclose(found[x], wanted[x], atol=1e-9) for x in wanted)


def test_what_stays_on_disk_is_a_fraction_of_the_vectors(spark, monkeypatch):
    """Work tables of the rounds held 8 bytes for each node and dimension, and those of a round more."""
    kept = []
    monkeypatch.setattr(G.Work, "place", lambda self, name, place=G.Work.place: kept.append(place(self, name)) or kept[-1])
    edges = spark.range(20000).select(F.concat(F.lit("a"), "id").alias("src"), F.concat(F.lit("b"), (F.col("id") * 7 % 4000)).alias("dst"))
    assert P.fastrp(edges, 128, 3).count() == 24000
    import os

    size = sum(os.path.getsize(os.path.join(d, x)) for k in kept for d, _, names in os.walk(G.mounted(spark, k)) for x in names)
    assert 24000 * 128 < size < 24000 * 128 * 2


def test_signs_are_those_of_the_digests():
    names = [b"", b"W1", "Ω hub".encode(), *[b"x" * n for n in range(48, 60)]]
    ends = np.cumsum([0, *map(len, names)])
    wanted = [[hashlib.md5(x + b":%d" % i).hexdigest()[0] < "8" for i in range(101)] for x in names]
    found = np.unpackbits(G._signs(b"".join(names), ends, 101), axis=1, count=101)
    assert (found == np.array(wanted)).all()

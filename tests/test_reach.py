"""Rounds of tables against the kernel, and the searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.operators import density as Y
from tallygrove.operators import reach as R
from tallygrove.sources.work import Work

KIND = "bin int, id long, v array<double>"


@pytest.fixture
def rounds(spark, monkeypatch):
    monkeypatch.setattr(Y, "KERNEL_POINTS", 0)
    plain = {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in plain}
    for k, v in plain.items():
        spark.conf.set(k, v)
    yield monkeypatch
    for k, v in before.items():
        spark.conf.set(k, v)


def blobs(seed, n, dim, centres, noise):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, dim)) * 4
    inside = at[rng.integers(0, centres, n - noise)] + rng.normal(size=(n - noise, dim)) * rng.uniform(0.2, 0.8, (n - noise, 1))
    return np.vstack([inside, rng.uniform(-8, 8, (noise, dim))])


def frame(spark, groups):
    rows = [(g, i, None if v is None else [float(x) for x in v]) for g, points in groups.items() for i, v in enumerate(points)]
    return spark.createDataFrame(rows, KIND)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.bin, {})[r.id] = r.cluster
    return out


def test_rounds_equal_the_kernel(spark, rounds):
    """Blobs, copies in great number, few points, and one point only, in blocks of 64 and many cells."""
    rounds.setattr(R, "BLOCK", 64)
    copies = blobs(1, 260, 3, 2, 20)
    copies = np.vstack([copies, np.repeat(copies[:1], 90, axis=0), np.repeat(copies[1:2], 3, axis=0), np.round(copies[:80], 0)])
    groups = {0: blobs(0, 500, 5, 4, 40), 1: copies, 2: copies[:7], 3: np.ones((40, 3)), 4: [[1.0, 2.0]]}
    df = frame(spark, groups)
    got = found(Y.detect(df, "bin", least=15, neighbours=5, cosine=False))
    for g, points in groups.items():
        want = Y.clusters(np.array(points, float), 15, 5)
        assert [got[g][i] for i in range(len(points))] == want.tolist(), g
    assert {0, 1} <= set(got[0].values()) and set(got[3].values()) == {-1}


def test_unfit_vectors_are_noise(spark, rounds):
    good = list(blobs(2, 60, 4, 2, 0))
    bad = [None, [], [float("nan")] * 4, [float("inf"), 0, 0, 0]]
    df = frame(spark, {0: good + bad}).union(spark.createDataFrame([(None, 900, [1.0, None, 2.0, 0.0]), (0, 5, [0.0] * 4)], KIND))
    df = df.withColumn("w", F.lit("other")).withColumn("g", F.lit(1)).withColumn("p", F.lit(2))
    by_rounds = sorted(map(str, Y.detect(df, "bin", least=10, neighbours=3).collect()))
    rounds.setattr(Y, "KERNEL_POINTS", 10**6)
    assert by_rounds == sorted(map(str, Y.detect(df, "bin", least=10, neighbours=3).collect()))
    assert len(by_rounds) == 66


def test_no_rows_and_no_points(spark, rounds):
    empty = spark.createDataFrame([], KIND)
    assert Y.detect(empty, "bin").collect() == []
    assert [r.cluster for r in R.detect(frame(spark, {0: [None, None]}), "bin", "id", "v", 5, 3, True).collect()] == [-1, -1]


def test_lists_are_the_nearest(spark, rounds):
    rounds.setattr(R, "BLOCK", 50)
    data = blobs(3, 400, 8, 5, 100)
    work = Work(spark, "lists")
    points = R._packed(work, frame(spark, {0: data}), "bin", "id", "v", False).select("g", "v", F.lit(1).cast("long").alias("w"), F.col("id").alias("first"), F.col("id").alias("p"))
    cells = R._Cells(work, work.keep(points, "points"))
    assert cells.cells.count() > 3
    got = {}
    for r in R._lists(cells, 6).collect():
        got.setdefault(r.p, []).append((r.reach, r.x))
    for i, v in enumerate(data):
        far = np.linalg.norm(data - v, axis=1)
        assert [x for _, x in sorted(got[i])] == [j for j in np.argsort(far, kind="stable") if j != i][:6]


def test_five_thousand_vectors(spark, rounds):
    data = blobs(4, 5000, 6, 12, 400)
    got = found(Y.detect(frame(spark, {0: data}), "bin", least=50, neighbours=10))[0]
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    assert [got[i] for i in range(5000)] == Y.clusters(unit).tolist()


@pytest.mark.parametrize("cells, wide", [(2, 30), (5, 1000)])
def test_a_query_is_sent_once_for_each_part_of_cells(spark, rounds, cells, wide):
    """Parts and wide blocks of any size give the nearest, and no vector is written for each cell."""
    for name, value in (("BLOCK", 20), ("CELLS", cells), ("WIDE", wide)):
        rounds.setattr(R, name, value)
    data = blobs(5, 300, 8, 3, 100)
    work = Work(spark, "parts")
    points = R._packed(work, frame(spark, {0: data}), "bin", "id", "v", False).select("g", "v", F.lit(1).cast("long").alias("w"), F.col("id").alias("first"), F.col("id").alias("p"))
    known = R._Cells(work, work.keep(points, "points"))
    got = {}
    for r in R._lists(known, 4).collect():
        got.setdefault(r.p, []).append((r.reach, r.x))
    for i, v in enumerate(data):
        far = np.linalg.norm(data - v, axis=1)
        assert [x for _, x in sorted(got[i])] == [j for j in np.argsort(far, kind="stable") if j != i][:4]
    parts = -(-known.cells.agg(F.max("cell")).first()[0] // cells) + 1
    assert spark.read.parquet(work.paths["aimed"][-1]).count() <= 400 * parts


def test_lists_that_are_longer_than_a_block(spark, rounds):
    """The limit of a query comes from several blocks."""
    for name, value in (("BLOCK", 5), ("PIVOTS", 20)):
        rounds.setattr(R, name, value)
    data = np.round(blobs(6, 120, 3, 3, 40), 1)  # many equal distances
    work = Work(spark, "long")
    points = R._packed(work, frame(spark, {0: data}), "bin", "id", "v", False).select("g", "v", F.lit(1).cast("long").alias("w"), F.col("id").alias("first"), F.col("id").alias("p"))
    got = {}
    for r in R._lists(R._Cells(work, work.keep(points, "points")), 9).collect():
        got.setdefault(r.p, []).append((r.reach, r.x))
    for i, v in enumerate(data):
        far = np.linalg.norm(data - v, axis=1)
        far[i] = np.inf
        assert np.allclose([d for d, _ in sorted(got[i])], np.sort(far)[:9], atol=1e-9)

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.llm import negatives as N

from .fixtures import CLASHING


def brute(rows, anchor, positives=5, negatives=5, low=80, high=100):
    taken = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda p, q: sum(x * y for x, y in zip(p, q))
    first = {}
    for i, label, v in sorted(taken):
        if anchor(i):
            first.setdefault(i, (label, v))
    out = []
    for i, (label, v) in first.items():
        others = [(-score(v, w), j, m) for j, m, w in taken if j != i]
        for s, j, _ in sorted(x for x in others if x[2] == label)[:positives]:
            fit = sorted(x for x in others if x[2] != label and low * -s <= -100 * x[0] <= high * -s)[:negatives]
            out += [(i, j, r, k, -s, -t) for r, (t, k, _) in enumerate(fit, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


def vectors(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    v = centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dims))
    return [(i, int(rng.integers(0, 4)), (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(v)]


@pytest.mark.parametrize("seed, dims, spread", [(0, 64, 0.3), (1, 64, 2.0), (2, 20, 0.1), (3, 100, 0.5)])
def test_equals_brute_force(spark, seed, dims, spread):
    rows = vectors(seed, 700, dims, spread)
    found = N.mine(table(spark, rows).repartition(5), F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, found)) == brute(rows, lambda i: i % 10 == 0)


def test_steps_and_blocks_of_any_size(spark):
    """Many steps of a chunk and many blocks: what is kept from one step to the next decides."""
    rows = vectors(4, 6000, 16, 0.2)
    found = N.mine(table(spark, rows).coalesce(1), F.col("vec_id") % 20 == 0, positives=3, negatives=4, low_share=50, high_share=90).collect()
    assert sorted(map(tuple, found)) == brute(rows, lambda i: i % 20 == 0, 3, 4, 50, 90)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(5, 300, 8, 0.5)
    rows += [(None, 1, [1.0] * 8), (1000, None, [1.0] * 8), (1010, 1, None), (1020, 1, [1.0, None, 2.0]), (1030, 2, [nan] * 8), (1040, 3, [inf] * 8), (1050, 3, []), (1060, 2, [0.5, 0.5]), (1070, 1, [0.0] * 8), (1080, 9, [2.0] * 8)]
    rows += rows[10:14] + [(20, 0, rows[3][2]), (20, 3, rows[4][2])] + [(2000 + i, i % 2, [0.25] * 8) for i in range(30)]
    docs = table(spark, rows)
    for name in (*CLASHING, "vector", "numbers", "code", "length", "alignment", "positives", "slot", "block"):
        docs = docs.withColumn(name, F.lit(7)) if name not in docs.columns else docs
    found = N.mine(docs, F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, found)) == brute(rows, lambda i: i % 10 == 0)


def test_empty_tables_and_large_numbers(spark):
    docs = table(spark, vectors(6, 50, 8, 0.5))
    assert N.mine(docs.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert N.mine(docs, F.col("vec_id") < 0).collect() == []
    assert N.mine(docs.withColumn("label", F.lit(1)), F.col("vec_id") % 10 == 0).collect() == []
    with pytest.raises(Exception, match="beyond 2"):
        N.mine(table(spark, [(i, i % 2, [1e30] * 4) for i in range(9)]), F.col("vec_id") == 0).collect()


@pytest.mark.parametrize("dims", [3, 64, 200])
def test_intervals_hold_scores(dims):
    rng = np.random.default_rng(dims)
    x, q = (np.floor(256 * rng.normal(size=(n, dims)) * rng.choice([0, 0.01, 1, 50], (n, 1))) for n in (400, 60))
    assert np.allclose((N.rotated(x) ** 2).sum(1), (x * x).sum(1))
    low, high = N.Planes(q).bounds(*N.codes(x))
    exact = x @ q.T
    assert (low <= exact).all() and (exact <= high).all()
    real = (np.abs(x).sum(1) > 0)[:, None] & (np.abs(q).sum(1) > 0)
    width = (high - low)[real] / np.sqrt((x * x).sum(1)[:, None] * (q * q).sum(1))[real]
    assert width.mean() < 1.35  # of the 2 that lengths alone would leave

import pytest
from pyspark.sql import functions as F

from tallygrove.operators import agreement as A
from tallygrove.operators import sketches as H


def test_levels_are_united_from_cells(spark):
    rows = spark.range(30_000).select((F.col("id") % 5000).alias("id"), (F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"))
    store = H.sketched(rows, ["a", "b"], "id")
    assert store.count() == 21
    found = {(r.a, r.b, r.grouping_id): r.estimate for r in H.levels(store, [["a", "b"], ["b"], []]).collect()}
    assert len(found) == 21 + 3 + 1
    exact = {(r.a, r.b): r.n for r in rows.groupBy("a", "b").agg(F.count_distinct("id").alias("n")).collect()}
    assert all(abs(found[a, b, 0] - n) <= 0.05 * n for (a, b), n in exact.items())
    assert abs(found[None, None, 3] - 5000) <= 250


def test_more_rows_are_added_without_the_old_ones(spark):
    part = lambda s, e: H.sketched(spark.range(s, e).select("id", F.lit(1).alias("a")), ["a"], "id")
    both = H.extended(part(0, 4000), part(2000, 6000))
    assert abs(H.levels(both, [["a"]]).first().estimate - 6000) <= 300
    lost = spark.createDataFrame([(None, 1), (None, 1)], "id long, a int")
    assert H.levels(H.sketched(lost, ["a"], "id"), [["a"]]).first().estimate == 0
    assert H.levels(H.sketched(lost.limit(0), ["a"], "id"), [["a"]]).collect() == []


@pytest.mark.parametrize("a, b", [(lambda i: i % 3, lambda i: i % 5), (lambda i: i // 40, lambda i: (i * 7919) % 11), (lambda i: i, lambda i: i % 2), (lambda i: 0, lambda i: i % 4), (lambda i: i, lambda i: i), (lambda i: 0, lambda i: 0)])
def test_adjusted_information_equals_the_sum_over_pairs(spark, a, b):
    from math import log

    pairs = [(a(i), b(i)) for i in range(200)]
    n = len(pairs)
    sizes = [{x: [p[s] for p in pairs].count(x) for x in {p[s] for p in pairs}} for s in (0, 1)]
    found = A.adjusted_mi(spark.createDataFrame(pairs, "a int, b int"), "a", "b")
    if len(sizes[0]) == len(sizes[1]) and len(sizes[0]) in (1, n):
        assert found == 1
        return
    mi = sum(pairs.count(p) / n * log(n * pairs.count(p) / (sizes[0][p[0]] * sizes[1][p[1]])) for p in set(pairs))
    mean = sum(-sum(m / n * log(m / n) for m in side.values()) for side in sizes) / 2
    chance = A.expected_mi(list(sizes[0].values()), list(sizes[1].values()))
    below = mean - chance
    assert found == pytest.approx((mi - chance) / (below if abs(below) > 1e-15 else 1e-15), abs=1e-9)

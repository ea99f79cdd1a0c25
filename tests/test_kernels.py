import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.operators import agreement as A
from tallygrove.operators import bins as B
from tallygrove.operators import community as C
from tallygrove.operators import coupling as L
from tallygrove.operators import density as Y
from tallygrove.operators import fastrp as P
from tallygrove.operators import terms as T
from tallygrove.operators import tracking as K
from tallygrove.operators import vectors as V

TRIANGLES = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 0.2)]


def test_two_triangles():
    assert C.communities(6, TRIANGLES) == [0, 0, 0, 1, 1, 1]
    assert C.modularity(6, TRIANGLES, [0, 0, 0, 1, 1, 1]) > 0.4


def test_without_edges_every_node_is_its_own():
    assert C.communities(3, []) == [0, 1, 2]
    assert C.communities(1, []) == [0] and C.communities(0, []) == []


def test_communities_are_connected_and_no_worse_than_singletons():
    rng = random.Random(3)
    for _ in range(20):
        n = rng.randint(2, 30)
        edges = [(i, j, rng.random()) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.15]
        found = C.communities(n, edges)
        assert len(found) == n
        assert C.modularity(n, edges, found) >= C.modularity(n, edges, list(range(n))) - 1e-9
        for c in set(found):
            members = {i for i in range(n) if found[i] == c}
            seen, todo = set(), [min(members)]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [j for i, j, _ in edges if i == x and j in members] + [i for i, j, _ in edges if j == x and i in members]
            assert seen == members


def test_detect_on_frames(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(7)] + [(1, 9)], "bin int, id int")
    edges = spark.createDataFrame([(0, *e) for e in TRIANGLES], "bin int, a int, b int, weight double")
    found = {(r.bin, r.id): r.cluster for r in C.detect(nodes, edges, "bin").collect()}
    assert found[0, 0] == found[0, 1] == found[0, 2] != found[0, 3]
    assert len({found[0, i] for i in range(7)}) == 3 and found[1, 9] == 0
    assert {r.cluster for r in C.without_edges(nodes).collect()} == {-1}


def _blobs(n=60):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.2, (n, 2)) for c in ((0, 0), (5, 5), (0, 6))] + [rng.uniform(-20, 20, (12, 2)) + 40])
    return points, np.repeat([0, 1, 2, -1], [n, n, n, 12])


def test_density_finds_blobs_and_noise():
    points, truth = _blobs()
    found = Y.clusters(points, 20, 5)
    for c in range(3):
        values, counts = np.unique(found[truth == c], return_counts=True)
        assert values[counts.argmax()] >= 0 and counts.max() >= 55
    assert len(set(found[found >= 0])) == 3


def test_density_of_few_points_is_noise():
    assert (Y.clusters(np.zeros((3, 2)), 5, 2) == -1).all()
    assert len(Y.clusters(np.zeros((0, 2)), 5, 2)) == 0


def test_density_on_frames(spark):
    points, _ = _blobs(30)
    rows = [(int(i >= 51), i, [float(x) for x in p]) for i, p in enumerate(points)]
    found = Y.detect(spark.createDataFrame(rows, "bin int, id int, v array<double>"), "bin", least=10, neighbours=3, cosine=False)
    assert found.count() == len(rows) and found.filter("cluster < -1").count() == 0


def _partition(spark, a, b):
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(a, b))], "id int, a int, b int")


def test_agreement(spark):
    same = [i % 3 for i in range(30)]
    assert A.adjusted_mi(_partition(spark, same, same), "a", "b") == pytest.approx(1)
    rng = random.Random(0)
    other = [rng.randrange(3) for _ in range(300)]
    assert abs(A.adjusted_mi(_partition(spark, [i % 3 for i in range(300)], other), "a", "b")) < 0.03
    assert A.adjusted_mi(_partition(spark, [-1] * 30, same), "a", "b") is None  # all noise
    assert A.adjusted_mi(_partition(spark, same[:10], same[:10]), "a", "b") is None  # ten rows are too few


def test_expected_information_equals_the_mean_over_permutations():
    a, b = [0, 0, 0, 1, 1], [0, 0, 1, 1, 2]

    def mi(x, y):
        n = len(x)
        return sum(c / n * math.log(c * n / (x.count(i) * y.count(j))) for i in set(x) for j in set(y) if (c := sum(p == i and q == j for p, q in zip(x, y))))

    mean = np.mean([mi(a, list(p)) for p in itertools.permutations(b)])
    assert A.expected_mi([3, 2], [2, 2, 1]) == pytest.approx(mean)


@pytest.mark.parametrize("years, k", [([2000] * 5, 4), ([2000, 2001, 2001, 2001, 2009], 3), (list(range(1990, 2020)) * 3, 20), ([], 3)])
def test_bins_are_lower_quantiles(spark, years, k):
    found = B.equal_volume(spark.createDataFrame([(y,) for y in years], "year int"), k).orderBy("bin_id").collect()
    if not years:
        assert found == []
        return
    cuts = sorted({int(x) for x in np.quantile(np.sort(years), [j / k for j in range(1, k + 1)], method="lower")})
    assert [r.y_end for r in found] == cuts and found[-1].y_end == max(years)
    assert [r.y_start for r in found] == [min(years), *[c + 1 for c in cuts[:-1]]]


def test_windows_and_assignment(spark):
    span = spark.createDataFrame([(2010, 2013)], "year_min int, year_max int")
    windows = B.sliding(span)
    assert [(r.y_start, r.y_end) for r in windows.orderBy("bin_id").collect()] == [(2010, 2012), (2011, 2013)]
    assert B.sliding(span, 9).count() == 0
    rows = spark.createDataFrame([(1, 2011), (2, 2010), (3, 1999), (4, None)], "id int, year int")
    assert {r.id: r.bin_id for r in B.assign(rows, windows).collect()} == {1: 1, 2: 0, 3: -1, 4: -1}
    assert {r.id: r.bin_id for r in B.assign(rows, windows, last=False).collect()}[1] == 0
    assert B.members(rows, windows).count() == 3


def test_coupling_counts_repeated_references(spark):
    refs = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, "y"), (3, "y"), (3, "z")], "id int, ref string")
    edges = L.coupled(refs)
    assert sorted(map(tuple, edges.collect())) == [(1, 2, 2), (2, 3, 1)]
    weights = {(r.a, r.b): r.weight for r in L.salton(edges, refs).collect()}
    assert weights[2, 3] == pytest.approx(0.5) and max(weights.values()) <= 1 + 1e-6


def test_tracking_is_strict_and_ignores_noise(spark):
    rows = [(0, "a", i) for i in range(20)] + [(1, "b", 0)] + [(1, "b", 100 + i) for i in range(0)] + [(2, "c", 0), (2, "-", 5)]
    df = spark.createDataFrame([(b, {"a": 1, "b": 2, "c": 3, "-": -1}[c], i) for b, c, i in rows], "bin_id int, cluster int, id int")
    found = {(r.from_bin, r.to_bin): r.jaccard for r in K.transitions(df).collect()}
    assert found == {(1, 2): 1.0}  # 1 of 20 is 0.05, which is not above it
    assert {(r.from_bin, r.to_bin) for r in K.transitions(df, least=0.04).collect()} == {(0, 1), (1, 2)}
    assert K.transitions(df.limit(0)).count() == 0


def test_fastrp_vectors_are_units_without_nan(spark):
    edges = spark.createDataFrame([("W1", "W2"), ("W2", "I1"), ("W3", "I1")], "src string, dst string")
    found = [r.v for r in P.fastrp(edges, 16, 3).collect()]
    assert len(found) == 4 and all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in found)


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id int, embedding array<double>")
    found = V.nearest(df, df.filter("vec_id % 20 = 0"), 3, block=64).orderBy("query", "rank").collect()
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for q in range(0, 200, 20):
        order = [i for i in np.argsort(-(unit @ unit[q])) if i != q][:3]
        assert [r.neighbour for r in found if r.query == q] == order


def test_small_bins(spark):
    rows = spark.createDataFrame([(0, 3)] * 2 + [(1, 3)] * 5, "bin_id int, cluster int")
    assert {(r.bin_id, r.cluster) for r in K.small_bins(rows, "cluster", least=3).collect()} == {(0, 0), (1, 3)}
    assert rows.filter(F.col("cluster") == 3).count() == 7


def test_terms_of_texts_that_share_a_key_of_few_words_and_of_no_cluster(spark, monkeypatch):
    """Against counting: copies of a key are one text, ties at the vocabulary's end, and tables too large to be brought near."""
    import math
    import random
    from collections import Counter, defaultdict

    rng = random.Random(4)
    rows = [(c, rng.randrange(30), " ".join(rng.choice("ab cd ef gh ij kl".split()) + str(rng.randrange(3)) for _ in range(rng.randrange(12)))) for c in ("x", "y") for _ in range(40)]
    rows += [("z", 1, "one two"), (None, 2, "one two"), ("x", 3, None), ("x", None, "ab0 ab0 cd1"), ("y", 5, "the a")]

    def terms(text):
        w = [x for x in text.split() if len(x) > 1 and x not in T.STOP_WORDS]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    wanted = set()
    for c in ("x", "y", "z"):
        tf, n = defaultdict(Counter), sum(r[0] == c and r[2] is not None for r in rows)
        for r in rows:
            if r[0] == c and r[2] is not None:
                tf[r[1]].update(terms(r[2]))
        total = sum(tf.values(), Counter())
        known = sorted(total, key=lambda t: (-total[t], t))[:20]
        idf = {t: math.log((1 + n) / (1 + sum(t in f for f in tf.values()))) + 1 for t in known}
        sums = Counter()
        for k, f in tf.items():
            x = {t: f[t] * idf[t] for t in known if f[t]}
            for t in x if k is not None else ():
                sums[t] += x[t] / math.sqrt(sum(v * v for v in x.values()))
        best = sorted(sums, key=lambda t: (-round(sums[t], 6), t))[:6]
        wanted |= {(c, t, round(sums[t], 5), i + 1) for i, t in enumerate(best)}
    df = spark.createDataFrame(rows, "c string, id int, text string")
    for near in (T.NEAR, 0):
        monkeypatch.setattr(T, "NEAR", near)
        found = T.cluster_terms(df, "c", features=20, top=6).collect()
        assert {(r.c, r.term, round(r.weight, 5), r.rank) for r in found} == wanted


def test_pairs_of_words_that_cannot_be_in_the_vocabulary_are_not_counted(spark, monkeypatch):
    kept, keep = {}, T.Work.keep
    monkeypatch.setattr(T.Work, "keep", lambda self, df, name, **more: kept.setdefault(name, keep(self, df, name, **more)))
    rows = [(0, i, f"often often often rare{i} seldom{i}") for i in range(50)]
    found = T.cluster_terms(spark.createDataFrame(rows, "c int, id int, text string"), "c", features=1)
    assert [(r.term, r.rank) for r in found.collect()] == [("often", 1)]
    assert [r.term for r in kept["often"].collect()] == ["often"] and kept["vocabulary"].count() == 1


@pytest.mark.parametrize("size", [1, 3, 2048])
def test_coupling_through_lists_of_any_length(spark, monkeypatch, size):
    """A reference that all cite, in one group or none; null ids, groups and references couple nothing; numbers ride along."""
    monkeypatch.setattr(L, "LIST", size)
    rng = random.Random(size)
    rows = [(y, i, r) for y in (1, 2) for i in range(12) for r in ["hub", *(rng.choice("abcde") for _ in range(3))]] + [(None, 1, "a"), (None, 2, "a"), (1, 3, None), (1, 4, None), (1, None, "hub")]
    refs = spark.createDataFrame(rows, "year int, id int, ref string")
    times = {(y, i, r): rows.count((y, i, r)) for y, i, r in rows if None not in (y, i, r)}
    wanted = {}
    for (y, a, r), m in times.items():
        for b in range(a + 1, 12):
            if n := times.get((y, b, r)):
                wanted[y, a, b] = wanted.get((y, a, b), 0) + m * n
    assert {(e.year, e.a, e.b): e.shared for e in L.coupled(refs, "year").collect()} == wanted
    k = lambda y, i: sum(x[:2] == (y, i) for x in rows)
    found = {(e.year, e.a, e.b): e.weight for e in L.salton(L.coupled(refs, "year", sized=True), refs, "year", 0.2).collect()}
    assert found == pytest.approx({(y, a, b): s / math.sqrt(k(y, a) * k(y, b)) for (y, a, b), s in wanted.items() if s / math.sqrt(k(y, a) * k(y, b)) >= 0.2})


def test_tasks_grow_with_the_table_and_pairs_meet_no_join(spark, monkeypatch):
    from tallygrove.plans import fronts, works
    from tallygrove.sources import work

    monkeypatch.setattr(work, "TASK_ROWS", 500)
    data = "/root/testdata/sf0.001"
    assert works.work_institutions(spark, data).rdd.getNumPartitions() >= 10
    assert fronts.coupling(spark, data).rdd.getNumPartitions() > 4
    plan = fronts.salton_edges(spark, data)._jdf.queryExecution().toString()
    assert "Join" not in plan




def test_degrees_are_counted_from_tables_dealt_by_work(spark, monkeypatch):
    """One shuffle of the line items serves what is distinct and what is joined, in tasks of bounded rows."""
    from tallygrove.plans import fronts
    from tallygrove.sources import work

    monkeypatch.setattr(work, "TASK_ROWS", 500)
    edges = fronts.hetero_edges(spark, "/root/testdata/sf0.001")
    assert edges.rdd.getNumPartitions() > 12
    plan = fronts.degree(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "o_totalprice" not in plan.split("== Physical Plan ==")[1]

"""Queries do the whole job: all rows, production sizes. SQL without a cut is made from the registered one."""

import hashlib

import numpy as np
import pytest

from tallygrove.operators import community as C
from tallygrove.operators import vectors as V
from tallygrove.plans import fronts, registry, works

from .compare import check

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def whole(name: str, **cuts: str) -> str:
    sql = ORACLES[name]
    for old, new in cuts.values():
        sql = sql.replace(old, new)
    return sql


@pytest.mark.parametrize("name", ["coupling", "salton_edges", "hetero_edges", "degree"])
def test_works_of_all_years(spark, name):
    sql = whole(name, year=(" WHERE year = 1997", ""), pairs=("x.ref = y.ref", "x.year = y.year AND x.ref = y.ref"))
    assert "1997" not in sql
    check(spark, DATA, QUERIES[name], sql)


def test_citations_of_all_years(spark):
    sql = whole("citation_text", year=(" WHERE year = 1997", ""), line=("'(1997) J, Cited '", "'(' || year || ') J, Cited '"))
    assert "1997" not in sql
    check(spark, DATA, QUERIES["citation_text"], sql)


def test_communities_of_all_years(spark):
    nodes = works.works(spark, DATA).select("year", "id").collect()
    edges = fronts.salton_edges(spark, DATA).collect()
    found = {(r.year, r.id): r.cluster for r in fronts.communities(spark, DATA).collect()}
    wanted = set()
    for year in {n.year for n in nodes}:
        ids = sorted(n.id for n in nodes if n.year == year)
        place = {x: i for i, x in enumerate(ids)}
        links = sorted((place[e.a], place[e.b]) for e in edges if e.year == year)
        assert links
        got = [found[year, x] for x in ids]
        assert C.modularity(len(ids), [(a, b, 1.0) for a, b in links], got) > 0
        wanted |= {(year, x) for x in ids}
    assert len({year for year, _ in wanted}) > 1 and set(found) == wanted == {(n.year, n.id) for n in nodes}


def test_fastrp_has_production_size_and_equals_brute_force(spark):
    edges = [tuple(r) for r in fronts._hetero(spark, DATA).collect()]
    names = sorted({x for e in edges for x in e})
    place = {x: i for i, x in enumerate(names)}
    links = np.array([(place[a], place[b]) for a, b in edges])
    own = np.array([[1 if hashlib.md5(f"{x}:{i}".encode()).hexdigest()[0] < "8" else -1 for i in range(128)] for x in names]) * 128**-0.5
    now = own
    for _ in range(3):
        total, count = np.zeros_like(own), np.zeros(len(names))
        for a, b in (links.T, links.T[::-1]):
            np.add.at(total, a, now[b])
            np.add.at(count, a, 1)
        now = total / count[:, None] + own
    now /= np.linalg.norm(now, axis=1, keepdims=True)
    found = fronts.fastrp(spark, DATA).toPandas()
    assert set(found.node) == {f"W{r.id}" for r in works.works(spark, DATA).select("id").collect()}
    assert len(found) == 128 * found.node.nunique()
    assert np.abs(now[found.node.map(place), found.dim] - found.x).max() < 1.1e-5


def test_transitions_of_all_users(spark):
    sql = whole("cluster_transitions", users=(" WHERE id % 5 = 1", ""))
    assert "% 5" not in sql
    check(spark, DATA, QUERIES["cluster_transitions"], sql)


def test_types_of_all_works(spark):
    sql = whole("type_densified", gap=(" WHERE NOT (year = 1999 AND kind = 'R')", ""))
    assert "1999" not in sql
    check(spark, DATA, QUERIES["type_densified"], sql)


def test_a_gap_is_filled_with_zero(spark, tmp_path):
    """Returns in 1998 only."""
    for name in ("customer", "lineitem", "orders"):
        spark.read.parquet(f"{DATA}/{name}.parquet").createOrReplaceTempView(name)
    spark.table("customer").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT * FROM orders WHERE year(o_orderdate) IN (1997, 1998)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT l.* FROM lineitem l JOIN orders ON o_orderkey = l_orderkey WHERE year(o_orderdate) = 1998 OR l_returnflag <> 'R'").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {(r.year, r.kind): r.n for r in QUERIES["type_densified"](spark, str(tmp_path)).collect()}
    assert {y for y, _ in found} == {1997, 1998} and len(found) == 2 * len({k for _, k in found})
    assert found[1997, "R"] == 0 and all(n > 0 for at, n in found.items() if at != (1997, "R"))


def test_equal_vectors_go_by_id(spark):
    """300 equal vectors in one block, in falling order of ids; then in blocks of about 40."""
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(299, -1, -1)] + [(1000 + i, [float(i), 1.0, 0.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>").coalesce(1)
    for block in (2048, 40):
        found = V.nearest(df, df.filter("vec_id in (0, 3, 250)"), 5, block=block).orderBy("query", "rank").collect()
        assert [[r.neighbour for r in found if r.query == q] for q in (0, 3, 250)] == [[1, 2, 3, 4, 5], [0, 1, 2, 4, 5], [0, 1, 2, 3, 4]]


def test_segments_of_full_size(spark):
    data = DATA.replace("0.001", "0.01")
    sql = whole("institution_segments", top=("LIMIT 200", "LIMIT 1000"), country=("LIMIT 50", "LIMIT 500"), region=("<= 20", "<= 100"))
    check(spark, data, QUERIES["institution_segments"], sql)


@pytest.fixture(scope="module")
def analysed(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("fronts"))
    run, _ = fronts.analysis(spark, DATA, root)
    return run, {name: spark.read.parquet(f"{root}/{name}") for name in run.computed}


def test_every_year_is_in_a_window_and_clusters_are_tracked(spark, analysed):
    _, levels = analysed
    years = {r.year for r in works.works(spark, DATA).select("year").distinct().collect()}
    windows = levels["windows"].collect()
    assert years == {y for w in windows for y in range(w.y_start, w.y_end + 1)}
    assert {w.y_end - w.y_start for w in windows} == {2} and len(windows) == len(years) - 2
    assert levels["metadata"].select("id").distinct().count() == works.works(spark, DATA).count()
    moves = levels["tracking"].select("from_bin").distinct().collect()
    assert len(moves) == len(windows) - 1


def test_all_levels_run(analysed):
    run, levels = analysed
    assert tuple(run.computed) == run.levels
    for name in ("structural", "semantic", "topological"):
        assert levels[name].count() == levels["metadata"].count() == levels[name].select("bin_id", "id").distinct().count()
    assert levels["semantic"].filter("cluster is not null").count() > 0 and levels["topological"].filter("cluster is null").count() == 0
    ami = {r.pair: r.ami for r in levels["agreement"].collect()}
    assert set(ami) == {"ami_structural_vs_semantic", "ami_structural_vs_topological", "ami_semantic_vs_topological"}
    assert all(x is None or -1 <= x <= 1 + 1e-9 for x in ami.values())
    rows = levels["labels"].collect()
    assert rows and all(r.size >= 5 and r.label and len(r.keywords.split(", ")) <= 8 for r in rows)


def test_small_bins_and_bins_without_references(spark):
    meta = spark.createDataFrame([(b, i) for b, n in ((0, 49), (1, 50), (2, 50)) for i in range(n)], "bin_id int, id long")
    refs = spark.createDataFrame([(b, i, i // 2) for b in (0, 1) for i in range(40)], "bin_id int, id long, ref long")
    found = fronts._structural(meta, refs).toPandas().groupby("bin_id").cluster.apply(set)
    assert found[0] == {0} and len(found[1]) == 30 and found[2] == {-1}

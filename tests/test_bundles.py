"""Harvest plans, hierarchies, vectors of texts, and what runs without the training-data part."""

import math
import os
import shutil
import subprocess
import sys
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.operators import agreement as A
from tallygrove.operators import harvest as H
from tallygrove.operators import vectors as V
from tallygrove.sources import readers as S


def test_parts_are_disjoint_cover_all_and_are_small(spark):
    rows = [(2020 + i % 2, H.MONTHS[i % 12] if i % 5 else None, ["ar", "re", None][i % 3], ["MED", "ART"][i % 7 == 0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "year int, month string, kind string, area string")
    parts = H.yearly(H.counted(df, ["year", "month", "kind", "area"]), 2020, 2021, ("ar", "re"), ("MED",), most=60)
    assert sum(n for _, n in parts) == 3000 and len({p.name for p, _ in parts}) == len(parts)
    seen = 0
    for scope, n in parts[:12]:
        assert df.filter(scope.predicate()).count() == n
        seen += n
    assert seen and all(n <= 60 or len(p.equal) + len(p.without) == 4 for p, n in parts)


def test_what_no_split_makes_small_is_halved_by_dates():
    days = [date(2020, 1, 1 + i % 28) for i in range(1000)]
    count = lambda s: sum(s.dates is None or s.dates[0] <= d <= s.dates[1] for d in days)
    parts = list(H.partition(count, H.Scope(), [], 300, (date(2020, 1, 1), date(2020, 1, 28))))
    assert len(parts) > 3 and all(n <= 300 for _, n in parts) and {d for d in days} == {d for p, _ in parts for d in days if p.dates[0] <= d <= p.dates[1]}
    assert list(H.partition(lambda s: 0, H.Scope(), [])) == []


def test_half_years():
    found = H.half_years("MEDI", 2020, 2021)
    assert len(found) == 6 and found[0] == ("medi_2020_h1", "MEDI", 2020, H.MONTHS[:6]) and found[2][3] == ()


def test_gathered_parts_keep_the_earliest_row(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "eid int, t string")
    b = spark.createDataFrame([(2, "z", 5), (3, "w", 6)], "eid int, t string, more int")
    found = H.gather([a, b], "eid", "n", "q", 2000, 2001, ["e"])
    assert sorted(map(tuple, found.rows.select("eid", "t").collect())) == [(1, "x"), (2, "y"), (3, "w")]
    assert found.metadata == {"name": "n", "query": "q", "start_year": 2000, "end_year": 2001, "total_documents": 3, "exclusions": ["e"]}


def test_hierarchy_from_artefacts(spark, tmp_path):
    for name in ("pulmonary_and_respiratory_medicine/main", "anatomy/main", "anatomy/types"):
        spark.range(1).write.parquet(f"{tmp_path}/{name}")
    known = spark.createDataFrame([("Health Sciences", "Medicine", "Anatomy")], "domain string, field string, subfield string")
    found = {tuple(r) for r in S.hierarchy_from_artefacts(spark, str(tmp_path), known).collect()}
    assert found == {("Health Sciences", "Medicine", "Anatomy"), (*S.NOWHERE, "Pulmonary and Respiratory Medicine")}
    assert S.hierarchy_from_artefacts(spark, str(tmp_path)).count() == 2


def test_sources_are_asked_in_turn(spark):
    asked = []

    def source(name, found):
        def ask():
            asked.append(name)
            return found

        return ask

    assert S.first_of(source("a", None), source("b", spark.range(0)), source("c", spark.range(3)), source("d", spark.range(9))).count() == 3
    assert asked == ["a", "b", "c"] and S.first_of() is None


def test_rows_are_counted_without_reading_a_column(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").groupBy().count()
    assert "ReadSchema: struct<>" in df._jdf.queryExecution().toString()
    assert S.row_count(spark, "/root/testdata/sf0.001/orders.parquet") == df.first()[0]


def test_principal_components(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 2)) @ np.array([[3.0, 0, 1, 0], [0, 1.0, 0, 1]]) + 0.01 * rng.standard_normal((200, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>")
    found = np.array([r.reduced for r in V.reduced(df, "v", 2).orderBy("id").collect()])
    centred = found - found.mean(0)
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(centred), np.abs((x - x.mean(0)) @ axes[:2].T), atol=1e-6)


def test_vectors_that_are_null_are_no_neighbours(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 1.0]), (4, []), (5, [None, 1.0])], "vec_id int, embedding array<double>")
    assert [(r.query, r.neighbour) for r in V.nearest(df, df).orderBy("query").collect()] == [(1, 3), (3, 1)]


def test_log_factorials_and_expected_information():
    x = np.array([0, 1, 5, 62, 63, 64, 100, 10_000, 1_000_000])
    assert np.allclose(A.log_factorial(x), [math.lgamma(i + 1) for i in x], rtol=1e-13, atol=1e-10)
    rows, columns = [3, 4, 5], [6, 6]
    n, total = 12, 0.0
    for a in rows:
        for b in columns:
            for k in range(max(1, a + b - n), min(a, b) + 1):
                total += k / n * math.log(n * k / (a * b)) * math.comb(b, k) * math.comb(n - b, a - k) / math.comb(n, a)
    assert A.expected_mi(rows, columns) == pytest.approx(total)
    assert A.expected_mi([50_000] * 20, [100_000] * 10) < 1e-3


@pytest.mark.parametrize("broken", [False, True])
def test_the_entry_without_the_training_data_part(tmp_path, broken):
    """Taken away, or there but not importable (a library is missing)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tallygrove", tmp_path / "tallygrove", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    if broken:
        (tmp_path / "tallygrove" / "llm").mkdir()
        (tmp_path / "tallygrove" / "llm" / "__init__.py").write_text("")
        (tmp_path / "tallygrove" / "llm" / "queries.py").write_text("import no_such_library\n")
        (tmp_path / "corpus_pipeline.py").write_text("from tallygrove.llm import queries\n")
    code = "import __spark_entry__ as e; assert len(e.queries()) > 90 and not {'pipeline'} & set(e.queries()) and not [q for q in e.queries() if q.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_small_bins_and_consolidated_rows_of_null_keys(spark):
    from tallygrove.operators import dedup, tracking

    rows = spark.createDataFrame([(None, 1, 5), (None, 2, 6), (1, 3, 7), (1, 4, 8), (1, 5, 9)], "bin_id int, id int, cluster int")
    found = {r.id: r.cluster for r in tracking.small_bins(rows, "cluster", least=3).collect()}
    assert found == {1: 0, 2: 0, 3: 7, 4: 8, 5: 9}
    kept = dedup.prefer_consolidated(rows.withColumn("c", F.when(F.col("id") != 1, F.col("id").cast("string"))), ["bin_id"], "c")
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4, 5]

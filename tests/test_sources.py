import datetime
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.functions import text as X
from tallygrove.operators import cube, dedup, export, reshape
from tallygrove.plans import fronts, stages
from tallygrove.sources import readers, writers


def test_reading_what_is_not_there(spark, tmp_path):
    assert readers.read_or_none(spark, str(tmp_path / "none")) is None
    assert readers.artefact(spark, str(tmp_path), "Lung Disease", "main") is None
    with pytest.raises(ValueError):
        readers.artefact(spark, str(tmp_path), "x", "nothing")


def test_artefacts_and_metrics_by_name(spark, tmp_path):
    writers.overwrite(spark.range(3), f"{tmp_path}/lung_disease/types")
    assert readers.artefact(spark, str(tmp_path), " Lung Disease ", "types").count() == 3
    writers.overwrite(spark.range(2), f"{tmp_path}/country_annual")
    assert readers.cached_metrics(spark, str(tmp_path), "country", "annual").count() == 2


def test_append_reconciles_schemas(spark, tmp_path):
    path = str(tmp_path / "works")
    first = spark.createDataFrame([(1, "a", None)], T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("gap", T.NullType())]))
    writers.append(first, path)
    writers.append(spark.createDataFrame([("x", 2, [1, 2])], "extra string, id int, name array<int>"), path)
    writers.append(spark.createDataFrame([("no",)], "id string"), path)
    rows = {(r.id, r.name, r.gap) for r in spark.read.parquet(path).collect()}
    assert rows == {(1, "a", None), (2, "[1,2]", None), (None, None, None)}  # all three batches are there


def test_append_new_resumes(spark, tmp_path):
    path = str(tmp_path / "store")
    writers.append_new(spark.range(3), path, "id")
    writers.append_new(spark.range(5), path, "id")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]


def test_store_creation_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "vectors")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.ArrayType(T.FloatType()))])
    writers.create_store(spark, path, schema)
    writers.append(spark.createDataFrame([("a",)], "id string"), path)
    writers.create_store(spark, path, schema)
    assert spark.read.parquet(path).count() == 1
    writers.add_column(spark, path, str(tmp_path / "two"), "model_b", "array<float>")
    assert spark.read.parquet(str(tmp_path / "two")).columns == ["id", "v", "model_b"]


def test_text_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2]), (2, None)], "id int, a array<int>")
    writers.csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    writers.json(df, str(tmp_path / "json"))
    assert readers.json_lines(spark, str(tmp_path / "json"), "id int, a array<int>").count() == 2
    writers.text(spark.createDataFrame([("a\nb",)], "block string"), str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).count() == 2


def test_nulls_for_empty(spark):
    df = spark.createDataFrame([("", [], 1), ("x", ["y"], 2), (None, None, 3)], "s string, a array<string>, n int")
    assert [(r.s, r.a) for r in readers.nulls_for_empty(df).orderBy("n").collect()] == [(None, None), ("x", ["y"]), (None, None)]


def test_reindexed_and_tolerant(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    out = readers.reindexed(df, T.StructType([T.StructField("c", T.StringType()), T.StructField("a", T.LongType())]))
    assert out.columns == ["c", "a"] and out.first().asDict() == {"c": None, "a": 1}
    assert readers.tolerant(df, ["z", "b"]).columns == ["b"]


def test_journals_from_json_text_or_structs(spark):
    raw = spark.createDataFrame([("j", "5", '{"2yr_mean_citedness": 1.5, "h_index": 7}', "true"), ("k", "bad", "no json", None)], "id string, works_count string, summary_stats string, is_in_doaj string")
    a, b = readers.journals(raw).orderBy("id").collect()
    assert (a.works_count, a.mean_citedness, a.h_index, a.is_in_doaj, a.is_oa) == (5.0, 1.5, 7.0, True, False)
    assert (b.works_count, b.mean_citedness, b.is_in_doaj) == (0.0, 0.0, False)


def test_year_range_defaults(spark):
    empty = spark.createDataFrame([], "year int")
    assert tuple(readers.year_range(empty).first()) == (2000, 2025)


def test_names_and_identifiers(spark):
    df = spark.createDataFrame([("Ada B Lovelace", " 10.1/X "), ("Plato", "https://doi.org/10.2/y"), (None, "")], "n string, d string")
    rows = df.select(X.short_author(F.col("n")).alias("n"), X.doi_url(F.col("d")).alias("d")).collect()
    assert [tuple(r) for r in rows] == [("Lovelace A.", "https://doi.org/10.1/x"), ("Plato", "https://doi.org/10.2/y"), (None, None)]
    joined = spark.createDataFrame([([" a ", None, "", "b"],), (None,)], "x array<string>").select(X.safe_join(F.col("x")).alias("x"))
    assert [r.x for r in joined.collect()] == ["a; b", ""]


def test_citation_block_leaves_empty_lines_out(spark):
    df = spark.createDataFrame([("W1", "T", 2020, "closed", None)], "id string, title string, publication_year int, oa_status string, doi string")
    lines = df.select(export.citation_block(df).alias("b")).first().b.split("\n")
    assert lines[0] == "[No authors]" and "(2020) [No source]" in lines
    assert not [x for x in lines if x.startswith(("DOI", "OPEN ACCESS", "ABSTRACT", "REFERENCES"))]
    head = spark.range(1).select(export.header(F.lit(datetime.date(2024, 2, 3)))).first()[0]
    assert head == "Scopus\nEXPORT DATE: 03 February 2024\n"


def test_network_document_is_json(spark):
    nodes = spark.createDataFrame([("a", "A \"x\"", 2), ("b", None, 1)], "id string, label string, weight int")
    edges = spark.createDataFrame([("a", "b", 3.0)], "s string, t string, w double")
    text = export.network_document(export.network_items(nodes, "id", "label", F.lit(1), "weight"), export.network_links(edges, "s", "t", "w")).first()[0]
    found = json.loads(text)["network"]
    assert found["items"][0] == {"id": "a", "label": 'A "x"', "cluster": 1, "weight": 2, "type": "node"}
    assert found["links"] == [{"source_id": "a", "target_id": "b", "strength": 3.0}]


def test_markdown_head():
    assert export.markdown_head(["a", "b"]) == ["| a | b |", "| --- | --- |"]


def test_dedup_and_preferences(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, v int, w string")
    assert sorted(map(tuple, dedup.latest(df, ["k"], ["v"]).collect())) == [("a", 2, "y"), ("b", 1, "z")]
    assert sorted(map(tuple, dedup.first(df, ["k"], ["v"]).collect())) == [("a", 1, "x"), ("b", 1, "z")]
    rows = spark.createDataFrame([("a", ""), ("a", "MX"), ("b", "US")], "k string, c string")
    assert sorted(map(tuple, dedup.prefer_consolidated(rows, ["k"], "c").collect())) == [("a", ""), ("b", "US")]


def test_regions_and_entity_aliases(spark):
    df = spark.createDataFrame([("MX",), ("ZZ",)], "entity_name string")
    found = df.select(cube.region_of(F.col("entity_name"), {"South": ["MX", "BR"], "North": ["US"]}).alias("r")).collect()
    assert [r.r for r in found] == ["South", "Other"]
    assert cube.of_entity(df, "México").count() == 1


def test_pivot_fills_with_zero(spark):
    df = spark.createDataFrame([("a", "x", 2)], "e string, t string, n long")
    assert reshape.pivoted(df, "e", "t", ["y", "x"], "n").first().asDict() == {"e": "a", "y": 0, "x": 2}


def test_levels_resume_and_force(spark, tmp_path):
    run, labels = fronts.analysis(spark, "/root/testdata/sf0.001", str(tmp_path))
    assert run.computed[0] == "windows" and labels.count() >= 0
    again, _ = fronts.analysis(spark, "/root/testdata/sf0.001", str(tmp_path))
    assert again.computed == []
    forced, _ = fronts.analysis(spark, "/root/testdata/sf0.001", str(tmp_path), "agreement")
    assert forced.computed == ["agreement", "tracking", "labels"]
    assert run.status()["semantic"] > 0 and run.status()["windows"] > 0
    with pytest.raises(ValueError):
        stages.forced("nothing", "windows")


def test_blocs(spark):
    from tallygrove.functions import dims

    assert len(dims.BLOCS) == 9 and len(dims.codes()) == len(set(dims.codes())) == 99
    df = spark.createDataFrame([("MX", ["US", "CN"]), ("TR", []), (None, None)], "c string, l array<string>")
    found = df.select(dims.bloc(F.col("c")).alias("b"), dims.first_bloc(F.col("l")).alias("f"), dims.country_name(F.col("c")).alias("n")).collect()
    assert [tuple(r) for r in found] == [("Latinoamérica y Caribe", "China", "México"), ("Other", "Other", "Turquía"), ("Other", "Other", None)]
    assert dims.table(spark).count() == 99
    codes = spark.createDataFrame([("MX", "MEX")], "iso2 string, iso3 string")
    assert [r.iso3 for r in dims.iso3(df, "c", codes).collect()] == ["MEX"]


def test_metric_levels_are_written_as_tables(spark, tmp_path):
    from tallygrove.operators import periodic

    rows = [("j", "MX", 2020, 1.0, 95.0, "gold", "es"), ("j", "MX", 2021, None, None, None, None), ("k", "BR", 2020, 2.0, 99.5, "closed", "xx")]
    df = spark.createDataFrame(rows, "journal_id string, country_code string, year int, fwci double, percentile double, oa_status string, language string")
    found = {(r.level, r.kind, r.period, r.journal_id or r.country_code): r for r in periodic.levels(df).collect()}
    assert len(found) == 3 + 2 + 3 + 2 + 2 + 1
    j = found["journal", "period", "2020-2021", "j"]
    assert (j.num_documents, j.fwci_avg, j.pct_top_10, j.pct_top_1, j.pct_oa_gold, j.pct_lang_es, j.pct_lang_other) == (2, 0.5, 50.0, 0.0, 50.0, 50.0, 50.0)
    periodic.written(periodic.levels(df), str(tmp_path / "m"))
    assert spark.read.parquet(f"{tmp_path}/m/part=country_annual").count() == 3

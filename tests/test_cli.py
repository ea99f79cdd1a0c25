import pytest

from tallygrove.__main__ import main

TABLES = "/root/testdata/sf0.001"


def test_query_run_and_status(spark, tmp_path, capsys):
    assert main(["query", "year_histogram", "--tables", TABLES, "--out", str(tmp_path / "q")]) == 0
    assert spark.read.parquet(str(tmp_path / "q")).count() == 7
    assert main(["run", "--tables", TABLES, "--root", str(tmp_path / "r")]) == 0
    assert main(["run", "--tables", TABLES, "--root", str(tmp_path / "r")]) == 0
    assert main(["status", "--root", str(tmp_path / "r")]) == 0
    said = capsys.readouterr().out
    assert "computed: windows" in said and "computed: nothing" in said and "semantic     -" not in said and "semantic" in said


def test_setup_embed_and_all(spark, tmp_path, capsys):
    root, texts = str(tmp_path / "r"), str(tmp_path / "t")
    spark.createDataFrame([(1, "Deep water"), (2, None)], "id long, text string").write.parquet(texts)
    assert main(["setup", "--root", root]) == 0 and spark.read.parquet(f"{root}/vectors").count() == 0
    assert main(["embed", "--texts", texts, "--root", root]) == 0
    spark.createDataFrame([(3, "more")], "id long, text string").write.mode("append").parquet(texts)
    assert main(["all", "--tables", TABLES, "--texts", texts, "--root", root]) == 0
    said = capsys.readouterr().out
    assert "embedded: 2" in said and "embedded: 1" in said and "computed: windows" in said and "labels" in said
    assert spark.read.parquet(f"{root}/vectors").count() == 3


def test_unknown_query_is_refused():
    with pytest.raises(SystemExit):
        main(["query", "nothing", "--tables", "x", "--out", "y"])

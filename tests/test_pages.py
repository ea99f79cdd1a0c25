import glob

import pytest

from tallygrove.sources import pages as P

SCHEMA = "id long, title string, score double, year int, country string"
NAMES = "year int, country string"
BY = ["year", "country"]


def rows_of(df):
    return sorted((tuple(r[c] for c in ("id", "title", "score", "year", "country")) for r in df.collect()), key=repr)


@pytest.fixture
def written(spark, tmp_path):
    rows = [(i, f"title é {i}\nline \"two\"", i / 7, 2000 + i % 3, ["PERU", "COSTA RICA", "A/B=C", None][i % 4]) for i in range(240)]
    rows += [rows[5], rows[5], (None, None, None, None, "PERU"), (900, "", float("1e300"), 2001, ""), (901, "x" * 3_000_000, 0.0, 2002, "PERU")]
    docs = spark.createDataFrame(rows, SCHEMA)
    folder = str(tmp_path / "pages")
    P.write_pages(docs, folder, BY, size=6)
    return docs, folder


def spoil(folder, pattern):
    found = glob.glob(f"{folder}/{pattern}/page=*/*.txt")
    assert found
    for path in found:
        with open(path, "w") as f:
            f.write("not a header\nnot a record\n")
    return len(found)


def test_all_records_come_back(spark, written):
    docs, folder = written
    empty_is_null = docs.replace("", None, ["country"])  # folders have no name for an empty value
    assert rows_of(P.pages(spark, folder, SCHEMA, BY)) == rows_of(empty_is_null)


def test_a_filter_opens_only_its_pages(spark, written):
    """All other pages are unreadable, and one task is planned for each page that is wanted."""
    docs, folder = written
    wanted = docs.filter("year = 2001 and country = 'PERU'")
    n = len(glob.glob(f"{folder}/year=2001/country=PERU/page=*/*.txt"))
    assert n > 1
    spoil(folder, "year=2000/*"), spoil(folder, "year=2001/country=COSTA RICA")
    found = P.pages(spark, folder, SCHEMA, BY).filter("year >= 2001 and year < 2002 and country in ('PERU')")
    assert found.rdd.getNumPartitions() == n and rows_of(found) == rows_of(wanted)
    assert rows_of(found.filter("score > 20")) == rows_of(wanted.filter("score > 20"))  # others are left to Spark
    with pytest.raises(Exception):
        P.pages(spark, folder, SCHEMA, BY).collect()


def test_counts_come_from_headers(spark, written):
    docs, folder = written
    for path in glob.glob(f"{folder}/*/*/page=*/*.txt"):
        lines = open(path).readlines()
        with open(path, "w") as f:
            f.writelines([lines[0], "not a record\n"])
    found = {(r.year, r.country): r["count"] for r in P.headers(spark, folder, NAMES, BY).collect()}
    wanted = docs.filter("country is null or country <> ''").groupBy("year", "country").count().collect()
    assert {k: found[k] for k in found if k[1]} == {(r.year, r.country): r["count"] for r in wanted if r.country}


def test_fetching_resumes(spark, written, tmp_path):
    docs, folder = written
    docs, store = docs.filter("country = 'PERU'"), str(tmp_path / "store")
    peru = P.F.col("country") == "PERU"
    total = docs.select("year").distinct().count()
    late = glob.glob(f"{folder}/year=2002/country=PERU/page=*/*.txt")[0]
    text = open(late).read()
    open(late, "w").close()  # a page that has not come yet
    assert P.fetch(spark, folder, SCHEMA, BY, store, peru & (P.F.col("year") == 2000)) == 1
    spoil(folder, "year=2000/country=PERU")  # what is committed isn't opened for its records again
    for path in glob.glob(f"{folder}/year=2000/country=PERU/page=*/*.txt"):
        with open(path, "w") as f:
            f.write('{"count": 1, "page": 0, "pages": 1, "rows": 1}\nnot a record\n')
    # a run that died after its rows were written and before they were committed
    P.pages(spark, folder, SCHEMA, BY).filter("year = 2001 and country = 'PERU'").write.mode("append").partitionBy(*BY).parquet(store)
    assert P.fetch(spark, folder, SCHEMA, BY, store, peru) == total - 2  # 2000 is there, 2002 isn't whole
    with open(late, "w") as f:
        f.write(text)
    assert P.fetch(spark, folder, SCHEMA, BY, store, peru) == 1
    assert P.fetch(spark, folder, SCHEMA, BY, store, peru) == 0
    assert rows_of(P.stored(spark, SCHEMA, store)) == rows_of(docs)


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path / "none")
    P.write_pages(spark.createDataFrame([], SCHEMA), folder, BY)
    assert P.pages(spark, folder, SCHEMA, BY).count() == 0 and P.headers(spark, folder, NAMES, BY).count() == 0

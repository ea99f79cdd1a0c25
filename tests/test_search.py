from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallygrove.operators import search as S

QUERY = '''( TITLE-ABS-KEY ( "heart failure" OR asthma* OR (lung W/3 cancer) ) AND SUBJTERMS ( 2740 ) AND SUBJAREA ( MEDI )
AND NOT ( TITLE-ABS-KEY ( murine OR 'mouse model' ) OR SUBJAREA ( VETE ) ) )'''


def test_parse_reads_terms_codes_and_exclusions():
    q = S.parse(QUERY)
    assert q.terms == ["heart failure", "asthma*", "(lung W/3 cancer)"]
    assert q.codes == ["SUBJTERMS(2740)", "SUBJAREA(MEDI)"]
    assert q.exclusions == [S.Exclusion(["murine", "mouse model"], [], True)]
    assert q.exclusions[0].animal


def test_codes_and_proximity_are_read_by_depth():
    assert S.codes_in("SUBJTERMS ( 12 ) subjarea(medi) SUBJTERMS(x1) SUBJAREA(a b) SUBJAREA()") == ["SUBJTERMS(12)", "SUBJAREA(medi)"]
    assert S.parse("( TITLE(a) AND NOT ( subjarea ( Vete ) ) )").exclusions == [S.Exclusion([], [], True)]
    assert S.proximity("(heart  attack w/12 old age)") == ("heart attack", "old age", 12)
    assert S.proximity("(a W/2 (b c)) d") == ("a", "(b c)", 2)
    assert [S.proximity(t) for t in ("a W/2 b", "(a W/x b)", "(W/2 b)", "(a W/2)", "(a W/2 b", "")] == [None] * 6


def test_reinclusion_is_what_follows_at_depth_one_of_a_block():
    block = S.split_and_not("(a AND NOT (b) AND NOT c)")
    assert block == ["(a", "(b)", "c)"]
    assert S.split_and_not("a AND NOT b") == ["a AND NOT b"]  # not within parentheses
    assert S.split_and_not("(((a AND NOT b)))") == ["(((a AND NOT b)))"]  # too deep


def test_field_contents_are_balanced():
    assert S.field_contents("title ( a (b) c ) x TITLE(d)", "TITLE") == ["a (b) c", "d"]
    assert S.field_contents("TITLE(a", "TITLE") == []


@pytest.mark.parametrize(
    "text, terms",
    [("a OR b", ["a", "b"]), ('"a b" OR (c OR d)', ["a b", "(c OR d)"]), ("a\nOR b OR\nc", ["a", "b", "c"]), ("ORbit OR x", ["ORbit", "x"]), ("", [])],
)
def test_split_or(text, terms):
    assert S.split_or(text) == terms


def test_formatted():
    assert [S.formatted(t) for t in ("a b", "(a b)", '"a b"', "a W/3 b", "a")] == ['"a b"', "(a b)", '"a b"', "a W/3 b", "a"]
    assert S.batches(["a b", "c", "d"], 2) == ['"a b" OR c', "d"]


def _hits(spark, texts, predicate):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, abstract string")
    return sorted(r[0] for r in df.filter(predicate(F.col("abstract"))).select("id").collect())


def test_wildcards_have_unicode_word_edges(spark):
    texts = ["the ñu", "theme", "a the.", None, "niño"]
    assert _hits(spark, texts, lambda c: S.wildcard(c, "the")) == [0, 2]
    assert _hits(spark, texts, lambda c: S.wildcard(c, "the*")) == [0, 1, 2]
    assert _hits(spark, texts, lambda c: S.wildcard(c, "u")) == []
    assert _hits(spark, texts, lambda c: S.wildcard(c, "ni?o")) == [4]


def test_proximity(spark):
    texts = ["lung and the cancer", "cancer of lungs", "lung a b c d cancer", "lung", None]
    assert _hits(spark, texts, lambda c: S.matches(c, ["(lung W/3 cancer)"])) == [0]
    assert _hits(spark, texts, lambda c: S.matches(c, ["(lung* W/3 cancer)"])) == [0, 1]
    assert _hits(spark, texts, lambda c: S.matches(c, ["lung W/3 cancer"])) == []  # needs parentheses
    assert _hits(spark, ["a a", "a"], lambda c: S.near(c, "a", "a", 1)) == [0]  # two different places


def test_exclusion_with_reinclusion_and_missing_columns(spark):
    df = spark.createDataFrame([(0, "x", "mouse"), (1, "y", "asthma child"), (2, None, "asthma"), (3, "z", None)], "id int, title string, abstract string")
    rules = [S.Exclusion(["asthma"], ["child"]), S.Exclusion(["mouse"])]
    assert sorted(r.id for r in S.exclude(df, rules).collect()) == [1, 3]
    assert S.exclude(df, []).count() == 4


def test_animal_rules_leave_keywords_out(spark):
    df = spark.createDataFrame([(0, "t", "a", ["rodent"])], "id int, title string, abstract string, keywords array<string>")
    assert S.exclude(df, [S.Exclusion(["rodent"])]).count() == 1
    assert S.exclude(df, [S.Exclusion(["rodent*", "x"], veterinary=True)]).count() == 1
    assert S.exclude(df.withColumnRenamed("keywords", "concepts"), [S.Exclusion(["t a rodent*"])]).count() == 1


def test_date_ranges_cover_all_days():
    first, last = date(2020, 1, 1), date(2020, 12, 31)
    found = S.date_ranges(lambda a, b: (b - a).days * 100, first, last)
    assert found[0][0] == first and found[-1][1] == last
    assert all((b - a).days * 100 <= 5000 for a, b in found)
    days = {a + timedelta(days=i) for a, b in found for i in range((b - a).days + 1)}
    assert len(days) == 366

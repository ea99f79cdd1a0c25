import hashlib
import random
from re import findall

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.llm import decontaminate as D

from ..compare import check
from .fixtures import CLASHING, WORDS, doubled, frame, lowered, sentence


def words(text):
    return findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute(docs, items, span=13):
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            b = words(item)
            if not b:
                continue
            n = min(span, len(b))
            grams = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)}
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    names.add(str(name))
        out.append((i, len(w), len(hit), tuple(sorted(names - {"None"}))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.randint(1, 40))) for i in range(12)] + [(90, None), (91, ""), (92, "lung"), (93, "of the data"), (94, None), (None, "unique words here only")]
    items.append((95, items[0][1]))  # the same text twice
    rows = []
    for i in range(40):
        cut = rng.choice(items)[1] or ""
        rows.append((i, f"{sentence(rng, rng.randint(0, 30))} {cut.upper()} {sentence(rng, rng.randint(0, 60))}", None, None, 0))
    rows += [(50, None, None, None, 0), (51, "", None, None, 0), (52, "unique, words: here - ONLY", None, None, 0), (53, " ".join(WORDS) * 400, None, None, 0), rows[0], (None, items[1][1], None, None, None)]
    return rows, items


def test_equals_brute_force(spark, tables):
    rows, items = tables
    found = D.contamination(frame(spark, rows, CLASHING), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect()], key=repr) == brute([(r[0], r[1]) for r in rows], items)


def test_every_place_of_a_long_span_is_found(spark):
    """The guarantee: any thirteen shared words, wherever they stand."""
    rng = random.Random(9)
    item = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(48):
        rows.append((i, " ".join([f"x{i}a"] * (i % 5) + item[i : i + 13] + [f"y{i}b"] * 7), None, None, 0))
        rows.append((100 + i, " ".join(item[i : i + 12]), None, None, 0))
    found = {r.doc_id: r.n_hit for r in D.contamination(frame(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert all(found[i] == 13 and found[100 + i] == 0 for i in range(48))


def test_doubling_words_are_no_match(spark):
    a, b = (x.decode() for x in doubled(1024))
    found = D.contamination(frame(spark, [(1, f"x {a} y", None, None, 0), (2, f"x {b} y", None, None, 0)]), spark.createDataFrame([(7, b)], "item_id long, text string"))
    assert {r.doc_id: r.n_hit for r in found.collect()} == {1: 0, 2: 1}


def test_windows_select_few_places_and_shared_ones_the_same():
    rng = np.random.default_rng(3)
    hashes = D.mix(rng.integers(0, 500, 20_000).astype(np.uint64))
    at, _ = D.winnowed(hashes, np.array([0, 20_000]), 13, 7)
    assert np.diff(at).max() <= 7 and len(at) < 0.27 * 20_000  # two in eight
    for start in rng.integers(0, 19_000, 30):
        part, fp = D.winnowed(np.concatenate([rng.integers(0, 9, 5).astype(np.uint64), hashes[start : start + 40]]), np.array([0, 5, 45]), 13, 7)
        assert set(part - 5 + start) <= set(at) and len(part) == len(fp) >= 4


def test_equal_hashes_of_unlike_words_decide_nothing(spark, tables, monkeypatch):
    """Words decide: with all k-gram hashes drawn from four values the result is the same."""
    rows, items = tables
    known = D.item_fingerprints(spark.createDataFrame(items, "item_id long, text string")).withColumn("fp", F.lit(1).cast("long"))
    found = D.matches(known, known).collect()
    assert found and all(r.hi - r.lo >= r.n for r in found)
    for r in found:
        a, b = r.context.split(" "), r.other.split(" ")
        assert a[r.lead + r.lo : r.lead + r.hi] == b[r.other_lead + r.lo : r.other_lead + r.hi]


def test_a_passage_in_half_of_all_rows_is_compared_once(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{passage} tail{i}", None, None, 0) if i % 2 else (i, sentence(rng, 20), None, None, 0) for i in range(400)]
    items = spark.createDataFrame([(i, f"head{i} {passage}") for i in range(50)], "item_id long, text string")
    found = {r.doc_id: (r.n_hit, len(r["items"])) for r in D.contamination(frame(spark, rows), items).collect()}
    assert all(found[i] == ((30, 50) if i % 2 else (0, 0)) for i in range(400))


@pytest.mark.parametrize("n", [100, 400])
def test_a_common_phrase_pairs_nothing(spark, n):
    """Twelve common words with a different one after them: no row is joined; thirteen: one for each surrounding, not for each pair."""
    phrase = " ".join(f"p{i}" for i in range(12))
    for extra, most in (("", 0), (" p12", 3 * n)):
        docs = frame(spark, [(i, f"a{i} b{i} {phrase}{extra} c{i} d{i}", None, None, 0) for i in range(n)])
        items = spark.createDataFrame([(i, f"e{i} f{i} {phrase}{extra} g{i} h{i}") for i in range(n)], "item_id long, text string")
        asked = D.item_fingerprints(docs, "text", "doc_id")
        assert D.matches(asked, D.item_fingerprints(items)).count() <= most
        found = D.contamination(docs, items).collect()
        assert {(r.n_hit, len(r["items"])) for r in found} == {(13, n) if extra else (0, 0)}


def test_empty_tables(spark, tables):
    rows, items = tables
    items = spark.createDataFrame(items, "item_id long, text string")
    assert D.contamination(frame(spark, rows).limit(0), items).count() == 0
    clean = D.contamination(frame(spark, rows), items.limit(0)).collect()
    assert {(r.n_hit, tuple(r["items"])) for r in clean} == {(0, ())} and len(clean) == len(rows)


def test_clean_keeps_columns_and_clean_rows(spark, tables):
    rows, items = tables
    docs = frame(spark, rows, CLASHING)
    kept = D.clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns
    bad = {i for i, n, hit, _ in brute([(r[0], r[1]) for r in rows], items) if hit and 20 * hit >= n}
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r[0]) for r in rows if r[0] not in bad)


def test_query_equals_sql(spark):
    check(spark, "/root/testdata/sf0.001", D.query, D.ORACLE)
    empty = [r for r in D.query(spark, "/root/testdata/sf0.001").collect() if r.n_items == 0]
    assert {r.items_sha256 for r in empty} == {hashlib.sha256(b"").hexdigest()}

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tallygrove.llm.counts import hashed, stored, without

from .test_suffix import brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in P.STAGES:
        before, docs = docs, P.settle(stage(spark, docs, DATA), f"test-{name}")
        out.append((before, docs))
    return out


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash", "suffix_dedup", "decontaminate", "packing"]
    assert all(after.columns == before.columns for before, after in steps[:-1])
    counts = [after.count() for _, after in steps[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0


def test_language_keeps_documents_with_letters(steps):
    before, after = steps[0]
    assert before.join(after, "doc_id", "left_anti").filter(F.col("text").rlike(r"\p{L}{2}")).count() == 0


def test_simhash_keeps_one_of_each_group(steps):
    from .test_simhash import closure, fingerprint

    before, after = steps[1]
    fp = {r.doc_id: fingerprint(r.text) for r in before.collect()}
    ids = sorted(fp)
    a = np.array([fp[i] for i in ids], np.uint64)
    links = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3) + i + 1]
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(closure(ids, links).values()))


def test_suffix_removes_what_repeats(steps):
    before, after = steps[2]
    rows = before.collect()
    left = {r.doc_id: r for r in after.collect()}
    for r, (n, gone, _, _) in zip(rows, brute([r.text for r in rows], 200)):
        if gone == 0:
            assert left[r.doc_id].text == r.text
        elif gone == n:
            assert r.doc_id not in left
        else:
            assert left[r.doc_id].n_chars == len(left[r.doc_id].text) < len(r.text)


def test_decontamination_drops_what_the_rule_says(spark, steps):
    from .test_decontaminate import brute as judged

    before, after = steps[3]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {i for i, n, hit, _ in judged([(r.doc_id, r.text) for r in before.collect()], items) if hit and 20 * hit >= n}
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == bad


def test_packing_packs_all(steps):
    before, after = steps[4]
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    assert after.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("ok")).filter("not ok").count() == 0


def test_key_sets(spark):
    key = lambda c: hashed(F.col(c).isNull(), F.col(c))
    keys = spark.range(0, 5000, 3).selectExpr("id - 100 as k")
    df = spark.range(5000).selectExpr("case when id % 7 > 0 then id - 100 end as a", "id as _x", "1 as _key")
    kept = without(df, key("a"), stored(keys.select(*key("k"))))
    assert kept.columns == ["a", "_x", "_key"]
    assert kept.count() == df.filter("a is null or (a + 100) % 3 > 0").count()
    assert without(df, key("a"), stored(keys.limit(0).select(*key("k")))).count() == 5000


def test_repeated_ids_with_unlike_texts_lose_no_text(spark):
    """Stage 2 decides row by row, and stage 4 by the text."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    twice = docs.withColumn("doc_id", F.col("doc_id") % 7).withColumn("_key", F.lit(1))
    own = {r.doc_id for r in dict(P.STAGES)["simhash"](spark, docs, DATA).collect()}
    texts = {r.text for r in docs.collect() if r.doc_id in own}
    kept = dict(P.STAGES)["simhash"](spark, twice, DATA)
    assert kept.count() == len(own) and len({r.text for r in kept.collect()}) == len(texts)
    clean = dict(P.STAGES)["decontaminate"](spark, kept, DATA)
    assert clean.columns == twice.columns

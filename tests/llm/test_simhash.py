import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallygrove.llm import simhash as S
from tallygrove.llm.components import components

from .fixtures import CLASHING, frame, lowered, sentence


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", lowered(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in ([w[i : i + 3] for i in range(len(w) - 2)] or [w])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(nodes, links):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_fingerprints_and_components_equal_brute_force(spark):
    rng = random.Random(2)
    base = [sentence(rng, 80) for _ in range(10)]
    rows = [(1000 - i, t, None, None, 0) for i, t in enumerate(b + f" v{k}" for b in base for k in range(6))]
    docs = frame(spark, [*rows, *[r for r in frame(spark).collect()]], CLASHING)
    found = S.near_duplicates(docs).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    fp = {i: fingerprint(t) for i, t in texts if i is not None}
    assert all(r.fp & (2**64 - 1) == fp[r.doc_id] for r in found if r.doc_id is not None)
    ids = sorted(fp)
    wanted = closure(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    assert len(found) == len(texts)
    assert all(r.component_id == wanted[r.doc_id] for r in found if r.doc_id is not None)


@pytest.mark.parametrize("bucket, dense", [(4, S.DENSE), (4096, S.DENSE), (4, 8)])
def test_links_have_the_closure_of_all_pairs(spark, bucket, dense):
    """Dense groups, chains and noise; small buckets are dealt out as pairs of sub-buckets, dense ones as stars."""
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    near = [c ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4)))) for c in centres for _ in range(12)]
    chain = [np.uint64((1 << k) - 1) for k in range(0, 60, 3)]
    fps = np.unique(np.array([*near, *chain, *rng.integers(0, 2**63, 200, dtype=np.uint64)], np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = S.links(df, bucket=bucket, dense=dense).collect()
    signed = fps.view(np.int64).tolist()
    all_pairs = [(signed[i], signed[j]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3) + i + 1]
    assert closure(signed, [(r.a, r.b) for r in found]) == closure(signed, all_pairs)


def test_pivots_discard_before_verification():
    """A pair beyond the radius in any coordinate never needs its bits compared."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**63, 2000, dtype=np.uint64), rng.integers(0, 2**63, 2000, dtype=np.uint64)
    d = np.bitwise_count(a[:, None] ^ S.PIVOT_TABLE) .astype(int) - np.bitwise_count(b[:, None] ^ S.PIVOT_TABLE)
    far = np.abs(d).max(axis=1) > S.RADIUS
    assert far.mean() > 0.99 and (np.bitwise_count(a ^ b)[far] > S.RADIUS).all()


def test_components_of_long_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.label for r in components(df).collect()}
    assert found == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1400)}}
    assert components(df.limit(0)).count() == 0


def test_keep_first(spark):
    docs = frame(spark, extra=("fp", "label"))
    kept = S.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    groups = {r.component_id for r in S.near_duplicates(docs).collect() if r.doc_id is not None}
    assert sorted(i for i in ids if i is not None) == sorted(groups) and None in ids


def test_unlike_texts_of_one_id_are_judged_apart(spark):
    rng = random.Random(5)
    a, b = sentence(rng, 200), sentence(rng, 200)
    rows = [(2, b, None, None, 0), (5, a, None, None, 0), (5, b, None, None, 0), (5, a, "en", None, 1), (None, a, None, None, 0), (None, a, None, None, 0)]
    kept = [(r.doc_id, r.text) for r in S.keep_first(frame(spark, rows, CLASHING)).collect()]
    assert sorted(kept, key=repr) == sorted([(2, b), (5, a), (None, a), (None, a)], key=repr)


def test_ids_may_be_strings(spark):
    docs = frame(spark).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    kept = {r.doc_id for r in S.keep_first(docs).collect()}
    assert kept == {r.component_id for r in S.near_duplicates(docs).collect()} | {None}


def test_one_text_at_half_of_all_rows(spark):
    """Each copy is a row of the result; what is gathered by fingerprint is one row for it."""
    rng = random.Random(8)
    rows = [(i, "the same words again and again", None, None, 0) for i in range(500)] + [(500 + i, sentence(rng, 100), None, None, 0) for i in range(500)]
    docs = frame(spark, rows)
    found = S.near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in found) == list(range(1000)) and {r.component_id for r in found if r.doc_id < 500} == {0}
    assert sorted(r.doc_id for r in S.keep_first(docs).collect() if r.doc_id < 500) == [0]


def test_empty_table(spark):
    empty = frame(spark).limit(0)
    assert S.near_duplicates(empty).count() == 0 and S.keep_first(empty).count() == 0

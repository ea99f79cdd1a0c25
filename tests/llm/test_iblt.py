import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallygrove.llm import iblt as I

from .fixtures import CLASHING, frame


def units(text):
    return {u.strip(" ") for u in re.findall(r"[^\n\r\u2028\u2029\u0085]{150,}?[.!?](?=\s)|[^\n]+", text or "")} - {""}


def dice(a, b):
    return 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))


def ordered(rows):
    """Descending ids, nulls last; equal rows follow each other."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def test_peeling_recovers_both_sides(spark):
    rng = random.Random(1)
    digest = [rng.getrandbits(63) for _ in range(100)]
    df = spark.createDataFrame([(digest[:5], [*digest[3:5], digest[9]]), ([], []), (digest[7:8], digest[7:8]), (digest, [])], "a array<long>, b array<long>")
    found = df.select(I.peel(I.minus(I.block(F.col("a")), I.block(F.col("b")))).alias("p")).select("p.*").collect()
    assert (set(found[0].left), set(found[0].right), found[0].ok) == (set(digest[:3]), {digest[9]}, True)
    assert (found[1].left, found[1].ok, found[2].left, found[2].ok) == ([], True, [], True)
    assert not found[3].ok  # a hundred don't fit: this is where a larger table is tried


@pytest.mark.parametrize("growth", [1, 2])
def test_wide_tables_recover_any_difference(spark, growth):
    rows = [(i, [hash((i, k)) for k in range(n)], [hash((i, k)) for k in range(n // 2, n + n // 3)]) for i, n in enumerate([0, 1, 2, 30, 500, 4000])]
    df = spark.createDataFrame(rows, "pid long, a array<long>, b array<long>")
    found = {r.pid: (r.left, r.right, r.open) for r in I.recover(df, growth).collect()}
    for pid, a, b in rows:
        if a or b:
            left, right, open_ = found.get(pid, (0, 0, 0))
            assert open_ > 0 or (left, right) == (len(set(a) - set(b)), len(set(b) - set(a)))
    assert sum(o > 0 for *_, o in found.values()) <= 1


def test_next_document_over_many_buckets(spark):
    rows = [(i * 7 % 101, f"text {i}", None, None, 0) for i in range(101)] + [(None, "last", None, None, 0)]
    found = {r.doc_id: r.next_text for r in I.with_next(frame(spark, rows, CLASHING)).collect()}
    line = ordered(rows)
    assert len(found) == 102
    for a, b in zip(line, line[1:] + line[:1]):
        assert found[a[0]] == b[1]


@pytest.mark.parametrize("n", [0, 1, 2, 10, 101])
def test_buckets(spark, n):
    cuts = [3 * i for i in range(n)]
    found = spark.range(-2, 3 * n + 2).select("id", I._below(F.col("id"), [F.lit(c).cast("long") for c in cuts]).alias("b")).collect()
    assert all(r.b == sum(c < r.id for c in cuts) for r in found)


def test_single_and_equal_rows(spark):
    one = frame(spark, [(5, "x", None, None, 0)])
    assert [r.next_text for r in I.with_next(one).collect()] == ["x"]
    twice = frame(spark, [(5, "x", None, None, 0)] * 2 + [(4, None, None, None, 0)])
    assert sorted(r.next_text for r in I.with_next(twice).collect()) == ["", "x", "x"]
    assert I.with_next(one.limit(0)).count() == 0


def test_ids_may_be_strings_and_half_may_be_null(spark, monkeypatch):
    monkeypatch.setattr(I, "BOUNDS", 50)
    rows = [(None if i % 2 else f"d{i:03}", f"text {i}", None, None, 0) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id string, text string")
    found = I.with_next(docs).collect()
    assert len(found) == 300 and sorted(r.next_text for r in found) == sorted(r[1] for r in rows)  # one round through all
    named = sorted((r[:2] for r in rows if r[0]), reverse=True)
    by = {r.doc_id: r.next_text for r in found if r.doc_id}
    assert all(by[a[0]] == b[1] for a, b in zip(named, named[1:]))
    largest = docs.withColumn("tie", F.xxhash64("text")).filter("doc_id is null").count()
    assert largest == 150


def test_query_equals_brute_force(spark, tmp_path):
    rows = [r for r in map(tuple, frame(spark).collect()) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    text = "\n".join(f"line {i} of a long document." for i in range(3000))
    rows += [(500, text, None, None, 0), (501, text.replace("line 77 ", "row 77 "), None, None, 0)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in I.query(spark, str(tmp_path)).collect()}
    line = ordered(rows)
    assert set(found) == {r[0] for r in rows}
    texts = {}
    for a, b in zip(line, line[1:] + line[:1]):
        own, other = a[1] or "", b[1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        r = found[a[0]]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(dice(units(own), units(edited))) and r.near_next == pytest.approx(dice(units(own), units(other)))
        texts.setdefault(own, set()).add(r.fingerprint)
        texts.setdefault(edited, set()).add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in texts.values())


def test_plan_is_native(spark):
    plan = I.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

import random
import zlib

import numpy as np
import pytest

from tallygrove.llm import langid as L

from .fixtures import CLASHING, frame

SYLLABLES = {"en": ["the", "ing", "er", "th", "on"], "fr": ["eau", "oui", "é", "ç", "le"], "de": ["sch", "ung", "ü", "ein", "der"]}


def text(rng, language, n):
    return " ".join("".join(rng.choice(SYLLABLES[language]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    return L.train([(text(rng, k, 60).encode(), k) for k in SYLLABLES for _ in range(30)], steps=150)


def test_gradients_are_those_of_the_loss():
    """Backpropagation through time against finite differences, both directions, places outside included."""
    net = L.BiGru(["a", "b"], hidden=3, seed=1)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    data = np.frombuffer(b"abchello", np.uint8)
    codes = L.coded(data, np.array([0, 2, 3]), 5, np.array([0, 2, 3]), np.array([2, 3, 8]), context=0)
    assert (codes == L.OUTSIDE).sum() == 7
    label = np.array([0, 1, 1])
    _, grads = net.gradients(codes, label)
    rng = np.random.default_rng(0)
    for name in net.params:
        flat = net.params[name].reshape(-1)
        rows = np.flatnonzero(np.abs(grads[name].reshape(-1)) > 1e-7)
        for i in rng.choice(rows, min(6, len(rows)), replace=False):
            old, step = flat[i], 1e-3
            flat[i] = old + step
            up = net.gradients(codes, label)[0]
            flat[i] = old - step
            down = net.gradients(codes, label)[0]
            flat[i] = old
            assert grads[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=2e-4)


def whole(model, data):
    """The network over a whole text at once, place by place: the states never start anew."""
    codes = L.lower_ascii(np.frombuffer(data, np.uint8))[:, None].astype(np.int64)
    return model.probabilities(codes)[:, :, 0].sum(axis=0)


def test_lanes_do_not_depend_on_each_other(model):
    data = np.frombuffer("eaueinschungen".encode(), np.uint8)
    both, alone = model.sums(data, np.array([0, 3, 14])), model.sums(data[:3], np.array([0, 3]))
    assert np.allclose(alone[0], both[0], atol=1e-4) and alone[0].sum() == pytest.approx(3, abs=1e-3)


def test_detection_equals_a_plain_pass_over_each_text(spark, model):
    """Chunks with context give what one unbroken recurrence over the text gives, whatever its length."""
    rng = random.Random(4)
    texts = [text(rng, k, n) for k in SYLLABLES for n in (1, 3, 20, 150, 900)]
    texts += ["".join(text(rng, k, 300).split()) for k in SYLLABLES]  # no white space at all
    texts += [text(rng, "en", 200) + text(rng, "fr", 210), "é" * 500, "THE Eau ç"]
    found = {r.doc_id: r for r in L.detect(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]), model).collect()}
    for i, t in enumerate(texts):
        mean = whole(model, t.encode()) / len(t.encode())
        assert found[i].lang_pred == model.languages[mean.argmax()] and found[i].score == pytest.approx(mean.max(), abs=0.01)


def test_states_pass_white_space(model):
    """The byte after a space is labelled by what stands before it."""
    a, b = (model.probabilities(np.frombuffer(x, np.uint8)[:, None].astype(np.int64))[-1, :, 0] for x in (b"sch ung e", b"eau oui e"))
    assert np.abs(a - b).max() > 0.01


def test_held_out_accuracy(spark, model):
    rng = random.Random(9)
    rows = [(i, text(rng, k, rng.randint(3, 40)), k, None, 0) for i, k in enumerate(list(SYLLABLES) * 60)]
    found = {r.doc_id: r for r in L.detect(frame(spark, rows, CLASHING), model).collect()}
    assert np.mean([found[r[0]].lang_pred == r[2] for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in found.values())


def test_unknown_texts_and_whole_texts(spark, model):
    rng = random.Random(3)
    rows = [(0, None, None, None, 0), (1, "", None, None, 0), (2, "12 ... !? 😀", None, None, 0), (3, " \t\n", None, None, 0), (4, "the " * 50 + "eau oui ç " * 40_000, None, None, 0), (5, "é" * 30_000, None, None, 0), (6, text(rng, "de", 9), None, None, 0), (6, text(rng, "de", 9), None, None, 0), (None, "eau", None, None, None)]
    found = L.detect(frame(spark, rows), model).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in range(4))
    assert by[4].lang_pred == "fr" and by[5].lang_pred == "fr"  # what comes late counts
    assert L.detect(frame(spark, rows).limit(0), model).count() == 0


def test_the_sample_is_of_whole_distinct_texts(spark):
    rows = [(i, "the " * 5000 if i < 50 else f"oui {i}", "en" if i < 50 else "fr", None, 0) for i in range(100)] + [(None, None, "en", None, 0), (None, "x", None, None, 0)]
    found = L.sample(frame(spark, rows, CLASHING), sample_docs=7)
    assert sorted(len(t) for t, k in found if k == "en") == [20_000] and sum(k == "fr" for _, k in found) == 7


def test_the_driver_gets_a_bounded_number_of_bytes(spark):
    """Fifty labels with texts of five megabytes: excerpts of the whole length, within the bound."""
    from pyspark.sql import functions as F

    docs = spark.range(150, numPartitions=15).select(F.col("id").alias("doc_id"), F.concat(F.lit("start "), F.repeat(F.concat(F.lit("é"), F.col("id").cast("string")), 1_250_000), F.lit(" end")).alias("text"), (F.col("id") % 50).cast("string").alias("lang"))
    found = L.sample(docs, sample_docs=3, sample_bytes=300_000)
    assert sum(len(t) for t, _ in found) <= 300_000 and len({k for _, k in found}) == 50
    assert sum(len(t) for t, _ in found) > 290_000 and len(found) == 150 * 8 and len(set(found)) > 300
    assert sorted(found) == sorted(L.sample(docs.repartition(7), sample_docs=3, sample_bytes=300_000))
    with pytest.raises(ValueError, match="languages"):
        L.sample(docs.withColumn("text", F.lit("short")), sample_docs=3, sample_bytes=5000)


def test_nothing_to_learn_from(spark):
    docs = frame(spark)
    empty = L.fit(docs.filter("false"))
    assert {(r.lang_pred, r.score) for r in L.detect(docs, empty).collect()} == {("und", 0.0)}


def test_keep_known_keeps_rows_as_they_are(spark, model):
    docs = frame(spark, [(1, "the ing", "x", "y", 3), (2, "...", None, None, 0), (None, "eau", None, None, None)], CLASHING)
    kept = L.keep_known(docs, model, 0.3)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, None}
    other = docs.withColumnRenamed("text", "body").withColumn("text", docs["lang"])
    kept = L.keep_known(other, model, 0.3, "body")
    assert kept.columns == other.columns and {r.doc_id for r in kept.collect()} == {1, None}


def test_query_predicts_held_out_documents(spark):
    found = L.query(spark, "/root/testdata/sf0.001").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert held and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95

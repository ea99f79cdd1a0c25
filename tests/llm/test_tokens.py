import random
import re

import pytest
from pyspark.sql import functions as F

from tallygrove.llm import tokencounts as C
from tallygrove.llm import tokens as T

from .fixtures import CLASHING, frame


def own(name):
    """Ids by the file's library itself."""
    path = T.public(name)
    if name.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    return lambda text: found.encode(text, add_special_tokens=False).ids


NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")
LONG = [x * 2_000_000 for x in (" ", "\t", " ", "a")] + ["x" + " " * 1_200_000 + "y", "x " + "\n" * 100_000 + " !", " " * 20_000 + "<|endoftext|>" + " " * 20_000, "\x1c" * 30_000 + " " * 20_000 + "\x1f"]


@pytest.mark.parametrize("name", NAMES)
def test_ids_are_the_librarys(name):
    rng = random.Random(3)
    texts = ["", " ", "  x  ", "don't <|endoftext|> it's <s> </s>", "😀 naïve 中文   x", "\x00\x1c\x85 1234½²"]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(60)) for _ in range(200)]
    ids = own(name)
    assert T.encoder(T.public(name))(texts) == [ids(t) for t in texts]


@pytest.mark.parametrize("text", LONG, ids=range(len(LONG)))
def test_long_runs(text):
    ids = T.encoder(T.public("byte_bpe_50k.json"))([text])[0]
    assert ids == own("byte_bpe_50k.json")(text)


def test_runs_of_any_length_are_cut_where_the_pattern_cuts(monkeypatch):
    monkeypatch.setattr(T, "LONG_RUN", 2)
    monkeypatch.setattr(T, "_RUN", re.compile(T._RUN.pattern.replace(str(1 << 14), "2")))
    rng, ids = random.Random(4), own("byte_bpe_50k.json")
    texts = ["".join(rng.choice([" ", " ", "\n", "\t", " ", "\x1c", "a", "1", "'s", "!", "é", "<|endoftext|>"]) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert T.encoder(T.public("byte_bpe_50k.json"))(texts) == [ids(t) for t in texts]


def test_bytes_of_tokens_give_texts_back():
    text = " Hello naïve 中文\n\n 😀 x"
    for name, given in (("byte_bpe_50k.json", text), ("piece_bpe_32k.model", text[1:])):
        of = T.token_bytes(T.public(name))
        assert b"".join(of[i] for i in T.encoder(T.public(name), plain=True)([given])[0]) == text.encode()


@pytest.mark.parametrize("name", NAMES)
def test_counts_equal_the_library(spark, tmp_path, name):
    docs = frame(spark, None, (*CLASHING, "digest", "copies", "n_tokens", "n_bytes", "hot_digest", "hot_tokens"))
    found = C.token_counts(docs, T.public(name), f"file://{tmp_path}/cache").collect()
    ids = own(name)
    key = lambda x: (-1 if x[0] is None else x[0], *x[1:])
    wanted = [(r.doc_id, len((r.text or "").encode()), n := len(ids(r.text or "")), n > 512) for r in docs.collect()]
    assert sorted([tuple(r) for r in found], key=key) == sorted(wanted, key=key)


def test_only_what_is_missing_is_encoded(spark, tmp_path, monkeypatch):
    path, cache = T.public("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    docs = frame(spark)
    distinct = docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    batches = lambda plain=False: [spark.read.parquet(x).count() for x in C.batches_of(spark, cache, T.version(path, plain))]
    first = sorted(map(str, C.token_counts(docs, path, cache).collect()))
    assert batches() == [distinct]
    assert sorted(map(str, C.token_counts(docs, path, cache).collect())) == first and batches() == [distinct]
    more = docs.unionByName(frame(spark, [(900, "something new", "en", "s", 13), (901, "something new", "en", "s", 13)]))
    for most in (C.BROADCAST_DIGESTS, 0):  # by a broadcast of what is missing, and by a shuffle
        monkeypatch.setattr(C, "BROADCAST_DIGESTS", most)
        more = more.unionByName(frame(spark, [(902, f"new {most}", "en", "s", 13)]))
        assert C.token_counts(more, path, cache).count() == more.count()
    assert sorted(batches()) == [1, 2, distinct]
    C.token_counts(docs, path, cache, plain=True).collect()  # another version: its own counts
    assert batches(True) == [distinct] and sorted(batches()) == [1, 2, distinct]


def test_half_written_and_doubled_batches(spark, tmp_path):
    path, cache = T.public("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    docs = frame(spark, [(1, "one two", "en", "s", 7), (2, None, "en", "s", 0)])
    first = sorted(C.token_counts(docs, path, cache).collect())
    folder = f"{cache}/version={T.version(path)}"
    rows = spark.read.parquet(*C.batches_of(spark, cache, T.version(path)))
    rows.write.parquet(f"{folder}/again")  # what a second run at the same time stores
    rows.withColumn("n_tokens", F.lit(99).cast("long")).write.parquet(f"{folder}/died")
    (tmp_path / "cache" / f"version={T.version(path)}" / "died" / "_SUCCESS").unlink()
    assert sorted(C.token_counts(docs, path, cache).collect()) == first and len(C.batches_of(spark, cache, T.version(path))) == 2


def test_hot_texts_and_an_empty_table(spark, tmp_path):
    path = T.public("byte_bpe_50k.json")
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    found = {r.doc_id: r.n_tokens for r in C.token_counts(docs, path, f"file://{tmp_path}/hot").collect()}
    ids = own("byte_bpe_50k.json")
    assert found == {i: len(ids("hot text" if i % 3 == 0 else f"t{i}")) for i in range(4000)}
    assert C.token_counts(docs.limit(0), path, f"file://{tmp_path}/none").collect() == []

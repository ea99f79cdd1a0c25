import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.llm import alignment as L
from tallygrove.llm import mph
from tallygrove.llm import tokens as T

from .fixtures import CLASHING, frame

A, B = T.public("byte_bpe_50k.json"), T.public("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


def spans(parts):
    at = 0
    for p in parts:
        yield at, at + len(p)
        at += len(p)


def brute(rows, libraries):
    first, second = libraries
    decode = {c: b for c, b in T._bytes_of_characters().items()}
    docs = []
    for _, text in rows:
        a, b, raw = [], [], (" " + (text or "")).encode()
        if text:
            one = first.encode(" " + text, add_special_tokens=False)
            a = list(zip(one.ids, (bytes(decode[c] for c in t) for t in one.tokens)))
            ids = second.encode(text)
            piece = lambda p: bytes([int(p[1:-1], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()
            b = [(i, piece(second.id_to_piece(i))) for i in ids]
            if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
                a, b = [], []
        sa, sb = list(spans(x for _, x in a)), list(spans(x for _, x in b))
        links, j = [], 0
        for (i, _), (s, e) in zip(a, sa):
            while j and sb[j - 1][1] > s:
                j -= 1
            while j < len(b) and sb[j][0] < e:
                if sb[j][1] > s:
                    links.append((i, b[j][0]))
                j += 1
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, start = [], 0
        for end in ends:
            groups.append([[t[0] for t, (s, e) in zip(x, y) if start <= s and e <= end] for x, y in ((a, sa), (b, sb))] if len(a) < 3000 else None)
            start = end
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups) if None not in groups else None
        docs.append((len(a), len(b), groups, links, text))
    count = Counter(p for d in docs for p in set(d[3]))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), None if text is None else hashlib.sha256(text.encode()).hexdigest() if n_a else "")
        for n_a, n_b, groups, links, text in docs
    ]


TEXTS = ["plain words, twice words", " leading", "tail ", "a▁b", "\x00 nul", "日本語 and 😀😀", "<s> <|endoftext|> </s> <0x41>", "tabs\t\tand\n\nlines  two", "﻿mark", "é \u0085  x", "x" * 500]


def test_equals_brute_force(spark, libraries):
    more = [(500 + i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)]
    docs = frame(spark).unionByName(frame(spark, more))
    for name in (*CLASHING, "a", "b", "pair", "leaf", "n_a"):
        docs = docs.withColumn(name, F.lit(7))
    found = sorted((str(r[0]), *r[1:]) for r in L.aligned(docs, A, B).collect())
    rows = [(str(r.doc_id), r.text) for r in docs.collect()]
    wanted = sorted((i, *x) for (i, _), x in zip(rows, brute(rows, libraries)))
    assert len(found) == len(wanted)
    for f, w in zip(found, wanted):
        assert f[:7] == w[:7] and (w[7] is None or f[7] == w[7])
    assert any(w[1] == 0 for w in wanted) and any(w[1] > 5000 for w in wanted)


def test_several_shards_leaves_and_flushes(spark, libraries, monkeypatch):
    """Bounds small enough for every path; tasks get them with the operator's own functions."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("alpha beta gamma Überraschung naïve 42 x1 colour".split()) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 40)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    monkeypatch.setattr(L, "SHARD_PAIRS", 50)
    ids = L.encoded(docs, A, B)
    known = L.pair_counts(ids, A, B)
    assert known.shards > 3
    wanted = {r[0]: r[1:] for r in zip([i for i, _ in rows], *zip(*brute(rows, libraries)))}
    found = {r[0]: tuple(r[1:]) for r in L.aligned(docs, A, B).collect()}
    assert found == wanted
    with pytest.raises(LookupError):
        known.counts(np.array([50_000 * 32_000 + 7]))


def test_pairs_are_handed_on_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(L, "HELD", 8)
    rng = np.random.default_rng(6)
    docs = []
    for _ in range(60):
        text = " " + " ".join(f"w{x}" for x in rng.integers(0, 40, 12))
        docs.append((T.encoder(A, True)([text])[0], T.encoder(B, True)([text[1:]])[0]))
    batches = [pa.RecordBatch.from_arrays([pa.array([np.array(a, np.uint16).tobytes()]), pa.array([np.array(b, np.uint16).tobytes()])], ["a", "b"]) for a, b in docs]
    total = Counter()
    for batch in L._local_pairs(iter(batches), L._Reader(A, B)):
        total.update(dict(zip(batch.column("pair").to_pylist(), batch.column("n").to_pylist())))
    many = Counter()
    for batch in batches:
        for _, _, _, found, vocabulary in L._Reader(A, B)([batch]):
            many.update(set(found.pairs(vocabulary).tolist()))
    assert total == many


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 100_000])
def test_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) if n > 64 else np.arange(n, dtype=np.uint64)
    arrays = mph.build(keys)
    assert sorted(mph.find(arrays, keys)) == list(range(len(keys)))
    other = mph.find(arrays, keys + np.uint64(1 << 62))
    assert ((other >= -1) & (other < max(1, len(keys)))).all()
    assert 64 * len(arrays["words"]) <= 8 * len(keys) + 64 * 12 * 3


def test_empty_tables(spark):
    assert L.aligned(frame(spark).limit(0), A, B).collect() == []
    rows = L.aligned(frame(spark, [(1, None, "en", "s", 0), (2, "", "en", "s", 0)]), A, B).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]

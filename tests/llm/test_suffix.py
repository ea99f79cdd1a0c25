import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallygrove.llm import suffix as S

from .fixtures import CLASHING, doubled, frame, sentence


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    """Copies, shared passages at many places, periodic texts, and texts without any trigger."""
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    shared = [letters(rng.randint(150, 700)) for _ in range(4)]
    texts = []
    for _ in range(40):
        parts = [letters(rng.randint(0, 400))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts += [s[a : a + rng.randint(100, 600)], letters(rng.randint(0, 300))]
        texts.append("".join(parts))
    texts += [None, "", "x" * 199, "x" * 200, "y" * 201, "z" * 500, "ab" * 300, "ab" * 150, texts[0], texts[0], letters(5000), sentence(rng, 200)]
    return texts


@pytest.mark.parametrize("seed, hot", [(0, S.HOT), (1, S.HOT), (2, 2)])
def test_equals_brute_force(spark, seed, hot):
    texts = corpus(seed)
    docs = frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)], CLASHING)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(docs, hot=hot, shard_bytes=4000).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts, S.LENGTH)


def test_neighbours_are_compared_by_bytes(spark, monkeypatch):
    """Strings that differ in their last byte stand side by side; an order of hashes would not find what repeats."""
    a = "".join(chr(97 + i * i % 23) for i in range(199))
    rows = {(a + "x" + a[:30]).encode(): 0, (a + "y" + a[:30]).encode(): 0, (a + "x" + a[50:90]).encode(): 0}
    data, at = S.repeated(rows, 200)
    assert sorted(data[p : p + 200].tobytes() for p in at) == [(a + "x").encode()] and S.repeated({b"z" * 200: 2, b"y" * 200: 1}, 200)[1].tolist() == [0]


def test_anchors_are_the_rarest_phrases_of_their_strings():
    rng = random.Random(3)
    data = np.frombuffer(sentence(rng, 400).encode(), np.uint8)
    parse = S.Parse(data, np.array([0, 1500, len(data)]), 200)
    count = np.random.default_rng(1).integers(1, 5, len(parse.phrase))
    low, high, anchor = parse.stretches(count)
    found = {s: j for a, b, j in zip(low, high, anchor) for s in range(a, b + 1)}
    wanted = {}
    for begin, end in ((0, 1500), (1500, len(data))):
        for s in range(begin, end - 199):
            inside = [j for j, p in enumerate(parse.phrase) if parse.at[p] - S.WINDOW >= s and parse.next[p] <= s + 200 and parse.row[p] == (begin > 0)]
            best = min(inside, key=lambda j: (count[j], j), default=None)
            if best is not None and count[best] > 1:
                wanted[s] = best
    assert found == wanted and len(wanted) > 50 and sum(high - low + 1) == len(found)


def test_doubling_strings(spark):
    texts = [x.decode() for n in (1024, 2048, 4096) for x in doubled(n)] + ["q" + doubled(1024)[0].decode()]
    found = S.remove_repeats(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]), shard_bytes=4000).collect()
    assert [x[1:] for x in sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)] == brute(texts, 200)


def test_a_passage_in_half_of_all_rows(spark):
    """More occurrences than ``hot``, in unlike surroundings."""
    rng = random.Random(4)
    passage = sentence(rng, 60)
    texts = [f"{rng.random()} {passage} {rng.random()}" if i % 2 else sentence(rng, 30) + str(rng.random()) for i in range(120)]
    found = S.remove_repeats(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]), hot=20, shard_bytes=4000).collect()
    assert [x[1:] for x in sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)] == brute(texts, 200)


def test_repeated_rows_lose_what_they_share(spark):
    rows = [(1, "q" * 30 + "".join(chr(97 + i % 23) for i in range(400)), None, None, 0)] * 2 + [(None, "other", None, None, None)]
    found = S.remove_repeats(frame(spark, rows)).collect()
    assert sorted((r.n_removed, bytes(r.kept)) for r in found) == [(0, b"other"), (430, b""), (430, b"")]


def test_empty_table(spark):
    assert S.remove_repeats(frame(spark).limit(0)).count() == 0


def test_corpus_order_is_that_of_sorted_suffixes():
    rng = random.Random(5)
    shared = bytes(rng.randrange(97, 103) for _ in range(600))
    rows = [shared[a : a + 300] for a in range(0, 280, 7)] + [bytes(rng.randrange(97, 100) for _ in range(260)) for _ in range(20)]
    data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    order = S.corpus_order(data, offsets, 200)
    flat, row = data.tobytes(), S.row_of(order, offsets)
    suffixes = [flat[a : offsets[r + 1]] for a, r in zip(order, row)]
    assert len(order) > 40 and suffixes == sorted(suffixes)


def test_ranks_of_dictionary_and_parse():
    words = [b"banana--", b"bandana-", b"ananas--", b"banana--"]
    data = np.frombuffer(b"".join(words), np.uint8)
    at, end = np.array([0, 8, 16, 24]), np.array([8, 16, 24, 32])
    rank = S.dictionary_ranks(data, at, end)
    assert rank[0] == rank[3] and rank[2] < rank[0] < rank[1]
    parse = S.parse_ranks(np.array([2, 1, 2, 1, 2]), np.array([0, 0, 0, 1, 1]))
    assert parse[3] == parse[1] and parse[4] == parse[2] and parse[1] < parse[2] < parse[0]


def test_clean_keeps_columns_and_whole_characters(spark):
    shared = "é" * 90 + "".join(chr(97 + i * i % 19) for i in range(300))
    rows = [(1, "start " + shared, "en", "s", 396), (2, shared + " end of it", "de", "t", 400), (3, "nothing", None, None, 7), (4, shared, None, None, 390), (5, None, None, None, None), (6, "", None, None, 0)]
    docs = frame(spark, rows, ("kept", "row_lang"))
    found = S.clean(docs)
    assert found.columns == docs.columns
    text = {r.doc_id: r.text for r in found.collect()}
    assert set(text) == {1, 2, 3, 5, 6}
    assert text[1].startswith("start") and text[2].endswith("end of it") and text[3] == "nothing"
    assert {r.doc_id: r.n_chars for r in found.collect()}[1] == len(text[1])

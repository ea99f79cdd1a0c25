import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallygrove.llm import packing as P

from .fixtures import CLASHING, frame


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.default_tokenizer())


def whole(pieces, ids):
    """Checks that pieces and sequences are gapless, and returns the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p[0]].append(p[1:3])
        by_sequence[p[3]].append(p[4:5] + p[2:3])
    for doc, parts in by_doc.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at == ids[doc]
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding


@pytest.mark.parametrize("seed", range(5))
def test_blocks_are_whole_and_waste_one_window(seed):
    rng = random.Random(seed)
    lengths = [max(1, int(rng.expovariate(1 / 600))) for _ in range(rng.randint(1, 400))]
    pieces = P.pack(lengths)
    assert whole([(d, s, n, w, o) for d, s, n, w, o, _ in pieces], dict(enumerate(lengths))) < 1024
    windows = sorted({p[3] for p in pieces})
    assert windows == list(range(len(windows)))
    assert {p[5] for p in pieces} <= set(P.TIERS)


@pytest.mark.parametrize("lengths", [[], [1], [1024], [1025, 1023], [64] * 9, [5000]])
def test_small_blocks(lengths):
    whole([p[:5] for p in P.pack(lengths)], dict(enumerate(lengths)))


def test_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(1)
    texts = ["", "Hello  world\n\n x", "don't <|endoftext|> it's", "😀 naïve 中文 \u00a0\u2003x", "\x00\x1c\x85 1234½²"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(60)) for _ in range(300)]
    texts += ["".join(f"a{chr(c)} {chr(c)}1" for c in range(a, a + 4096) if not 0xD800 <= c < 0xE000) for a in range(0, 0x20000, 4096)]
    for text, ids in zip(texts, P.encode(texts, P.default_tokenizer())):
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0], text[:40]


def test_operator_round_trip(spark, tokenizer):
    docs = frame(spark, [r for r in frame(spark).collect() if r.doc_id is not None and r.doc_id != 3], CLASHING)
    rows = P.packed_pieces(docs, P.default_tokenizer()).collect()
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    whole([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in rows], {k: len(v) for k, v in ids.items()})
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.ids == part.tolist() and r.doc_tokens == len(ids[r.doc_id])
    assert {r.doc_id for r in rows} == set(ids)


def test_null_ids_repeated_rows_and_empty_table(spark):
    docs = frame(spark)
    rows = P.packed_pieces(docs, P.default_tokenizer()).collect()
    assert sum(r.length for r in rows if r.doc_id is None) > 0
    assert sum(r.start == 0 for r in rows if r.doc_id == 3) == 2
    assert P.packed_pieces(docs.limit(0), P.default_tokenizer()).count() == 0


def test_step_groups_are_even():
    rng = random.Random(3)
    for n in (1, 2, 40, 3000):
        sizes = [rng.choice(P.TIERS) for _ in range(n)]
        group = P.balanced(sizes, 4096)
        totals = [sum(s for s, g in zip(sizes, group) if g == k) for k in range(max(group) + 1)]
        assert sum(totals) == sum(sizes) and max(totals) - min(totals) <= max(sizes)
        assert n < 40 or all(0.7 * 4096 < t < 1.4 * 4096 for t in totals)


def test_step_groups_of_the_query_are_even(spark):
    rows = P.query(spark, "/root/testdata/sf0.01").collect()
    tier = {r.sequence_id: (r.step_group, r.tier) for r in rows}
    assert all(tier[r.sequence_id] == (r.step_group, r.tier) for r in rows)
    tokens = defaultdict(int)
    for group, size in tier.values():
        tokens[group] += size
    assert len(tokens) > 8 and max(tokens.values()) - min(tokens.values()) <= 0.1 * P.STEP_TOKENS


def test_texts_of_megabytes(spark, tokenizer):
    texts = ["x" + " " * 1_200_000 + "y", "\t" * 2_000_000, "\u00a0" * 1_000_000 + "!", "a" * 2_000_000, "word " * 600_000]
    rows = P.packed_pieces(frame(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]), P.default_tokenizer()).select("doc_id", "start", "length", "ids").collect()
    for i, text in enumerate(texts):
        ids = [x for _, part in sorted((r.start, r.ids) for r in rows if r.doc_id == i) for x in part]
        assert ids == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]

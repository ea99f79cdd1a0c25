"""Small tables with every awkward case, and brute force to compare with."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in data model lung heart café über straße niño x1 42".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed=0, n=60):
    """Nulls, empty, blank, very long, exact and near copies, ties, control characters, repeated rows."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(1, 120)) + rng.choice([".", "!\n", ""]) for _ in range(n)]
    texts += [None, "", " \t\n ", "a", "12 34 !?", "é", "\x1c\u00a0\u2003odd\x0b spaces\x85", "word " * 30_000, "z" * 20_000, texts[0], texts[0], texts[1] + " tail", "<|endoftext|> \\ <|im_end|>", "😀 emoji 😀"]
    rows = [(i, t, rng.choice(["en", "de", None]), "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "the lost one", None, None, None)]


def frame(spark, rows=None, extra=()):
    """The rows as a table, with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    for name in extra:
        df = df.withColumn(name, F.lit(7))
    return df


CLASHING = ("rid", "fp", "n", "key", "shard", "block", "row", "kept", "label", "score", "word", "items", "at", "window", "bucket", "tie", "ghost", "page", "cell", "_key", "k1", "k2", "mask", "part", "n_words", "fingerprint")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def doubled(n):
    """Two unlike words of n bytes whose polynomials agree modulo every power of two."""
    a, b = b"a", b"b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b

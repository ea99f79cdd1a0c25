"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 is the vocabulary: hashes of words in order, counts as differences of a
monotone sequence.  A word's id is its place.  Level k holds the k-grams as
pairs of a context (the place of its (k-1)-gram in level k-1) and a word:
contexts are one monotone sequence, pointers to their children another, and
children are ids raised by their context's place, a third.  A lookup finds the
context, and then does a successor search for the word among that context's
children only.  Beside each k-gram stands its smoothed probability, quantised
to a byte: the count over the context's count plus ``prior``.  A query adds the
lower order, weighted by prior / (context count + prior): Dirichlet smoothing
down to add-one unigrams.  Before they are quantised every conditional
distribution sums to one; a byte's step is a 255th of its shard's range of
logarithms, so a token's score is off by half a step of some 0.02 at most.

Levels are cut into shards of bounded size by a hash of the whole k-gram, so a
word that follows everything, or that everything follows, is spread evenly.
Each shard is a file of the shared folder that one task builds: nothing is
collected or broadcast but one number per shard.

Scoring by bigrams brings the pairs of the texts to the shards, not the shards
to the texts: a text's score is the sum over tokens of the lower order's share,
which needs the vocabulary alone, and of what the pairs that the trie knows add
to it.  A task hands on its distinct pairs by text, one task per shard looks
them up, in order, and gives back one sum for each text, in blocks by chunk of texts.
So each shard is read once, however many texts there are, and blocks follow the
number of pairs (more than ``FAN`` shards are parted in rounds).  A pair that more
texts of a task hold than a shard has pairs on average is dealt by ranges of texts
besides, in groups of some ``PART`` texts, each of which maps the pair's shard.  Higher orders are scored by tasks
that map the shards they need; contexts must then be found before pairs are.

Defined results: null text is empty and is its end token alone; a null document
id is learned from; with nothing to learn from, the unigram denominator is 1
and all scores are 0; repeated rows count as often as they stand there; other
columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .counts import FAN, narrower, widest
from .eliasfano import EliasFano, pack, unpack
from .shared import RangeHash, in_arrow, lower_ascii, map_file, mix, pieces, put_file, settle, table, texts_of, work_folder

ORDER = 2
PRIOR = 64.0
#: Words of a vocabulary shard, and tokens that a shard of a higher level is made from, on average.
VOCABULARY_SHARD = 1 << 19
TOKEN_SHARD = 1 << 20
PIECE = 2 << 20
#: k-grams that a counting task gathers before it hands them on.
GATHER = 3 << 20
#: Texts of one frequent pair that a task answers together.
PART = 1 << 20
OPEN_SHARDS = 512
_U = np.uint64


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a piece, the number of each token's word, and the number of tokens before each row."""
    lowered = lower_ascii(data)
    text = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(lowered))
    split = pc.ascii_split_whitespace(text)
    ends, flat = split.offsets.to_numpy(), split.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])[ends]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), before


def _hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    data, offsets = texts_of(words)
    return RangeHash(data).of(offsets[:-1], offsets[1:]), RangeHash(data, 1).of(offsets[:-1], offsets[1:])


def _count_words(batches):
    held: list[pa.Table] = []
    size = rows = 0

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    for part, data, offsets in pieces(batches, "text", PIECE):
        rows += part.num_rows
        words, index, _ = _tokens(data, offsets)
        held.append(pa.table({"word": words.cast(pa.string()), "n": np.bincount(index, minlength=len(words)).astype(np.int64)}))
        size += len(words)
        if size > 1 << 20:
            yield from merged().to_batches()
            held, size = [], 0
    if rows:
        held.append(pa.table({"word": pa.array([""]), "n": pa.array([rows], pa.int64())}))  # the end tokens
        yield from merged().to_batches(max_chunksize=1 << 16)


def _shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the upper half of the key, so places follow the key's order."""
    return (((key >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)


def _dealt_words(batches, shards: int):
    for batch in batches:
        key, second = _hashes(batch.column("word"))
        yield pa.RecordBatch.from_arrays([pa.array(_shard_of(key, shards).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(second.view(np.int64)), batch.column("n")], ["shard", "key", "second", "n"])


def _build_vocabulary(group: pa.Table, folder: str) -> pa.Table:
    key, second = (group.column(c).to_numpy().view(np.uint64) for c in ("key", "second"))
    order = np.lexsort((second, key))
    keys, a = EliasFano.encode(key[order], "keys")
    sums, b = EliasFano.encode(np.cumsum(group.column("n").to_numpy()[order]).astype(np.uint64), "sums")
    shard = group.column("shard")[0].as_py()
    put_file(f"{folder}/1-{shard}", pack(keys | sums | {"second": second[order]}, **a, **b))
    return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(key)], pa.int64())})


class Trie:
    """The files of a folder and the number of k-grams in each shard.  Tasks open shards as they need them."""

    def __init__(self, folder: str, tokens: int, words: int, documents: int, prior: float):
        self.folder, self.tokens, self.words, self.documents, self.prior = folder, tokens, words, documents, prior
        self.base: list[np.ndarray] = []  # for each level, k-grams before each shard
        self._open: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    @property
    def order(self) -> int:
        return len(self.base)

    def add_level(self, sizes: dict[int, int], shards: int) -> None:
        self.base.append(np.concatenate([[0], np.cumsum([sizes.get(i, 0) for i in range(shards)])]).astype(np.int64))

    def shard(self, level: int, i: int):
        if (level, i) not in self._open:
            if len(self._open) >= OPEN_SHARDS:
                self._open.clear()
            arrays, values = unpack(map_file(f"{self.folder}/{level}-{i}"))
            self._open[level, i] = arrays, {n: EliasFano(arrays, values, n) for n in ("keys", "sums", "contexts", "pointers") if f"{n}.n" in values}, values
        return self._open[level, i]

    def _by_shard(self, shard: np.ndarray, level: int):
        """(shard, places of its rows), without shards that hold nothing."""
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(len(self.base[level - 1])))
        for i in np.flatnonzero(np.diff(cut)):
            if self.base[level - 1][i + 1] > self.base[level - 1][i]:
                yield int(i), order[cut[i] : cut[i + 1]]

    def vocabulary(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its id, or -1, and its count."""
        key, second = _hashes(words)
        order = np.argsort(key)
        key, second = key[order], second[order]
        ids, counts = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
        for i, rows in self._by_shard(_shard_of(key, len(self.base[0]) - 1), 1):
            arrays, ef, _ = self.shard(1, i)
            at, found = ef["keys"].successor(key[rows])
            # words with one 64-bit hash stand side by side; the second hash tells them apart
            while True:
                wrong = found.copy()
                wrong[found] = arrays["second"][at[found]] != second[rows][found]
                if not wrong.any():
                    break
                at[wrong] += 1
                found[wrong] = at[wrong] < ef["keys"].n
                again = wrong & found
                found[again] = ef["keys"].get(at[again]) == key[rows][again]
            rows, at = rows[found], at[found]
            ids[rows] = at + self.base[0][i]
            counts[rows] = self._count(ef["sums"], at)
        out = np.empty_like(ids), np.empty_like(counts)
        out[0][order], out[1][order] = ids, counts
        return out

    @staticmethod
    def _count(sums: EliasFano, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.zeros(0, np.int64)
        return (sums.get(at) - np.where(at > 0, sums.get(np.maximum(at - 1, 0)), _U(0))).astype(np.int64)

    def counts(self, level: int, node: np.ndarray) -> np.ndarray:
        """Counts of k-grams by their places; at level 1 the place past the last word is the start of a text."""
        out = np.full(len(node), self.documents, np.int64)
        real = np.flatnonzero(node < self.base[level - 1][-1])
        for i, rows in self._by_shard(np.searchsorted(self.base[level - 1], node[real], "right") - 1, level):
            out[real[rows]] = self._count(self.shard(level, i)[1]["sums"], node[real[rows]] - self.base[level - 1][i])
        return out

    def children(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each (context, word): place in the level, or -1; smoothed probability, or 0; count.

        Equal pairs are looked up once, in order; so is a context in a shard.
        """
        known = np.flatnonzero((context >= 0) & (word >= 0))
        pairs, which = np.unique(context[known].astype(np.uint64) * _U(self.words) + word[known].astype(np.uint64), return_inverse=True)
        contexts, words = pairs // _U(self.words), pairs % _U(self.words)
        node, share, count = np.full(len(pairs), -1, np.int64), np.zeros(len(pairs)), np.zeros(len(pairs), np.int64)
        for i, rows in self._by_shard(_gram_shard(contexts, words, len(self.base[level - 1]) - 1), level):
            arrays, ef, values = self.shard(level, i)
            own = contexts[rows]
            head = np.concatenate([[True], own[1:] != own[:-1]])
            group = np.cumsum(head) - 1
            place, found = ef["contexts"].successor(own[head])
            start = np.zeros(len(place), np.int64)
            end = np.zeros(len(place), np.int64)
            start[found] = ef["pointers"].get(place[found])
            end[found] = ef["pointers"].get(place[found] + 1)
            real = found[group]
            rows, group = rows[real], group[real]
            at, found = ef["keys"].successor(place[group].astype(np.uint64) * _U(self.words) + words[rows], start[group], end[group])
            rows, at = rows[found], at[found]
            node[rows] = at + self.base[level - 1][i]
            share[rows] = 10.0 ** (values["least"] + values["step"] * arrays["quanta"][at])
            if level < self.order:
                count[rows] = self._count(ef["sums"], at)
        out = np.full(len(word), -1, np.int64), np.zeros(len(word)), np.zeros(len(word), np.int64)
        for whole, part in zip(out, (node, share, count)):
            whole[known] = part[which]
        return out


def _gram_shard(context: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
    return _shard_of(mix(context.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + word.astype(np.uint64)), shards)


def _sequence(trie: Trie, words: pa.Array, index: np.ndarray, before: np.ndarray):
    """Of each token, ends included: id and count; and the place of each row's first token."""
    ids, counts = trie.vocabulary(pa.concat_arrays([words.cast(pa.large_string()), pa.array([""], pa.large_string())]))
    rows = len(before) - 1
    first = before[:-1] + np.arange(rows)
    index = np.insert(index, before[1:], len(words))
    return ids[index], counts[index], first


def _contexts(trie: Trie, ids: np.ndarray, counts: np.ndarray, first: np.ndarray, level: int):
    """Of each token the place and count of the (level-1)-gram before it, or -1."""
    context, many = np.roll(ids, 1), np.roll(counts, 1)
    context[first], many[first] = trie.words, trie.documents
    for k in range(2, level):
        node, _, count = trie.children(k, context, ids)
        context, many = np.roll(node, 1), np.roll(count, 1)
        context[first], many[first] = -1, 0
    return context, many


def _count_grams(batches, trie: Trie, level: int, shards: int):
    held: list[np.ndarray] = []
    size = 0

    def handed():
        yield from _gram_blocks(*np.unique(np.concatenate(held), return_counts=True), trie.words, shards, widest(shards))

    for _, data, offsets in pieces(batches, "text", PIECE):
        ids, counts, first = _sequence(trie, *_tokens(data, offsets))
        context, _ = _contexts(trie, ids, counts, first, level)
        real = context >= 0
        held.append(context[real].astype(np.uint64) * _U(trie.words) + ids[real].astype(np.uint64))
        size += len(held[-1])
        if size >= GATHER:
            yield from handed()
            held, size = [], 0
    if size:
        yield from handed()


def _gram_blocks(keys: np.ndarray, counts: np.ndarray, words: int, shards: int, width: int):
    """Distinct k-grams in order as one block for each range of ``width`` shards that has any; it is named by the first of them."""
    shard = _gram_shard((keys // _U(words)).astype(np.int64), (keys % _U(words)).astype(np.int64), shards) // width
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(-(-shards // width) + 1))
    for i in np.flatnonzero(np.diff(cut)):
        rows = order[cut[i] : cut[i + 1]]
        arrays, values = EliasFano.encode(keys[rows], "keys")
        many = counts[rows]
        block = pack(arrays | {"counts": many.astype(np.min_scalar_type(int(many.max())))}, **values)
        yield pa.RecordBatch.from_arrays([pa.array([i * width], pa.int32()), pa.array([block], pa.binary())], ["shard", "block"])


def _opened(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    arrays, values = unpack(np.frombuffer(block, np.uint8))
    part = EliasFano(arrays, values, "keys")
    return part.get(np.arange(part.n)), arrays["counts"].astype(np.int64)


def _split_grams(batches, words: int, shards: int, width: int):
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def handed():
        keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        yield from _gram_blocks(keys, np.bincount(where, np.concatenate([c for _, c in held])).astype(np.int64), words, shards, width)

    for batch in batches:
        for block in batch.column("block").to_pylist():
            held.append(_opened(block))
            if sum(len(k) for k, _ in held) >= GATHER:
                yield from handed()
                held.clear()
    if held:
        yield from handed()


def _parted(blocks: DataFrame, split, shards: int, fan: int, *more: Column) -> DataFrame:
    """Blocks of ranges of shards, split until each is of one shard."""
    width = widest(shards, fan)
    while width > 1:
        width = narrower(width, shards, fan)
        blocks = blocks.repartition("shard", *more).transform(in_arrow, partial(split, shards=shards, width=width), blocks.schema)
    return blocks


def _build_level(group: pa.Table, trie: Trie, level: int) -> pa.Table:
    keys, counts = map(list, zip(*map(_opened, group.column("block").to_pylist())))
    keys, where = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(where, np.concatenate(counts)).astype(np.int64)
    context, word = keys // _U(trie.words), keys % _U(trie.words)
    distinct, place = np.unique(context, return_inverse=True)
    pointers = np.searchsorted(place, np.arange(len(distinct) + 1))
    share = np.log10(count / (trie.counts(level - 1, distinct.astype(np.int64))[place] + trie.prior))
    least = float(share.min())
    step = (float(share.max()) - least) / 255
    quanta = np.rint((share - least) / step).astype(np.uint8) if step else np.zeros(len(share), np.uint8)
    arrays, values = {"quanta": quanta}, {"least": least, "step": step}
    for name, sequence in (("contexts", distinct), ("pointers", pointers.astype(np.uint64)), ("keys", place.astype(np.uint64) * _U(trie.words) + word), ("sums", np.cumsum(count).astype(np.uint64))):
        a, v = EliasFano.encode(sequence, name)
        arrays, values = arrays | a, values | v
    shard = group.column("shard")[0].as_py()
    put_file(f"{trie.folder}/{level}-{shard}", pack(arrays, **values))
    return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64())})


def _level_builder(trie: Trie, level: int):
    return lambda group: _build_level(group, trie, level)


def fit(docs: DataFrame, text_col: str = "text", order: int = ORDER, prior: float = PRIOR) -> Trie:
    """Count the words and k-grams of all rows and build the trie's files."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    words = settle(rows.transform(in_arrow, _count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "ngram-words")
    tokens, size, documents = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("n"))), F.lit(0))).first()
    trie = Trie(work_folder(spark, "ngram-trie"), int(tokens), int(size), int(documents), prior)
    shards = max(1, -(-trie.words // VOCABULARY_SHARD))
    dealt = words.transform(in_arrow, partial(_dealt_words, shards=shards), "shard int, key long, second long, n long")
    built = dealt.groupBy("shard").applyInArrow(lambda group: _build_vocabulary(group, trie.folder), "shard int, n long")
    trie.add_level(dict(map(tuple, built.collect())), shards)  # one row per shard
    for level in range(2, order + 1):
        if (int(trie.base[-1][-1]) + 1) * trie.words >= 1 << 64:
            raise OverflowError(f"{trie.base[-1][-1]} contexts times {trie.words} words don't fit a key of 64 bits")
        shards = max(1, -(-trie.tokens // TOKEN_SHARD))
        grams = rows.transform(in_arrow, partial(_count_grams, trie=trie, level=level, shards=shards), "shard int, block binary")
        grams = _parted(grams, partial(_split_grams, words=trie.words), shards, FAN)
        built = grams.groupBy("shard").applyInArrow(_level_builder(trie, level), "shard int, n long")
        trie.add_level(dict(map(tuple, built.collect())), shards)
    return trie


def _score(batches, trie: Trie):
    for rows, data, offsets in pieces(batches, "text", PIECE):
        ids, counts, first = _sequence(trie, *_tokens(data, offsets))
        unigram = (counts + 1.0) / (trie.tokens + trie.words + 1.0)
        chance = unigram
        for level in range(2, trie.order + 1):
            context, many = _contexts(trie, ids, counts, first, level)
            _, share, _ = trie.children(level, context, ids)
            chance = np.where(many > 0, share + trie.prior / (many + trie.prior) * chance, chance)
        sizes = np.diff(np.append(first, len(ids)))
        sums = [np.add.reduceat(x, first) for x in (np.log10(unigram), np.log10(chance), (counts > 0).astype(np.int64))]
        yield pa.RecordBatch.from_arrays(
            [*[c for c, f in zip(rows.columns, rows.schema) if f.name != "text"], pa.array(sizes.astype(np.int64)), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1])],
            [*[f.name for f in rows.schema if f.name != "text"], "n_tokens", "n_known", "base_score", "score"],
        )


def score(docs: DataFrame, trie: Trie, text_col: str = "text", id_col: str = "doc_id", part: int = PART) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score (add-one unigrams), score (the trie): log10 of the texts' probabilities."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    numbers = "n_tokens long, n_known long, base_score double, score double"
    if trie.order != 2:
        return rows.transform(in_arrow, partial(_score, trie=trie), f"doc_id {kind.simpleString()}, {numbers}")
    shards = len(trie.base[1]) - 1
    asked = rows.withColumn("rid", F.monotonically_increasing_id()).transform(in_arrow, partial(_ask, trie=trie, shards=shards, part=part), "shard int, block binary")
    questions = _parted(asked, partial(_split_asked, words=trie.words), shards, FAN, _range_of_texts())
    answers = questions.groupBy("shard", _range_of_texts().alias("texts")).applyInArrow(_answerer(trie), "chunk long, block binary")
    return answers.groupBy("chunk").applyInArrow(_united, f"doc_id {kind.simpleString()}, {numbers}")


# ---- pairs of texts brought to the shards -------------------------------------------------


#: A block of one frequent pair begins with this byte; then come seven that name a range of texts.
FREQUENT = b"\x02"


def _range_of_texts() -> Column:
    return F.when(F.substring("block", 1, 1) == F.lit(FREQUENT), F.substring("block", 1, 8)).otherwise(F.lit(b""))


def _asked_block(keys: np.ndarray, rids: np.ndarray, times: np.ndarray) -> bytes:
    names, many = np.unique(keys, return_counts=True)
    arrays, values = EliasFano.encode(names, "keys")
    least = int(rids.min())
    small = lambda x: x.astype(np.min_scalar_type(int(x.max())))
    return pack(arrays | {"many": small(many), "rids": small(rids - least), "times": small(times)}, least=least, **values)


def _asked_blocks(keys: np.ndarray, rids: np.ndarray, times: np.ndarray, words: int, shards: int, width: int, part: int | None = None):
    """Pairs by text (key, text, how often) as one block for each range of shards: distinct keys, texts of each, times.

    With ``part`` pairs that are frequent among these have blocks of their own:
    those of as many input partitions (the high bits of a text's number) as hold some ``part`` texts go together.
    """
    shard = _gram_shard((keys // _U(words)).astype(np.int64), (keys % _U(words)).astype(np.int64), shards) // width
    order = np.lexsort((rids, keys, shard))
    shard, keys, rids, times = shard[order], keys[order], rids[order], times[order]
    head = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (rids[1:] != rids[:-1])])) if len(keys) else np.zeros(0, np.int64)
    shard, keys, rids, times = shard[head], keys[head], rids[head], np.add.reduceat(times, head) if len(head) else times
    if part and len(keys):
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        many = np.diff(np.append(first, len(keys)))
        frequent = many > max(64, 2 * len(keys) // shards)
        for at, n in zip(first[frequent].tolist(), many[frequent].tolist()):
            one = slice(at, at + n)
            bits = max(0, (part // n).bit_length() - 1)
            name = FREQUENT + bytes([bits]) + (int(rids[at]) >> 33 >> bits).to_bytes(6, "big")
            exact = int(_gram_shard((keys[one][:1] // _U(words)).astype(np.int64), (keys[one][:1] % _U(words)).astype(np.int64), shards)[0])
            yield pa.RecordBatch.from_arrays([pa.array([exact], pa.int32()), pa.array([name + _asked_block(keys[one], rids[one], times[one])], pa.binary())], ["shard", "block"])
        rest = ~np.repeat(frequent, many)
        shard, keys, rids, times = shard[rest], keys[rest], rids[rest], times[rest]
    cut = np.searchsorted(shard, np.arange(-(-shards // width) + 1))
    for i in np.flatnonzero(np.diff(cut)):
        one = slice(cut[i], cut[i + 1])
        yield pa.RecordBatch.from_arrays([pa.array([i * width], pa.int32()), pa.array([_asked_block(keys[one], rids[one], times[one])], pa.binary())], ["shard", "block"])


def _asked(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """A block's pairs; None for a block of texts."""
    if block[:1] == TEXTS:
        return None
    arrays, values = unpack(np.frombuffer(block, np.uint8, offset=8 if block[:1] == FREQUENT else 0))
    part = EliasFano(arrays, values, "keys")
    return np.repeat(part.get(np.arange(part.n)), arrays["many"].astype(np.int64)), arrays["rids"].astype(np.int64) + values["least"], arrays["times"].astype(np.int64)


#: Texts whose sums come together again are those with the same number but for so many bits.
CHUNK = 10


def _chunks(rids: np.ndarray):
    """(chunk, first, end) of each run of rows, in order of their numbers, that is in one chunk."""
    cut = np.flatnonzero(np.diff(rids >> CHUNK)) + 1
    for at, end in zip([0, *cut.tolist()], [*cut.tolist(), len(rids)]):
        yield int(rids[at]) >> CHUNK, at, end


#: A block of texts begins with this byte; one of pairs with the low byte of a length, a multiple of eight.
TEXTS = b"\x01"


def _ask(batches, trie: Trie, shards: int, part: int = PART):
    """Blocks of the pairs of a task's texts; and, to any shard, the texts with what the vocabulary alone says of them."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    width = widest(shards)

    def handed():
        yield from _asked_blocks(*(np.concatenate(x) for x in zip(*held)), trie.words, shards, width, part)

    for rows, data, offsets in pieces(batches, "text", PIECE):
        ids, counts, first = _sequence(trie, *_tokens(data, offsets))
        context, many = _contexts(trie, ids, counts, first, 2)
        unigram = np.log10((counts + 1.0) / (trie.tokens + trie.words + 1.0))
        lower = unigram + np.where(many > 0, np.log10(trie.prior / (many + trie.prior)), 0.0)
        sizes = np.diff(np.append(first, len(ids)))
        sums = [np.add.reduceat(x, first) for x in (unigram, lower, (counts > 0).astype(np.int64))]
        rids = rows.column("rid").to_numpy()
        texts = pa.RecordBatch.from_arrays([rows.column("rid"), rows.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1])], ["rid", "doc_id", "n_tokens", "n_known", "base_score", "score"])
        for chunk, at, end in _chunks(rids):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, texts.schema) as stream:
                stream.write_batch(texts.slice(at, end - at))
            yield pa.RecordBatch.from_arrays([pa.array([chunk % shards // width * width], pa.int32()), pa.array([TEXTS + sink.getvalue().to_pybytes()], pa.binary())], ["shard", "block"])
        known = np.flatnonzero((context >= 0) & (ids >= 0))
        row = np.repeat(np.arange(len(sizes)), sizes)[known]
        held.append((context[known].astype(np.uint64) * _U(trie.words) + ids[known].astype(np.uint64), rids[row], np.ones(len(known), np.int64)))
        if sum(len(h[0]) for h in held) >= GATHER:
            yield from handed()
            held.clear()
    if held:
        yield from handed()


def _split_asked(batches, words: int, shards: int, width: int):
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        for at, block in zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist()):
            part = _asked(block)
            if part is None or block[:1] == FREQUENT:
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([block], pa.binary())], ["shard", "block"])
                continue
            held.append(part)
            if sum(len(h[0]) for h in held) >= GATHER:
                yield from _asked_blocks(*(np.concatenate(x) for x in zip(*held)), words, shards, width)
                held.clear()
    if held:
        yield from _asked_blocks(*(np.concatenate(x) for x in zip(*held)), words, shards, width)


def _answer(group: pa.Table, trie: Trie) -> pa.Table:
    """By chunk of texts, as blocks: what the known pairs of a shard add to each text; and the texts that came along."""
    parts, chunks, blocks = [], [], []
    for block in sorted(group.column("block").to_pylist()):  # sums don't depend on what comes first
        if (part := _asked(block)) is not None:
            parts.append(part)
        else:
            chunks.append(pa.ipc.open_stream(block[1:]).read_all().column("rid")[0].as_py() >> CHUNK)
            blocks.append(block)
    if parts:
        keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        context, word = (keys // _U(trie.words)).astype(np.int64), (keys % _U(trie.words)).astype(np.int64)
        share = trie.children(2, context, word)[1]
        weight = trie.prior / (trie.counts(1, context) + trie.prior)
        unigram = (trie.counts(1, word) + 1.0) / (trie.tokens + trie.words + 1.0)
        more = np.log10(1 + share / (weight * unigram))[where] * np.concatenate([p[2] for p in parts])
        rids, of = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        sums = np.bincount(of, more)
        for chunk, at, end in _chunks(rids):
            chunks.append(chunk)
            blocks.append(pack({"rids": (rids[at:end] & ((1 << CHUNK) - 1)).astype(np.uint16), "sums": sums[at:end]}))
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "block": pa.array(blocks, pa.binary())})


def _answerer(trie: Trie):
    return lambda group: _answer(group, trie)


def _united(group: pa.Table) -> pa.Table:
    """A chunk's texts, and the sums that all shards gave for them."""
    texts, more = [], np.zeros(1 << CHUNK)
    for block in sorted(group.column("block").to_pylist()):
        if block[:1] == TEXTS:
            texts.append(pa.ipc.open_stream(block[1:]).read_all())
        else:
            part = unpack(np.frombuffer(block, np.uint8))[0]
            more[part["rids"]] += part["sums"]
    whole = pa.concat_tables(texts)
    score = whole.column("score").to_numpy() + more[whole.column("rid").to_numpy() & ((1 << CHUNK) - 1)]
    return whole.drop_columns(["rid", "score"]).append_column("score", pa.array(score))


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trie = fit(docs.filter(~held_out(F.col("doc_id"))))
    found = score(docs, trie)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(trie.tokens).cast("long").alias("train_tokens"), "base_score", "score")

"""Removal of repeated byte strings by prefix-free parsing and suffix arrays.

A rolling hash over ``WINDOW`` bytes cuts texts into phrases wherever it fires;
each phrase begins and ends with a trigger, so no phrase suffix is a prefix of
another.  The dictionary is the set of distinct phrases, the parse is each
text's sequence of them.  A text suffix is a phrase suffix followed by a parse
suffix, so its place in corpus order is the pair of their ranks in the suffix
arrays of dictionary and parse.  Equal strings of ``length`` bytes are
neighbours in that order.

The corpus is ordered in parts that strings of equal content cannot leave.  A
string's part is its anchor: of the whole phrases in it the one that is rarest
in the corpus, the first of equally rare ones.

1. Count phrases.  A string whose anchor occurs once occurs once itself;
   nothing more is done for it.
2. Other strings are taken together by their anchor: one stretch of text per
   phrase occurrence that is an anchor.  Stretches are runs of the parse and are
   counted as such; one that occurs twice settles all its strings.
3. Distinct stretches of an anchor that has unsettled ones go to one shard,
   where dictionary and parse are sorted; neighbours in corpus order are
   compared byte by byte, and those with ``length`` bytes in common repeat.
   As the anchor is the rarest phrase, a part is no larger than the number of
   copies of its text.  Strings of an anchor above ``hot`` occurrences, and those
   without a whole phrase, are spread by their own content instead: one row for
   each distinct string of a task and its number there, ordered and compared in
   shards like the others.  So no phrase makes a large group.
4. Texts are read once more, and bytes under any repeated string are removed.

Counts and sets live in files of the shared folder, cut by hash into shards of
bounded size and memory-mapped by the tasks; neither is collected nor
broadcast.  Their keys are two independent 64-bit hashes.

Defined results: null text is empty; matches stay within a text; a repeated row
repeats all its strings, so it loses them as any copy does; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .counts import BLOCKS, Counts, Gathering, counted, shard_of
from .eliasfano import pack, unpack
from .shared import RangeHash, in_arrow, mix, pieces, runs, table

LENGTH = 200
WINDOW = 8
#: Mean bytes between triggers.
PERIOD = 24
HOT = 4096
#: Text bytes that one shard is made from.
SHARD_BYTES = 12 << 20
_U = np.uint64
_FIRES = _U((1 << 32) // PERIOD)
_FAR = 1 << 60


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where triggers end, and in which row."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.ndarray((len(data) - WINDOW + 1,), "<u8", np.ascontiguousarray(data).data, 0, (1,))
    at = np.flatnonzero((((seen * _U(0x9E3779B97F4A7C15)) ^ _U(0x2545F491)) * _U(0xD6E8FEB86659FD93)) >> _U(32) < _FIRES) + WINDOW
    row = np.searchsorted(offsets, at - 1, "right") - 1
    inside = at - WINDOW >= offsets[row]
    return at[inside], row[inside]


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the intervals [low, high], and the interval of each."""
    sizes = np.maximum(high - low + 1, 0)
    which = np.repeat(np.arange(len(low)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which], which


# ---- parsing ------------------------------------------------------------------------------


class Parse:
    """A piece of text cut into phrases.

    Entry j stands for the strings whose first visible trigger ends at
    ``at[j]``; each row has a last entry beyond its end for strings without.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        at, row = boundaries(data, offsets)
        rows = len(offsets) - 1
        at = np.insert(at, np.searchsorted(row, np.arange(rows), "right"), offsets[1:] + length + WINDOW)
        self.row = np.insert(row, np.searchsorted(row, np.arange(rows), "right"), np.arange(rows))
        self.at, self.data, self.hash, self.length, self._second = at, data, RangeHash(data), length, None
        n = len(at)
        self.real = np.ones(n, bool)  # entries that begin a whole phrase
        same = np.zeros(n, bool)
        same[:-1] = self.row[1:] == self.row[:-1]
        last_real = np.zeros(n, bool)
        last_real[:-1] = same[:-1] & ~np.append(same[1:], False)[: n - 1]
        self.real = same & ~last_real
        self.next = np.where(same, np.append(at[1:], 0), at + 2 * length)
        before = np.full(n, -_FAR)
        before[1:][same[:-1]] = at[:-1][same[:-1]]
        start, end = offsets[self.row], offsets[self.row + 1]
        self.start, self.end = start, end
        self.low = np.maximum(start, before - WINDOW + 1)
        self.high = np.minimum(at - WINDOW, end - length)
        self.phrase = np.flatnonzero(self.real & (end - start >= length))
        self.key = self.hash.of(at[self.phrase] - WINDOW, self.next[self.phrase])

    def loose(self) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of strings that hold no whole phrase."""
        high = np.minimum(self.high, self.next - self.length - 1)
        keep = self.low <= high
        return self.low[keep], high[keep]

    def stretches(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of strings whose anchor occurs twice or more, and the anchor (an index of ``phrase``).

        A phrase is in the strings from its end less ``length`` to its start;
        it is their anchor where no phrase before it that is as rare, and none
        after it that is rarer, is in them too.
        """
        begin, end, row = self.at[self.phrase] - WINDOW, self.next[self.phrase], self.row[self.phrase]
        low = np.maximum(self.start[self.phrase], end - self.length)
        high = np.minimum(begin, self.end[self.phrase] - self.length)
        for step in (-1, 1):
            live = np.flatnonzero(count >= 2)
            other = live + step
            while len(live):
                inside = (other >= 0) & (other < len(begin))
                live, other = live[inside], other[inside]
                near = row[other] == row[live]
                near &= begin[other] >= low[live] if step < 0 else end[other] - self.length <= high[live]
                live, other = live[near], other[near]
                if step < 0:
                    wins = count[other] <= count[live]
                    low[live[wins]] = begin[other[wins]] + 1
                else:
                    wins = count[other] < count[live]
                    high[live[wins]] = end[other[wins]] - self.length - 1
                live, other = live[~wins], other[~wins] + step
        keep = np.flatnonzero((low <= high) & (count >= 2))
        return low[keep], high[keep], keep

    def _pair(self, start: np.ndarray, end: np.ndarray, odd: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        if self._second is None:
            self._second = RangeHash(self.data, 1)
        return mix(self.hash.of(start, end) ^ odd), mix(self._second.of(start, end) ^ odd)

    def stretch_keys(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._pair(low, high + self.length, _U(0xA5A5))

    def string_keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._pair(at, at + self.length, _U(0))

    def split(self, phrases: Counts, hot: int):
        """Stretches (low, high, anchor's key, its count), and the places of the strings that are taken one by one."""
        count = phrases.of(self.key, np.zeros_like(self.key))
        low, high, anchor = self.stretches(count)
        common = count[anchor] > hot
        single = spread(*(np.concatenate(x) for x in zip(self.loose(), (low[common], high[common]))))[0]
        rest = ~common
        return low[rest], high[rest], self.key[anchor[rest]], count[anchor[rest]], single


def _phrases(batches, length: int, shards: int):
    held = Gathering(shards)
    for _, data, offsets in pieces(batches, "text"):
        keys = Parse(data, offsets, length).key
        yield from held.add(keys, np.zeros_like(keys))  # counts of phrases only choose; one hash will do
    yield from held.rest()


def _strings(batches, length: int, shards: int, phrases: Counts, hot: int):
    held = Gathering(shards)
    for _, data, offsets in pieces(batches, "text"):
        parse = Parse(data, offsets, length)
        low, high, _, _, single = parse.split(phrases, hot)
        for keys in (parse.stretch_keys(low, high), parse.string_keys(single)):
            yield from held.add(*keys)
    yield from held.rest()


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings at the places ``a`` and ``b`` have their first ``length`` bytes in common."""
    out = np.zeros(len(a), bool)
    if len(a):
        window = np.lib.stride_tricks.sliding_window_view(data, length)
        for at in range(0, len(a), 4096):
            part = slice(at, at + 4096)
            out[part] = (window[a[part]] == window[b[part]]).all(axis=1)
    return out


class _Rows:
    """Distinct rows of text by shard, and how often each was there (0 for a stretch, whose number nobody asks for)."""

    def __init__(self, most: int = 16 << 20):
        self.held: dict[int, dict[bytes, int]] = {}
        self.size, self.most = 0, most

    def add(self, shard: int, row: bytes, times: int):
        rows = self.held.setdefault(shard, {})
        if row not in rows:
            self.size += len(row)
        rows[row] = rows.get(row, 0) + times
        if self.size >= self.most:
            yield from self.rest()

    def rest(self):
        for shard, rows in self.held.items():
            sizes = np.array([len(x) for x in rows], np.int64)
            block = pack({"sizes": sizes, "times": np.array([*rows.values()], np.int64), "data": np.frombuffer(b"".join(rows), np.uint8)})
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.binary())], ["shard", "block"])
        self.held, self.size = {}, 0


def _unsettled(batches, length: int, shards: int, phrases: Counts, strings: Counts, hot: int):
    """Stretches by shard of their anchor, unless all the anchor's occurrences are in equal stretches; strings by shard of their own."""
    rows = _Rows()
    for _, data, offsets in pieces(batches, "text"):
        parse = Parse(data, offsets, length)
        low, high, anchor, count, single = parse.split(phrases, hot)
        open_ = np.flatnonzero(count > np.maximum(strings.of(*parse.stretch_keys(low, high)), 1))
        flat = data.tobytes()
        for shard, a, b in zip(shard_of(mix(anchor[open_]), shards).tolist(), low[open_].tolist(), (high[open_] + length).tolist()):
            yield from rows.add(shard, flat[a:b], 0)
        key, second = parse.string_keys(single)
        twice = strings.of(key, second) > 1
        single, key = single[twice], key[twice]
        _, first, which, many = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        equal = same_bytes(data, single, single[first[which]], length)
        many -= np.bincount(which[~equal], minlength=len(many))
        alone = np.flatnonzero(~equal)  # unlike strings of one hash
        for chosen, times in ((first, many), (alone, np.ones(len(alone), np.int64))):
            for shard, a, n in zip(shard_of(key[chosen], shards).tolist(), single[chosen].tolist(), times.tolist()):
                yield from rows.add(shard, flat[a : a + length], n)
    yield from rows.rest()


# ---- suffix arrays ------------------------------------------------------------------------


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of tuples, equal for equal tuples; the first key counts most."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), np.int64)
    for key in keys:
        change[1:] |= key[order][1:] != key[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(change)
    return rank


def dictionary_ranks(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranks of the phrase suffixes data[at:end] in the dictionary's suffix array; equal suffixes share a rank.

    Eight bytes a round; only suffixes that are still tied go on.
    """
    room = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray((len(room) - 7,), ">u8", room.data, 0, (1,))
    rank = np.zeros(len(at), np.int64)
    live, done = np.arange(len(at)), 0
    while len(live):
        left = end[live] - at[live] - done
        key = words[at[live] + done].astype(np.uint64)
        short = left < 8
        key[short] &= ~((_U(1) << (_U(8) * (8 - left[short]).astype(np.uint64))) - _U(1))
        order = np.lexsort((key, rank[live]))
        r, k = rank[live][order], key[order]
        group = np.concatenate([[True], r[1:] != r[:-1]])
        head = group.copy()
        head[1:] |= k[1:] != k[:-1]
        index = np.arange(len(order))
        start = np.maximum.accumulate(np.where(head, index, 0))
        rank[live[order]] = r + start - np.maximum.accumulate(np.where(group, index, 0))
        last = np.append(np.flatnonzero(head)[1:], len(order))
        tied = np.repeat(np.diff(np.append(np.flatnonzero(head), len(order))) > 1, last - np.flatnonzero(head))
        live = np.sort(live[order][tied & (left[order] > 8)])
        done += 8
    return rank


def parse_ranks(symbols: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of each row's sequence of symbols (above 0), by doubling; an end is the least."""
    rank, step = symbols.astype(np.int64), 1
    longest = int(np.bincount(row).max(initial=1)) if len(row) else 1
    while step < longest:
        after = np.zeros(len(rank), np.int64)
        after[:-step] = np.where(row[step:] == row[:-step], rank[step:], 0)
        rank = _dense(rank, after) + 1
        step *= 2
    return rank


def corpus_order(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Places of all strings of ``length`` bytes in the order of the texts that begin there."""
    at, row = boundaries(data, offsets)
    rows = len(offsets) - 1
    first = np.searchsorted(row, np.arange(rows))
    # phrases of each row: its head up to the first trigger, then from trigger to trigger, then its tail
    begin = np.insert(at - WINDOW, first, offsets[:-1])
    owner = np.insert(row, first, np.arange(rows))
    end = np.insert(at, np.searchsorted(row, np.arange(rows), "right"), offsets[1:])
    flat = data.tobytes()
    words = [flat[a:b] for a, b in zip(begin.tolist(), end.tolist())]
    dictionary = sorted(set(words))
    number = {word: i for i, word in enumerate(dictionary)}
    phrase = np.array([number[word] for word in words], np.int64)
    parse = np.append(parse_ranks(phrase + 1, owner), 0)
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    places = spread(offsets[:-1], offsets[1:] - length)[0]
    if not len(places):
        return places
    holder = np.searchsorted(begin, places, "right") - 1
    ends = np.cumsum([len(word) for word in dictionary])
    starts = ends - [len(word) for word in dictionary]
    suffix, which = np.unique(starts[phrase[holder]] + places - begin[holder], return_inverse=True)
    ranks = dictionary_ranks(np.frombuffer(b"".join(dictionary), np.uint8), suffix, ends[np.searchsorted(ends, suffix, "right")])
    follow = np.where(last[holder], 0, parse[holder + 1])
    return places[np.lexsort((follow, ranks[which]))]


def row_of(at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, at, "right") - 1


def repeated(rows: dict[bytes, int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and their numbers -> their bytes, and the places of strings that occur twice: neighbours in corpus order with ``length`` bytes in common."""
    data = np.frombuffer(b"".join(rows), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int64)
    order = corpus_order(data, offsets, length)
    same = same_bytes(data, order[1:], order[:-1], length)
    many = offsets[:-1][np.array([*rows.values()]) > 1]
    return data, np.unique(np.concatenate([order[1:][same], many]))


def _compare(group: pa.Table, length: int, shards: int):
    """One shard of rows: keys of the strings that occur twice in it."""
    rows: dict[bytes, int] = {}
    for block in group.column("block").to_pylist():
        part = unpack(np.frombuffer(block, np.uint8))[0]
        flat, at = part["data"].tobytes(), 0
        for size, times in zip(part["sizes"].tolist(), part["times"].tolist()):
            row = flat[at : at + size]
            rows[row] = rows.get(row, 0) + times
            at += size
    data, at = repeated(rows, length)
    held = Gathering(shards)
    keys = [mix(RangeHash(data, which).of(at, at + length)) for which in (0, 1)]
    batches = [*held.add(*keys), *held.rest()]
    return pa.Table.from_batches(batches, pa.schema([("shard", pa.int32()), ("block", pa.binary())]))


# ---- the operator -------------------------------------------------------------------------


def _removed(batches, length: int, phrases: Counts, strings: Counts, ordered: Counts, hot: int, as_text: bool):
    for rows, data, offsets in pieces(batches, "text"):
        parse = Parse(data, offsets, length)
        low, high, _, _, single = parse.split(phrases, hot)
        settled = strings.of(*parse.stretch_keys(low, high)) > 1
        places = np.concatenate([spread(low[~settled], high[~settled])[0], single])
        places = places[ordered.of(*parse.string_keys(places)) > 0]
        change = np.zeros(len(data) + 1, np.int32)
        for start, end in ((low[settled], high[settled] + length), (places, places + length)):
            np.add.at(change, start, 1)
            np.add.at(change, end, -1)
        gone = np.cumsum(change[:-1]) > 0
        starts, ends, before = runs(gone, offsets)
        lost = np.concatenate([[0], np.cumsum(ends - starts)])[before]
        kept = [(data[a:b][~gone[a:b]] if n else data[a:b]).tobytes() for a, b, n in zip(offsets[:-1], offsets[1:], np.diff(lost))]
        yield pa.RecordBatch.from_arrays(
            [
                *[c for c, f in zip(rows.columns, rows.schema) if f.name != "text"],
                pa.array(np.diff(offsets)), pa.array(np.diff(lost)), pa.array(np.diff(before).astype(np.int64)),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
            ],
            [*[f.name for f in rows.schema if f.name != "text"], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, hot: int = HOT, shard_bytes: int = SHARD_BYTES, as_text: bool = False) -> DataFrame:
    """The columns but the text, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    ``id_col`` comes out as doc_id; other columns under their own names with
    ``row_`` before.  With ``as_text``, kept is text: characters of which bytes
    are missing go whole.
    """
    others = [c for c in docs.columns if c not in (text_col, id_col)]
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.col(f"`{c}`").alias(f"row_{i}") for i, c in enumerate(others)], F.col(text_col).cast("string").alias("text"))
    texts = rows.select("text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    phrases = counted(texts.transform(in_arrow, partial(_phrases, length=length, shards=shards), BLOCKS), shards, "suffix-phrases")
    strings = counted(texts.transform(in_arrow, partial(_strings, length=length, shards=shards, phrases=phrases, hot=hot), BLOCKS), shards, "suffix-strings")
    open_ = texts.transform(in_arrow, partial(_unsettled, length=length, shards=shards, phrases=phrases, strings=strings, hot=hot), BLOCKS)
    compared = open_.groupBy("shard").applyInArrow(lambda group: _compare(group, length, shards), BLOCKS)
    ordered = counted(compared, shards, "suffix-ordered", least=1)
    schema = T.StructType([f for f in rows.schema if f.name != "text"])
    for name, kind in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("kept", T.StringType() if as_text else T.BinaryType())):
        schema = schema.add(name, kind)
    found = rows.transform(in_arrow, partial(_removed, length=length, phrases=phrases, strings=strings, ordered=ordered, hot=hot, as_text=as_text), schema)
    return found.select("doc_id", *[F.col(f"row_{i}").alias(f"row_{c}") for i, c in enumerate(others)], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def clean(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` without repeated strings; rows that lose all their text go, rows that had none stay.

    ``n_chars``, where it is a column, is counted anew for rows that lost text.
    """
    found = remove_repeats(docs, text_col, id_col, length, as_text=True)
    out = found.withColumnRenamed("kept", "text").filter((F.col("n_removed") == 0) | (F.col("text") != ""))
    own = {text_col: F.col("text"), id_col: F.col("doc_id")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row_n_chars"))
    return out.select(*[own.get(c, F.col(f"`row_{c}`")).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

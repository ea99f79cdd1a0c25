"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of id pairs.

Texts are encoded once by both tokenizers (A and B), and their ids are written
as a table.  First pass: from the byte ranges of the tokens come the linked
pairs of every document, distinct ones are counted within a task, and all
distinct pairs are dealt to shards by hash.  Each shard has a minimal perfect
hash with its keys stored at their hashes, so a key that isn't there is told.
Counts are dense vectors, one number for each hash of a shard; tasks' vectors
are added up in a tree of groups of ``FAN``.  Second pass: documents are aligned
again from their ids, and counts are looked up in the mapped shards.

There are at most as many pairs as ids of A times ids of B, whatever the size of
the corpus; the highest count of each id of A is one vector of A's vocabulary.

Defined results: texts that are null, empty, or not given back exactly by the
tokens of A or B have no tokens: their numbers are 0 and their digest is ''.
A row is a document: repeated rows count as often as they stand there. Null ids
pass through, other columns are ignored, an empty table gives none, and texts may
have any length that a row can.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import mph, tokens
from .eliasfano import pack, unpack
from .shared import Opened, in_arrow, map_file, mix, pieces, put_file, settle, strings_of, table, work_folder

SHARD_PAIRS = 1 << 17
#: Distinct pairs that a task holds before it hands them on.
HELD = 1 << 20
#: Vectors that one group of the tree adds up.
FAN = 16
_U = np.uint64


# ---- ids ----------------------------------------------------------------------------------


def _encode(batches, a: str, b: str, kind: pa.DataType):
    ways = [(tokens.encoder(p, plain=True), tokens.token_bytes(p), tokens.narrow(len(tokens.token_bytes(p)))) for p in (a, b)]
    for rows, _, _ in pieces(batches, "text"):
        texts = strings_of(rows.column("text"))
        spaced = [" " + t for t in texts]
        found = [ways[0][0](spaced), ways[1][0](texts)]
        columns = [[], []]
        for text, *both in zip(spaced, *found):
            raw = text.encode()
            same = raw != b" " and all(b"".join(map(way[1].__getitem__, ids)) == raw for way, ids in zip(ways, both))
            for column, way, ids in zip(columns, ways, both):
                column.append(np.array(ids if same else [], way[2]).tobytes())
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(kind), *[pa.array(c, pa.binary()) for c in columns]], ["doc_id", "a", "b"])


def encoded(docs: DataFrame, a: str, b: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, a, b: the ids of both tokenizers as little-endian numbers, of two bytes where the vocabulary allows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    return rows.transform(in_arrow, partial(_encode, a=a, b=b, kind=to_arrow_type(kind)), f"doc_id {kind.simpleString()}, a binary, b binary")


def _ids_of(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows end to end, and the offsets of rows."""
    column = pa.concat_arrays([column.cast(pa.large_binary())])
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1)
    data = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]].view(kind).astype(np.int64), (offsets - offsets[0]) // kind.itemsize


# ---- alignment ----------------------------------------------------------------------------


class Aligned:
    """Links and groups of some documents, laid end to end: both tokenizers end where a document ends."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_rows: np.ndarray, a_size: np.ndarray, b_size: np.ndarray):
        self.a, self.b = a, b
        # every stretch between two ends lies in one token of A and one of B, and every linked pair shares one stretch
        ended = np.zeros(int(a_size[a].sum()) + 1, np.uint8)
        ended[np.cumsum(a_size[a])] = 1
        ended[np.cumsum(b_size[b])] |= 2
        ended = ended[np.flatnonzero(ended)]
        a_after, b_after = np.cumsum(ended & 1, dtype=np.int64), np.cumsum(ended >> 1, dtype=np.int64)
        self.link_a, self.link_b = a_after - (ended & 1), b_after - (ended >> 1)
        self.row_of_a = np.repeat(np.arange(len(a_rows) - 1), np.diff(a_rows))
        self.row = self.row_of_a[self.link_a]
        #: One past the last token of each group.
        self.group_a, self.group_b = a_after[ended == 3], b_after[ended == 3]

    def pairs(self, b_vocabulary: int) -> np.ndarray:
        return self.a[self.link_a] * b_vocabulary + self.b[self.link_b]


def _sizes(path: str) -> np.ndarray:
    return np.array([len(x) for x in tokens.token_bytes(path)], np.int64)


class _Reader:
    """Aligns batches of a table of ids."""

    def __init__(self, a: str, b: str):
        self.a, self.b = a, b

    def __call__(self, batches):
        a_size, b_size = _sizes(self.a), _sizes(self.b)
        a_kind, b_kind = tokens.narrow(len(a_size)), tokens.narrow(len(b_size))
        for batch in batches:
            if batch.num_rows:
                (a, a_rows), (b, b_rows) = _ids_of(batch.column("a"), a_kind), _ids_of(batch.column("b"), b_kind)
                yield batch, a_rows, b_rows, Aligned(a, b, a_rows, a_size, b_size), len(b_size)


def _local_pairs(batches, read: _Reader):
    """pair, n: distinct pairs and the number of documents that hold them, added up while ``HELD`` allows."""
    held, size = [], 0

    def united():
        pair, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        return pair, np.bincount(at, np.concatenate([n for _, n in held]), len(pair)).astype(np.int64)

    def out(pair, n):
        for at in range(0, len(pair), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(pair[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)])], ["pair", "n"])

    for _, _, _, found, vocabulary in read(batches):
        pairs = found.pairs(vocabulary)
        place, name = pd.factorize(pairs)
        once = pd.unique(found.row * max(1, len(name)) + place)  # a document counts a pair once
        held.append((name, np.bincount(once % max(1, len(name)), minlength=len(name)).astype(np.int64)))
        size += len(name)
        if size >= HELD:
            held = [united()]
            size = len(held[0][0])
            if size >= HELD // 2:
                yield from out(*held[0])
                held, size = [], 0
    if held:
        yield from out(*united())


# ---- counts -------------------------------------------------------------------------------


def _shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    return (((mix(pairs.astype(np.uint64) + _U(1)) >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)


def _named(batches, shards: int):
    for batch in batches:
        pairs = batch.column("pair").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(_shard_of(pairs, shards).astype(np.int32)), batch.column("pair")], ["shard", "pair"])


def _build(group: pa.Table, folder: str) -> pa.Table:
    keys = np.sort(group.column("pair").to_numpy())
    arrays = mph.build(keys.view(np.uint64))
    stored = np.empty(len(keys), np.int64)
    stored[mph.find(arrays, keys.view(np.uint64))] = keys
    shard = group.column("shard")[0].as_py()
    put_file(f"{folder}/keys/{shard}", pack(arrays | {"keys": stored}))
    return pa.table({"shard": pa.array([shard], pa.int32())})


class Shards:
    """Key files, and counts beside them, of a folder."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards, self.files = folder, shards, Opened()

    def places(self, pairs: np.ndarray):
        """For each shard that some pairs belong to: its number, which pairs, their hashes, and how many hashes there are."""
        shard = _shard_of(pairs, self.shards)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for i in np.flatnonzero(np.diff(cut)):
            rows = order[cut[i] : cut[i + 1]]
            arrays = self.files.get(f"{self.folder}/keys/{i}", lambda data: unpack(data)[0])
            at = mph.find(arrays, pairs[rows].view(np.uint64))
            if (at < 0).any() or (arrays["keys"][at] != pairs[rows]).any():
                raise LookupError("a pair that no document of the first pass has")
            yield i, rows, at, len(arrays["keys"])

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pairs), np.int64)
        for i, rows, at, _ in self.places(pairs):
            out[rows] = self.files.get(f"{self.folder}/counts/{i}", lambda data: unpack(data)[0])["counts"][at]
        return out


def _packed(vector: np.ndarray) -> bytes:
    return pack({"v": vector.astype(np.min_scalar_type(int(vector.max(initial=0))))})


def _vectors(batches, known: Shards):
    """shard, leaf, v: a task's counts as dense vectors."""
    from pyspark import TaskContext

    leaf = TaskContext.get().partitionId()
    held, size = [], 0

    def out():
        pairs, n = (np.concatenate(x) for x in zip(*held))
        for i, rows, at, many in known.places(pairs):
            vector = np.bincount(at, n[rows], many).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([leaf], pa.int32()), pa.array([_packed(vector)], pa.binary())], ["shard", "leaf", "v"])

    for batch in batches:
        held.append((batch.column("pair").to_numpy(), batch.column("n").to_numpy()))
        size += batch.num_rows
        if size >= HELD:
            yield from out()
            held, size = [], 0
    if size:
        yield from out()


def _added(group: pa.Table) -> np.ndarray:
    total = None
    for block in group.column("v"):
        vector = unpack(np.frombuffer(block.as_buffer(), np.uint8))[0]["v"].astype(np.int64)
        total = vector if total is None else total + vector
    return total


def _add(group: pa.Table) -> pa.Table:
    return pa.table({"shard": group.column("shard")[:1], "leaf": pa.array([group.column("leaf")[0].as_py() // FAN], pa.int32()), "v": pa.array([_packed(_added(group))], pa.binary())})


def _finish(group: pa.Table, known: Shards, vocabulary: int) -> pa.Table:
    """Write a shard's counts; a, best: the highest count of each id of A in it."""
    shard = group.column("shard")[0].as_py()
    counts = _added(group)
    put_file(f"{known.folder}/counts/{shard}", pack({"counts": counts}))
    keys = unpack(map_file(f"{known.folder}/keys/{shard}"))[0]["keys"]
    a, at = np.unique(keys // vocabulary, return_inverse=True)
    best = np.zeros(len(a), np.int64)
    np.maximum.at(best, at, counts)
    return pa.table({"a": a, "best": best})


def pair_counts(ids: DataFrame, a: str, b: str) -> Shards:
    """In how many documents of a table of ids each pair is linked: mapped shards, and ``best`` of each id of A beside them."""
    spark = ids.sparkSession
    local = settle(ids.select("a", "b").transform(in_arrow, partial(_local_pairs, read=_Reader(a, b)), "pair long, n long"), "pairs")
    distinct = settle(local.select("pair").distinct(), "distinct-pairs")
    known = Shards(work_folder(spark, "alignment"), max(1, -(-distinct.count() // SHARD_PAIRS)))
    named = distinct.transform(in_arrow, partial(_named, shards=known.shards), "shard int, pair long")
    named.groupBy("shard").applyInArrow(lambda group: _build(group, known.folder), "shard int").write.format("noop").mode("overwrite").save()
    vectors = settle(local.transform(in_arrow, partial(_vectors, known=known), "shard int, leaf int, v binary"), "vectors")
    leaves = (vectors.agg(F.max("leaf")).first()[0] or 0) + 1
    while leaves > FAN:
        vectors = vectors.groupBy("shard", F.expr(f"leaf div {FAN}").alias("branch")).applyInArrow(lambda group: _add(group), "shard int, leaf int, v binary")
        leaves = -(-leaves // FAN)
    a_vocabulary, b_vocabulary = len(tokens.token_bytes(a)), len(tokens.token_bytes(b))
    found = vectors.groupBy("shard").applyInArrow(lambda group: _finish(group, known, b_vocabulary), "a long, best long")
    best = np.zeros(a_vocabulary, np.int64)
    for row in found.groupBy("a").agg(F.max("best").alias("best")).collect():  # a row for each id of A at most
        best[row.a] = row.best
    put_file(f"{known.folder}/best", pack({"best": best}))
    return known


# ---- results ------------------------------------------------------------------------------


def _labels(path: str) -> list[np.ndarray]:
    """Each id as text with what follows it: within a group, and at its end."""
    n = len(tokens.token_bytes(path))
    return [np.array([f"{i}{mark}" for i in range(n)], object) for mark in ",|;"]


def _digests(found: Aligned, a_rows: np.ndarray, b_rows: np.ndarray, a_text: list, b_text: list) -> list[str]:
    last_a, last_b = np.zeros(len(found.a), bool), np.zeros(len(found.b), bool)
    last_a[found.group_a - 1] = last_b[found.group_b - 1] = True
    # tokens in the order of the text: a group's of A, then its of B
    before_a = np.concatenate([[0], found.group_b])[np.searchsorted(found.group_a, np.arange(len(found.a)), "right")]
    before_b = found.group_a[np.searchsorted(found.group_b, np.arange(len(found.b)), "right")]
    line = np.empty(len(found.a) + len(found.b), object)
    line[np.arange(len(found.a)) + before_a] = np.where(last_a, a_text[1][found.a], a_text[0][found.a])
    line[np.arange(len(found.b)) + before_b] = np.where(last_b, b_text[2][found.b], b_text[0][found.b])
    rows = a_rows + b_rows
    return [hashlib.sha256("".join(line[s:e])[:-1].encode()).hexdigest() if e > s else "" for s, e in zip(rows[:-1], rows[1:])]


def _described(batches, read: _Reader, known: Shards):
    a_text, b_text = _labels(read.a), _labels(read.b)
    best = unpack(map_file(f"{known.folder}/best"))[0]["best"]
    for batch, a_rows, b_rows, found, vocabulary in read(batches):
        n = batch.num_rows
        at, pairs = pd.factorize(found.pairs(vocabulary))
        counts = known.counts(pairs)
        highest = counts == best[pairs // vocabulary]
        many = lambda rows, weight=None: pa.array(np.bincount(rows, weight, n).astype(np.int64))
        sums = np.zeros(n, np.int64)
        np.add.at(sums, found.row, counts[at])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(np.diff(a_rows)), pa.array(np.diff(b_rows)), many(found.row_of_a[found.group_a - 1]),
                many(found.row), many(found.row[highest[at]]), pa.array(sums), pa.array(_digests(found, a_rows, b_rows, a_text, b_text), pa.string()),
            ],
            ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
        )


def aligned(docs: DataFrame, a: str, b: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row the numbers of tokens, groups and links, of best links, the sum of counts, and a digest of the groups.

    ``a`` is a byte-level BPE file, which reads a space before each text; ``b``
    is a piece model, which adds that space.  Both paths are present on every executor.
    """
    ids = settle(encoded(docs, a, b, text_col, id_col), "aligned-ids")
    known = pair_counts(ids, a, b)
    kind = ids.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{x} long" for x in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    return ids.transform(in_arrow, partial(_described, read=_Reader(a, b), known=known), f"doc_id {kind}, {numbers}, groups_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), tokens.public("byte_bpe_50k.json"), tokens.public("piece_bpe_32k.model"))

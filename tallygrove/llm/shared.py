"""What the operators share: work tables, files in the shared folder, Arrow plumbing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step works on, and one less than the powers that its range hashes need; a longer document is one step of its own.
PIECE_BYTES = (1 << 19) - 1
#: Bytes of an Arrow batch; a longer row is one of its own.
BATCH_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir), with its scheme; a temporary one only on one machine where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallygrove-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    # a path without a scheme belongs to the default file system, which need not be a local one
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(path).toString().rstrip("/")


def remove_folder(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone at exit; the cluster's cleaner takes the rest
        pass


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one.  It is removed when the driver ends, since lazy results may still read it."""
    path = f"{shared_root(spark)}/tallygrove/{name}-{uuid.uuid4().hex}"
    atexit.register(remove_folder, spark, path)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, runs the work once."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---- files that Python tasks write and map -------------------------------------------------


def local_path(uri: str) -> str | None:
    """The path when the shared folder is mounted on every machine, else None."""
    parts = urlparse(uri)
    return parts.path if parts.scheme == "file" else None


def put_file(uri: str, data: bytes) -> None:
    """Write a file of the shared folder at once: a retried or speculative task replaces it by equal bytes."""
    if (path := local_path(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temp = f"{path}.{uuid.uuid4().hex}"
        with open(temp, "wb") as f:
            f.write(data)
        os.replace(temp, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(f"{path}.{(mark := uuid.uuid4().hex)}") as f:
        f.write(data)
    store.move(f"{path}.{mark}", path)


def put_parts(uri: str, parts: Iterator[np.ndarray]) -> None:
    """Write a file of a mounted folder from arrays, one after the other."""
    path = local_path(uri)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(temp := f"{path}.{uuid.uuid4().hex}", "wb") as f:
        for part in parts:
            f.write(np.ascontiguousarray(part).data)
    os.replace(temp, path)


def map_file(uri: str) -> np.ndarray:
    """The bytes of a file of the shared folder: memory-mapped, or read if it is not mounted."""
    if (path := local_path(uri)) is not None:
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as source:
        return np.frombuffer(source.read(), np.uint8)


class Opened:
    """Files of the shared folder that a task has open: the last used ones, up to ``most`` of them, and of read bytes up to ``most_bytes``."""

    def __init__(self, most: int = 512, most_bytes: int = 64 << 20):
        self.most, self.most_bytes, self.held, self.size = most, most_bytes, OrderedDict(), 0

    def __reduce__(self):
        return Opened, (self.most, self.most_bytes)

    def get(self, uri: str, read):
        """``read`` of the file's bytes, kept while there is room."""
        if uri in self.held:
            self.held.move_to_end(uri)
            return self.held[uri][0]
        data = map_file(uri)
        size = 0 if isinstance(data, np.memmap) else len(data)
        self.held[uri] = read(data), size
        self.size += size
        while len(self.held) > 1 and (len(self.held) > self.most or self.size > self.most_bytes):
            self.size -= self.held.popitem(last=False)[1][1]
        return self.held[uri][0]


# ---- Arrow ---------------------------------------------------------------------------------


class _Task:
    """A task's work on Arrow batches; what it allocated goes back to the system, since workers stay for later tasks."""

    def __init__(self, work):
        self.work = work

    def __call__(self, batches):
        try:
            yield from self.work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)


def in_arrow(df: DataFrame, work, schema) -> DataFrame:
    """``mapInArrow`` in batches of bounded bytes, however long the rows are."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(_Task(work), schema)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if column.null_count or column.offset:
        column = pa.concat_arrays([column])
    n, (_, offsets, data) = len(column), column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, 8 * column.offset) if offsets else np.zeros(n + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in pieces of about ``most`` bytes of text: the rows, their bytes, their offsets."""
    for batch in batches:
        data, offsets = texts_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def strings_of(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


# ---- hashes --------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


#: The field of the range hashes is that of the prime 2**61 - 1, and these are the points at which texts are evaluated as polynomials.
PRIME = (1 << 61) - 1
POINTS = (0x0F3C6EF372FE94F8, 0x15A54FF53A5F1D36)
_P, _29, _31, _32, _61 = (np.uint64(x) for x in (PRIME, 29, 31, 32, 61))
_LOW29, _LOW30, _LOW31, _LOW32 = (np.uint64((1 << n) - 1) for n in (29, 30, 31, 32))
#: Bytes whose sums of products stay below 2**64.
_STEP = 1 << 22


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products in the field, by halves of 30 and 31 bits."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & _LOW30) << _31) + a0 * b0)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` in the field, at least."""
    known = _POWERS.get(base, np.ones(1, np.uint64))
    while len(known) < n:
        known = np.concatenate([known, times(known, np.full(1, pow(base, len(known), PRIME), np.uint64))])
    _POWERS[base] = known
    return known


class RangeHash:
    """64-bit hashes of any byte ranges of a buffer, equal for equal bytes wherever they stand.

    A range is a polynomial whose coefficients are its bytes, evaluated at a
    point of the field of 2**61 - 1; unlike ranges of n bytes agree at n of
    2**61 points at most, whatever their structure.  ``which`` is one of two
    independent points.
    """

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data)
        power, self.back = powers(POINTS[which], n + 1), powers(pow(POINTS[which], -1, PRIME), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        for at in range(0, n, _STEP):
            part = data[at : at + _STEP].astype(np.uint64) + np.uint64(1)
            weight = power[at : at + len(part)]
            low, high = np.cumsum(part * (weight & _LOW32)), np.cumsum(part * (weight >> _32))
            self.sums[at + 1 : at + 1 + len(part)] = _reduced(((high & _LOW29) << _32) + (high >> _29) + low + self.sums[at])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        span = times(_reduced(self.sums[end] + _P - self.sums[start]), self.back[start])
        return mix((span << np.uint64(3)) | ((end - start).astype(np.uint64) & np.uint64(7)))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross rows: starts, ends, and for each row the number of runs before it."""
    n = len(inside)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)

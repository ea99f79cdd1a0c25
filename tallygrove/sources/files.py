"""Arrays in files of the folder that all executors share: tasks write them whole or not at all, any task maps them."""

from __future__ import annotations

import json
import os
import uuid
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import SparkSession


def mounted(spark: SparkSession, uri: str) -> str | None:
    """The path of a folder that is mounted on every machine, else None. One without a scheme belongs to the default file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = urlparse(store.makeQualified(path).toString())
    return parts.path if parts.scheme == "file" else None


def put(path: str, **arrays: np.ndarray) -> None:
    """Write the arrays at once: a retried task replaces the file by equal bytes."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    arrays = {k: np.ascontiguousarray(v) for k, v in arrays.items()}
    head = json.dumps({k: [v.dtype.str, v.shape] for k, v in arrays.items()}).encode()
    with open(temp := f"{path}.{uuid.uuid4().hex}", "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for v in arrays.values():
            f.write(bytes(-f.tell() % 64))
            f.write(v.data)
    os.replace(temp, path)


def opened(path: str) -> dict[str, np.ndarray]:
    data = np.memmap(path, np.uint8, "r")
    at = 8 + int.from_bytes(data[:8].tobytes(), "little")
    out = {}
    for name, (kind, shape) in json.loads(data[8:at].tobytes()).items():
        at += -at % 64
        size = int(np.prod(shape, dtype=np.int64)) * np.dtype(kind).itemsize
        out[name] = np.asarray(data[at : at + size]).view(kind).reshape(shape)
        at += size
    return out


class Files:
    """The files that a task has open: the last used ones."""

    def __init__(self, folder: str, most: int = 512):
        self.folder, self.most, self.held = folder, most, OrderedDict()

    def get(self, name: str) -> dict[str, np.ndarray]:
        if name in self.held:
            self.held.move_to_end(name)
        else:
            self.held[name] = opened(f"{self.folder}/{name}")
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        return self.held[name]

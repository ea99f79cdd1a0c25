"""Work tables: what rounds of an iteration write and read again.

They lie in the folder of ``spark.checkpoint.dir``, which all executors share;
only a local session without one gets a folder of its own.  A written table
cuts the lineage, so a lost executor costs a round and not all of them.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}

#: Rows that a task of a dealt table takes.
TASK_ROWS = 1 << 18


def dealt(df: DataFrame, rows: int, *keys) -> DataFrame:
    """A table of so many rows, shuffled by keys to tasks whose number grows with it, and is the session's at least."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), *keys)


def root(spark: SparkSession) -> str:
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN.setdefault("root", "file://" + tempfile.mkdtemp(prefix="tallygrove-"))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone at exit
        pass


def _forget(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:  # the session may be gone at exit
        pass


class Work:
    """The tables of one iteration. With ``rolling`` the table before the last of a name goes when one more is kept."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, f"{root(spark)}/tallygrove-work/{name}-{uuid.uuid4().hex}", {}
        atexit.register(_remove, spark, self.folder)

    def keep(self, df: DataFrame, name: str, rolling: bool = False) -> DataFrame:
        known = self.paths.setdefault(name, [])
        known.append(f"{self.folder}/{name}-{len(known)}")
        df.write.parquet(known[-1])
        if rolling and len(known) > 2:
            _remove(self.spark, known[-3])
        self._release()
        return self.spark.read.schema(df.schema).parquet(known[-1])

    def append(self, df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
        """The table of that name with these rows too, in buckets by a key, so what goes by the key needs no shuffle."""
        table = f"{name}_{self.folder.rsplit('-', 1)[1]}"
        if name not in self.paths:
            atexit.register(_forget, self.spark, table)
        self.paths[name] = [f"{self.folder}/{name}"]
        df.write.format("parquet").mode("append").option("path", self.paths[name][0]).bucketBy(buckets, key).saveAsTable(table)
        self._release()
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more."""
        for name in names:
            for path in self.paths.get(name, []):
                _remove(self.spark, path)

    def place(self, name: str) -> str:
        """A new folder for files of that name."""
        known = self.paths.setdefault(name, [])
        known.append(f"{self.folder}/{name}-{len(known)}")
        return known[-1]

    def clear(self, path: str) -> None:
        """Removes a folder of files, and shuffle files of finished jobs."""
        _remove(self.spark, path)
        self._release()

    def _release(self) -> None:
        """Spark removes shuffle files of finished jobs when the driver's JVM collects their plans, which may not come about in a short run."""
        self.spark.sparkContext._jvm.System.gc()

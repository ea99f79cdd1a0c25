"""Named stages that each leave a table; a run goes on where the last one stopped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import read_or_none

#: The levels of the research-front analysis, in order.
LEVELS = ("windows", "metadata", "citations", "structural", "semantic", "topological", "agreement", "tracking", "labels")


def forced(force_from: str | None, level: str, levels: tuple[str, ...] = LEVELS) -> bool:
    """Whether a level is computed anew: it, or one before it, is forced."""
    if force_from is None:
        return False
    if force_from not in levels:
        raise ValueError(f"unknown level {force_from!r}; known: {', '.join(levels)}")
    return levels.index(level) >= levels.index(force_from)


@dataclass
class Run:
    """Tables of one analysis under ``root``; a level is read if it is there and not forced, else computed and written.

    Spark writes a table's ``_SUCCESS`` mark last, so a run that was cut off
    leaves no table that counts as complete.
    """

    spark: SparkSession
    root: str
    force_from: str | None = None
    levels: tuple[str, ...] = LEVELS
    computed: list[str] = field(default_factory=list)

    def _complete(self, level: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{level}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def level(self, name: str, compute: Callable[[], DataFrame]) -> DataFrame:
        if forced(self.force_from, name, self.levels) or not self._complete(name):
            compute().write.mode("overwrite").parquet(f"{self.root}/{name}")
            self.computed.append(name)
        return self.spark.read.parquet(f"{self.root}/{name}")

    def status(self) -> dict[str, int | None]:
        """Rows of each level, None for one that isn't there."""
        out = {}
        for name in self.levels:
            df = read_or_none(self.spark, f"{self.root}/{name}") if self._complete(name) else None
            out[name] = None if df is None else df.count()
        return out

"""A lineage table as a log: every append is a small delta, every so many of them become a snapshot, and a read opens the newest
snapshot and the deltas after it, however many appends there were.

Folders below the root are delta=<number> and snapshot=<number>; one counts once its success file is there. An append takes the next
number and fails if another writer took it first; what a crashed append left behind keeps its number and is not read. A snapshot holds the latest row of each key among all deltas up to its number, so
deltas and snapshots before it are history that no read opens (see vacuum).
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators.aggregates import upsert


class LineageLog:
    """The log below a root; keys name a row, of equal keys the greatest stamp counts."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], stamp: str = "created_at", every: int = 16):
        self.spark, self.root, self.keys, self.stamp, self.every = spark, root.rstrip("/"), keys, stamp, every

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path, jvm.org.apache.hadoop.fs.Path

    def _numbers(self, kind: str, whole: bool = True) -> list[int]:
        """Numbers of the deltas or snapshots, in order: of whole ones, or of all that were begun."""
        fs, _, path = self._fs()
        found = fs.globStatus(path(f"{self.root}/{kind}=*" + ("/_SUCCESS" if whole else ""))) or []
        return sorted(int(re.search(rf"{kind}=(\d+)", f.getPath().toString())[1]) for f in found)

    def files(self) -> list[str]:
        """The folders that a read opens."""
        last = max(self._numbers("snapshot"), default=0)
        return ([f"{self.root}/snapshot={last:012d}"] if last else []) + [f"{self.root}/delta={n:012d}" for n in self._numbers("delta") if n > last]

    def read(self) -> DataFrame | None:
        """The present state, the latest row of each key; None before the first append. Columns of a later append are null before it."""
        state = None
        for folder in self.files():
            rows = self.spark.read.parquet(folder)
            state = rows if state is None else state.unionByName(rows, allowMissingColumns=True)
        return None if state is None else upsert(state, state.limit(0), self.keys, self.stamp)

    def append(self, rows: DataFrame) -> int:
        """Add rows as the next delta, whose number is returned; a snapshot follows when it is due."""
        number = max(self._numbers("delta", whole=False), default=0) + 1
        try:
            rows.write.mode("errorifexists").parquet(f"{self.root}/delta={number:012d}")
        except AnalysisException as e:
            raise FileExistsError(f"another writer has taken number {number}") from e
        if number - max(self._numbers("snapshot"), default=0) >= self.every:
            self.compact()
        return number

    def compact(self) -> None:
        """Write the present state as a snapshot; a crash on the way leaves the log as it was."""
        number, state = max(self._numbers("delta"), default=0), self.read()
        if state is not None and number not in self._numbers("snapshot"):
            state.write.mode("overwrite").parquet(f"{self.root}/snapshot={number:012d}")

    def vacuum(self) -> int:
        """Delete the deltas and snapshots that no read opens; gives their number. Readers that listed them before may still want them."""
        fs, _, path = self._fs()
        last, gone = max(self._numbers("snapshot"), default=0), 0
        for kind, least in (("delta", last + 1), ("snapshot", last)):
            for n in self._numbers(kind):
                if n < least and n != max(self._numbers("delta"), default=0):
                    gone += bool(fs.delete(path(f"{self.root}/{kind}={n:012d}"), True))
        return gone

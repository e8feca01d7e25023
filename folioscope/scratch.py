"""Intermediate tables with a lifetime: written once, read by later plans, deleted when no plan can read them any more.

Every table written for a session belongs to its :class:`Scratch`. Readers are not declared: a plan that reads a table
holds the table's file index, so the JVM's reachability of that index counts the readers, through any number of
derived DataFrames. Once the last of them is gone, the next sweep deletes the files. Sweeps come with every write and
at the start of every query; a write also collects garbage when the tables have doubled since the last time, so they
never hold much more than twice what is still readable, and when the driver's heap has grown past half of its limit: most
of it is plans of finished steps, and the JVM gives memory back only where it is asked to collect. ``release`` deletes a table whose last reader has
just been written, without waiting for that, and what is left goes when the Python process ends.
"""

from __future__ import annotations

import atexit
import gc
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Tables below this size never cause a garbage collection by themselves.
QUIET_BYTES = 64 << 20
#: Many small tables are collected every so many writes, which keeps the plans on the driver few as well.
COLLECT_EVERY = 8


@dataclass
class _Table:
    path: str
    #: JVM WeakReference to the file index that every reading plan holds.
    readers: object
    size: int


class Scratch:
    """The tables of one Spark application below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._jvm, self._hadoop = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = f"{folder}/folioscope/{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
        self.tables: dict[str, _Table] = {}
        self._collect_at, self._writes = QUIET_BYTES, 0

    def write(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` from a table of its own."""
        gc.collect()  # so that the JVM hears of what is unused while the table is written
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        table = df.sparkSession.read.schema(df.schema).parquet(path)
        index = _file_index(table)
        size = self._store(path, lambda fs, p: fs.getContentSummary(p).getLength())
        self.tables[path] = _Table(path, self._jvm.java.lang.ref.WeakReference(index), size)
        del index
        self._writes += 1
        self.sweep(collect=self.held > self._collect_at or self._writes % COLLECT_EVERY == 0 or self._crowded())
        return table

    @property
    def held(self) -> int:
        return sum(t.size for t in self.tables.values())

    def sweep(self, collect: bool = False, wait: float = 0.0) -> int:
        """Delete the tables that no plan can read any more; returns how many.

        ``collect`` finds those that only garbage still refers to. Python tells the JVM in the background, about once
        a second, which objects it has let go; ``wait`` seconds are given to that.
        """
        if collect and self.tables:
            gc.collect()
            time.sleep(wait)
            self._jvm.System.gc()
        dead = [t.path for t in self.tables.values() if t.readers.get() is None]
        for path in dead:
            self._drop(path)
        if collect:
            self._collect_at = max(QUIET_BYTES, 2 * self.held)
        return len(dead)

    def release(self, *tables: DataFrame) -> None:
        """Delete tables at once: the caller has written the last result that reads them."""
        for table in tables:
            for root in _file_index(table).rootPaths().mkString("\n").split("\n"):
                for path in [p for p in self.tables if root.rstrip("/").endswith(p.split(":", 1)[-1].lstrip("/"))]:
                    self._drop(path)

    @contextmanager
    def folder(self) -> Iterator[str]:
        """A folder for files that a sink writes and a source reads before the block ends."""
        path = f"{self.root}/files-{uuid.uuid4().hex}"
        try:
            yield path
        finally:
            self._store(path, lambda fs, p: fs.delete(p, True))

    @contextmanager
    def closing(self) -> Iterator[Scratch]:
        """Whatever is written inside goes at the end, read or not: results must have been written elsewhere."""
        before = set(self.tables)
        try:
            yield self
        finally:
            for path in set(self.tables) - before:
                self._drop(path)

    def close(self) -> None:
        """Delete everything; best effort, as the application may be gone already."""
        try:
            self._store(self.root, lambda fs, p: fs.delete(p, True))
        except Exception:  # noqa: BLE001  nothing is left to report to at the end of the process
            pass
        self.tables.clear()

    def _crowded(self) -> bool:
        heap = self._jvm.java.lang.Runtime.getRuntime()
        return 2 * heap.totalMemory() > heap.maxMemory()

    def _drop(self, path: str) -> None:
        del self.tables[path]
        self._store(path, lambda fs, p: fs.delete(p, True))

    def _store(self, path: str, act: Callable) -> int:
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return act(p.getFileSystem(self._hadoop), p)


def _file_index(table: DataFrame) -> object:
    """The file index of a table as read, which plans on it share."""
    return table._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()


_open: dict[tuple[str, str], Scratch] = {}


def scratch(spark: SparkSession, folder: str) -> Scratch:
    """The application's tables below ``folder``."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _open:
        for stale in [k for k in _open if k[0] != key[0]]:  # of an application that has been stopped
            del _open[stale]
        _open[key] = Scratch(spark, folder)
        atexit.register(_open[key].close)
    return _open[key]

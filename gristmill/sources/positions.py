"""Positions of rows in a folder of Parquet files: the files' order, the row counts of their footers, and each row's place in its file.

A source that has no position column needs no sort to get one, and a scan that ends at a position opens no file beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sorted_files(spark: SparkSession, path: str, ending: str = ".parquet") -> list[str]:
    """The files of a folder by name, or the file that ``path`` is; hidden ones and folders are left out. The listing is Hadoop's, so any store does."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getFileStatus(target).isFile():
        return [path]
    found = [s.getPath() for s in system.listStatus(target) if s.isFile()]
    return [str(p.toString()) for p in sorted(found, key=lambda p: p.getName()) if p.getName().endswith(ending) and p.getName()[0] not in "._"]


class OrderedFiles:
    """A folder of Parquet files as one sequence of rows. Footers are read as far as positions are asked for, twice as many files each time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, sorted_files(spark, path)
        of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.names = [of(f).toUri().getRawPath().rsplit("/", 1)[-1] for f in self.files]  # as Spark's metadata has them, escaped
        self.starts = [0]  # of each file whose predecessors are counted

    @property
    def counted(self) -> int:
        return len(self.starts) - 1

    def _name(self) -> Column:
        return F.col("_metadata.file_name")

    def _count(self, stop: int) -> None:
        """One job that reads no column, which takes the footers alone; the driver gets a number for each file."""
        some = slice(self.counted, stop)
        rows = {r["name"]: r["n"] for r in self.spark.read.parquet(*self.files[some]).groupBy(self._name().alias("name")).agg(F.count("*").alias("n")).collect()}
        for name in self.names[some]:
            self.starts.append(self.starts[-1] + rows.get(name, 0))

    def _reach(self, position: int | None) -> None:
        while self.counted < len(self.files) and (position is None or self.starts[-1] < position):
            self._count(min(len(self.files), 2 * self.counted + 1))

    def rows(self, files: range) -> DataFrame:
        """Rows of some files, with ``pos``. The files' starts are a table of as many rows as files."""
        some = [self.files[k] for k in files]
        read = self.spark.read.parquet(*(some or self.files[:1]))
        starts = self.spark.createDataFrame([(self.names[k], self.starts[k]) for k in files], "__file string, __start long")
        placed = read.select("*", self._name().alias("__file"), F.col("_metadata.row_index").alias("__row")).join(F.broadcast(starts), "__file")
        return placed.withColumn("pos", F.col("__start") + F.col("__row")).drop("__file", "__start", "__row")

    def first(self, n: int) -> DataFrame:
        """The first ``n`` rows, by ``pos``: files after the one that holds the last of them are never opened."""
        self._reach(max(n, 1))
        need = sum(start < n for start in self.starts[: self.counted])
        return self.rows(range(need)).where(F.col("pos") < n)

    def after(self, n: int) -> DataFrame:
        """All rows from position ``n`` on; files before are opened for their footers only."""
        self._reach(None)
        begin = sum(stop <= n for stop in self.starts[1:])
        return self.rows(range(min(begin, len(self.files)), len(self.files))).where(F.col("pos") >= n)

    def until(self, n: int, amount: Column, target: float) -> DataFrame:
        """Rows from position ``n`` on, of as few files as hold ``target`` of ``amount`` (a sum) between them, or of all: more files are looked at, twice as many
        each time, until they do."""
        self._reach(n + 1)
        begin = sum(stop <= n for stop in self.starts[1:])
        end, have, step = begin, 0.0, 1
        while have < target and end < len(self.files):
            stop = min(len(self.files), end + step)
            if self.counted < stop:
                self._count(stop)
            part = self.rows(range(end, stop)).where(F.col("pos") >= n)
            have += part.agg(F.sum(amount)).first()[0] or 0.0
            end, step = stop, step * 2
        return self.rows(range(begin, end)).where(F.col("pos") >= n)


def batches(files: OrderedFiles, size: int) -> Iterator[DataFrame]:
    """The sequence in pieces of ``size`` rows, for callers that stop when they have enough; each piece opens its own files only."""
    at = 0
    while True:
        files._reach(at + size)
        if at >= files.starts[-1]:
            return
        own = [k for k in range(files.counted) if files.starts[k] < at + size and files.starts[k + 1] > at]
        yield files.rows(range(own[0], own[-1] + 1)).where((F.col("pos") >= at) & (F.col("pos") < at + size))
        at += size

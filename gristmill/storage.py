"""The shared folder, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: rows go to Python in batches of so many bytes (the default takes several times that outside the heap where
#: texts are long), and the shuffle files of a write go when it ends, as what it wrote takes their place.
WHILE_WRITING = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves if the executors are threads of this process; on a cluster that is an error, as each
    executor would write to its own disk.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gristmill-"))
        path = context.getCheckpointDir()
    return path.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Sets what the session has not set itself, and puts it back."""
    before = {k: spark.conf.get(k, None) for k in values}
    defaults = {"spark.sql.execution.arrow.maxBytesPerBatch": "67108864b"}
    ours = {k: v for k, v in values.items() if before[k] in (None, "false", defaults.get(k))}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in ours:
            if before[k] is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, before[k])


class Workspace:
    """Tables written to the shared folder to cut lineage; a lost executor loses none of them.

    ``drop`` deletes a table once a later one has been written from it; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is not None:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def _end(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the JVM may be gone by then
            return

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
        """Writes a table and reads it again. A ``narrow`` one (a few numbers a row, where texts set the partitions) is put in a quarter as many
        files, which spares as many small ones."""
        if narrow:
            df = df.coalesce(max(8, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 4))
        with settings(self.spark, WHILE_WRITING):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

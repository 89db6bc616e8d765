"""Tables written to the folder that the cluster shares, used to cut lineage; and the size of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Only where it is unset and executors are threads of the driver is a temporary folder set here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quadloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Rows and bytes at which an Arrow batch ends; a row that is larger is a batch of its own.
ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers, whatever the size of documents. Spark reads these settings from the session; smaller values that it has are left."""
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(key).rstrip("b") or 0)
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


#: Tasks for each core where rows are dealt out by a number of tasks, which Spark does not lower.
TASKS_PER_CORE = 4


def many_tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


class Scratch:
    """A folder of intermediate Parquet tables. A task that is lost is computed again from them.

    Results read these tables lazily, so they stay until the application ends, when the folder is
    deleted; steps that have been read can be dropped before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/quadloom-{name}-{uuid.uuid4().hex}"
        path, files = self._files("")
        files.deleteOnExit(path)

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        for name in names:
            path, files = self._files(name)
            files.delete(path, True)

"""Tables that cut lineage, written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset and the master is local (tests, a laptop), a temporary folder is made and
    set; on a cluster an unset folder is an error, since a machine-local one would be lost with
    its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="evidenta-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, step: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{step}"

    def save(self, frame: DataFrame, step: str = "table", codec: str = "snappy") -> DataFrame:
        """Write a frame as Parquet and read it back."""
        path = self.path(step)
        frame.write.option("compression", codec).parquet(path)
        saved = self.spark.read.schema(frame.schema).parquet(path)
        saved.scratch_path = path
        return saved

    def drop(self, frame_or_path) -> None:
        """Delete a table that no later step reads."""
        text = getattr(frame_or_path, "scratch_path", frame_or_path)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def tidy(self) -> None:
        """Let Spark delete the shuffle files of finished steps now: its cleaner follows the driver's garbage collection."""
        self.spark._jvm.System.gc()

"""What every job asks of the session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def workers_find(spark: SparkSession) -> SparkSession:
    """Python workers find the library where the driver found it; where they don't share its disk, the package must be installed."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share, set as the place of checkpoints.

    Only a session in one process, which shares its disk with itself, may do without: it gets a new local folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def no_rows(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """An empty table, made without Python workers."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])


def written(frame: DataFrame) -> DataFrame:
    """The same rows, computed once: written as Parquet to the shared folder and read from there. A lost executor loses nothing, and Spark knows the table's real size."""
    path = f"{shared_folder(frame.sparkSession)}/written-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


class Folder:
    """Files under one folder, by the file system that Spark uses for it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):  # noqa: ANN202
        return self.path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def names(self, name: str) -> list[str]:
        """What is in a folder; nothing, if there is none."""
        return [x.getPath().getName() for x in self.fs.listStatus(self._at(name))] if self.exists(name) else []

    def buckets(self, name: str) -> list[int]:
        """The buckets that a table written by its column `bucket` has rows in."""
        return [int(x.partition("=")[2]) for x in self.names(name) if x.startswith("bucket=")]

    def mark(self, name: str) -> None:
        self.fs.create(self._at(name), True).close()

    def put(self, name: str, text: str) -> None:
        """A small file, which is there whole or not at all: it is written under another name and renamed."""
        part = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self._at(part), True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(self._at(part), self._at(name)):
            raise FileExistsError(f"{self.root}/{name}")

    def text(self, name: str) -> str:
        source = self.fs.open(self._at(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

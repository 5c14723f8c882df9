"""Intermediate tables that outlive executors.

``Stash`` writes a DataFrame as Parquet under the shared folder that the session
names in ``spark.checkpoint.dir`` and hands back a reader of those files.  That
cuts lineage the way ``checkpoint()`` does, but compressed and column-pruned.
Only a local session without that setting gets a temporary folder of its own.

What a lazy result still reads stays in the folder, as checkpoints do; ``stage`` deletes
the tables of a computation whose result has been written.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


ARROW_BYTES = "8m"
_ARROW, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a fresh temporary one in a local session without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="inkstream-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Stash:
    """Written intermediate tables of one operator run.

    The session's Arrow batches, where it has not set their bytes itself, get ``ARROW_BYTES``
    at most: rows here are whole texts and sets, and a batch is held by the JVM and by the
    Python worker at once.
    """

    #: Stashes of the stages that are open, innermost last.
    _stages: list[list[Stash]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        if self._stages:
            self._stages[-1].append(self)
        if spark.conf.get(_ARROW, None) == _ARROW_DEFAULT:
            spark.conf.set(_ARROW, ARROW_BYTES)
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def folder(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a reader of what was written."""
        path = self.folder(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stash_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            delete(self.spark, t._stash_path)

    def release(self) -> None:
        """Let Spark's cleaner remove shuffle files of stages whose results are already written."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)  # the cleaner works beside us


@contextmanager
def stage():
    """Deletes the tables of all stashes made inside, once what was computed from them is written."""
    made: list[Stash] = []
    Stash._stages.append(made)
    try:
        yield
    finally:
        Stash._stages.remove(made)
        for s in made:
            delete(s.spark, s.root)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

"""Intermediate tables in the cluster's shared folder.

Spark may lose executors at any time, so lineage is cut by writing Parquet to
the folder named by ``spark.checkpoint.dir`` and never by a local checkpoint.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: While an operator runs: texts may be long, so batches to Python have few bytes, and shuffle files go once a table is written.
_WHILE = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: While a small table is written: rows of many tasks go to files of the advisory size, for a local file system starts processes for each file.
_FEW = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one is made only in local mode, where one machine is the cluster."""
    found = spark.conf.get(_KEY, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="marlstone-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set(_KEY, f"file://{made}")
    return f"file://{made}"


class Scratch:
    """Tables written by one operator run, and what it broadcasts.

    ``drop`` deletes all tables but those named, destroys the broadcasts and
    gives the session back its settings.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.before = self._set(_WHILE)
        self.root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.sent: list = []

    def _set(self, values: dict[str, str]) -> dict[str, str]:
        """Settings of the session, and what they were."""
        before = {k: self.spark.conf.get(k) for k in values}
        for k, v in values.items():
            self.spark.conf.set(k, v)
        return before

    def send(self, value):
        """A broadcast that is only read until ``drop``."""
        self.sent.append(self.spark.sparkContext.broadcast(value))
        return self.sent[-1]

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the written table."""
        path = f"{self.root}/{name}"
        before = self._set(_WHILE)
        df.write.mode("overwrite").parquet(path)
        self._set(before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_few(self, df: DataFrame, name: str) -> DataFrame:
        """As ``keep``, in few files where partitions are small."""
        before = self._set(_FEW)
        out = self.keep(df, name)
        self._set(before)
        return out

    def drop(self, *keep: str) -> None:
        sc = self.spark.sparkContext
        jvm = sc._jvm
        for name, path in list(self.paths.items()):
            if name not in keep:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
                del self.paths[name]
        for value in self.sent:
            value.destroy()
        self.sent.clear()
        self._set(self.before)

"""Sinks: idempotent, batch-atomic writes of parquet tables.

A table is a folder of numbered versions; a writer adds the next version and
then points to it, so readers see a batch whole or not at all.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import relational as op


class VersionedTable:
    """A parquet table whose versions are written whole and then pointed to, on any file system Spark can reach."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest committed version, 0 for none."""
        jvm, fs = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_commits")
        if not fs.exists(at):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()), default=0)

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={v}") if v else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """Commit ``df`` as the next version; a commit that another writer made first fails."""
        v = self.version() + 1
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/v={v}")
        jvm, fs = self._fs()
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_commits"))
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_commits/{v}"), False)
        out.write(bytearray(json.dumps({"version": v}).encode()))
        out.close()
        return v

    def insert_new(self, new: DataFrame, keys: list[str]) -> int:
        old = self.read()
        return self.write(old.unionByName(op.insert_new(old, new, keys)))

    def upsert(self, new: DataFrame, keys: list[str], rules: dict[str, str] | None = None) -> int:
        return self.write(op.upsert(self.read(), new, keys, rules))

    def delete(self, keys: DataFrame, on: list[str]) -> int:
        return self.write(self.read().join(keys, on, "left_anti"))


def ingest(spark: SparkSession, documents: VersionedTable, chunks: VersionedTable, batch: DataFrame, chunked: DataFrame) -> tuple[int, int]:
    """Documents of a batch that are new by ``source_path``, and their chunks.

    Chunks are committed first: a document that readers can see has its chunks,
    and a batch that broke off is written again whole by its next run.
    """
    known = documents.read()
    fresh = op.insert_new(known, batch, ["source_path"]).select(*batch.columns)
    new_chunks = chunked.join(fresh.select("source_path"), "source_path", "left_semi")
    return chunks.insert_new(new_chunks, ["chunk_id"]), documents.write(known.unionByName(fresh))


def blob_path(content: Column, prefix: str = "") -> Column:
    """The content-addressed place of a blob: prefix/aa/bb/hash."""
    h = F.sha2(content, 256)
    return F.concat(F.lit(prefix.rstrip("/") + "/" if prefix else ""), F.substring(h, 1, 2), F.lit("/"), F.substring(h, 3, 2), F.lit("/"), h)


def remember(memory: DataFrame, new: DataFrame) -> DataFrame:
    """Key-value memory after new entries (agent, key, value, at): the newest value of each key; values that are no JSON are wrapped."""
    wrapped = new.withColumn("value", F.when(F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(F.to_json(F.struct(F.col("value").alias("text")))))
    return op.latest(memory.unionByName(wrapped.select(*memory.columns)), ["agent", "key"], "at", F.asc("value"))

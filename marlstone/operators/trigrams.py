"""Substring search without a scan: postings of trigrams, the rarest first, and a look at the texts that are left.

A text's trigrams are those of its lower-case characters.  A search reads the
postings of the rarest trigrams of its pattern, keeps the texts that hold them
all, and tries the pattern on these alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.index import shared_folder

#: Trigrams whose postings are met: more of them leave fewer texts to try, but read more.
MET = 4


def codes(text: str) -> np.ndarray:
    """Distinct trigrams, three code points of 21 bits each."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) if len(c) > 2 else np.zeros(0, np.int64)


def literals(pattern: str) -> list[str]:
    """Runs of a LIKE pattern between its wildcards; a backslash takes a wildcard's meaning away."""
    parts = re.findall(r"\\(.)|([%_])|([^\\%_])", pattern, re.S)
    out = [""]
    for escaped, wild, plain in parts:
        if wild:
            out.append("")
        else:
            out[-1] += escaped or plain
    return [x for x in out if x]


class TrigramIndex:
    def __init__(self, spark: SparkSession, path: str, texts: DataFrame, id_col: str, text: str) -> None:
        self.spark, self.path, self.texts, self.id, self.text = spark, path, texts, id_col, text

    @classmethod
    def build(cls, texts: DataFrame, id_col: str, text: str, path: str | None = None) -> TrigramIndex:
        """Write the postings of ``texts`` (a long id, a text); rows with a null id are found by a scan only and are left out."""
        import uuid

        spark = texts.sparkSession
        path = path or f"{shared_folder(spark)}/trigrams-{uuid.uuid4().hex}"

        def grams(batches):
            for b in batches:
                for at in range(0, len(b), 256):
                    part = b.slice(at, 256)
                    found = [codes(t or "") for t in part.column(1).to_pylist()]
                    n = np.array([len(f) for f in found], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found])), part.column(0).take(pa.array(np.repeat(np.arange(len(part)), n)))], ["gram", "id"])

        plain = texts.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(text)).alias("t"))
        raw = f"{path}/_raw"
        plain.mapInArrow(grams, "gram long, id long").write.parquet(raw)
        read = spark.read.parquet(raw)
        # A trigram that very many texts hold fills several files.
        read.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.option("parquet.block.size", 4 << 20).parquet(f"{path}/postings")
        spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(raw)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return cls(spark, path, texts, id_col, text)

    def candidates(self, pattern: str) -> DataFrame | None:
        """Ids of texts that hold the rarest trigrams of a LIKE pattern; None if it has no run of three characters."""
        wanted = sorted({g for run in literals(pattern) for g in codes(run.lower()).tolist()})
        if not wanted:
            return None
        known = {r["gram"]: r["n"] for r in self.spark.read.parquet(f"{self.path}/counts").where(F.col("gram").isin(*wanted)).collect()}
        if len(known) < len(wanted):
            return self.spark.createDataFrame([], "id long")
        rarest = sorted(wanted, key=lambda g: (known[g], g))[:MET]
        hits = self.spark.read.parquet(f"{self.path}/postings").where(F.col("gram").isin(*rarest))
        return hits.groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rarest)).select("id")

    def search(self, pattern: str) -> DataFrame:
        """Rows whose text is ILIKE the pattern.  Patterns without three characters in a row are tried on every text."""
        found = self.candidates(pattern)
        mine = self.texts if found is None else self.texts.join(found.withColumnRenamed("id", self.id), self.id, "left_semi")
        return mine.where(F.col(self.text).ilike(pattern))

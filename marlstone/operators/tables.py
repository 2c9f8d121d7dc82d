"""Tables that an iterative operator writes to the cluster's shared folder, to cut lineage and to be read many times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators.index import shared_folder


class Written:
    """Tables of one run under a folder of their own; ``drop`` deletes all but those named."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *keep: str) -> None:
        for name in self.names - set(keep):
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        self.names &= set(keep)


def numbered(df: DataFrame, out: Written, name: str, column: str, *order) -> DataFrame:
    """``df`` with places from 1 in a total order, as the long ``column``, without a task that holds all rows.

    Rows are dealt by ranges, sorted where they lie and written with their
    place; one row for each partition meets the others.
    """
    placed = out.keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), name)
    counts = placed.groupBy(F.shiftright("__at", 33).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    # As many rows as there are partitions.
    out_ = placed.withColumn("__p", F.shiftright("__at", 33)).join(F.broadcast(before), "__p")
    return out_.withColumn(column, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__p", "__at", "__before")

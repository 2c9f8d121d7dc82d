"""Numbers in a total order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.store import Scratch


def numbered(df: DataFrame, scratch: Scratch, name: str, column: str, *order) -> DataFrame:
    """``df`` with a count from 1 in the given order, as the long ``column``.

    The rows are dealt by ranges, sorted in each partition and written with
    their place; only one row for each partition meets the others.  Rows that
    are equal in ``order`` are numbered in any order, and may lie in several
    partitions.
    """
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    placed = scratch.keep(dealt.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    # As many rows as there are partitions.
    counts = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    out = placed.withColumn("__p", part).join(F.broadcast(before), "__p")
    return out.withColumn(column, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__p", "__at", "__before")

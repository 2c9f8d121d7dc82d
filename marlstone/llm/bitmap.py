"""A membership filter of fixed size, built by Spark and read by numpy.

One bit per hash value, so answers are "certainly not" or "perhaps".  The
filter has at most ``2**bits`` bits whatever the input, hence it may be
collected and broadcast; as it fills up, fewer rows are spared, none is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import textkit

BITS = 26


def build(df: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Words of the filter over a long column: 2**(bits - 6) values of 64 bits."""
    slot = F.expr(f"shiftrightunsigned({column}, {64 - bits})")
    rows = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.shiftrightunsigned(slot, 6).cast("int").alias("w"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 AS int))")).alias("b"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return out


def has(words: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether each 64-bit value may be in the filter."""
    bits = int(np.log2(len(words))) + 6
    slot = value.view(np.uint64) >> np.uint64(64 - bits)
    return (words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def split(df: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may have a key of ``keys`` (one column), and rows that certainly have none; only the first need a join.

    No row is shuffled here, and rows with a null key are among the second
    unless the filter happens to hold what stands for null.
    """
    import pyarrow as pa

    words = df.sparkSession.sparkContext.broadcast(build(keys.select(F.xxhash64(keys.columns[0]).alias("h")), "h"))
    hashed = df.withColumn("__h", F.xxhash64(column))
    n = len(df.columns)

    def rows(wanted):
        def run(batches):
            for b in batches:
                yield b.filter(pa.array(has(words.value, b.column(n).to_numpy()) == wanted)).select(list(range(n)))

        return run

    return hashed.mapInArrow(textkit.tidy(rows(True)), df.schema), hashed.mapInArrow(textkit.tidy(rows(False)), df.schema)

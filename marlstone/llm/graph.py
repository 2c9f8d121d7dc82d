"""Connected components of an edge table, by large-star and small-star rounds.

Everything stays in DataFrames.  A vertex with very many edges is one row on
the aggregated side of each join, whose other side Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.store import Scratch


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.expr("pmod(xxhash64(v, u), 1000003)")).alias("s")
    ).first()
    return row["n"], row["x"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, tag: str, rounds: int = 50) -> DataFrame:
    """(id, component) for every vertex that is not its component's least id.

    ``edges`` has long columns u and v; loops and repeats are ignored.  The
    number of rounds grows with the logarithm of the longest path; a graph that
    has not settled after ``rounds`` is an error, never a partial answer.
    """
    now = scratch.keep_few(edges.where("u <> v").select("u", "v").distinct(), f"{tag}_0")
    mark = _mark(now)
    for k in range(1, rounds + 1):
        if not mark[0]:
            break
        now = scratch.keep_few(_small_star(_large_star(now)), f"{tag}_{k}")
        was, mark = mark, _mark(now)
        if was == mark:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))

"""Percentiles of long logs: mergeable hourly sketches, and exact values by narrowing a histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.tables import Written

#: Size parameter of a sketch: rank errors of about 1 %, at most 2 % for nearly all sketches.
K = 350
#: Bins of a round, and values of a bin that may be put in order in one task.
BINS, FEW = 1024, 10_000


def hourly(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """One sketch per key and hour, for a table that is appended to: keys, ``hour``, ``n`` and ``sketch``."""
    some = df.where(F.col(value).isNotNull())
    return some.groupBy(*keys, F.date_trunc("hour", F.col(at)).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K)).alias("sketch"))


def from_sketches(sketches: DataFrame, keys: list[str], ranks: list[float]) -> DataFrame:
    """Keys, ``n``, and an array ``values`` of the quantiles: hours are merged, no value is read again."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(K)).alias("s"))
    return merged.select(*keys, "n", F.array(*[F.kll_sketch_get_quantile_double("s", F.lit(float(r))) for r in ranks]).alias("values"))


def exact(df: DataFrame, keys: list[str], value: str, rank: float, few: int = FEW) -> DataFrame:
    """Keys, ``n`` and ``quantile``, the exact interpolated percentile of each key (as percentile_cont).

    Each round counts a key's values in equal bins between two bounds and goes
    on in the bin that holds both wanted places, until it holds ``few`` values
    or a single one; when the places lie in two bins, the answer is between the
    one's largest and the other's smallest.  Counts are added before they are
    shuffled, so no task meets all values of a key.  Nulls and values that are
    not finite are left out.
    """
    out = Written(df.sparkSession)
    match = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    finite = F.abs(F.col(value).cast("double")) < F.lit(float("inf"))
    held = out.keep(df.where(finite).select(*keys, F.col(value).cast("double").alias("__v")), "values")
    state = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    place = (F.col("n") - 1) * F.lit(float(rank))
    # Places from 0 of the two values that are interpolated, how many values lie below the bounds, and the two values once they are known.
    none = F.lit(None).cast("double")
    state = state.withColumns({"p": F.floor(place).cast("long"), "q": F.ceil(place).cast("long"), "below": F.lit(0).cast("long"), "inside": F.col("n"), "x": none, "y": none})
    state = out.keep(state, "s0")
    names, wide_, rounds = state.columns, F.col("x").isNull() & (F.col("inside") > few) & (F.col("lo") < F.col("hi")), 0
    while not (wide := state.where(wide_)).isEmpty():
        mine = held.alias("v").join(wide.alias("s"), match("v", "s")).where("__v BETWEEN lo AND hi")
        bin_ = F.least(F.floor((F.col("__v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS), F.lit(BINS - 1))
        counts = mine.select(*[F.col(f"v.{k}") for k in keys], bin_.alias("bin"), "__v").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("c"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        # At most BINS rows for each key.
        before = F.sum("c").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
        placed = counts.withColumn("before", before).alias("b").join(wide.alias("s"), match("b", "s"))
        start = F.col("below") + F.col("before")
        chosen = placed.where((start <= F.col("q")) & (start + F.col("c") > F.col("p")))
        apart = F.count(F.lit(1)) > 1
        narrowed = chosen.groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], "n", "p", "q", "below").agg(
            F.min("low").alias("lo"), F.max("high").alias("hi"), F.min("before").alias("b"), F.sum("c").alias("inside"), F.when(apart, F.min("high")).alias("x"), F.when(apart, F.max("low")).alias("y")
        )
        rounds += 1
        state = out.keep(state.where(~wide_).unionByName(narrowed.withColumn("below", F.col("below") + F.col("b")).select(*names)), f"s{rounds}")
        out.drop(f"s{rounds}", "values")
    # Equal values are counted before they are put in order.
    last = held.alias("v").join(state.where("x IS NULL").alias("s"), match("v", "s")).where("__v BETWEEN lo AND hi")
    each = last.groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], "n", "p", "q", "below", "__v").agg(F.count(F.lit(1)).alias("c"))
    ended = each.withColumn("upto", F.col("below") + F.sum("c").over(Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda place: F.min(F.when(F.col("upto") > F.col(place), F.col("__v")))
    sorted_ = ended.groupBy(*keys, "n", "p").agg(first("p").alias("x"), first("q").alias("y"))
    part = (F.col("n") - 1) * F.lit(float(rank)) - F.col("p")
    found = sorted_.unionByName(state.where("x IS NOT NULL").select(*keys, "n", "p", "x", "y"))
    result = out.keep(found.select(*keys, "n", (F.col("x") + (F.col("y") - F.col("x")) * part).alias("quantile")), "result")
    out.drop("result")
    return result

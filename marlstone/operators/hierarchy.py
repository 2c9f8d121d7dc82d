"""Deep hierarchies and connected components in a number of rounds that grows with the logarithm of their depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.tables import Written


def roots(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """One row per node: ``node``, ``root``, ``depth`` (steps to the root) and ``cycle``, by pointer doubling.

    Every node knows a node above it and how far that is; each round it jumps to
    what that one knows, so distances double.  After as many rounds as the
    number of nodes has bits, whoever still has a node above it is on a cycle or
    under one: its root and depth are null.  A child has one parent; of several
    the least counts.  A node that is only a parent is a root, and so is one
    whose parent is null.
    """
    spark = edges.sparkSession
    out = Written(spark)
    plain = edges.select(F.col(child).cast("long").alias("node"), F.col(parent).cast("long").alias("up"))
    named = plain.unionByName(plain.select(F.col("up").alias("node"), F.lit(None).cast("long").alias("up"))).where("node IS NOT NULL")
    first = named.groupBy("node").agg(F.min("up").alias("up"))
    state = out.keep(first.select("node", F.coalesce("up", "node").alias("root"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("up").isNotNull().alias("open")), "r0")
    n, rounds = state.count(), 0
    while rounds <= n.bit_length():
        # Only those that have not come to a root jump; those that have are what others read.
        moving = state.where("open")
        if moving.isEmpty():
            break
        above = state.select(F.col("node").alias("root"), F.col("root").alias("to"), F.col("depth").alias("further"), F.col("open").alias("on"))
        moved = moving.join(above, "root").select("node", F.col("to").alias("root"), (F.col("depth") + F.col("further")).alias("depth"), F.col("on").alias("open"))
        rounds += 1
        state = out.keep(state.where("NOT open").unionByName(moved), f"r{rounds}")
        out.drop(f"r{rounds}")
    done = ~F.col("open")
    return state.select("node", F.when(done, F.col("root")).alias("root"), F.when(done, F.col("depth")).alias("depth"), F.col("open").alias("cycle"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component``, its least reachable node, by alternating large and small stars; loops and repeats do not matter."""
    out = Written(edges.sparkSession)
    pair = lambda x, y: F.struct(F.least(x, y).alias("v"), F.greatest(x, y).alias("u"))
    links = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    nodes = links.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    now = out.keep(links.where("x <> y").select(pair(F.col("x"), F.col("y")).alias("p")).select("p.u", "p.v").distinct(), "s0")
    k = 0
    while True:
        # Each node's larger neighbours get its least neighbour.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Each node and its smaller neighbours get the least of them.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        k += 1
        after = out.keep(small, f"s{k}")
        same = now.count() == after.count() and now.exceptAll(after).isEmpty()
        now = after
        out.drop(f"s{k}")
        if same:
            break
    star = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(star, "node", "left").select("node", F.coalesce("component", "node").alias("component"))

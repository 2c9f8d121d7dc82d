"""Change application over batches, with the state of cursors and failures kept in tables.

Each function takes and gives frames; :func:`run` drives them from a stream
with ``foreachBatch``, where the checkpoint is the cursor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import relational as op


def apply_changes(state: DataFrame, changes: DataFrame, key: str, order: str, bootstrap: bool = False) -> DataFrame:
    """The state after a batch of changes with an ``op`` column ("upsert" or "delete").

    The newest change of each key counts.  A delete stamps ``deleted_at`` once
    and keeps the row; deletes are ignored while bootstrapping, and for keys
    that were never seen.
    """
    newest = op.latest(changes, [key], order, F.asc("op"))
    if bootstrap:
        newest = op.latest(changes.where("op <> 'delete'"), [key], order)
    columns = [c for c in state.columns if c not in (key, "deleted_at")]
    s, n = state.alias("s"), newest.alias("n")
    joined = s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full_outer")
    upsert, delete = F.col("n.op") == "upsert", F.col("n.op") == "delete"
    out = [F.coalesce(f"s.{key}", f"n.{key}").alias(key)]
    out += [F.when(upsert, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in columns]
    out.append(F.when(upsert, None).when(delete & F.col("s.deleted_at").isNull(), F.col(f"n.{order}")).otherwise(F.col("s.deleted_at")).alias("deleted_at"))
    return joined.where(F.col(f"s.{key}").isNotNull() | upsert).select(*out)


def after_cursor(feed: DataFrame, page: str, cursor: int | None) -> DataFrame:
    """The pages of a change feed after the last one that was read; all of them without a cursor."""
    return feed if cursor is None else feed.where(F.col(page) > cursor)


def resync(state: DataFrame, listing: DataFrame, key: str, stamp: Column) -> DataFrame:
    """The state after a whole listing, for a cursor that has expired: listed keys are alive, all others are marked deleted once."""
    s, n = state.alias("s"), listing.alias("n")
    there = F.col(f"n.{key}").isNotNull()
    columns = [c for c in state.columns if c not in (key, "deleted_at")]
    out = [F.coalesce(f"n.{key}", f"s.{key}").alias(key), *[F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in columns]]
    return s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full_outer").select(*out, F.when(~there, F.coalesce("s.deleted_at", stamp)).alias("deleted_at"))


def advance_cursor(cursors: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Cursors after a batch: a new position wins, a failed batch (null position) keeps the old one, counters add up."""
    return op.upsert(cursors, batch, keys, {"messages_seen": "add", "removals": "add"})


def gated(messages: DataFrame, rules: DataFrame, mailbox: str, address: str, most: int = 10_000) -> DataFrame:
    """Messages that their mailbox's strategy lets in: all, none, or those whose address or ``*.domain`` is listed.

    The rules are configuration; their number is checked before they are broadcast.
    """
    if rules.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rules")
    strategy = F.broadcast(rules.groupBy(mailbox).agg(F.first("strategy").alias("strategy"), F.collect_set(F.lower("pattern")).alias("patterns")))
    a = F.lower(F.col(address))
    domain = F.substring_index(a, "@", -1)
    listed = F.array_contains("patterns", a) | F.exists("patterns", lambda p: p.startswith("*.") & (domain.endswith(F.substring(p, 2, 1000)) | (domain == F.substring(p, 3, 1000))))
    m = messages.join(strategy, mailbox, "left")
    return m.where((F.coalesce("strategy", F.lit("full")) == "full") | ((F.col("strategy") == "filtered") & listed)).drop("strategy", "patterns")


def changed_only(items: DataFrame, snapshot: DataFrame, key: str, tag: str) -> DataFrame:
    """Items that are new or whose tag differs from the snapshot's."""
    old = snapshot.select(F.col(key), F.col(tag).alias("__old"))
    return items.join(old, key, "left").where(~F.col(tag).eqNullSafe(F.col("__old"))).drop("__old")


def retryable(items: DataFrame, failures: DataFrame, key: str, attempts: int = 3) -> DataFrame:
    """Items without a permanent failure and under ``attempts`` failed tries."""
    bad = failures.groupBy(key).agg(F.bool_or("permanent").alias("p"), F.sum("attempts").alias("n")).where(F.col("p") | (F.col("n") >= attempts))
    return items.join(bad, key, "left_anti")


def run(spark: SparkSession, source: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Drive ``step(batch, number)`` from a stream; the checkpoint holds the position, a failed batch is tried again."""
    writer = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def watch_folder(spark: SparkSession, folder: str, schema: str, archive: str | None = None, fmt: str = "json") -> DataFrame:
    """New files of a folder as a stream; finished ones are archived."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", 1000)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder)


def deduplicated(stream: DataFrame, key: str, at: str, delay: str = "6 hours") -> DataFrame:
    """Each key once within the watermark's delay, so state stays bounded."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def fresh(stream: DataFrame, at: str, received: Column, minutes: int = 15) -> DataFrame:
    """Rows not older than ``minutes`` when received."""
    return stream.where(received - F.col(at) <= F.expr(f"INTERVAL {minutes} MINUTE"))

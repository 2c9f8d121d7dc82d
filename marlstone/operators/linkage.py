"""Record linkage: blocks, scored pairs, components, and the choice of one canonical record.

Records that agree in their normal form are one class.  Classes meet in blocks,
one for each blocking key; inside a block they are sorted by their normal form,
and each is compared with the next few, so a block costs as much as it has
classes and never all their pairs.  Pairs that score high enough link, links
make components, and of each component one record is canonical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators import relational as op
from marlstone.operators.hierarchy import components
from marlstone.operators.tables import Written, numbered

#: Classes that each class is compared with in the order of a block.
NEXT = 10
#: Share of words that two names have in common at least, for a link.
LEAST = 0.6


def normal(name: Column) -> Column:
    """A name's words in lower case, sorted, each once, without punctuation."""
    words = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words of two normal forms."""
    x, y = F.split(a, " "), F.split(b, " ")
    both = F.size(F.array_intersect(x, y))
    return both / (F.size(x) + F.size(y) - both)


def linked(records: DataFrame, id_col: str, name: Column, blocks: list[Column], least: float = LEAST, near: int = NEXT) -> DataFrame:
    """``id`` and ``entity``, the least id of its component, of every record with an id.

    ``blocks`` are blocking keys (strings); records with a null key are in no
    block of that kind.  Records with equal normal names in a block always link.
    """
    out = Written(records.sparkSession)
    keyed = out.keep(records.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), normal(name).alias("form"), F.array(*[F.concat(F.lit(f"{i}:"), b.cast("string")) for i, b in enumerate(blocks)]).alias("keys")), "keyed")
    each = keyed.select("id", "form", F.explode("keys").alias("block")).where("block IS NOT NULL")
    # One class for each normal form of a block, under its least id.
    classes = out.keep(each.groupBy("block", "form").agg(F.min("id").alias("head")), "classes")
    own = each.join(classes, ["block", "form"]).where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    # Places in the order of blocks and forms: a class meets those of the next places, so a large block is no task's own.
    placed = out.keep(numbered(classes.where("form <> ''"), out, "sorted", "at", "block", "form", "head"), "placed")
    asks = placed.select("block", "form", "head", F.explode(F.sequence(F.col("at") + 1, F.col("at") + near)).alias("at"))
    others = placed.select("at", F.col("block").alias("b2"), F.col("form").alias("form2"), F.col("head").alias("head2"))
    compared = asks.join(others, "at").where("block = b2")
    close = compared.where(similarity(F.col("form"), F.col("form2")) >= least).select(F.col("head").alias("a"), F.col("head2").alias("b"))
    joined = components(out.keep(own.unionByName(close).distinct(), "links"), "a", "b")
    found = keyed.select("id").distinct().join(joined.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("entity"))
    result = out.keep(found, "entities")
    out.drop("entities")
    return result


def canonical(records: DataFrame, id_col: str, group: str, source: str, copy_key: str, priority: Column, richness: Column, kept: Column, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The fate of every record, and the links after it.

    Three passes and a clean-up: of a group's records of one source with the
    same ``copy_key`` the richest stays; of what is left the one of the least
    ``priority``, the richest of these, is canonical; the others point to it.
    Copies and others are deleted, unless ``kept`` says that they hold what
    nothing else does.  ``links`` (record, target) of deleted records move to
    the record that stays in their place, once each.

    The first frame has the id, ``canonical_id``, ``is_canonical``, ``deleted``
    (null, "copy" or "source") and ``into``, the record that takes its links.
    """
    r = records.select(F.col(id_col).alias("id"), F.col(group).alias("g"), F.col(source).alias("s"), F.col(copy_key).alias("c"), priority.alias("p"), richness.alias("rich"), F.coalesce(kept, F.lit(False)).alias("kept"))
    # Aggregates, not windows: a large group is added up where it lies.
    best_copy = r.groupBy("g", "s", "c").agg(F.max_by("id", F.struct(F.col("kept"), F.col("rich"), -F.col("id"))).alias("stays"))
    best_copy = best_copy.select(F.col("g").alias("bg"), F.col("s").alias("bs"), F.col("c").alias("bc"), "stays")
    one = r.join(best_copy, F.col("g").eqNullSafe(F.col("bg")) & F.col("s").eqNullSafe(F.col("bs")) & F.col("c").eqNullSafe(F.col("bc"))).select("id", "g", "p", "rich", "kept", "stays")
    one = one.withColumn("copy", (F.col("id") != F.col("stays")) & ~F.col("kept"))
    top = one.where(~F.col("copy")).groupBy("g").agg(F.min_by("id", F.struct("p", -F.col("rich"), "id")).alias("top")).withColumnRenamed("g", "__g")
    fate = one.join(top, F.col("g").eqNullSafe(F.col("__g")))
    gone = F.when(F.col("copy"), "copy").when((F.col("id") != F.col("top")) & ~F.col("kept"), "source")
    fate = fate.select("id", F.col("top").alias("canonical_id"), (F.col("id") == F.col("top")).alias("is_canonical"), gone.alias("deleted"), F.when(gone.isNotNull(), F.col("top")).alias("into"))
    moved = None
    if links is not None:
        moved = links.join(fate.select(F.col("id").alias("record"), "into"), "record", "left").select(F.coalesce("into", "record").alias("record"), "target").distinct()
    return fate.withColumnRenamed("id", id_col), moved


def availability(records: DataFrame, fate: DataFrame, id_col: str, group: str, source: str, external: str) -> DataFrame:
    """One row for each group, source and external id that is left: the record that answers for it."""
    left = records.join(fate.where("deleted IS NULL OR deleted = 'source'").select(id_col, "is_canonical"), id_col)
    return op.distinct_on(left.select(group, source, external, id_col, "is_canonical"), [group, source, external], F.desc("is_canonical"), F.asc(id_col))

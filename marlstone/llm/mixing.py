"""Mixing sources to target weights, in DataFrame functions only.

Words are summed for each source, and the sources share a budget by weight:
whoever would pass its limit is held there, and what it leaves is shared among
the others, until none is above.  A source's target over its size is its
repetition rate; each document is taken floor(rate) times, and once more if a
number made from its id by a hash is below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.ranks import numbered
from marlstone.llm.store import Scratch

#: Weights of the sources in order, over and over.
WEIGHTS = (5, 2, 1)
#: The budget as a multiple of all sizes, and how often a source may be taken.
SHARE, MOST = 1.5, 2.0
SEED = "mixing"


def size(text_col: str) -> Column:
    """Words of a text; white space is what ``[\\x20\\x09-\\x0D]`` says."""
    cut = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", -1)
    # Only the first and the last part can be empty, and both are if all is white space.
    return (F.size(cut) - F.when(F.get(cut, F.lit(0)) == "", 1).otherwise(0) - F.when((F.size(cut) > 1) & (F.element_at(cut, -1) == ""), 1).otherwise(0)).cast("long")


def draw(id_col: str, text_col: str, seed: str = SEED) -> Column:
    """A number from 0 to 1 made from a row's id, or from its text where the id is null."""
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key).cast("binary"), 256), 1, 13)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def targets(docs: DataFrame, scratch: Scratch, text_col: str, source_col: str, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target`` and ``rate``."""
    sums = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.sum(size(text_col)).alias("source_size"))
    ordered = numbered(scratch.keep(sums, "sums"), scratch, "ordered", "n", F.asc_nulls_last("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    own = scratch.keep(ordered.select("source", "source_size", F.get(cycle, ((F.col("n") - 1) % len(weights)).cast("int")).alias("weight"), (F.col("source_size") * F.lit(most)).alias("limit")), "sources")
    all_ = own.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget, level, held = share * (all_["size"] or 0), 0.0, -1
    free = all_["weight"] or 0.0
    # Each round holds at least one source more at its limit, and its answer is one row.
    limits = 0.0
    while free:
        level = (budget - limits) / free
        got = own.where(F.col("limit") <= F.lit(level) * F.col("weight")).agg(F.count(F.lit(1)).alias("n"), F.sum("limit").alias("limit"), F.sum("weight").alias("weight")).first()
        if got["n"] == held:
            break
        held, limits, free = got["n"], got["limit"] or 0.0, all_["weight"] - (got["weight"] or 0.0)
    target = F.least(F.col("limit"), F.lit(level) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return own.select("source", "source_size", target.alias("target"), F.least(rate, F.lit(most)).alias("rate"))


def plan_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED,
) -> DataFrame:
    """One row per document: ``id``, ``source``, ``size``, ``source_size``, ``target``, ``rate`` and ``copies``.

    Sources are numbered by code point, a null one last and an empty one first.
    A null or empty text has size 0 and its copies add no word; a source of size
    0 has target 0.  Rows with equal ids are taken equally often within a
    source, and rows with a null id by their text.  Extra columns are ignored;
    an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    each = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), size(text_col).alias("size"), draw(id_col, text_col, seed).alias("u"))
    by_source = targets(docs, scratch, text_col, source_col, weights, share, most).withColumnRenamed("source", "of")
    out = each.join(by_source, F.col("source").eqNullSafe(F.col("of"))).select("id", "source", "size", "source_size", "target", "rate", _copies("rate", "u").alias("copies"))
    scratch.drop("sources")
    return out


def _copies(rate: str, u: str) -> Column:
    return (F.floor(rate) + F.when(F.col(u) < F.col(rate) - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED,
) -> DataFrame:
    """The mixture itself: ``docs``, each row as often as it is taken; see :func:`plan_mix`."""
    scratch = Scratch(docs.sparkSession)
    by_source = targets(docs, scratch, text_col, source_col, weights, share, most).select(F.col("source").alias("__of"), F.col("rate").alias("__rate"))
    keyed = docs.select("*", F.col(source_col).cast("string").alias("__key"), draw(id_col, text_col, seed).alias("__u"))
    taken = keyed.join(by_source, F.col("__key").eqNullSafe(F.col("__of"))).withColumn("__times", _copies("__rate", "__u"))
    out = taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__times")))).select(*docs.columns)
    scratch.drop("sources")
    return out


def oracle(table: str, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> str:
    """The rows in DuckDB's SQL: a source is held at its limit if the level without it would still be above."""
    return rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, 'null ' || coalesce(text, ''))), 1, 13))::BIGINT / {1 << 52}::DOUBLE AS u
  FROM {table}
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([{", ".join(f"{float(w)}::DOUBLE" for w in weights)}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1)::INT] AS weight, sum(size) * {most}::DOUBLE AS lim
  FROM d GROUP BY source
), o AS (
  SELECT *, ({share}::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(lim) OVER below, 0)) / sum(weight) OVER above AS level
  FROM s WINDOW below AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), above AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), t AS (
  SELECT source, source_size, least(lim, coalesce((SELECT max(level) FROM o), 0) * weight) AS target FROM s
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM (SELECT doc_id, size, u, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, {most}::DOUBLE) ELSE 0 END AS rate
      FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)"""

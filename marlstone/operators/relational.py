"""Relational operators that Spark has no single name for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def where_all(df: DataFrame, *tests: Column | None) -> DataFrame:
    """Rows that pass every test given; None stands for a parameter that was not set."""
    given = [t for t in tests if t is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def distinct_on(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order; a limit on row_number prunes rows before the shuffle."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rn = 1").drop("__rn")


def top_per_key(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return ranked.where(F.col("rn") <= n)


def paged(df: DataFrame, limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    """A page of an ordered frame with the limit clamped to 1..most."""
    return df.offset(max(0, offset)).limit(max(1, min(limit, most)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str] | None = None) -> DataFrame:
    """All keys of both: new values win, null new values keep old ones, and ``add`` columns are summed.

    ``rules`` maps a column to ``add``, ``keep`` (old wins) or ``replace`` (new
    wins even if null).  ``new`` has one row for each key.
    """
    rules = rules or {}
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    out = []
    present = F.col(f"n.{keys[0]}").isNotNull()
    for c in old.columns:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        match rules.get(c):
            case "add":
                out.append((F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).alias(c))
            case "keep":
                out.append(F.coalesce(a, b).alias(c))
            case "replace":
                out.append(F.when(present, b).otherwise(a).alias(c))
            case _:
                out.append(F.coalesce(b, a).alias(c))
    return joined.select(*out)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old``, one for each key: insert or do nothing."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of every parent in ``new`` replaced by the new ones, others kept."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def append_once(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """An append-only table after new entries; those whose key is there already are left out."""
    return old.unionByName(insert_new(old, new, keys))


def reset_on_tag(old: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """The table (key, tag, status, attempts) after a listing (key, tag): what is new or has another tag is pending with no attempts; ``changed`` is null for new keys."""
    o, n = old.alias("o"), listed.alias("n")
    j = n.join(o, key, "full_outer")
    again = F.col("n.tag").isNotNull() & ~F.col("n.tag").eqNullSafe(F.col("o.tag"))
    return j.select(
        key, F.coalesce("n.tag", "o.tag").alias("tag"), F.when(again, F.lit("pending")).otherwise(F.col("o.status")).alias("status"),
        F.when(again, F.lit(0)).otherwise(F.col("o.attempts")).alias("attempts"), F.when(F.col("o.status").isNotNull(), again).alias("changed"),
    )


def claim(queue: DataFrame, key: str, most: int, *order: Column) -> DataFrame:
    """The queue (key, state, attempts, ...) after the first pending entries are claimed; at most ``most`` rows travel."""
    mine = queue.where("state = 'pending'").orderBy(*order).limit(most).select(key).withColumn("__mine", F.lit(True))
    j = queue.join(F.broadcast(mine), key, "left")
    out = j.withColumns({"state": F.when(F.col("__mine"), F.lit("claimed")).otherwise(F.col("state")), "attempts": F.when(F.col("__mine"), F.col("attempts") + 1).otherwise(F.col("attempts"))})
    return out.select(*queue.columns)


def retry(queue: DataFrame, at: str, most: int, seconds: int) -> DataFrame:
    """The queue with failed entries pending again after ``seconds`` doubled by each attempt, or undelivered after ``most`` of them."""
    failed, again = F.col("state") == "failed", F.col("attempts") < most
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.lit(seconds) * F.pow(F.lit(2), F.col("attempts"))).cast("decimal(18,6)"))
    return queue.withColumns({"next_at": F.when(failed & again, F.col(at) + wait), "state": F.when(failed & again, "pending").when(failed, "undelivered").otherwise(F.col("state"))})


def grow_dimension(old: DataFrame, names: DataFrame, name: str, key: str) -> DataFrame:
    """A small dimension with the names that it does not know yet, numbered on from its greatest key in order of name."""
    fresh = names.where(F.col(name).isNotNull()).select(name).distinct().join(old.select(name), name, "left_anti")
    top = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    new = fresh.crossJoin(F.broadcast(top)).withColumn(key, F.col("__top") + F.row_number().over(Window.orderBy(name)))
    return old.select(name, key).withColumn("known", F.lit(True)).unionByName(new.select(name, key).withColumn("known", F.lit(False)))


def latest(df: DataFrame, keys: list[str], at: str, *ties: Column) -> DataFrame:
    return distinct_on(df, keys, F.col(at).desc_nulls_last(), *ties)


def neighbours(chunks: DataFrame, targets: DataFrame, document: str, index: str, width: int = 1) -> DataFrame:
    """Chunks around each target by an equi-join on the document and on each offset, so no range join is needed."""
    wanted = targets.select(F.col(document), F.col(index).alias("target_index"), F.explode(F.sequence(F.col(index) - width, F.col(index) + width)).alias(index))
    return chunks.join(wanted, [document, index]).withColumn("is_target", F.col(index) == F.col("target_index"))


def any_of_join(left: DataFrame, right: DataFrame, ways: list[tuple[list[str], list[str]]], left_key: list[str], right_key: list[str]) -> DataFrame:
    """An OR of equi-joins as a union of them, pairs once: a join on OR would be a nested loop."""
    parts = []
    for a, b in ways:
        l, r = left.alias("l"), right.alias("r")  # noqa: E741
        on = reduce(lambda x, y: x & y, [F.col(f"l.{x}") == F.col(f"r.{y}") for x, y in zip(a, b, strict=True)])
        parts.append(l.join(r, on).select(*[F.col(f"l.{k}") for k in left_key], *[F.col(f"r.{k}") for k in right_key]))
    return reduce(DataFrame.union, parts).distinct()


def sliding_counts(df: DataFrame, keys: list[str], at: str, seconds: int, block: int | None = None, name: str = "n") -> DataFrame:
    """``df`` with the number of its key's rows from ``seconds`` before each row up to it, rows of the same time included.

    A key's time is cut into blocks, and each block gets the rows of the
    ``seconds`` before it as context, so a busy key is counted in many tasks.
    Rows without a time are counted as 0.
    """
    block = block or 6 * seconds
    micros = F.unix_micros(F.col(at).cast("timestamp")) if dict(df.dtypes)[at] != "bigint" else F.col(at)
    length, reach = F.lit(block * 1_000_000), seconds * 1_000_000
    own = F.floor(F.col("__at") / length).cast("long")
    timed = df.withColumn("__at", micros)
    placed = timed.where("__at IS NOT NULL").withColumn("__own", own)
    # A row is in its own block and in those that its reach touches.
    placed = placed.withColumn("__block", F.explode(F.sequence("__own", F.floor((F.col("__at") + F.lit(reach)) / length).cast("long"))))
    near = Window.partitionBy(*keys, "__block").orderBy("__at").rangeBetween(-reach, Window.currentRow)
    counted = placed.withColumn(name, F.count(F.lit(1)).over(near)).where("__block = __own").drop("__at", "__own", "__block")
    return counted.unionByName(timed.where("__at IS NULL").drop("__at").withColumn(name, F.lit(0).cast("long")))


def rule_join(df: DataFrame, rules: DataFrame, text: str, pattern: str, few: int = 64) -> DataFrame:
    """Rows with every rule whose pattern they match.

    There is no equi-key: a ``few`` rules travel as literals of one array, more
    of them by an automaton (:mod:`patterns`).
    """
    rows = rules.limit(few + 1).collect()
    if len(rows) > few:
        from marlstone.operators.patterns import pattern_join

        return pattern_join(df, rules, text, pattern)
    if not rows:
        return df.limit(0).crossJoin(rules.limit(0))
    names = rules.columns
    hits = F.array(*[F.when(F.col(text).rlike(r[pattern]), F.struct(*[F.lit(r[c]).cast(rules.schema[c].dataType).alias(c) for c in names])) for r in rows])
    return df.withColumn("__rule", F.explode(F.filter(hits, lambda x: x.isNotNull()))).select(*df.columns, *[F.col(f"__rule.{c}") for c in names])


def first_seen_merge(frames: list[DataFrame], key: str, score: str, limit: int) -> DataFrame:
    """Ranked lists merged: the first list that has a key gives its row, then the best scores."""
    tagged = [f.withColumn("__p", F.lit(i)) for i, f in enumerate(frames)]
    merged = reduce(lambda a, b: a.unionByName(b), tagged)
    return distinct_on(merged, [key], F.col("__p"), F.col(score).desc()).drop("__p").orderBy(F.col(score).desc(), key).limit(limit)


def soft_delete(df: DataFrame, due: Column, stamp: Column, reason: str, cleared: list[str]) -> DataFrame:
    """Content of due rows set to null, with time and reason; a row already purged is left alone."""
    now = due & F.col("purged_at").isNull()
    out = df.withColumns({c: F.when(now, F.lit(None)).otherwise(F.col(c)) for c in cleared})
    return out.withColumns({"purge_reason": F.when(now, F.lit(reason)).otherwise(F.col("purge_reason")), "purged_at": F.when(now, stamp).otherwise(F.col("purged_at"))})


def stats_row(**metrics: DataFrame) -> DataFrame:
    """(metric, value) of several one-row counts, as one plan."""
    parts = [df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value") for name, df in metrics.items()]
    return reduce(DataFrame.unionByName, parts)


def select_only(spark: SparkSession, sql: str, most: int = 100) -> DataFrame:
    """A gateway for queries: the statement is parsed, anything but a query is refused, and rows are capped."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    kind = plan.getClass().getSimpleName()
    text = plan.getClass().getName()
    allowed = {"Project", "Filter", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Aggregate", "UnresolvedWith", "WithCTE", "Union", "Except", "Intersect", "UnresolvedHaving", "SubqueryAlias", "UnresolvedInlineTable", "UnresolvedRelation", "LocalRelation", "OneRowRelation"}
    if ".command." in text or kind not in allowed:
        raise PermissionError(f"only queries may run here, not {kind}")
    return spark.sql(sql).limit(most)


def stratified(df: DataFrame, tier: Column, shares: dict[str, float], total: int, key: str, seed: int = 7) -> DataFrame:
    """A repeatable sample with a share of ``total`` rows from each tier, by hash order."""
    want = F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(int(round(total * v))))])
    ranked = df.withColumn("tier", tier).withColumn("__rn", F.row_number().over(Window.partitionBy("tier").orderBy(F.xxhash64(key, F.lit(seed)), key)))
    return ranked.where(F.col("__rn") <= F.try_element_at(want, F.col("tier"))).drop("__rn")

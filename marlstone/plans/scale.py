"""Queries over the operators that keep their own structures: trigrams, rules, deep chains, percentiles, linkage, timed release."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import hierarchy, linkage, patterns, quantiles
from marlstone.operators.index import fingerprint
from marlstone.operators.trigrams import TrigramIndex
from marlstone.plans.registry import query
from marlstone.sources.tables import table as t
from marlstone.streaming import release

_trigrams: dict[tuple, tuple[tuple, TrigramIndex]] = {}


def trigram_index(spark, sf_dir: str) -> TrigramIndex:
    """The trigrams of a folder's documents, written on first use and anew once the table's files have changed."""
    d = t(spark, sf_dir, "documents")
    key, now = (spark.sparkContext.applicationId, sf_dir), fingerprint(d)
    if key not in _trigrams or _trigrams[key][0] != now:
        _trigrams[key] = (now, TrigramIndex.build(d, "doc_id", "text"))
    return _trigrams[key][1]


@query("substring_search", "SELECT doc_id, source FROM documents WHERE text ILIKE '%general public lic%'")
def substring_search(spark, sf_dir, words="general public lic"):
    """Texts that hold a string in any case, by the postings of its rarest trigrams."""
    return trigram_index(spark, sf_dir).search(f"%{words}%").select("doc_id", "source")


@query("substring_like", r"SELECT doc_id FROM documents WHERE text ILIKE '%licen_e%version%' AND source <> 'src0'")
def substring_like(spark, sf_dir, like="%licen_e%version%"):
    """A pattern with wildcards, and a condition on another column."""
    return trigram_index(spark, sf_dir).search(like).where("source <> 'src0'").select("doc_id")


_RULES = r"regexp_extract(text, '^\s*\S+\s+([A-Za-z]{3,})\s+([A-Za-z]{2,})\s', 1)"


@query("many_rules", rf"""
WITH rules AS (SELECT doc_id AS rule, '(?i) ' || {_RULES} || ' +' || {_RULES.replace(", 1)", ", 2)")} || ' ' AS pattern FROM documents WHERE doc_id % 5 = 0 AND {_RULES} <> '')
SELECT rule, count(*) AS n, min(doc_id) AS first_doc FROM documents, rules WHERE regexp_matches(text, pattern) GROUP BY rule""")
def many_rules(spark, sf_dir):
    """A rule for each of a fifth of the documents, its second and third word in any case, over all texts by one automaton.

    Rules of the same pattern are tried and counted together.
    """
    d = t(spark, sf_dir, "documents").select("doc_id", "text")
    word = lambda k: F.regexp_extract("text", r"^\s*\S+\s+([A-Za-z]{3,})\s+([A-Za-z]{2,})\s", k)
    rules = d.where(F.col("doc_id") % 5 == 0).select(F.col("doc_id").alias("rule"), word(1).alias("a"), word(2).alias("b")).where("a <> ''")
    rules = rules.select("rule", F.concat(F.lit("(?i) "), "a", F.lit(" +"), "b", F.lit(" ")).alias("pattern"))
    found = patterns.pattern_join(d, rules.select("pattern").distinct(), "text", "pattern")
    counts = found.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    return rules.join(counts, "pattern").groupBy("rule").agg(F.sum("n").alias("n"), F.min("first_doc").alias("first_doc"))


@query("deep_chains", "SELECT event_id AS node, min(event_id) OVER w AS root, row_number() OVER w - 1 AS depth, FALSE AS cycle FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)")
def deep_chains(spark, sf_dir):
    """Each event after the one before it of its kind: chains as long as the table, walked in rounds that double."""
    e = t(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(Window.partitionBy("event_type").orderBy("event_id")).alias("before"))
    return hierarchy.roots(e, "event_id", "before")


@query("shared_part_components", """
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_quantity >= 49),
s AS (SELECT o AS node, o AS c FROM e UNION SELECT b.o, s.c FROM s JOIN e a ON a.o = s.node JOIN e b ON b.p = a.p)
SELECT node, min(c) AS component FROM s GROUP BY node""")
def shared_part_components(spark, sf_dir):
    """Orders that share a part in a large quantity, directly or over others."""
    e = t(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").cast("long").alias("o"), (-F.col("l_partkey") - 1).cast("long").alias("p")).distinct()
    found = hierarchy.components(e, "o", "p").where("node >= 0")
    # Parts have negative numbers; a component is named by its least order.
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))


@query("percentiles_exact", "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def percentiles_exact(spark, sf_dir, rank=0.95):
    """The 95th percentile of each kind by narrowing histograms."""
    got = quantiles.exact(t(spark, sf_dir, "events"), ["event_type"], "value", rank, few=200)
    return got.select("event_type", "n", F.round("quantile", 6).alias("p95"))


@query("percentiles_of_sketches")
def percentiles_of_sketches(spark, sf_dir, ranks=(0.5, 0.95, 0.99)):
    """Percentiles of each kind from hourly sketches."""
    return quantiles.from_sketches(quantiles.hourly(t(spark, sf_dir, "events"), ["event_type"], "ts", "value"), ["event_type"], list(ranks))


@query("linked_parts")
def linked_parts(spark, sf_dir):
    """Parts that are the same by name: those of one type, and those of one brand and size, are compared."""
    p = t(spark, sf_dir, "part")
    return linkage.linked(p, "p_partkey", F.col("p_name"), [F.col("p_type"), F.concat_ws("|", "p_brand", "p_size")])


@query("canonical_three_passes", """
WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS g, l_suppkey AS s, l_returnflag AS c, l_suppkey % 7 AS p, l_quantity AS rich, l_discount >= 0.10 AS kept FROM lineitem),
w AS (SELECT *, first_value(id) OVER (PARTITION BY g, s, c ORDER BY kept DESC, rich DESC, id) AS stays FROM r),
x AS (SELECT *, id <> stays AND NOT kept AS copy FROM w),
y AS (SELECT *, first_value(id) OVER (PARTITION BY g ORDER BY copy, p, rich DESC, id) AS top FROM x)
SELECT id, top AS canonical_id, id = top AS is_canonical, CASE WHEN copy THEN 'copy' WHEN id <> top AND NOT kept THEN 'source' END AS deleted, CASE WHEN copy OR (id <> top AND NOT kept) THEN top END AS "into" FROM y""")
def canonical_three_passes(spark, sf_dir):
    """Copies within a source, the canonical record of each part, and the clean-up of the others."""
    l = t(spark, sf_dir, "lineitem").withColumn("id", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long"))  # noqa: E741
    return linkage.canonical(l, "id", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_suppkey") % 7, F.col("l_quantity"), F.col("l_discount") >= 0.10)[0]


@query("notification_release")
def notification_release(spark, sf_dir, zone="America/Los_Angeles"):
    """Batches of messages as quiet hours and the gap let them go, each with the senders it names."""
    e = t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return release.release(e, "user_id", "at", "event_id", "event_type", zone=zone)

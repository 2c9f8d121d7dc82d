"""Operational analytics and governance: usage, latency, quality, security, retention and canonical records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import relational as op
from marlstone.plans.registry import query
from marlstone.plans.text import CLASSIFY, classify
from marlstone.sources.tables import table as t

NOW = "(SELECT max(ts) AS now FROM events)"


def as_of(e: DataFrame) -> DataFrame:
    """The latest time of the log, one row: every relative window counts from it and never from the wall clock."""
    return e.agg(F.max("ts").alias("now"))


def recent(e: DataFrame, interval: str, log: DataFrame | None = None) -> DataFrame:
    """Rows of the last interval before the latest time of ``log``; give the whole log where ``e`` is a part of it."""
    return e.crossJoin(F.broadcast(as_of(e if log is None else log))).where(F.expr(f"ts > now - INTERVAL {interval}"))


def findings(*parts: tuple[str, str, DataFrame]) -> DataFrame:
    """(check, severity, n) of several checks, each a frame of offending rows."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), F.lit(sev).alias("severity"), "n") for name, sev, df in parts])


@query("data_quality_findings", """
SELECT 'missing_vectors' AS check_name, 'high' AS severity, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 'short_text', 'low', count(*) FROM documents WHERE length(trim(text)) < 50
UNION ALL SELECT 'duplicate_copies', 'medium', coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM documents GROUP BY md5(text) HAVING count(*) > 1)
UNION ALL SELECT 'orphan_vectors', 'medium', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'unlabelled', 'low', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def data_quality_findings(spark, sf_dir):
    d, e, l = t(spark, sf_dir, "documents"), t(spark, sf_dir, "embeddings"), t(spark, sf_dir, "labels")  # noqa: E741
    keys = d.select("doc_id")
    extra = d.groupBy(F.md5("text").alias("h")).agg((F.count(F.lit(1)) - 1).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0)).cast("long").alias("n"))
    counted = findings(
        ("missing_vectors", "high", keys.join(e, F.col("doc_id") == F.col("vec_id"), "left_anti")),
        ("short_text", "low", d.where(F.length(F.trim("text")) < 50).select("doc_id")),
        ("orphan_vectors", "medium", e.select("vec_id").join(d, F.col("doc_id") == F.col("vec_id"), "left_anti")),
        ("unlabelled", "low", keys.join(l, "doc_id", "left_anti")),
    )
    return counted.unionByName(extra.select(F.lit("duplicate_copies").alias("check_name"), F.lit("medium").alias("severity"), "n"))


@query("tool_usage", "SELECT event_type, count(*) AS calls, count(DISTINCT user_id) AS clients, count(*) FILTER (WHERE value > 90) AS slow, CAST(round(avg(value)) AS BIGINT) AS mean_ms FROM events GROUP BY event_type")
def tool_usage(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("user_id").alias("clients"), F.count_if(F.col("value") > 90).alias("slow"), F.round(F.avg("value")).cast("long").alias("mean_ms"))


@query("repeated_queries", "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n, count(DISTINCT user_id) AS clients FROM events GROUP BY 1, 2 HAVING count(*) >= 5 ORDER BY n DESC, event_type, k LIMIT 20")
def repeated_queries(spark, sf_dir):
    e = t(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("clients"))
    return e.where("n >= 5").orderBy(F.desc("n"), "event_type", "k").limit(20)


@query("zero_result_patterns", "SELECT event_type, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') = '0' GROUP BY event_type HAVING count(*) > 1")
def zero_result_patterns(spark, sf_dir):
    return t(spark, sf_dir, "events").where(F.get_json_object("props", "$.k") == "0").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("client_comparison", "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS tools, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY user_id HAVING count(*) >= 5")
def client_comparison(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("tools"), F.round(F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY value)"), 6).alias("p95")).where("n >= 5")


@query("request_rate_sliding", """
SELECT event_id, user_id, ts, n FROM (SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTE PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 1""")
def request_rate_sliding(spark, sf_dir, least=2):
    """Calls after which a client has made too many in the ten minutes before."""
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return op.sliding_counts(e, ["user_id"], "ts", 600).where(F.col("n") >= least)


@query("unknown_clients", "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY user_id")
def unknown_clients(spark, sf_dir):
    known = t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return t(spark, sf_dir, "events").join(known, "user_id", "left_anti").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("pii_documents", r"SELECT doc_id, source FROM documents WHERE regexp_matches(text, '\b(?:\d[ -]*?){13,16}\b') OR regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')")
def pii_documents(spark, sf_dir):
    return t(spark, sf_dir, "documents").where(F.col("text").rlike(tx.PII["card"]) | F.col("text").rlike(tx.PII["email"])).select("doc_id", "source")


@query("fleet_error_rate", "SELECT user_id, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id HAVING count(*) >= 8 AND count(*) FILTER (WHERE event_type = 'error') > 0.22 * count(*)")
def fleet_error_rate(spark, sf_dir, runs=8, share=0.22):
    e = t(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return e.where((F.col("runs") >= runs) & (F.col("errors") > share * F.col("runs")))


@query("pending_by_severity", "SELECT o_orderpriority AS severity, count(*) AS n, min(o_orderdate) AS oldest FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def pending_by_severity(spark, sf_dir):
    return t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_orderpriority").alias("severity")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("oldest"))


@query("cross_agent_conflict", "SELECT l_partkey, count(DISTINCT l_returnflag) AS verdicts FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) > 2")
def cross_agent_conflict(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_returnflag").alias("verdicts")).where("verdicts > 2")


@query("case_overview", "SELECT o_orderstatus, count(DISTINCT o_orderkey) AS cases, count(DISTINCT l_partkey) AS documents, count(DISTINCT o_custkey) AS parties FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
def case_overview(spark, sf_dir):
    o, l = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")  # noqa: E741
    return o.join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderstatus").agg(F.countDistinct("o_orderkey").alias("cases"), F.countDistinct("l_partkey").alias("documents"), F.countDistinct("o_custkey").alias("parties"))


@query("cross_case_parties", "SELECT o_custkey, count(*) AS cases, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS statuses FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def cross_case_parties(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("cases"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses")).where("cases > 15")


@query("recent_filings", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 DAY ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def recent_filings(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return o.crossJoin(F.broadcast(o.agg(F.max("o_orderdate").alias("now")))).where(F.expr("o_orderdate > now - INTERVAL 7 DAY")).select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25)


@query("weekly_scorecard", f"""
SELECT count(*) AS calls, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(100::DOUBLE * count(*) FILTER (WHERE event_type = 'error') / greatest(count(*), 1), 1) AS error_pct
FROM events, {NOW} WHERE ts > now - INTERVAL 7 DAY""")
def weekly_scorecard(spark, sf_dir):
    e = recent(t(spark, sf_dir, "events"), "'7' DAY")
    pc = lambda p: F.round(F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY value)"), 6)
    return e.agg(F.count(F.lit(1)).alias("calls"), pc(0.95).alias("p95"), pc(0.99).alias("p99"), F.round(100.0 * F.count_if(F.col("event_type") == "error") / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("error_pct"))


@query("top_errors", f"SELECT user_id, count(*) AS n FROM events, {NOW} WHERE event_type = 'error' AND ts > now - INTERVAL 7 DAY GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def top_errors(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return recent(e.where("event_type = 'error'"), "'7' DAY", e).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("retrieval_eval", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents), p AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS p FROM benchmark),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS g FROM w, unnest(range(1, len(w) - 6)) u(i)), h AS (SELECT DISTINCT item_id, array_to_string(p[i:i + 7], ' ') AS g FROM p, unnest(range(1, len(p) - 6)) u(i)),
n AS (SELECT item_id, count(*) AS n FROM h GROUP BY 1), m AS (SELECT item_id, doc_id, count(*) AS c FROM h JOIN g USING (g) GROUP BY 1, 2), k AS (SELECT item_id, count(*) AS hits FROM m JOIN n USING (item_id) WHERE 2 * c >= n GROUP BY 1)
SELECT item_id, coalesce(hits, 0) AS hits, hits IS NOT NULL AS passed FROM benchmark LEFT JOIN k USING (item_id)""")
def retrieval_eval(spark, sf_dir, size=8):
    """In how many documents each evaluation passage is found: half its distinct runs of eight words, by an equi-join on the runs."""

    def runs(df, key):
        words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        cut = df.select(key, words.alias("w")).where(F.size("w") >= size)
        return cut.select(key, F.explode(F.expr(f"array_distinct(transform(sequence(1, size(w) - {size - 1}), i -> array_join(slice(w, i, {size}), ' ')))")).alias("g"))

    b = t(spark, sf_dir, "benchmark")
    wanted = runs(b, "item_id")
    n = wanted.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    met = runs(t(spark, sf_dir, "documents"), "doc_id").join(wanted, "g").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    hits = met.join(n, "item_id").where("2 * c >= n").groupBy("item_id").agg(F.count(F.lit(1)).alias("hits"))
    return b.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.col("hits").isNotNull().alias("passed"))


@query("eval_regression", "SELECT d, rate, rate - lag(rate) OVER (ORDER BY d) < -0.05 AS regressed FROM (SELECT date_trunc('day', ts) AS d, round(count(*) FILTER (WHERE event_type <> 'error') / count(*)::DOUBLE, 6) AS rate FROM events GROUP BY 1)")
def eval_regression(spark, sf_dir):
    day = t(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("d")).agg(F.round(F.count_if(F.col("event_type") != "error") / F.count(F.lit(1)), 6).alias("rate"))
    return day.withColumn("regressed", F.col("rate") - F.lag("rate").over(Window.orderBy("d")) < -0.05)


@query("latency_regression", f"""
WITH w AS (SELECT event_type, value, CASE WHEN ts > now - INTERVAL 7 DAY THEN 'now' WHEN ts > now - INTERVAL 14 DAY THEN 'before' END AS win FROM events, {NOW}),
s AS (SELECT event_type, count(*) FILTER (WHERE win = 'now') AS n_now, count(*) FILTER (WHERE win = 'before') AS n_before, quantile_cont(value, 0.95) FILTER (WHERE win = 'now') AS p_now, quantile_cont(value, 0.95) FILTER (WHERE win = 'before') AS p_before FROM w WHERE win IS NOT NULL GROUP BY 1)
SELECT event_type, n_now, n_before, round(p_now, 6) AS p_now, round(p_before, 6) AS p_before, n_now >= 20 AND n_before >= 20 AND p_now >= 1.05 * p_before AS regressed FROM s""")
def latency_regression(spark, sf_dir, calls=20, ratio=1.05):
    """Two adjacent windows from one pass; percentiles skip the nulls of the other window."""
    e = t(spark, sf_dir, "events")
    e = e.crossJoin(F.broadcast(as_of(e))).withColumn("win", F.expr("CASE WHEN ts > now - INTERVAL '7' DAY THEN 'now' WHEN ts > now - INTERVAL '14' DAY THEN 'before' END")).where("win IS NOT NULL")
    pc = lambda w: F.expr(f"percentile_cont(0.95) WITHIN GROUP (ORDER BY CASE WHEN win = '{w}' THEN value END)")
    s = e.groupBy("event_type").agg(F.count_if(F.col("win") == "now").alias("n_now"), F.count_if(F.col("win") == "before").alias("n_before"), pc("now").alias("a"), pc("before").alias("b"))
    return s.select("event_type", "n_now", "n_before", F.round("a", 6).alias("p_now"), F.round("b", 6).alias("p_before"), ((F.col("n_now") >= calls) & (F.col("n_before") >= calls) & (F.col("a") >= ratio * F.col("b"))).alias("regressed"))


@query("threshold_bands", "SELECT event_id, CASE WHEN value >= 95 THEN 'critical' WHEN value >= 80 THEN 'warning' ELSE 'ok' END AS band FROM events")
def threshold_bands(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.when(F.col("value") >= 95, "critical").when(F.col("value") >= 80, "warning").otherwise("ok").alias("band"))


@query("agent_health", f"SELECT user_id, count(*) AS runs, round(quantile_cont(value, 0.95), 6) AS p95, max(ts) AS last_run FROM events, {NOW} WHERE ts > now - INTERVAL 48 HOUR GROUP BY user_id")
def agent_health(spark, sf_dir):
    e = recent(t(spark, sf_dir, "events"), "'48' HOUR")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.round(F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY value)"), 6).alias("p95"), F.max("ts").alias("last_run"))


@query("stale_agents", f"SELECT user_id, last_run FROM (SELECT user_id, max(ts) AS last_run FROM events GROUP BY user_id), {NOW} WHERE last_run < now - INTERVAL 2 DAY")
def stale_agents(spark, sf_dir, interval="'2' DAY"):
    e = t(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last_run"))
    return last.crossJoin(F.broadcast(as_of(e))).where(F.expr(f"last_run < now - INTERVAL {interval}")).select("user_id", "last_run")


@query("hourly_analytics", "SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def hourly_analytics(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("channel_counts", "SELECT c.conv_id, c.n, c.last_turn, u.n_users FROM (SELECT conv_id, count(*) AS n, max(turn) AS last_turn FROM conversations GROUP BY 1) c JOIN (SELECT conv_id, count(DISTINCT role) AS n_users FROM conversations GROUP BY 1) u USING (conv_id)")
def channel_counts(spark, sf_dir):
    return t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last_turn"), F.countDistinct("role").alias("n_users"))


@query("briefing_sections", "SELECT 'today' AS section, count(*) AS n FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 1 DAY UNION ALL SELECT 'open', count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'urgent', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'")
def briefing_sections(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    now = o.agg(F.max("o_orderdate").alias("now"))
    return op.stats_row(today=o.crossJoin(F.broadcast(now)).where(F.expr("o_orderdate >= now - INTERVAL 1 DAY")), open=o.where("o_orderstatus = 'O'"), urgent=o.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'")).withColumnRenamed("metric", "section").withColumnRenamed("value", "n")


@query("case_context", "SELECT o_orderkey, count(*) AS filings, count(DISTINCT l_suppkey) AS sources, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def case_context(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("filings"), F.countDistinct("l_suppkey").alias("sources"), F.min("l_shipdate").alias("first_at"), F.max("l_shipdate").alias("last_at"))


@query("extension_breakdown", r"SELECT coalesce(nullif(regexp_extract(url, '\.(html)', 1), ''), 'none') AS ext, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS size FROM pages GROUP BY 1")
def extension_breakdown(spark, sf_dir):
    ext = F.coalesce(F.nullif(F.regexp_extract("url", r"\.(html)", 1), F.lit("")), F.lit("none"))
    return t(spark, sf_dir, "pages").groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("html")).cast("long").alias("size"))


@query("tag_systemic_report", "SELECT n_name, c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2 HAVING count(*) >= 3")
def tag_systemic_report(spark, sf_dir):
    c, n = t(spark, sf_dir, "customer"), t(spark, sf_dir, "nation")
    return c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean")).where("n >= 3")


@query("importer_validation", "SELECT 'lang' AS kind, lang AS k, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'no_text', 'all', count(*) FROM documents WHERE text IS NULL OR text = ''")
def importer_validation(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    one = lambda c: d.groupBy(c).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("kind"), F.col(c).alias("k"), "n")
    empty = d.where("text IS NULL OR text = ''").agg(F.count(F.lit(1)).alias("n")).select(F.lit("no_text").alias("kind"), F.lit("all").alias("k"), "n")
    return one("lang").unionByName(one("source")).unionByName(empty)


RETAIN = f"""
SELECT o_orderkey, class, CASE class WHEN 'spam' THEN o_orderdate + INTERVAL 90 DAY WHEN 'transactional' THEN o_orderdate + INTERVAL 365 DAY WHEN 'privileged' THEN NULL ELSE CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1825 DAY END END AS retain_until
FROM (SELECT o_orderkey, o_orderdate, o_orderstatus, coalesce(class, 'unknown') AS class FROM orders LEFT JOIN (SELECT doc_id, {CLASSIFY} AS class FROM documents) ON doc_id = o_orderkey)"""


def retention(spark, sf_dir):
    """Spam and transactional mail by age from creation, content by age from its deletion at the source, privileged never."""
    c = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("o_orderkey"), classify(F.col("source"), F.col("text")).alias("class"))
    o = t(spark, sf_dir, "orders").join(c, "o_orderkey", "left").withColumn("class", F.coalesce("class", F.lit("unknown")))
    until = F.expr("CASE class WHEN 'spam' THEN o_orderdate + INTERVAL 90 DAY WHEN 'transactional' THEN o_orderdate + INTERVAL 365 DAY WHEN 'privileged' THEN NULL ELSE CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1825 DAY END END")
    return o.select("o_orderkey", "class", until.alias("retain_until"))


query("retention_clock", RETAIN)(retention)


@query("retention_recompute", f"WITH r AS ({RETAIN}), o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL 1825 DAY END AS old FROM orders) SELECT count(*) FILTER (WHERE old IS NOT DISTINCT FROM retain_until) AS unchanged, count(*) FILTER (WHERE old IS NOT NULL AND retain_until IS NULL) AS set_null, count(*) FILTER (WHERE old IS DISTINCT FROM retain_until AND retain_until IS NOT NULL) AS updated FROM r JOIN o USING (o_orderkey)")
def retention_recompute(spark, sf_dir):
    old = t(spark, sf_dir, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL 1825 DAY END").alias("old"))
    j = retention(spark, sf_dir).join(old, "o_orderkey")
    same = F.col("old").eqNullSafe(F.col("retain_until"))
    return j.agg(F.count_if(same).alias("unchanged"), F.count_if(F.col("old").isNotNull() & F.col("retain_until").isNull()).alias("set_null"), F.count_if(~same & F.col("retain_until").isNotNull()).alias("updated"))


@query("purge_eligible", f"SELECT o_orderkey, retain_until FROM ({RETAIN}) WHERE retain_until < TIMESTAMP '2000-01-01' AND o_orderkey % 10 <> 0 ORDER BY retain_until, o_orderkey LIMIT 100")
def purge_eligible(spark, sf_dir, as_of="2000-01-01"):
    """Due, not on hold (every tenth case here), oldest first."""
    return retention(spark, sf_dir).where(F.col("retain_until") < F.lit(as_of).cast("timestamp_ntz")).where("o_orderkey % 10 <> 0").select("o_orderkey", "retain_until").orderBy("retain_until", "o_orderkey").limit(100)


@query("log_age_purge", f"SELECT event_type, count(*) AS kept FROM events, {NOW} WHERE ts >= now - (CASE WHEN event_type IN ('error', 'purchase') THEN INTERVAL 21 DAY ELSE INTERVAL 7 DAY END) GROUP BY 1")
def log_age_purge(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    kept = e.crossJoin(F.broadcast(as_of(e))).where(F.expr("ts >= now - CASE WHEN event_type IN ('error', 'purchase') THEN INTERVAL '21' DAY ELSE INTERVAL '7' DAY END"))
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


@query("canonical_records", """
WITH w AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, l_shipdate, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS rn FROM lineitem),
f AS (SELECT l_partkey, l_suppkey, l_orderkey, l_quantity FROM w WHERE rn = 1), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_suppkey) AS k, count(*) OVER (PARTITION BY l_partkey) AS sources FROM f)
SELECT l_partkey, l_suppkey AS canonical_source, sources, l_quantity > 25 AS available FROM r WHERE k = 1""")
def canonical_records(spark, sf_dir):
    """Newest record within each source, then the best source of each record, then availability."""
    l = t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")  # noqa: E741
    f = op.distinct_on(l, ["l_partkey", "l_suppkey"], F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber"))
    g = f.groupBy("l_partkey").agg(F.min_by(F.struct("l_suppkey", "l_quantity"), F.struct(-F.col("l_quantity"), F.col("l_suppkey"))).alias("b"), F.count(F.lit(1)).alias("sources"))
    return g.select("l_partkey", F.col("b.l_suppkey").alias("canonical_source"), "sources", (F.col("b.l_quantity") > 25).alias("available"))


@query("availability_recommendation", "SELECT l_partkey, CASE WHEN max(l_quantity) >= 45 THEN 'view' WHEN min(l_extendedprice) < 5000 THEN 'fetch_free' WHEN bool_or(l_returnflag = 'N') THEN 'fetch_paid' ELSE 'unavailable' END AS advice, min(l_extendedprice) AS cheapest FROM lineitem GROUP BY l_partkey")
def availability_recommendation(spark, sf_dir):
    advice = F.when(F.max("l_quantity") >= 45, "view").when(F.min("l_extendedprice") < 5000, "fetch_free").when(F.bool_or(F.col("l_returnflag") == "N"), "fetch_paid").otherwise("unavailable")
    return t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(advice.alias("advice"), F.min("l_extendedprice").alias("cheapest"))


@query("deadline_reminders", "SELECT o_orderkey, days FROM (SELECT o_orderkey, CAST(date_diff('day', CAST(TIMESTAMP '1996-06-01' AS DATE), CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders WHERE o_orderstatus <> 'F') WHERE days IN (7, 3, 1, 0) OR days BETWEEN -3 AND -1")
def deadline_reminders(spark, sf_dir, as_of="1996-06-01", before=(7, 3, 1), overdue=3):
    days = F.datediff(F.to_date("o_orderdate"), F.lit(as_of).cast("date")).cast("long")
    o = t(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", days.alias("days"))
    return o.where(F.col("days").isin(*before, 0) | F.col("days").between(-overdue, -1))


@query("enrichment_cost_report", "SELECT event_type, round(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) * 0.003::DOUBLE, 4) AS cost, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 5) AS important FROM events GROUP BY event_type")
def enrichment_cost_report(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum(k.cast("double")) * 0.003, 4).alias("cost"), F.count_if(k.cast("long") >= 5).alias("important"))


@query("promotion_candidates", "SELECT doc_id, n_chars FROM documents WHERE text LIKE '%|%' AND coalesce(n_chars, 0) > 200 ORDER BY n_chars DESC, doc_id LIMIT 30")
def promotion_candidates(spark, sf_dir):
    return t(spark, sf_dir, "documents").where(F.col("text").contains("|") & (F.coalesce("n_chars", F.lit(0)) > 200)).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(30)


@query("entity_records_latest", "SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS records FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def entity_records_latest(spark, sf_dir):
    top = op.distinct_on(t(spark, sf_dir, "customer"), ["c_nationkey"], F.desc("c_acctbal"), F.asc("c_custkey"))
    n = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("records"))
    return top.join(n, "c_custkey", "left").select("c_nationkey", "c_custkey", "c_name", F.coalesce("records", F.lit(0)).alias("records"))


@query("tool_sessions")
def tool_sessions(spark, sf_dir, gap="30 minutes"):
    """Runs of calls with no longer gap: an extra beside the chain query."""
    e = t(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")

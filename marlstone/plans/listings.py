"""Listings and reports that clients page through: cases, activity, status, calendars and folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.plans.registry import query
from marlstone.plans.relational import _sql
from marlstone.sources.tables import table as t

_sql("case_documents", "SELECT o.o_orderkey, p.p_partkey, p.p_name, coalesce(l.l_shipdate, o.o_orderdate) AS dated FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey WHERE o.o_orderkey = 7 ORDER BY coalesce(l.l_shipdate, o.o_orderdate) DESC, p.p_partkey", None, "orders", "lineitem", "part")
_sql("case_summary_all", "SELECT o.o_orderstatus, c.c_mktsegment, count(DISTINCT o.o_orderkey) AS cases, count(DISTINCT o.o_custkey) AS parties, count(l.l_linenumber) AS filings, max(l.l_shipdate) AS latest FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderstatus, c.c_mktsegment", None, "orders", "customer", "lineitem")
_sql("case_details", "SELECT o.o_orderkey, o.o_orderstatus, c.c_name, n.n_name, r.r_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey WHERE o.o_orderkey IN (1, 2, 3, 4, 5, 6, 7)", None, "orders", "customer", "nation", "region")
_sql("date_range_search", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-03-07' ORDER BY l_shipdate, l_orderkey, l_linenumber LIMIT 100", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-03-07' ORDER BY l_shipdate, l_orderkey, l_linenumber LIMIT 100", "lineitem")
_sql("recent_activity", "SELECT user_id, event_type, count(*) AS n, max(ts) AS last_at FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL '72' HOUR GROUP BY user_id, event_type", None, "events")
_sql("ingestion_status", "SELECT d.source, count(*) AS documents, count(e.vec_id) AS embedded, count(l.doc_id) AS labelled, round(100.0D * count(e.vec_id) / greatest(count(*), 1), 1) AS pct FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source", "SELECT d.source, count(*) AS documents, count(e.vec_id) AS embedded, count(l.doc_id) AS labelled, round(CAST(100 AS DOUBLE) * count(e.vec_id) / greatest(count(*), 1), 1) AS pct FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source", "documents", "embeddings", "labels")
_sql("tag_usage", "SELECT n.n_name AS tag, r.r_name AS parent, count(c.c_custkey) AS used FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name, r.r_name", None, "nation", "region", "customer")
_sql("entity_documents", "SELECT DISTINCT l.l_suppkey, l.l_orderkey FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE s.s_nationkey = 3", None, "lineitem", "supplier")
_sql("domain_totals", "SELECT d.lang, d.documents, d.chars, coalesce(v.vectors, 0) AS vectors FROM (SELECT lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang) d LEFT JOIN (SELECT x.lang, count(*) AS vectors FROM embeddings e JOIN documents x ON x.doc_id = e.vec_id GROUP BY x.lang) v ON v.lang = d.lang", None, "documents", "embeddings")
_sql("query_log_page", "SELECT event_id, user_id, event_type, value FROM events WHERE event_type <> 'view' AND value >= 10 ORDER BY ts DESC, event_id LIMIT 50 OFFSET 50", None, "events")
_sql("sessions_per_agent", "SELECT c.c_custkey, c.c_name, coalesce(s.n, 0) AS sessions, s.last_at FROM customer c LEFT JOIN (SELECT user_id, count(*) AS n, max(ts) AS last_at FROM events GROUP BY user_id) s ON s.user_id = c.c_custkey", None, "customer", "events")
_sql("property_timeline", "SELECT s_suppkey AS id, 'supplier' AS kind, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey UNION ALL SELECT c_custkey, 'customer', min(o_orderdate), max(o_orderdate) FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", None, "supplier", "lineitem", "customer", "orders")
_sql("quality_by_source", "SELECT d.source, count(*) AS n, round(avg(l.quality), 6) AS quality, CAST(sum(l.toxic) AS BIGINT) AS toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source", None, "documents", "labels")
_sql("error_share_24h", "SELECT user_id, count(*) AS n, round(100.0D * sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / count(*), 1) AS pct FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL '24' HOUR GROUP BY user_id", "SELECT user_id, count(*) AS n, round(CAST(100 AS DOUBLE) * sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / count(*), 1) AS pct FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL '24' HOUR GROUP BY user_id", "events")
_sql("folder_recursion", "WITH RECURSIVE f AS (SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, r_name AS name FROM region UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), n_name FROM nation), w(id, name) AS (SELECT id, name FROM f WHERE parent IS NULL AND name <> 'AFRICA' UNION ALL SELECT f.id, f.name FROM f JOIN w ON f.parent = w.id WHERE f.name NOT LIKE '%7%') SELECT id, name FROM w", None, "region", "nation")


@query("calendar_events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts AS start_at, ts + INTERVAL 30 MINUTE AS end_at FROM events WHERE event_type = 'signup'")
def calendar_events(spark, sf_dir):
    """Nested JSON read by an explicit schema and flattened."""
    e = t(spark, sf_dir, "events").where("event_type = 'signup'")
    return e.withColumn("p", F.from_json("props", "k long")).select("event_id", F.col("p.k").alias("k"), F.col("ts").alias("start_at"), F.expr("ts + INTERVAL 30 MINUTE").alias("end_at"))

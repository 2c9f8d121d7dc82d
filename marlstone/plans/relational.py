"""Joins, aggregates, windows, sorts, set operations and recursion over the mapped relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import relational as op
from marlstone.plans.registry import query
from marlstone.sources.tables import table as t
from marlstone.sources.tables import views

AS_OF = "(SELECT max(ts) FROM events)"


def _sql(name: str, spark_sql: str, oracle: str | None = None, *tables: str) -> None:
    """Register one statement that both engines read alike, or two where their dialects part."""

    def run(spark, sf_dir):
        views(spark, sf_dir, *tables)
        return spark.sql(spark_sql)

    run.__name__ = name
    query(name, oracle or spark_sql)(run)


# ---- filters and projections

@query("filter_optional_params", "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND n_chars >= 1000")
def filter_optional_params(spark, sf_dir, lang="en", source=None, least=1000):
    """Parameters that are not set do not filter."""
    d = t(spark, sf_dir, "documents")
    return op.where_all(d, F.col("lang") == lang if lang else None, F.col("source") == source if source else None, F.col("n_chars") >= least if least else None).select("doc_id", "lang", "source")


_sql("filter_ilike_contains", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%customer%1%' OR c_mktsegment ILIKE '%build%'", None, "customer")
_sql("filter_ilike_suffix", "SELECT page_id, url FROM pages WHERE url ILIKE '%.html'", None, "pages")


@query("filter_name_both_orders", "WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1) END AS name FROM part) SELECT p_partkey, name FROM n WHERE lower(name) LIKE '%small ring%' OR lower(name) LIKE '%ring, small%'")
def filter_name_both_orders(spark, sf_dir, first="Small", last="Ring"):
    """Names kept as "first last" or as "last, first"."""
    parts = F.split("p_name", " ")
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.get(parts, F.lit(1)), F.lit(", "), F.get(parts, F.lit(0))))
    p = t(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return p.where(F.col("name").ilike(f"%{first} {last}%") | F.col("name").ilike(f"%{last}, {first}%"))


@query("filter_regex", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)license') AND NOT regexp_matches(text, '!!')")
def filter_regex(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return d.where(F.col("text").rlike("(?i)license") & ~F.col("text").rlike("!!")).select("doc_id")


@query("filter_date_range_inclusive", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-03-31' + INTERVAL 1 DAY")
def filter_date_range_inclusive(spark, sf_dir, start="1996-01-01", end="1996-03-31"):
    o = t(spark, sf_dir, "orders")
    return o.where((F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.expr(f"CAST('{end}' AS timestamp_ntz) + INTERVAL 1 DAY"))).select("o_orderkey")


_sql("filter_relative_window", f"SELECT event_id, event_type FROM events WHERE ts > {AS_OF} - INTERVAL '24' HOUR", None, "events")


@query("filter_json_key", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 5")
def filter_json_key(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return t(spark, sf_dir, "events").where(k > 5).select("event_id", k.alias("k"))


_sql("filter_array_overlap", "SELECT vec_id FROM (SELECT vec_id, array(label, label + 1) AS a FROM embeddings) WHERE arrays_overlap(a, array(3, 9))", "SELECT vec_id FROM embeddings WHERE list_has_any([label, label + 1], [3, 9])", "embeddings")


@query("filter_off_hours_zone", "SELECT event_id, user_id FROM events WHERE extract(hour FROM (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles') NOT BETWEEN 6 AND 23")
def filter_off_hours_zone(spark, sf_dir):
    hour = F.hour(F.convert_timezone(F.lit("UTC"), F.lit("America/Los_Angeles"), F.col("ts")))
    return t(spark, sf_dir, "events").where(~hour.between(6, 23)).select("event_id", "user_id")


_sql("null_safe_equality", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE NOT (l.toxic <=> 0)", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic IS DISTINCT FROM 0", "documents", "labels")
_sql("case_severity_rank", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS severity FROM orders", None, "orders")
_sql("preview_projection", "SELECT doc_id, substring(text, 1, 200) AS preview, coalesce(nullif(source, ''), lang) AS title FROM documents", None, "documents")
_sql("text_search_three_columns", "SELECT p_partkey FROM part WHERE p_name ILIKE '%12%' OR p_brand ILIKE '%12%' OR p_type ILIKE '%steel%'", None, "part")


@query("paged_listing", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def paged_listing(spark, sf_dir, limit=50, offset=100):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return op.paged(o, limit, offset)


@query("select_gateway", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def select_gateway(spark, sf_dir, sql="SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey"):
    views(spark, sf_dir, "nation")
    return op.select_only(spark, sql)


@query("alias_resolution", "SELECT doc_id, lang, source FROM documents")
def alias_resolution(spark, sf_dir):
    """Columns by their older names are renamed where a frame comes in."""
    from marlstone.sources.tables import with_aliases

    old = t(spark, sf_dir, "documents").withColumnsRenamed({"doc_id": "id", "lang": "domain", "source": "mailbox"})
    return with_aliases(old).select("doc_id", "lang", "source")


@query("target_rules_match", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_name LIKE '%7'")
def target_rules_match(spark, sf_dir):
    """Exact and wildcard rules over a field, as one compiled condition."""
    c = t(spark, sf_dir, "customer")
    rules = spark.createDataFrame([("^BUILDING\\|",), ("7$",)], "pattern string")
    both = c.select("c_custkey", F.concat_ws("|", "c_mktsegment", "c_name").alias("both"))
    return op.rule_join(both, rules, "both", "pattern").select("c_custkey").distinct()


# ---- joins

_sql("join_inner_equi", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 300000", None, "orders", "customer")
_sql("join_left_chain", "SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey", None, "orders", "customer", "nation", "region")
_sql("join_bridge_mn", "SELECT DISTINCT o.o_orderkey, p.p_partkey, p.p_name FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey WHERE p.p_size = 10", None, "orders", "lineitem", "part")
_sql("join_self_parent", "SELECT a.conv_id, a.turn, b.turn AS reply_turn, b.role AS reply_role FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1", None, "conversations")
_sql("join_self_inequality", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey", None, "nation")


@query("join_cooccurrence", """
WITH x AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT a.p_brand AS brand_a, b.p_brand AS brand_b, count(*) AS n FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand GROUP BY 1, 2""")
def join_cooccurrence(spark, sf_dir):
    """Brands found in the same order."""
    x = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "p_brand").distinct()
    # Orders hold a few brands, so pairs are made within each order's sorted array and counted before the shuffle.
    sets = x.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("p_brand")).alias("b"))
    pairs = sets.select(F.explode(F.expr("flatten(transform(b, (x, i) -> transform(slice(b, i + 2, size(b)), y -> struct(x AS brand_a, y AS brand_b))))")).alias("p"))
    return pairs.groupBy("p.brand_a", "p.brand_b").agg(F.count(F.lit(1)).alias("n"))


@query("join_or_condition", "SELECT DISTINCT o.o_orderkey, c.c_custkey FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey OR c.c_custkey = o.o_orderkey")
def join_or_condition(spark, sf_dir):
    o, c = t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer")
    return op.any_of_join(o, c, [(["o_custkey"], ["c_custkey"]), (["o_orderkey"], ["c_custkey"])], ["o_orderkey"], ["c_custkey"])


@query("join_theta_rules", r"""
SELECT doc_id, tag FROM documents, (VALUES ('license', '(?i)license'), ('shout', '[A-Z]{4,}!!'), ('table', ' \| ')) r(tag, pattern) WHERE regexp_matches(text, pattern)""")
def join_theta_rules(spark, sf_dir):
    rules = spark.createDataFrame([("license", "(?i)license"), ("shout", "[A-Z]{4,}!!"), ("table", r" \| ")], "tag string, pattern string")
    return op.rule_join(t(spark, sf_dir, "documents"), rules, "text", "pattern").select("doc_id", "tag")


_sql("join_semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)", None, "customer", "orders")


@query("join_exists_flag", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_closed FROM customer")
def join_exists_flag(spark, sf_dir):
    closed = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return t(spark, sf_dir, "customer").select("c_custkey").join(closed, "c_custkey", "left").select("c_custkey", F.coalesce("hit", F.lit(False)).alias("has_closed"))


_sql("join_anti_left_null", "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000 WHERE o.o_orderkey IS NULL", None, "customer", "orders")
_sql("join_anti_not_exists", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)", None, "documents", "labels")
_sql("join_anti_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 AND l_partkey IS NOT NULL)", None, "part", "lineitem")


@query("join_not_exists_or_exists", """
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def join_not_exists_or_exists(spark, sf_dir):
    """Both tests from one aggregate over the orders."""
    agg = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("most"))
    return t(spark, sf_dir, "customer").select("c_custkey").join(agg, "c_custkey", "left").where("most IS NULL OR most > 300000").select("c_custkey")


@query("join_range_neighbours", "SELECT c.conv_id, c.turn, g.turn AS target_turn, c.turn = g.turn AS is_target FROM conversations c JOIN conversations g ON c.conv_id = g.conv_id AND c.turn BETWEEN g.turn - 1 AND g.turn + 1 WHERE g.role = 'user'")
def join_range_neighbours(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    out = op.neighbours(c.select("conv_id", "turn"), c.where("role = 'user'"), "conv_id", "turn", 1)
    return out.select("conv_id", "turn", F.col("target_index").alias("target_turn"), "is_target")


_sql("join_lateral_explode", "SELECT p_partkey, w FROM part LATERAL VIEW explode(split(p_type, ' ')) x AS w", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part", "part")


@query("join_scalar_counts", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS n_open FROM customer")
def join_scalar_counts(spark, sf_dir):
    """Correlated counts as one pre-aggregated left join."""
    agg = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("k"))
    return t(spark, sf_dir, "customer").select("c_custkey").join(agg, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("k", F.lit(0)).alias("n_open"))


@query("join_scalar_limit_one", "SELECT c_custkey, (SELECT o_orderpriority FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate, o_orderkey LIMIT 1) AS first_priority FROM customer")
def join_scalar_limit_one(spark, sf_dir):
    first = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("first_priority"))
    return t(spark, sf_dir, "customer").select("c_custkey").join(first, "c_custkey", "left")


_sql("join_preaggregated", "SELECT n.n_name, coalesce(s.n, 0) AS suppliers FROM nation n LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey) s ON s.s_nationkey = n.n_nationkey", None, "nation", "supplier")
_sql("join_scalar_subquery", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > (SELECT count(*) / count(DISTINCT l_suppkey) FROM lineitem)", None, "lineitem")
_sql("join_polymorphic_edge", "SELECT e.kind, e.id, coalesce(c.c_name, s.s_name) AS name FROM (SELECT 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier) e LEFT JOIN customer c ON e.kind = 'customer' AND c.c_custkey = e.id LEFT JOIN supplier s ON e.kind = 'supplier' AND s.s_suppkey = e.id", None, "customer", "supplier")


@query("join_fuzzy_best", """
WITH a AS (SELECT p_partkey, p_brand, p_type, p_size FROM part WHERE p_partkey % 5 = 0), b AS (SELECT p_partkey AS other, p_brand AS ob, p_type AS ot, p_size AS os FROM part WHERE p_partkey % 5 <> 0),
s AS (SELECT p_partkey, other, CASE WHEN ot = p_type AND os = p_size THEN 4 WHEN ot = p_type THEN 3 WHEN os = p_size THEN 2 ELSE 1 END AS score FROM a JOIN b ON ob = p_brand)
SELECT p_partkey, other, CAST(score AS BIGINT) AS score FROM s QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, other) = 1""")
def join_fuzzy_best(spark, sf_dir):
    """Best scored match of each part of one list in another one, the first on ties.

    A score names what must be equal, so the least candidate of each combination
    is found once and each level is one equi-join: no pair is built.
    """
    p = t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    a, b = p.where("p_partkey % 5 = 0"), p.where("p_partkey % 5 <> 0")
    out = a
    for score, keys in ((4, ["p_brand", "p_type", "p_size"]), (3, ["p_brand", "p_type"]), (2, ["p_brand", "p_size"]), (1, ["p_brand"])):
        out = out.join(b.groupBy(*keys).agg(F.min("p_partkey").alias(f"m{score}")), keys, "left")
    best = F.coalesce(*[F.when(F.col(f"m{s}").isNotNull(), F.struct(F.col(f"m{s}").alias("other"), F.lit(s).cast("long").alias("score"))) for s in (4, 3, 2, 1)])
    return out.withColumn("best", best).where("best IS NOT NULL").select("p_partkey", "best.other", "best.score")


# ---- aggregates

_sql("agg_basic", "SELECT lang, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars), 6) AS mean FROM documents GROUP BY lang", None, "documents")
_sql("agg_multi_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_returnflag", None, "lineitem")
_sql("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders GROUP BY o_orderpriority", None, "orders")
_sql("agg_distinct_filter", "SELECT lang, count(DISTINCT CASE WHEN n_chars > 1000 THEN source END) AS sources FROM documents GROUP BY lang", None, "documents")
_sql("agg_conditional_sums", "SELECT event_type, count(CASE WHEN value > 50 THEN 1 END) AS high, CAST(sum(CASE WHEN value <= 50 THEN 1 ELSE 0 END) AS BIGINT) AS low FROM events GROUP BY event_type", None, "events")
_sql("agg_having", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 12", None, "events")
_sql("agg_array_distinct", "SELECT source, array_join(array_sort(collect_set(lang)), ',') AS langs FROM documents GROUP BY source", "SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY source", "documents")
_sql("agg_listagg_ordered", "SELECT conv_id, listagg(role, '>') WITHIN GROUP (ORDER BY turn) AS roles FROM conversations GROUP BY conv_id", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id", "conversations")
_sql("agg_percentiles", "SELECT event_type, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 6) AS p95, round(percentile_cont(0.99) WITHIN GROUP (ORDER BY value), 6) AS p99 FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type", "events")
_sql("agg_ratio_guarded", "SELECT user_id, round(100.0D * count(CASE WHEN event_type = 'error' THEN 1 END) / greatest(count(*), 1), 1) AS error_pct FROM events GROUP BY user_id", "SELECT user_id, round(CAST(100.0 AS DOUBLE) * count(CASE WHEN event_type = 'error' THEN 1 END) / greatest(count(*), 1), 1) AS error_pct FROM events GROUP BY user_id", "events")
_sql("agg_rounded_average", "SELECT event_type, CAST(round(avg(value)) AS BIGINT) AS mean FROM events GROUP BY event_type", None, "events")
_sql("agg_json_object", "SELECT to_json(map_from_entries(array_sort(collect_list(struct(lang, n))))) AS stats FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)", "SELECT '{' || string_agg('\"' || lang || '\":' || n, ',' ORDER BY lang) || '}' AS stats FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)", "documents")


@query("agg_stats_row", " UNION ALL ".join(f"SELECT '{n}' AS metric, count(*) AS value FROM {n}" for n in ("documents", "pages", "events", "orders", "lineitem", "customer", "labels")))
def agg_stats_row(spark, sf_dir):
    return op.stats_row(**{n: t(spark, sf_dir, n) for n in ("documents", "pages", "events", "orders", "lineitem", "customer", "labels")})


_sql("agg_group_ordinals", "SELECT substring(o_orderpriority, 1, 1) AS p, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2", None, "orders")
_sql("agg_time_bucket", "SELECT date_trunc('hour', ts) AS h, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY date_trunc('hour', ts)", None, "events")
_sql("agg_json_key", "SELECT get_json_object(props, '$.k') AS k, count(*) AS n FROM events GROUP BY get_json_object(props, '$.k')", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1", "events")
_sql("agg_exploded_pivot", "SELECT w, count_if(p_size <= 10) AS small, count_if(p_size BETWEEN 11 AND 30) AS medium, count_if(p_size > 30) AS large FROM part LATERAL VIEW explode(split(p_type, ' ')) x AS w GROUP BY w", "SELECT w, count(*) FILTER (WHERE p_size <= 10) AS small, count(*) FILTER (WHERE p_size BETWEEN 11 AND 30) AS medium, count(*) FILTER (WHERE p_size > 30) AS large FROM (SELECT p_size, unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY w", "part")
_sql("agg_duplicate_groups", "SELECT md5(text) AS h, count(*) AS copies, count(*) - 1 AS extra FROM documents GROUP BY md5(text) HAVING count(*) > 1", None, "documents")
_sql("agg_entity_across_domains", "SELECT n.n_name, c.c_mktsegment, count(DISTINCT c.c_custkey) AS documents, count(*) AS mentions FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY n.n_name, c.c_mktsegment", None, "nation", "customer", "orders")


@query("agg_repeated_findings", r"""
SELECT regexp_replace(lower(event_type || ' took ' || CAST(CAST(value AS BIGINT) AS VARCHAR)), '[0-9]+', '#', 'g') AS signature, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen,
       array_to_string(list_slice(list_sort(list(DISTINCT user_id)), 1, 5), ',') AS samples
FROM events GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, signature LIMIT 20""")
def agg_repeated_findings(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    sig = F.regexp_replace(F.lower(F.concat("event_type", F.lit(" took "), F.round("value").cast("long").cast("string"))), "[0-9]+", "#")
    g = e.groupBy(sig.alias("signature")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.array_join(F.slice(F.array_sort(F.collect_set("user_id")), 1, 5), ",").alias("samples"))
    return g.where("n >= 3").orderBy(F.desc("n"), "signature").limit(20)


@query("agg_alert_fingerprint", "SELECT event_type, count(*) AS n, sha256(array_to_string(list_sort(list(DISTINCT user_id || ':' || event_type)), '|')) AS fingerprint FROM events GROUP BY event_type")
def agg_alert_fingerprint(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    details = F.array_sort(F.collect_set(F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type")))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(details, "|"), 256).alias("fingerprint"))


@query("agg_eval_score", """
SELECT doc_id, CAST(round(0.2 * (lang = 'en')::INT + 0.4 * (n_chars > 500)::INT + 0.3 * (source <> 'src0')::INT + 0.1, 6) AS DOUBLE) AS score, (0.2 * (lang = 'en')::INT + 0.4 * (n_chars > 500)::INT + 0.3 * (source <> 'src0')::INT + 0.1) >= 0.7 AS passed FROM documents""")
def agg_eval_score(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    s = F.lit(2) * (F.col("lang") == "en").cast("int") + F.lit(4) * (F.col("n_chars") > 500).cast("int") + F.lit(3) * (F.col("source") != "src0").cast("int") + F.lit(1)
    return d.select("doc_id", F.round(s / 10, 6).alias("score"), (s >= 7).alias("passed"))


@query("agg_pii_counts", r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS BIGINT) AS email, CAST(len(regexp_extract_all(text, '\(\d{3}\) ?\d{3}-\d{4}|\b\d{3}-\d{3}-\d{4}\b')) AS BIGINT) AS phone, CAST(len(regexp_extract_all(text, '\b(?:\d[ -]*?){13,16}\b')) AS BIGINT) AS card, CAST(len(regexp_extract_all(text, '(?i)\bMRN[: ]?\d{6,12}\b')) AS BIGINT) AS mrn, CAST(len(regexp_extract_all(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')) AS BIGINT) AS ip FROM documents""")
def agg_pii_counts(spark, sf_dir):
    counts = tx.pii_counts(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", *[counts[k].alias(k) for k in ("email", "phone", "card", "mrn", "ip")])


_sql("agg_drift_sets", "(SELECT 'only_a' AS side, n_name AS name FROM nation WHERE n_regionkey < 3 EXCEPT SELECT 'only_a', n_name FROM nation WHERE n_nationkey > 10) UNION ALL (SELECT 'only_b', n_name FROM nation WHERE n_nationkey > 10 EXCEPT SELECT 'only_b', n_name FROM nation WHERE n_regionkey < 3)", None, "nation")

# ---- windows


@query("window_rank_topk", "SELECT vec_id, label, row_number() OVER (ORDER BY label DESC, vec_id) AS rn FROM (SELECT vec_id, label FROM embeddings ORDER BY label DESC, vec_id LIMIT 40)")
def window_rank_topk(spark, sf_dir):
    """Ranks of the first rows: the limit comes first, so the global window sees those rows alone."""
    e = t(spark, sf_dir, "embeddings").select("vec_id", "label").orderBy(F.desc("label"), "vec_id").limit(40)
    return e.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("label"), "vec_id")).cast("long"))


@query("window_failure_streak", """
WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id FROM r WHERE rn <= 3 GROUP BY user_id HAVING count(*) = 3 AND bool_and(event_type = 'error')""")
def window_failure_streak(spark, sf_dir):
    r = op.top_per_key(t(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], 3, F.desc("ts"), F.desc("event_id"))
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("event_type") == "error").alias("bad")).where("n = 3 AND bad").select("user_id")


@query("window_lag_chains", """
WITH x AS (SELECT user_id, event_type, lag(event_type) OVER w AS prev, ts - lag(ts) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT prev, event_type AS next, count(*) AS n FROM x WHERE gap < INTERVAL 1 HOUR GROUP BY 1, 2 HAVING count(*) >= 3""")
def window_lag_chains(spark, sf_dir, gap_seconds=3600):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t(spark, sf_dir, "events").select("user_id", "event_type", F.lag("event_type").over(w).alias("prev"), (F.col("ts") - F.lag("ts").over(w)).alias("gap"))
    return e.where(F.expr(f"gap < INTERVAL '{gap_seconds}' SECOND")).groupBy("prev", F.col("event_type").alias("next")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query("window_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, (o_orderstatus = 'F') DESC, o_orderdate DESC NULLS LAST, o_orderkey")
def window_distinct_on(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return op.distinct_on(o, ["o_custkey"], (F.col("o_orderstatus") == "F").desc(), F.col("o_orderdate").desc_nulls_last(), F.asc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate")


_sql("window_previous_run", "SELECT d, n, n - lag(n) OVER (ORDER BY d) AS delta FROM (SELECT date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY date_trunc('day', ts))", None, "events")


@query("window_last_n_ascending", "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4")
def window_last_n_ascending(spark, sf_dir):
    c = op.top_per_key(t(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], 4, F.desc("turn"))
    return c.select("conv_id", "turn", "role").orderBy("conv_id", "turn")


_sql("window_lead_ranges", "SELECT conv_id, turn AS first_turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, max(turn) OVER (PARTITION BY conv_id)) AS last_turn FROM conversations WHERE role = 'user' OR turn = 0", None, "conversations")


@query("window_latest_wins", "SELECT user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def window_latest_wins(spark, sf_dir):
    return op.latest(t(spark, sf_dir, "events"), ["user_id"], "ts", F.desc("event_id")).select("user_id", "event_type", "ts")


# ---- sorting, sets, recursion

_sql("sort_nulls_last", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY l.quality DESC NULLS LAST, d.doc_id LIMIT 100", None, "documents", "labels")
_sql("sort_coalesced_key", "SELECT d.doc_id, coalesce(l.toxic, -1) AS k FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY coalesce(l.toxic, -1) DESC, d.doc_id LIMIT 50", None, "documents", "labels")
_sql("sort_case_order", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey LIMIT 75", None, "orders")
_sql("sort_text_as_number", "SELECT p_partkey, try_cast(regexp_replace(p_brand, '[^0-9]', '') AS INT) AS num FROM part ORDER BY try_cast(regexp_replace(p_brand, '[^0-9]', '') AS INT) NULLS LAST, p_partkey LIMIT 60", "SELECT p_partkey, try_cast(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INT) AS num FROM part ORDER BY 2 NULLS LAST, p_partkey LIMIT 60", "part")


@query("topk_branches_union", """
SELECT * FROM ((SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS stamp FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20) UNION ALL (SELECT 'ship', l_orderkey * 10 + l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber LIMIT 20) UNION ALL (SELECT 'event', event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 20)) ORDER BY stamp DESC, kind, id LIMIT 30""")
def topk_branches_union(spark, sf_dir):
    """A timeline: each branch keeps its newest rows before they meet."""
    parts = [
        t(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("stamp")),
        t(spark, sf_dir, "lineitem").select(F.lit("ship").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("stamp")),
        t(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("stamp")),
    ]
    a, b, c = (p.orderBy(F.desc("stamp"), "id").limit(20) for p in parts)
    return a.unionByName(b).unionByName(c).orderBy(F.desc("stamp"), "kind", "id").limit(30)


@query("stratified_sample")
def stratified_sample(spark, sf_dir, total=100):
    """30, 40 and 30 % from short, middling and long documents, the same rows each time."""
    tier = F.when(F.col("n_chars") < 800, "short").when(F.col("n_chars") < 3000, "middle").otherwise("long")
    return op.stratified(t(spark, sf_dir, "documents"), tier, {"short": 0.3, "middle": 0.4, "long": 0.3}, total, "doc_id").select("doc_id", "tier")


_sql("sort_strategy_composite", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_totalprice DESC, o_orderdate, o_orderkey LIMIT 40", None, "orders")
_sql("union_all_content", "SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, url FROM pages", None, "documents", "pages")
_sql("union_distinct_in", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT vec_id FROM embeddings WHERE label = 3)", None, "documents", "labels", "embeddings")


@query("merge_first_seen", """
WITH m AS (SELECT doc_id, 0 AS p, CAST(n_chars AS DOUBLE) AS s FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 1, CAST(n_chars * 2 AS DOUBLE) FROM documents WHERE source = 'src3')
SELECT doc_id, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, s DESC) AS rn FROM m) WHERE rn = 1 ORDER BY s DESC, doc_id LIMIT 25""")
def merge_first_seen(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    one = d.where("lang = 'de'").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    two = d.where("source = 'src3'").select("doc_id", (F.col("n_chars") * 2).cast("double").alias("score"))
    return op.first_seen_merge([one, two], "doc_id", "score", 25)


_sql("set_difference", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000", None, "customer", "supplier")
_sql("set_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None, "customer", "supplier")

TREE = """
  SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, r_name AS name FROM region
  UNION ALL SELECT 100 + n_nationkey, CAST(n_regionkey AS BIGINT), n_name FROM nation
  UNION ALL SELECT 1000 + s_suppkey, 100 + CAST(s_nationkey AS BIGINT), s_name FROM supplier"""

_sql("recursive_hierarchy", f"WITH RECURSIVE tags AS ({TREE}), h(id, name, path, depth) AS (SELECT id, name, name, 0 FROM tags WHERE parent IS NULL UNION ALL SELECT t.id, t.name, concat(h.path, ' > ', t.name), h.depth + 1 FROM tags t JOIN h ON t.parent = h.id) SELECT id, path, CAST(depth AS BIGINT) AS depth FROM h", None, "region", "nation", "supplier")
_sql("recursive_descendants", f"WITH RECURSIVE tags AS ({TREE}), h(id) AS (SELECT id FROM tags WHERE name = 'ASIA' UNION ALL SELECT t.id FROM tags t JOIN h ON t.parent = h.id) SELECT id FROM h", None, "region", "nation", "supplier")
_sql("recursive_counts", f"WITH RECURSIVE tags AS ({TREE}), h(root, id) AS (SELECT id, id FROM tags WHERE id < 1000 UNION ALL SELECT h.root, t.id FROM tags t JOIN h ON t.parent = h.id) SELECT root, count(DISTINCT id) - 1 AS below FROM h GROUP BY root", None, "region", "nation", "supplier")


@query("merge_tasks_dedup", "SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_key FROM orders GROUP BY 1, 2")
def merge_tasks_dedup(spark, sf_dir):
    """One task for each key tuple, the first given."""
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("first_key"))
    return op.distinct_on(o, ["o_custkey", "o_orderpriority"], F.asc("first_key"))

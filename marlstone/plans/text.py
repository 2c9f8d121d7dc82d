"""Text dataflow: extraction, chunking, classification, tagging and formatting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.functions.vectors import printed
from marlstone.operators import chunking as ch
from marlstone.operators import relational as op
from marlstone.operators.tables import Written
from marlstone.plans.registry import query
from marlstone.sources.tables import MAGIC, crawlable, magic, normalise_url
from marlstone.sources.tables import table as t


@query("html_title_links", r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '(?i)<a\b[^>]*?href=[\"'']([^\"''#][^\"'']*)[\"'']', 1)) AS BIGINT) AS links FROM pages")
def html_title_links(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", tx.html_title(F.col("html")).alias("title"), F.size(tx.html_links(F.col("html"))).cast("long").alias("links"))


@query("html_plain_text")
def html_plain_text(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


@query("url_normalise", r"SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages")
def url_normalise(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", normalise_url(F.col("url")).alias("url"))


@query("url_crawlable", r"SELECT page_id, NOT regexp_matches(lower(url), '\.(css|js|png|jpg|zip)([?#]|$)') AS ok FROM pages")
def url_crawlable(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", crawlable(F.col("url")).alias("ok"))


@query("crawl_frontier")
def crawl_frontier(spark, sf_dir, depth=2):
    """Breadth-first levels over the page table's own links, which are taken from the pages once: each level anti-joins what was seen."""
    out = Written(spark)
    p = t(spark, sf_dir, "pages").select("page_id", normalise_url(F.col("url")).alias("u"), "html")
    host = F.regexp_extract("u", r"^(https?://[^/]+)", 1)
    found = p.select("u", F.explode(tx.html_links(F.col("html"))).alias("l")).select("u", F.when(F.col("l").startswith("/"), F.concat(host, "l")).otherwise(F.col("l")).alias("to"))
    links = out.keep(found.distinct(), "links")
    seen = out.keep(p.where("page_id < 20").select("u").distinct().withColumn("level", F.lit(0)), "l0")
    edge = seen
    for k in range(1, depth + 1):
        edge = out.keep(edge.join(links, "u").select(F.col("to").alias("u")).distinct().join(seen, "u", "left_anti").withColumn("level", F.lit(k)), f"l{k}")
        seen = seen.unionByName(edge)
    return seen


@query("magic_bytes", """
SELECT page_id, CASE WHEN page_id % 9 < 5 THEN ['pdf', 'png', 'jpg', 'gif', 'zip'][(page_id % 9 + 1)::INT] WHEN page_id % 9 = 5 THEN 'eml' WHEN page_id % 9 = 6 OR coalesce(html, '') = '' THEN 'unknown'
  WHEN regexp_matches(lower(html), '^ *(<!doctype html|<html)') THEN 'html' ELSE 'unknown' END AS kind FROM pages""")
def magic_bytes(spark, sf_dir):
    """Kinds by first bytes: pages as they are, and behind the first bytes of every other kind."""
    p = t(spark, sf_dir, "pages").withColumn("k", F.col("page_id") % 9)
    first = F.when(F.col("k") == 5, F.encode(F.lit("Received: "), "UTF-8")).when(F.col("k") == 6, F.encode(F.lit("plain text "), "UTF-8"))
    for i, (_, start) in enumerate(MAGIC):
        first = first.when(F.col("k") == i, F.unhex(F.lit(start)))
    content = F.concat(F.coalesce(first, F.lit(b"")), F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    return p.select("page_id", magic(content).alias("kind"))


@query("content_hash", "SELECT doc_id, substring(sha256(text), 1, 16) AS h, md5(source || ':' || 0) AS chunk_id FROM documents")
def content_hash(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("h"), F.md5(F.concat("source", F.lit(":0"))).alias("chunk_id"))


@query("chunk_windows", "SELECT doc_id, count(*) AS n, CAST(sum(length(c)) AS BIGINT) AS total FROM (SELECT doc_id, substring(text, i * 800 + 1, 1000) AS c FROM documents, unnest(range(0, greatest(1, ceil((length(text) - 200) / 800.0)::BIGINT))) u(i)) GROUP BY doc_id")
def chunk_windows(spark, sf_dir):
    w = ch.windows_sql(t(spark, sf_dir, "documents"), "text", 1000, 200)
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).cast("long").alias("total"))


def _chunks(method: str, **kw):
    def run(spark, sf_dir):
        return ch.chunk(t(spark, sf_dir, "documents").select("doc_id", "text"), "text", method, **kw).drop("text")

    run.__name__ = f"chunk_{method}"
    query(run.__name__)(run)


_chunks("recursive")
_chunks("window", overlap=200)
_chunks("snapped", overlap=200)
_chunks("paragraph", overlap=1)


@query("segment_mail")
def segment_mail(spark, sf_dir):
    """Mail parts of each message, with the turn before it quoted below."""
    c = t(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    quoted = F.concat(F.lit("\n\nOn Monday the writer wrote:\n> "), F.regexp_replace(before, "\n", "\n> "))
    body = F.concat(F.col("text"), F.lit("\n-- \nSynthetic Sender\n"), F.coalesce(quoted, F.lit("")))
    return ch.segment(c.select("conv_id", "turn", body.alias("body")), "body").drop("body")


@query("route_by_type", "SELECT doc_id, CASE WHEN n_chars < 400 THEN 'message' WHEN text LIKE '% | %' THEN 'table' ELSE 'document' END AS kind, n_chars >= 400 AND text NOT LIKE '% | %' AS embeds FROM documents")
def route_by_type(spark, sf_dir):
    kind = F.when(F.col("n_chars") < 400, "message").when(F.col("text").contains(" | "), "table").otherwise("document")
    return t(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), (kind == "document").alias("embeds"))


@query("context_prefix", "SELECT doc_id, '<context>' || chr(10) || 'From ' || source || ', a ' || lang || ' document' || CASE WHEN doc_id % 2 = 0 THEN ' in case ' || doc_id ELSE '' END || '.' || chr(10) || '</context>' || chr(10) AS prefix FROM documents")
def context_prefix(spark, sf_dir):
    case = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string"))
    return t(spark, sf_dir, "documents").select("doc_id", tx.context_prefix(F.col("source"), F.col("lang"), F.lit("document"), case).alias("prefix"))


@query("case_numbers", r"""
WITH x AS (SELECT o_orderkey, lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '-2-' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') || '-' || 10 + o_orderkey % 90 AS state, lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') AS n, o_orderkey % 3 AS form FROM orders)
SELECT o_orderkey, array_to_string(list_sort([state, CASE form WHEN 0 THEN '219CV' || n WHEN 1 THEN '219CV' || n || 'RSM' ELSE '1223CV' || n || 'AB' END]), ',') AS cases FROM x""")
def case_numbers(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    state = F.format_string("%02d-2-%05d-%d", F.col("o_orderkey") % 100, F.col("o_orderkey") % 100000, 10 + F.col("o_orderkey") % 90)
    n, form = F.format_string("%05d", F.col("o_custkey") % 100000), F.col("o_orderkey") % 3
    federal = F.when(form == 0, F.concat(F.lit("2:19-CV-"), n, F.lit(" x"))).when(form == 1, F.concat(F.lit("2:19-cv-"), n, F.lit("-rsm"))).otherwise(F.concat(F.lit("1223CV"), n, F.lit("AB")))
    s = F.concat(F.lit("Re "), state, F.lit(" and "), federal)
    return o.select("o_orderkey", F.array_join(tx.case_numbers(s), ",").alias("cases"))


@query("case_number_from_path", r"SELECT page_id, regexp_extract(url, '/([0-9]+)(?:[/.?#]|$)', 1) AS number FROM pages")
def case_number_from_path(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"/([0-9]+)(?:[/.?#]|$)", 1).alias("number"))


#: Synthetic rule sets; a deployment passes its own.
PRIVILEGED, TRANSACTIONAL, SPAM = ("src1", "src2"), ("src3", "src4"), ("src5",)


def classify(source, text):
    return F.when(source.isin(*PRIVILEGED), "privileged").when(text.rlike("(?i)license"), "content").when(source.isin(*TRANSACTIONAL), "transactional").when(source.isin(*SPAM) | text.rlike("!!"), "spam").otherwise("content")


CLASSIFY = "CASE WHEN source IN ('src1','src2') THEN 'privileged' WHEN regexp_matches(text, '(?i)license') THEN 'content' WHEN source IN ('src3','src4') THEN 'transactional' WHEN source = 'src5' OR regexp_matches(text, '!!') THEN 'spam' ELSE 'content' END"


@query("classify_mail", f"SELECT doc_id, {CLASSIFY} AS class FROM documents")
def classify_mail(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", classify(F.col("source"), F.col("text")).alias("class"))


@query("inherit_parent_class", f"WITH c AS (SELECT doc_id, {CLASSIFY} AS class FROM documents) SELECT e.vec_id, coalesce(c.class, 'unknown') AS class FROM embeddings e LEFT JOIN c ON c.doc_id = e.vec_id")
def inherit_parent_class(spark, sf_dir):
    c = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), classify(F.col("source"), F.col("text")).alias("class"))
    return t(spark, sf_dir, "embeddings").select("vec_id").join(c, "vec_id", "left").select("vec_id", F.coalesce("class", F.lit("unknown")).alias("class"))


@query("auto_tag_rules", r"""
WITH h AS (SELECT doc_id, tag FROM documents, (VALUES ('license', '(?i)\blicense\b'), ('contact', '@[a-z0-9.-]+\.com'), ('shout', '!!')) r(tag, p) WHERE regexp_matches(text, p) AND doc_id NOT IN (SELECT doc_id FROM labels))
SELECT doc_id, tag FROM h UNION SELECT doc_id, 'any' FROM h""")
def auto_tag_rules(spark, sf_dir):
    """Rules by regular expression over documents that carry no label, with an umbrella tag."""
    rules = spark.createDataFrame([("license", r"(?i)\blicense\b"), ("contact", r"@[a-z0-9.-]+\.com"), ("shout", "!!")], "tag string, p string")
    free = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "text")
    hits = op.rule_join(free, rules, "text", "p").select("doc_id", "tag")
    return hits.unionByName(hits.select("doc_id", F.lit("any").alias("tag"))).distinct()


@query("first_matching_category", "SELECT doc_id, CASE WHEN text ILIKE '%apache%' THEN 'apache' WHEN text ILIKE '%gnu%' THEN 'gnu' WHEN text ILIKE '%license%' THEN 'other' ELSE 'none' END AS category FROM documents")
def first_matching_category(spark, sf_dir, categories=(("apache", "apache"), ("gnu", "gnu"), ("other", "license"))):
    out = F.when(F.lit(False), "")
    for name, word in categories:
        out = out.when(F.col("text").ilike(f"%{word}%"), name)
    return t(spark, sf_dir, "documents").select("doc_id", out.otherwise("none").alias("category"))


@query("extract_date_name", r"SELECT doc_id, nullif(regexp_extract(text, '(\d{3}\.\d{1,3}\.\d{1,3}\.\d{1,3})', 1), '') AS address, nullif(regexp_extract(text, 'Version (\d+\.\d+)', 1), '') AS version FROM documents")
def extract_date_name(spark, sf_dir):
    pick = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    return t(spark, sf_dir, "documents").select("doc_id", pick(r"(\d{3}\.\d{1,3}\.\d{1,3}\.\d{1,3})").alias("address"), pick(r"Version (\d+\.\d+)").alias("version"))


@query("sender_parse", """
SELECT c_custkey, 'customer#' || c_custkey || '@' || lower(c_mktsegment) || '.example' AS address, lower(c_mktsegment) || '.example' AS domain, c_name AS name FROM customer""")
def sender_parse(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    raw = F.concat(F.lit('"'), "c_name", F.lit('" <Customer#'), F.col("c_custkey").cast("string"), F.lit("@"), "c_mktsegment", F.lit(".example>"))
    a = tx.sender_address(raw)
    return c.select("c_custkey", a.alias("address"), tx.address_domain(a).alias("domain"), tx.sender_name(raw).alias("name"))


@query("first_two_lines", r"SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 1 AND NOT starts_with(x, '>') AND regexp_matches(x, '[\p{L}\p{N}]')), 1, 2), ' · ') AS lines FROM documents")
def first_two_lines(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", tx.two_lines(F.col("text")).alias("lines"))


@query("sms_format", "SELECT conv_id, turn, substring(role || ': ' || CASE WHEN length(text) > 100 THEN substring(text, 1, 97) || '...' ELSE text END, 1, 160) AS sms FROM conversations")
def sms_format(spark, sf_dir, part=100, most=160):
    short = F.when(F.length("text") > part, F.concat(F.substring("text", 1, part - 3), F.lit("..."))).otherwise(F.col("text"))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring(F.concat("role", F.lit(": "), short), 1, most).alias("sms"))


@query("garbage_text", r"SELECT doc_id, length(regexp_replace(substring(text, 1, 2000), '[\x00-\x7F]', '', 'g')) > length(substring(text, 1, 2000)) * 0.4 AS garbage FROM documents")
def garbage_text(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", tx.garbage(F.col("text")).alias("garbage"))


@query("ocr_acceptance", "SELECT doc_id, NOT (length(trim(text)) = 0 OR length(text) - length(replace(text, '|', '')) > 0.1 * length(text) OR length(text) < 0.5 * n_chars) AS accepted FROM documents")
def ocr_acceptance(spark, sf_dir):
    """Output that is empty, mostly padding or shrunk is refused."""
    pad = F.length("text") - F.length(F.replace(F.col("text"), F.lit("|"), F.lit("")))
    bad = (F.length(F.trim("text")) == 0) | (pad > 0.1 * F.length("text")) | (F.length("text") < 0.5 * F.col("n_chars"))
    return t(spark, sf_dir, "documents").select("doc_id", (~bad).alias("accepted"))


@query("noise_predicate", "SELECT p_partkey, regexp_matches(lower(p_type), '(tin|small)') AND p_size < 20 AS noise FROM part")
def noise_predicate(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", (F.lower("p_type").rlike("(tin|small)") & (F.col("p_size") < 20)).alias("noise"))


@query("template_fill", "SELECT c_custkey, 'Dear ' || c_name || ', your segment is ' || c_mktsegment || '. Ref: -' AS letter FROM customer")
def template_fill(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    variables = F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment")
    return c.select("c_custkey", tx.fill_template(F.lit("Dear {{ name }}, your segment is {{segment}}. Ref: {{ref}}"), variables, "-").alias("letter"))


@query("task_keywords", "SELECT doc_id, CAST(len(list_intersect(list_distinct(string_split(lower(text), ' ')), ['license', 'public', 'version', 'work'])) AS BIGINT) >= 2 AS legal FROM documents")
def task_keywords(spark, sf_dir, words=("license", "public", "version", "work")):
    hits = F.size(F.array_intersect(F.split(F.lower("text"), " "), F.array(*[F.lit(w) for w in words])))
    return t(spark, sf_dir, "documents").select("doc_id", (hits >= 2).alias("legal"))


@query("config_normalise", "SELECT 'mailboxes' AS name, 'a@court.example,b@counsel.example' AS list, 'db' AS source")
def config_normalise(spark, sf_dir):
    """Trimmed, lowered, first-seen distinct values; a command line wins over stored values, those over defaults."""
    df = spark.createDataFrame([("mailboxes", None, [" A@court.example", "b@counsel.example ", "a@court.example"], ["x@default.example"])], "name string, cli array<string>, db array<string>, base array<string>")
    clean = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    full = lambda c: c.isNotNull() & (F.size(c) > 0)
    pick = F.when(full(F.col("cli")), F.col("cli")).when(full(F.col("db")), F.col("db")).otherwise(F.col("base"))
    source = F.when(full(F.col("cli")), "cli").when(full(F.col("db")), "db").otherwise("default")
    return df.select("name", F.array_join(clean(pick), ",").alias("list"), source.alias("source"))


@query("token_estimate", "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("attachment_rollup", "SELECT conv_id, string_agg('[Attachment: ' || role || turn || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS rollup FROM conversations GROUP BY conv_id")
def attachment_rollup(spark, sf_dir):
    part = F.concat(F.lit("[Attachment: "), "role", F.col("turn").cast("string"), F.lit("]\n"), "text")
    return t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("rollup"))


@query("filename_match_key", r"SELECT p_partkey, lower(regexp_replace(p_name, '[^\p{L}\p{N}]', '', 'g')) AS k, regexp_replace(p_type, '[^A-Za-z0-9._-]+', '_', 'g') AS path FROM part")
def filename_match_key(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", tx.match_name(F.col("p_name")).alias("k"), tx.safe_name(F.col("p_type")).alias("path"))


@query("header_lines_dates", r"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def header_lines_dates(spark, sf_dir):
    """m/d/y dates to ISO."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "M/d/yyyy").alias("mdy"))
    return o.select("o_orderkey", F.date_format(F.to_date("mdy", "M/d/yyyy"), "yyyy-MM-dd").alias("iso"))


@query("vector_literal", "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', CAST(x AS DOUBLE))), ',') || ']' AS v FROM embeddings")
def vector_literal(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").select("vec_id", printed(F.col("embedding")).alias("v"))


@query("csv_rows", "SELECT n_nationkey, n_nationkey || ' | ' || n_name || ' | ' || n_regionkey AS line FROM nation")
def csv_rows(spark, sf_dir):
    """Non-empty cells joined, as the table extractor gives them."""
    n = t(spark, sf_dir, "nation")
    line = F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name", F.lit(""), F.col("n_regionkey").cast("string"))
    return n.select("n_nationkey", F.array_join(F.filter(F.split(line, ","), lambda x: F.trim(x) != ""), " | ").alias("line"))


@query("plain_text_cap", "SELECT doc_id, CAST(length(substring(text, 1, 500000)) AS BIGINT) AS n FROM documents")
def plain_text_cap(spark, sf_dir, most=500_000):
    return t(spark, sf_dir, "documents").select("doc_id", F.length(F.substring("text", 1, most)).cast("long").alias("n"))


@query("byte_size_pretty", "SELECT doc_id, CASE WHEN n_chars < 10240 THEN n_chars || ' bytes' ELSE CAST(round(n_chars / 1024.0) AS BIGINT) || ' kB' END AS size FROM documents")
def byte_size_pretty(spark, sf_dir):
    n = F.col("n_chars")
    return t(spark, sf_dir, "documents").select("doc_id", F.when(n < 10240, F.concat(n.cast("string"), F.lit(" bytes"))).otherwise(F.concat(F.round(n / 1024.0).cast("long").cast("string"), F.lit(" kB"))).alias("size"))

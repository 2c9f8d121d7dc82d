"""Retrieval queries: documents stand for texts, embeddings for their vectors (vec_id = doc_id)."""

from __future__ import annotations

import time
from functools import lru_cache

from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.functions import vectors as vx
from marlstone.operators import relational as op
from marlstone.operators import retrieval as rt
from marlstone.operators.chunking import windows_sql
from marlstone.operators.index import KEY, RetrievalIndex, fingerprint, whole
from marlstone.plans.registry import query
from marlstone.sources.tables import table as t

QUERY = "license public"
VECTOR_ID = 7


#: Seconds that a query vector is remembered for.
REMEMBERED = 300


@lru_cache(maxsize=64)
def _vector(session_id: str, sf_dir: str, vec_id: int, period: int) -> tuple[float, ...]:
    from pyspark.sql import SparkSession

    row = t(SparkSession.active(), sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return tuple(row["embedding"]) if row else ()


def vector(spark, sf_dir: str, vec_id: int = VECTOR_ID) -> list[float]:
    """The query vector: one row, looked up as a client's embedding call would give it."""
    return list(_vector(spark.sparkContext.applicationId, sf_dir, vec_id, int(time.time() // REMEMBERED)))


COS = "round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 6)"
STOP = ", ".join(f"'{w}'" for w in tx.STOP)
TOKENS = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND w NOT IN ({STOP}))"
SEM = f"SELECT e.vec_id AS id, {COS} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {VECTOR_ID}) q ORDER BY similarity DESC, id LIMIT 40"
#: The words of the tables' vocabularies that have the stems of the query's words.
FORMS = (r"'^licens(e|es|ed|ing|ings)$'", r"'^public(s|ly|ation|ations|ity|ist|ists)?$'")


def fts(where: str = "TRUE") -> str:
    """Documents with both words, by cover density: shortest ranges that hold both, each worth 0.1 over one and its other words."""
    one = lambda k: f"regexp_matches(w, {FORMS[k]})"
    return rf"""(WITH tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS t FROM documents WHERE {where}),
places AS (SELECT doc_id, p, w FROM (SELECT doc_id, unnest(range(len(t))) AS p, unnest(t) AS w FROM tok) WHERE {one(0)} OR {one(1)}),
seen AS (SELECT doc_id, p, row_number() OVER o AS i, least(max(CASE WHEN {one(0)} THEN p END) OVER o, max(CASE WHEN {one(1)} THEN p END) OVER o) AS begin, max(CASE WHEN {one(0)} THEN p END) OVER o IS NOT NULL AND max(CASE WHEN {one(1)} THEN p END) OVER o IS NOT NULL AS whole FROM places WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
covers AS (SELECT c.doc_id, c.p, c.begin, c.i - s.i + 1 AS own FROM (SELECT *, lag(begin) OVER (PARTITION BY doc_id ORDER BY p) AS earlier FROM seen WHERE whole) c JOIN seen s ON s.doc_id = c.doc_id AND s.p = c.begin WHERE c.earlier IS NULL OR c.begin > c.earlier)
SELECT doc_id AS id, round(sum(0.1::DOUBLE / (1 + (p - begin + 1 - own))), 6) AS rank FROM covers GROUP BY doc_id ORDER BY rank DESC, id LIMIT 40)"""


FTS = fts()


@query("semantic_search", f"SELECT e.vec_id, e.label, {COS} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {VECTOR_ID}) q WHERE {COS} >= 0.1 ORDER BY similarity DESC, e.vec_id LIMIT 10")
def semantic_search(spark, sf_dir, k=10, least=0.1):
    return rt.semantic(t(spark, sf_dir, "embeddings"), vector(spark, sf_dir), k, least=least).select("vec_id", "label", "similarity")


@query("semantic_search_filtered", f"SELECT e.vec_id, {COS} AS similarity FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = {VECTOR_ID}) q WHERE d.lang = 'en' ORDER BY similarity DESC, e.vec_id LIMIT 10")
def semantic_search_filtered(spark, sf_dir):
    """Domain filter as a semi-join, so documents in several cases are not counted twice."""
    en = t(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return rt.semantic(t(spark, sf_dir, "embeddings").join(en, "vec_id", "left_semi"), vector(spark, sf_dir), 10).select("vec_id", "similarity")


@query("semantic_batch", f"""
SELECT query_id, vec_id, similarity, rn FROM (SELECT q.vec_id AS query_id, e.vec_id, {COS} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, e.vec_id) AS rn
FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q) WHERE rn <= 5""")
def semantic_batch(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return rt.semantic_batch(e, q, 5)


@query("fulltext_search", f"SELECT id AS doc_id, rank FROM {FTS} ORDER BY rank DESC, doc_id LIMIT 10")
def fulltext_search(spark, sf_dir, q=QUERY, k=10):
    """By cover density over stems, from the postings of the query's words alone."""
    return document_index(spark, sf_dir).fulltext(q, k).select("doc_id", "rank")


@query("fulltext_websearch_syntax", f"SELECT doc_id FROM (SELECT doc_id, {TOKENS} AS tok FROM documents) WHERE (list_contains(tok, 'apache') AND NOT list_contains(tok, 'version')) OR (contains(' ' || array_to_string(tok, ' ') || ' ', ' general public license ') )")
def fulltext_websearch_syntax(spark, sf_dir, q='apache -version or "general public license"'):
    d = t(spark, sf_dir, "documents").withColumn("tok", tx.terms(F.col("text")))
    return d.where(tx.matches(F.col("tok"), q)).select("doc_id")


@query("fulltext_headline")
def fulltext_headline(spark, sf_dir):
    """The best documents with the words around their best cover."""
    index = document_index(spark, sf_dir)
    found = index.fulltext(QUERY, 10)
    return index.headlines(found, QUERY, t(spark, sf_dir, "documents"), "text").select("doc_id", "rank", "headline").orderBy(F.desc("rank"), "doc_id")


@query("fulltext_phrase_or_prefix", r"""
WITH tok AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> ''), ' ') || ' ' AS t FROM documents)
SELECT doc_id FROM tok WHERE (regexp_matches(t, ' general public(s|ly|ation|ations|ity|ist|ists)? licens(e|es|ed|ing|ings) ') AND NOT regexp_matches(t, ' apache(s)? ')) OR regexp_matches(t, ' warrant[^ ]* ')""")
def fulltext_phrase_or_prefix(spark, sf_dir, q='"general public license" -apache or warrant*'):
    """A phrase without a word, or any word with a beginning, by positions."""
    return document_index(spark, sf_dir).hits(q).select("doc_id")


@query("hybrid_rrf", f"""
WITH s AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS rs FROM ({SEM})), f AS (SELECT id, row_number() OVER (ORDER BY rank DESC, id) AS rf FROM {FTS})
SELECT coalesce(s.id, f.id) AS id, rs AS left_rank, rf AS right_rank, round(coalesce(0.7::DOUBLE / (60 + rs), 0) + coalesce(0.3::DOUBLE / (60 + rf), 0), 6) AS score FROM s FULL JOIN f ON f.id = s.id ORDER BY score DESC, id LIMIT 10""")
def hybrid_rrf(spark, sf_dir, k=10):
    """The flagship: both sides' best 4k, fused by weighted reciprocal ranks."""
    sem = rt.semantic(t(spark, sf_dir, "embeddings"), vector(spark, sf_dir), 4 * k).select(F.col("vec_id").alias("id"), "similarity")
    ft = document_index(spark, sf_dir).fulltext(QUERY, 4 * k).select(F.col("doc_id").alias("id"), "rank")
    return rt.rank_fusion(rt.numbered(sem, F.desc("similarity"), F.asc("id")), rt.numbered(ft, F.desc("rank"), F.asc("id")), "id", k)


@query("bm25_search", f"""
WITH tok AS (SELECT doc_id, {TOKENS} AS tok FROM documents), st AS (SELECT count(*) AS n, avg(len(tok)) AS m FROM tok),
h AS (SELECT * FROM (SELECT doc_id, len(tok) AS l, 'license' AS term, len(list_filter(tok, lambda x: regexp_matches(x, {FORMS[0]}))) AS tf FROM tok UNION ALL SELECT doc_id, len(tok), 'public', len(list_filter(tok, lambda x: regexp_matches(x, {FORMS[1]}))) FROM tok) WHERE tf > 0), d AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m))), 6) AS score FROM h JOIN d USING (term), st GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""")
def bm25_search(spark, sf_dir, q=QUERY):
    return document_index(spark, sf_dir).bm25(q, 10).select("doc_id", "score")


@query("best_chunk_per_document", "SELECT conv_id, turn, score FROM (SELECT conv_id, turn, length(text) % 97 AS score, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) % 97 DESC, turn) AS rn FROM conversations) WHERE rn = 1 ORDER BY score DESC, conv_id LIMIT 20")
def best_chunk_per_document(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 97).cast("long").alias("score"))
    return op.distinct_on(c, ["conv_id"], F.desc("score"), F.asc("turn")).orderBy(F.desc("score"), "conv_id").limit(20)


@query("two_chunks_per_document", "SELECT conv_id, turn, score FROM (SELECT conv_id, turn, length(text) % 97 AS score, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) % 97 DESC, turn) AS rn FROM conversations) WHERE rn <= 2 ORDER BY score DESC, conv_id, turn LIMIT 30")
def two_chunks_per_document(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 97).cast("long").alias("score"))
    return rt.cap_per_document(c, "conv_id", 2, F.desc("score"), F.asc("turn")).orderBy(F.desc("score"), "conv_id", "turn").limit(30)


@query("document_with_chunks", "SELECT doc_id, i AS chunk_index, substring(text, i * 800 + 1, 1000) AS content FROM documents, unnest(range(0, greatest(1, ceil((length(text) - 200) / 800.0)::BIGINT))) u(i)")
def document_with_chunks(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return windows_sql(d, "text", 1000, 200).select("doc_id", "chunk_index", "content")


@query("context_windows", """
WITH c AS (SELECT conv_id, turn, '[chunk ' || turn || '] ' || text AS x FROM conversations), g AS (SELECT conv_id, turn AS target FROM conversations WHERE role = 'user' AND turn % 4 = 0)
SELECT c.conv_id, g.target AS turn, string_agg(x, chr(10) ORDER BY c.turn) AS context FROM c JOIN g ON c.conv_id = g.conv_id AND c.turn BETWEEN g.target - 1 AND g.target + 1 GROUP BY 1, 2""")
def context_windows(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    return rt.context_windows(c, c.where("role = 'user' AND turn % 4 = 0"), "conv_id", "turn", "text", 1)


_indexes: dict[tuple, tuple[tuple, RetrievalIndex]] = {}


def _index(spark, sf_dir: str, kind: str, **how) -> RetrievalIndex:
    """The index of a folder's documents, written on first use; once the table's files have changed it is brought up to date."""
    d = t(spark, sf_dir, "documents").select("doc_id", "text")
    key, now = (spark.sparkContext.applicationId, sf_dir, kind), fingerprint(d)
    if key not in _indexes or _indexes[key][0] != now:
        index = _indexes[key][1] if key in _indexes else RetrievalIndex(spark, **how)
        index.refresh(d)
        _indexes[key] = (now, index)
    return _indexes[key][1]


def document_index(spark, sf_dir: str) -> RetrievalIndex:
    """Postings of whole documents."""
    return _index(spark, sf_dir, "documents", cut=whole, embedder=False, keep_text=False)


def _windows(docs):
    return windows_sql(docs, "text", 1000, 200).select("doc_id", "chunk_index", "content")


def chunk_index(spark, sf_dir: str) -> RetrievalIndex:
    """Overlapping windows with their vectors and postings."""
    return _index(spark, sf_dir, "windows", cut=_windows)


@query("rag_query")
def rag_query(spark, sf_dir, question="general public license version", k=10):
    """Hybrid retrieval, rerank, two chunks a document and neighbours, over an index of overlapping windows."""
    return chunk_index(spark, sf_dir).rag(question, k=k)


@query("rag_query_of_case")
def rag_query_of_case(spark, sf_dir, question="which license has case 24-2-00003?", k=10):
    """The question names a case, so only its documents answer."""
    cases = t(spark, sf_dir, "documents").select("doc_id", F.format_string("24-2-%05d-31", F.col("doc_id") % 7).alias("case_number"))
    return chunk_index(spark, sf_dir).rag(question, k=k, cases=cases)


@query("semantic_reranked")
def semantic_reranked(spark, sf_dir, k=10):
    near = rt.semantic(t(spark, sf_dir, "embeddings"), vector(spark, sf_dir), max(5 * k, 50))
    both = near.join(t(spark, sf_dir, "documents"), F.col("vec_id") == F.col("doc_id")).select("doc_id", "similarity", "text")
    return rt.rerank(both, QUERY, "text").drop("text").orderBy(F.desc("rerank_score"), F.desc("similarity"), "doc_id").limit(k)


@query("email_search", "SELECT doc_id, source, lang FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en' AND text ILIKE '%license%' ORDER BY n_chars DESC, doc_id LIMIT 20")
def email_search(spark, sf_dir, sender=("src1", "src2"), domain="en", contains="license", limit=20):
    d = t(spark, sf_dir, "documents")
    return op.where_all(d, F.col("source").isin(*sender), F.col("lang") == domain, F.col("text").ilike(f"%{contains}%")).orderBy(F.desc("n_chars"), "doc_id").limit(limit).select("doc_id", "source", "lang")


@query("email_semantic_best", f"""
WITH s AS (SELECT e.vec_id, e.label, {COS} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {VECTOR_ID}) q)
SELECT label, vec_id, similarity FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) = 1""")
def email_semantic_best(spark, sf_dir):
    """The best hit of each mail, taken before any limit."""
    e = t(spark, sf_dir, "embeddings").withColumn("similarity", F.round(vx.cosine_to(F.col("embedding"), vector(spark, sf_dir)), 6))
    return op.distinct_on(e.select("label", "vec_id", "similarity"), ["label"], F.desc("similarity"), F.asc("vec_id"))


@query("space_search_min_score", f"SELECT e.vec_id, {COS} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {VECTOR_ID}) q WHERE {COS} >= 0.2 AND e.label IN (1, 3, 5, 7) ORDER BY 2 DESC, 1 LIMIT 20")
def space_search_min_score(spark, sf_dir):
    return rt.semantic(t(spark, sf_dir, "embeddings"), vector(spark, sf_dir), 20, F.col("label").isin(1, 3, 5, 7), 0.2).select("vec_id", "similarity")


@query("drive_search_merge", f"WITH m AS (SELECT id, similarity AS score, 0 AS p FROM ({SEM}) UNION ALL SELECT id, rank, 1 FROM {FTS}) SELECT id, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, score DESC) AS rn FROM m) WHERE rn = 1 ORDER BY score DESC, id LIMIT 20")
def drive_search_merge(spark, sf_dir):
    """Two scales on one list, the first list winning: kept beside the rank fusion, as clients know it."""
    sem = rt.semantic(t(spark, sf_dir, "embeddings"), vector(spark, sf_dir), 40).select(F.col("vec_id").alias("id"), F.col("similarity").alias("score"))
    ft = document_index(spark, sf_dir).fulltext(QUERY, 40).select(F.col("doc_id").alias("id"), F.col("rank").alias("score"))
    return op.first_seen_merge([sem, ft], "id", "score", 20)


@query("memory_recall", f"SELECT e.vec_id, {COS} AS similarity FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = {VECTOR_ID}) q WHERE d.source NOT IN ('src0', 'src1') AND d.lang <> 'fr' ORDER BY 2 DESC, 1 LIMIT 8")
def memory_recall(spark, sf_dir):
    keep = t(spark, sf_dir, "documents").where("source NOT IN ('src0', 'src1') AND lang <> 'fr'").select(F.col("doc_id").alias("vec_id"))
    return rt.semantic(t(spark, sf_dir, "embeddings").join(keep, "vec_id", "left_semi"), vector(spark, sf_dir), 8).select("vec_id", "similarity")


@query("tag_search_descendants", """
WITH RECURSIVE tags AS (SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name FROM nation),
h AS (SELECT id, name FROM tags WHERE name = 'EUROPE' UNION ALL SELECT t.id, t.name FROM tags t JOIN h ON t.parent = h.id)
SELECT c_custkey, h.name AS tag FROM customer JOIN h ON h.id = 100 + c_nationkey ORDER BY c_custkey LIMIT 50 OFFSET 10""")
def tag_search_descendants(spark, sf_dir, root="EUROPE"):
    """Documents under a tag or any tag below it; the tree is two levels here, walked by a recursive statement."""
    t(spark, sf_dir, "region").createOrReplaceTempView("region")
    t(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    below = spark.sql(f"""WITH RECURSIVE tags AS (SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, r_name AS name FROM region UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), n_name FROM nation),
      h(id, name) AS (SELECT id, name FROM tags WHERE name = '{root}' UNION ALL SELECT t.id, t.name FROM tags t JOIN h ON t.parent = h.id) SELECT id, name AS tag FROM h""")
    c = t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") + 100).cast("long").alias("id"))
    return c.join(below, "id").select("c_custkey", "tag").orderBy("c_custkey").offset(10).limit(50)


@query("cross_entity_search", "SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer WHERE c_name ILIKE '%00012%' UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE s_name ILIKE '%00012%' UNION ALL SELECT 'part', p_partkey, p_name FROM part WHERE p_name ILIKE '%12%' UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation WHERE n_name ILIKE '%12%'")
def cross_entity_search(spark, sf_dir, q="00012"):
    one = lambda table, key, name, kind, pattern: t(spark, sf_dir, table).where(F.col(name).ilike(f"%{pattern}%")).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(name).alias("name"))
    return one("customer", "c_custkey", "c_name", "customer", q).unionByName(one("supplier", "s_suppkey", "s_name", "supplier", q)).unionByName(one("part", "p_partkey", "p_name", "part", q[-2:])).unionByName(one("nation", "n_nationkey", "n_name", "nation", q[-2:]))


@query("enrich_by_ids", "SELECT w.id, d.lang, d.source, d.doc_id IS NULL AS unknown FROM (VALUES (1), (5), (99), (123456789)) w(id) LEFT JOIN documents d ON d.doc_id = w.id")
def enrich_by_ids(spark, sf_dir, ids=(1, 5, 99, 123456789)):
    wanted = spark.createDataFrame([(i,) for i in ids], "id long")
    d = t(spark, sf_dir, "documents").where(F.col("doc_id").isin(*ids))
    return wanted.join(d, F.col("id") == F.col("doc_id"), "left").select("id", "lang", "source", F.col("doc_id").isNull().alias("unknown"))


@query("conversation_thread", "SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS n FROM conversations WHERE conv_id = 3 ORDER BY turn")
def conversation_thread(spark, sf_dir, conv_id=3):
    return t(spark, sf_dir, "conversations").where(F.col("conv_id") == conv_id).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n")).orderBy("turn")


@query("relationships_both_ways", "SELECT 'out' AS direction, l_partkey AS other FROM lineitem WHERE l_orderkey = 5 UNION ALL SELECT 'in', l_orderkey FROM lineitem WHERE l_partkey = 5")
def relationships_both_ways(spark, sf_dir, key=5):
    e = t(spark, sf_dir, "lineitem")
    return e.where(F.col("l_orderkey") == key).select(F.lit("out").alias("direction"), F.col("l_partkey").alias("other")).unionByName(e.where(F.col("l_partkey") == key).select(F.lit("in").alias("direction"), F.col("l_orderkey").alias("other")))


@query("related_documents", "SELECT b.l_orderkey AS related, count(DISTINCT b.l_partkey) AS shared FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_orderkey <> b.l_orderkey WHERE a.l_orderkey = 1 GROUP BY 1 ORDER BY shared DESC, related LIMIT 20")
def related_documents(spark, sf_dir, key=1):
    l = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")  # noqa: E741
    own = l.where(F.col("l_orderkey") == key).select("l_partkey").distinct()
    return l.where(F.col("l_orderkey") != key).join(own, "l_partkey", "left_semi").groupBy(F.col("l_orderkey").alias("related")).agg(F.countDistinct("l_partkey").alias("shared")).orderBy(F.desc("shared"), "related").limit(20)


@query("mailbox_direction_counts", "SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS inbound, count(*) FILTER (WHERE role <> 'user') AS outbound FROM conversations GROUP BY conv_id")
def mailbox_direction_counts(spark, sf_dir):
    return t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("inbound"), F.count_if(F.col("role") != "user").alias("outbound"))

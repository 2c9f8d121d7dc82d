"""Retrieval: vector, full-text and hybrid search, reranking, and context."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import text as tx
from marlstone.functions import vectors as vx
from marlstone.operators import relational as op


def semantic(vectors: DataFrame, query: list[float], k: int = 10, where: Column | None = None, least: float | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact cosine top k, with filters and threshold before the limit; zero vectors are never found."""
    scored = op.where_all(vectors, where).withColumn("similarity", F.round(vx.cosine_to(F.col(vector), query), 6)).where("similarity IS NOT NULL")
    scored = scored if least is None else scored.where(F.col("similarity") >= least)
    return scored.orderBy(F.desc("similarity"), id_col).limit(k)


def semantic_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", query_id: str = "query_id", vector: str = "embedding", query_vector: str = "query_vector", most: int = 4096) -> DataFrame:
    """Top k of each of many queries, in blocks of at most about ``most`` of them.

    A block of the query set travels to every task.  Only each task's k best of
    a query leave it.
    """
    blocks = max(1, -(-queries.count() // most))
    dims = [id_col, vector]

    def best(block: int) -> DataFrame:
        mine = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == block)
        rows = mine.select(query_id, query_vector).collect()
        names = [r[0] for r in rows]
        q = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))
        length = np.linalg.norm(q, axis=1)
        sent = vectors.sparkSession.sparkContext.broadcast((names, q, length))

        def run(batches):
            names, q, length = sent.value
            top: list = [[] for _ in names]
            for b in batches:
                if not len(b) or not names:
                    continue
                for at in range(0, len(b), 512):
                    part = b.slice(at, 512)
                    rows = [(i, v) for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if v is not None]
                    if rows:
                        merge(top, q, length, np.array([i for i, _ in rows], np.int64), np.array([x for _, x in rows], np.float64))
            out = [(names[j], i, -s) for j, t in enumerate(top) for s, i in t]
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], [query_id, id_col, "similarity"])

        def merge(top, q, length, ids, v):
            with np.errstate(invalid="ignore", divide="ignore"):
                cos = np.round(np.einsum("qd,vd->qv", q, v) / (length[:, None] * np.sqrt(np.einsum("vd,vd->v", v, v))[None, :]), 6)
            for j, row in enumerate(cos):
                ok = np.flatnonzero(~np.isnan(row))
                if len(ok):
                    least = np.partition(row[ok], len(ok) - k)[len(ok) - k] if len(ok) > k else -np.inf
                    near = ok[row[ok] >= least]
                    top[j] = sorted([*top[j], *zip((-row[near]).tolist(), ids[near].tolist(), strict=True)])[:k]

        return vectors.select(*dims).mapInArrow(run, f"{query_id} long, {id_col} long, similarity double")

    found = reduce(DataFrame.unionByName, [best(i) for i in range(blocks)])
    return op.top_per_key(found, [query_id], k, F.desc("similarity"), F.asc(id_col))


def fulltext(docs: DataFrame, query: str, k: int = 10, where: Column | None = None, id_col: str = "doc_id", text: str = "text", headline: bool = True) -> DataFrame:
    """Top k documents that match a web-style query, ranked by term counts over log length."""
    words = tx.query_words(query)
    tokens = docs.withColumn("__t", tx.terms(F.col(text)))
    found = op.where_all(tokens, where, tx.matches(F.col("__t"), query)).withColumn("rank", tx.rank(F.col("__t"), words)).drop("__t")
    found = found.orderBy(F.desc("rank"), id_col).limit(k)
    return found.withColumn("headline", tx.headline(F.col(text), words)) if headline else found


def postings(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index (term, id, tf, length): write it once, partitioned or bucketed by term, to search many times."""
    tokens = docs.select(id_col, tx.terms(F.col(text)).alias("t")).withColumn("length", F.size("t").cast("long"))
    return tokens.select(id_col, "length", F.explode("t").alias("term")).groupBy("term", id_col, "length").agg(F.count(F.lit(1)).alias("tf"))


def bm25(index: DataFrame, words: list[str], n_docs: int, mean_length: float, k: int = 10, k1: float = 1.2, b: float = 0.75, id_col: str = "doc_id") -> DataFrame:
    hits = index.where(F.col("term").isin(*words))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean_length))
    return hits.join(df, "term").groupBy(id_col).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def rank_fusion(left: DataFrame, right: DataFrame, key: str, k: int = 10, left_weight: float = 0.7, right_weight: float = 0.3, rrf_k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of two ranked lists with columns ``key`` and ``rn``."""
    joined = left.select(key, F.col("rn").alias("left_rank")).join(right.select(key, F.col("rn").alias("right_rank")), key, "full_outer")
    one = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(rrf_k) + F.col(r)), F.lit(0.0))
    return joined.withColumn("score", F.round(one(left_weight, "left_rank") + one(right_weight, "right_rank"), 6)).orderBy(F.desc("score"), key).limit(k)


def numbered(top: DataFrame, *order: Column) -> DataFrame:
    """Ranks of a frame that a limit has made small already."""
    return top.withColumn("rn", F.row_number().over(Window.orderBy(*order)).cast("long"))


def weights(semantic_weight: float | None, fulltext_weight: float | None) -> tuple[float, float]:
    """Weights clamped to 0 and above, summing to 1; .7 and .3 where both are missing or 0."""
    a, b = max(0.0, 0.7 if semantic_weight is None else semantic_weight), max(0.0, 0.3 if fulltext_weight is None else fulltext_weight)
    return (a / (a + b), b / (a + b)) if a + b > 0 else (0.7, 0.3)


def overlap_scores(query: str, passages: pd.Series) -> pd.Series:
    """The default reranker: the share of the query's words that a passage has."""
    words = set(tx.query_words(query))
    return passages.fillna("").map(lambda p: len(words & set(p.lower().split())) / max(len(words), 1))


def rerank(df: DataFrame, query: str, text: str, scorer: Callable[[str, pd.Series], pd.Series] = overlap_scores) -> DataFrame:
    """``df`` with ``rerank_score`` by a vectorised scorer of (query, passages)."""

    @F.pandas_udf(T.DoubleType())
    def score(passages: pd.Series) -> pd.Series:
        return scorer(query, passages).astype(float)

    return df.withColumn("rerank_score", score(F.col(text)))


def cap_per_document(df: DataFrame, document: str, most: int, *order: Column) -> DataFrame:
    return op.top_per_key(df, [document], most, *order).drop("rn")


def context_windows(chunks: DataFrame, hits: DataFrame, document: str = "doc_id", index: str = "chunk_index", content: str = "content", width: int = 1) -> DataFrame:
    """For each hit, its neighbours' text as ``[chunk i] ...`` in order."""
    around = op.neighbours(chunks.select(document, index, content), hits.select(document, index).distinct(), document, index, width)
    part = F.struct(F.col(index), F.concat(F.lit("[chunk "), F.col(index).cast("string"), F.lit("] "), F.col(content)).alias("t"))
    return around.groupBy(document, F.col("target_index").alias(index)).agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"]), "\n").alias("context"))


def hashed_embedder(dimensions: int = 64) -> Callable[[pd.Series], pd.Series]:
    """A deterministic stand-in for an embedding model: signed feature hashing of words, L2-normalised."""
    import hashlib

    import numpy as np

    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for s in texts.fillna(""):
            v = np.zeros(dimensions)
            for w in s[: 4 * 8192].lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dimensions] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return embed


def embed(df: DataFrame, text: str, embedder: Callable[[pd.Series], pd.Series] | None = None, name: str = "embedding") -> DataFrame:
    """``df`` with vectors of a text column; an Arrow batch is one model batch."""
    fn = embedder or hashed_embedder()

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        return fn(texts)

    return df.withColumn(name, run(F.col(text)))


#: How a question names a case, the longest form first.
CASE_FORMS = (r"\b\d{2,4}-\d{1,2}-\d{3,6}-\d{2,4}\b", r"\b\d{2,4}-\d{1,2}-\d{3,6}\b", r"(?i)\b\d{2}:\d{2}-[a-z]{2}-\d{5}\b")


def case_in(question: str) -> str | None:
    """The case number that a question names, if any."""
    return next((m[0] for m in (re.search(p, question) for p in CASE_FORMS) if m), None)


def rag(chunks: DataFrame, query: str, query_vector: list[float], k: int = 15, semantic_weight: float | None = None, fulltext_weight: float | None = None, width: int = 1, per_document: int = 2, where: Column | None = None, case_number: str | None = None, cases: DataFrame | None = None) -> DataFrame:
    """The whole question: both searches, fusion, rerank of a pool, a cap for each document, and context.

    ``chunks`` has doc_id, chunk_index, content and embedding.  With ``cases``
    (doc_id, case_number), a case number given or found in the question keeps
    the documents of cases whose number contains it.
    """
    query = " ".join(query.split())
    case_number = case_number or case_in(query)
    if case_number and cases is not None:
        chunks = chunks.join(cases.where(F.col("case_number").ilike(f"%{case_number}%")).select("doc_id"), "doc_id", "left_semi")
    ws, wf = weights(semantic_weight, fulltext_weight)
    keyed = chunks.withColumn("key", F.concat_ws(":", "doc_id", "chunk_index"))
    sem = numbered(semantic(keyed, query_vector, 3 * k, where, id_col="key").select("key", "similarity"), F.desc("similarity"), F.asc("key"))
    ft = numbered(fulltext(keyed, query, 3 * k, where, "key", "content", headline=False).select("key", "rank"), F.desc("rank"), F.asc("key"))
    pool = rank_fusion(sem, ft, "key", max(4 * k, 50), ws, wf).join(keyed.select("key", "doc_id", "chunk_index", "content"), "key")
    order = (F.coalesce("rerank_score", F.lit(-1e9)).desc(), F.desc("score"), F.asc("key"))
    best = cap_per_document(rerank(pool, query, "content"), "doc_id", per_document, *order).orderBy(*order).limit(k)
    context = context_windows(chunks, best, width=max(0, min(3, width)))
    return best.join(context, ["doc_id", "chunk_index"]).select("doc_id", "chunk_index", "score", "rerank_score", "context")

"""A retrieval index in segments: units of text with vectors, positional postings, and a stemmed vocabulary.

Each batch of changed documents becomes a segment, a folder in each of the
index's tables; only those documents are cut and embedded.  What a batch
replaces or deletes is marked dead by (document, segment), and a search leaves
the marked rows out of what it has found.  When there are many segments, the
small ones at the end are rewritten as one and their dead rows go.

The tables lie in the folder that the cluster shares (``spark.checkpoint.dir``),
or in a temporary one where a single machine is the cluster.  Postings are
sorted by word, so a search reads the pages of its words alone; a vector search
reads keys and vectors alone; text is read for a few units only.  An index has
one writer at a time; a reader opened before a merge is to be opened again.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import postings as ps
from marlstone.operators import relational as op
from marlstone.operators import retrieval as rt

KEY = ["doc_id", "chunk_index"]
#: Segments that are kept before the small ones are merged.
SEGMENTS = 8
#: Bytes of a row group of postings: small ones are skipped more often.
_GROUP = 4 << 20
_TABLES = ("units", "postings", "vocabulary", "touched", "dead")
Cut = Callable[[DataFrame], DataFrame]


def shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="marlstone-index-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def whole(docs: DataFrame) -> DataFrame:
    """Documents as units of their own."""
    return docs.select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("content"))


def fingerprint(df: DataFrame) -> tuple:
    """Names, lengths and times of the files that a table is read from: it changes when they do."""
    sc = df.sparkSession.sparkContext
    out = []
    for name in df.inputFiles():
        at = sc._jvm.org.apache.hadoop.fs.Path(name)
        status = at.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(at)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(sorted(out))


class RetrievalIndex:
    """``cut`` makes units (doc_id, chunk_index, content) of documents (doc_id, text).  ``embedder`` False leaves vectors out, ``keep_text`` False the text."""

    def __init__(self, spark: SparkSession, path: str | None = None, cut: Cut = whole, embedder=None, keep_text: bool = True) -> None:
        self.spark, self.cut, self.embedder, self.keep_text = spark, cut, embedder, keep_text
        self.path = (path or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}").rstrip("/")
        self.open()

    # ---- tables

    def _at(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def open(self) -> RetrievalIndex:
        """Look up the segments that are there now."""
        at, fs = self._at("touched")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        self.segments = sorted(int(n.split("=")[1]) for n in names if n.startswith("segment="))
        self._stats: tuple[int, float] | None = None
        self.any_dead = bool(self.segments) and not self.table("dead").isEmpty()
        return self

    def table(self, name: str) -> DataFrame:
        """Rows of all segments with their ``segment``, dead ones included."""
        if not self.segments:
            raise ValueError("the index is empty")
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/segment={s}" for s in self.segments])

    def live(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with doc_id and segment) without the dead."""
        return rows.join(self.table("dead").select("doc_id", F.col("of").alias("segment")), ["doc_id", "segment"], "left_anti") if self.any_dead else rows

    @property
    def chunks(self) -> DataFrame:
        return self.live(self.table("units"))

    @property
    def stats(self) -> tuple[int, float]:
        """Number of units and their mean length in words."""
        if self._stats is None:
            got = self.live(self.table("units").select("doc_id", "segment", "length")).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("m")).first()
            self._stats = (got["n"], got["m"] or 0.0)
        return self._stats

    # ---- writing

    def _write(self, df: DataFrame, name: str, segment: int) -> None:
        df.write.mode("overwrite").option("parquet.block.size", _GROUP if name == "postings" else 128 << 20).parquet(f"{self.path}/{name}/segment={segment}")

    def _sorted(self, postings: DataFrame) -> DataFrame:
        # A word that very many units hold fills several files.
        return postings.repartitionByRange("word", *KEY).sortWithinPartitions("word", *KEY)

    def _segment(self, documents: DataFrame, touched: DataFrame, dead: DataFrame) -> None:
        """Write one segment: the units of ``documents``, what is touched (doc_id, hash) and what is dead (doc_id, of)."""
        n = max(self.segments, default=0) + 1
        units = self.cut(documents).select(*KEY, F.coalesce("content", F.lit("")).alias("content"))
        if self.embedder is not False:
            units = rt.embed(units, "content", self.embedder)
        raw = f"{self.path}/_raw-{uuid.uuid4().hex}"
        counted = units.withColumn("length", F.size(F.filter(ps.words(F.col("content")), lambda w: (w != "") & ~w.isin(*tx.STOP))).cast("long"))
        self._write(counted if self.keep_text else counted.drop("content"), "units", n)
        # What has been cut and embedded is read again; without it the text comes from where it came before.
        source = self.spark.read.parquet(f"{self.path}/units/segment={n}") if self.keep_text else units
        ps.positional(source, KEY, "content").write.parquet(raw)
        self._write(self._sorted(self.spark.read.parquet(raw)), "postings", n)
        self._write(ps.vocabulary(self.spark.read.parquet(f"{self.path}/postings/segment={n}")), "vocabulary", n)
        self._write(dead, "dead", n)
        self._write(touched, "touched", n)
        at, fs = self._at(raw.rsplit("/", 1)[1])
        fs.delete(at, True)
        self.open()

    def refresh(self, docs: DataFrame) -> dict[str, int]:
        """Bring the index to the state of ``docs`` (doc_id, text), the whole table; gives the numbers of added, changed and deleted documents.

        A null id is left out; of rows with equal ids the one with the largest
        text hash counts.
        """
        texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"))
        now = texts.groupBy("doc_id").agg(F.max("hash").alias("hash"))
        if not self.segments:
            return self._apply(docs, now.select("doc_id", "hash", F.lit("added").alias("way"), F.lit(None).cast("int").alias("of")))
        known = self.live(self.table("touched").where("hash IS NOT NULL")).select("doc_id", F.col("hash").alias("old"), F.col("segment").alias("of"))
        both = now.join(known, "doc_id", "full_outer")
        way = F.when(F.col("old").isNull(), "added").when(F.col("hash").isNull(), "deleted").when(F.col("hash") != F.col("old"), "changed")
        return self._apply(docs, both.withColumn("way", way).where("way IS NOT NULL").select("doc_id", "hash", "way", "of"))

    def _apply(self, docs: DataFrame, plan: DataFrame) -> dict[str, int]:
        raw = f"{self.path}/_plan-{uuid.uuid4().hex}"
        plan.write.parquet(raw)
        plan = self.spark.read.parquet(raw)
        counts = {r["way"]: r["n"] for r in plan.groupBy("way").agg(F.count(F.lit(1)).alias("n")).collect()}
        if counts or not self.segments:
            text = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"))
            if set(counts) == {"added"} and not self.segments:
                mine = text.select("doc_id", "text") if text.select("doc_id").count() == counts["added"] else text.join(plan.select("doc_id", "hash"), ["doc_id", "hash"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text")
            else:
                mine = text.join(plan.where("way <> 'deleted'").select("doc_id", "hash"), ["doc_id", "hash"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text")
            self._segment(mine, plan.select("doc_id", "hash"), plan.where("of IS NOT NULL").select("doc_id", "of"))
            if len(self.segments) > SEGMENTS:
                self.merge(self.due())
        at, fs = self._at(raw.rsplit("/", 1)[1])
        fs.delete(at, True)
        return {w: counts.get(w, 0) for w in ("added", "changed", "deleted")}

    def due(self) -> list[int]:
        """The last segments that are small beside the one before them; all if none is large."""
        sizes = {r["segment"]: r["n"] for r in self.table("touched").groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
        total = 0
        for k in range(len(self.segments) - 1, 0, -1):
            total += sizes.get(self.segments[k], 0)
            if k < len(self.segments) - 1 and sizes.get(self.segments[k - 1], 0) > 2 * total:
                return self.segments[k:]
        return self.segments

    def merge(self, segments: list[int] | None = None) -> RetrievalIndex:
        """Rewrite the given last segments as one, without dead rows; all of them by default."""
        old = sorted(segments or self.segments)
        if len(old) < 2:
            return self
        if old != self.segments[-len(old) :]:
            raise ValueError("only the last segments can be merged")
        n, mine = old[-1] + 1, F.col("segment").isin(*old)
        rows = lambda name: self.live(self.table(name).where(mine)).drop("segment")
        self._write(rows("units"), "units", n)
        self._write(self._sorted(rows("postings")), "postings", n)
        self._write(ps.vocabulary(self.spark.read.parquet(f"{self.path}/postings/segment={n}")), "vocabulary", n)
        # Marks against segments that stay go on to hold.
        self._write(self.table("dead").where(mine & ~F.col("of").isin(*old)).drop("segment"), "dead", n)
        self._write(rows("touched").where("hash IS NOT NULL"), "touched", n)
        for name in _TABLES:
            for s in old:
                at, fs = self._at(f"{name}/segment={s}")
                fs.delete(at, True)
        return self.open()

    # ---- searching

    def asked(self, query: str) -> tuple[ps.Asked, dict[str, list[str]]]:
        asked = ps.Asked(query)
        return asked, asked.forms(self.table("vocabulary")) if asked.ways and self.segments else {s: [] for s in asked.stems}

    def hits(self, query: str, where: Column | None = None, documents: DataFrame | None = None) -> DataFrame:
        """Units that answer a web-style query: the keys, ``length``, ``rank``, and ``start`` and ``stop`` of the best cover.

        ``where`` is a condition on the keys; ``documents`` (doc_id) are those that may be found.
        """
        asked, forms = self.asked(query)
        if not asked.ways or not self.segments:
            return self.spark.createDataFrame([], "doc_id long, chunk_index int, length long, rank double, start int, stop int")
        wanted = sorted({w for ws in forms.values() for w in ws})
        rows = self.table("postings").where(F.col("word").isin(*wanted) if wanted else F.lit(False))
        rows = self.live(op.where_all(rows, where))
        if documents is not None:
            rows = rows.join(documents.select("doc_id"), "doc_id", "left_semi")
        return ps.hits(rows, KEY, asked, forms)

    def fulltext(self, query: str, k: int, where: Column | None = None, documents: DataFrame | None = None) -> DataFrame:
        """The best units by cover density, from postings alone: the keys, ``rank``, and ``start`` and ``stop`` of the best cover."""
        return self.hits(query, where, documents).select(*KEY, "rank", "start", "stop").orderBy(F.desc("rank"), *KEY).limit(k)

    def headlines(self, found: DataFrame, query: str, texts: DataFrame | None = None, text: str = "content") -> DataFrame:
        """``found`` (a few rows of :meth:`fulltext`) with ``headline``, made from the best cover."""
        words = sorted({w for ws in self.asked(query)[1].values() for w in ws})
        held = (self.chunks if texts is None else texts).join(F.broadcast(found), [c for c in KEY if texts is None or c in texts.columns])
        return held.select(*found.columns, ps.headline(F.col(text), F.col("start"), F.col("stop"), words).alias("headline"))

    def bm25(self, query: str, k: int, documents: DataFrame | None = None) -> DataFrame:
        """The best units with any of the query's words, by BM25 over the live units."""
        asked, forms = self.asked(query)
        wanted = sorted({w for ws in forms.values() for w in ws})
        rows = self.live(self.table("postings").where(F.col("word").isin(*wanted) if wanted else F.lit(False)))
        if documents is not None:
            rows = rows.join(documents.select("doc_id"), "doc_id", "left_semi")
        return ps.bm25(rows, KEY, asked, forms, *self.stats).orderBy(F.desc("score"), *KEY).limit(k)

    def semantic(self, query: list[float], k: int, documents: DataFrame | None = None) -> DataFrame:
        """The nearest units: doc_id, chunk_index, similarity."""
        units = self.live(self.table("units").select(*KEY, "segment", "embedding"))
        if documents is not None:
            units = units.join(documents.select("doc_id"), "doc_id", "left_semi")
        near = rt.semantic(units.select(F.struct(*KEY).alias("key"), "embedding"), query, k, id_col="key")
        return near.select("key.*", "similarity")

    def rag(self, question: str, embedder=None, k: int = 15, semantic_weight: float | None = None, fulltext_weight: float | None = None, width: int = 1, per_document: int = 2, case_number: str | None = None, cases: DataFrame | None = None) -> DataFrame:
        """As :func:`retrieval.rag`, over the index: what follows the two searches touches a pool of keys only."""
        question = " ".join(question.split())
        vector = (embedder or self.embedder or rt.hashed_embedder())(pd.Series([question]))[0]
        ws, wf = rt.weights(semantic_weight, fulltext_weight)
        case_number = case_number or rt.case_in(question)
        documents = cases.where(F.col("case_number").ilike(f"%{case_number}%")).select("doc_id") if case_number and cases is not None else None
        order = [F.asc(c) for c in KEY]
        sem = rt.numbered(self.semantic(vector, 3 * k, documents), F.desc("similarity"), *order).select(F.struct(*KEY).alias("key"), "rn")
        ft = rt.numbered(self.fulltext(question, 3 * k, documents=documents), F.desc("rank"), *order).select(F.struct(*KEY).alias("key"), "rn")
        fused = rt.rank_fusion(sem, ft, "key", max(4 * k, 50), ws, wf).select("key.*", "score")
        # A limit bounds the pool, so it may travel.
        pool = self.chunks.select(*KEY, "content").join(F.broadcast(fused), KEY)
        best_first = (F.coalesce("rerank_score", F.lit(-1e9)).desc(), F.desc("score"), *order)
        best = rt.cap_per_document(rt.rerank(pool, question, "content"), "doc_id", per_document, *best_first).orderBy(*best_first).limit(k).select(*KEY, "score", "rerank_score")
        width = max(0, min(3, width))
        around = best.select("doc_id", F.col("chunk_index").alias("target"), "score", "rerank_score", F.explode(F.sequence(F.col("chunk_index") - width, F.col("chunk_index") + width)).alias("chunk_index"))
        text = self.chunks.select(*KEY, "content").join(F.broadcast(around), KEY)
        part = F.struct("chunk_index", F.concat(F.lit("[chunk "), F.col("chunk_index").cast("string"), F.lit("] "), "content").alias("t"))
        context = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"]), "\n")
        return text.groupBy("doc_id", F.col("target").alias("chunk_index"), "score", "rerank_score").agg(context.alias("context"))

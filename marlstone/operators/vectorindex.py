"""An approximate vector index: inverted lists with product-quantised residuals, laid out by list.

Centres come from k-means whose rounds are Spark jobs over a bounded sample;
so do the code words of the residuals' parts.  Every vector is in one list.  The
index has two tables partitioned by list, so that a search reads the files of
the lists it probes and no others: blocks of packed codes, about 16 bytes a
vector, and the vectors themselves, of which only survivors are looked up.  A
search scores the codes of the nearest lists, keeps the best of each query, and
ranks these by exact cosines.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import vectors as vx
from marlstone.operators import relational as op
from marlstone.operators.index import shared_folder

#: Lists at most: the centres are held by the driver and sent to every task.
MOST_LISTS = 4096
#: Vectors that are learned from for each list, about.
SAMPLE = 256
#: Parts of a residual, each of one byte.
PARTS = 16
WORDS = 256
#: Codes in a block, and queries that meet it together.
BLOCK, TOGETHER = 2048, 256


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that are vectors of ``width`` finite entries and not zero, as unit vectors, and their places."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    values = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan))
    ends = np.cumsum(np.maximum(sizes, 0))
    place = np.flatnonzero(sizes == width)
    x = values[(ends - width)[place][:, None] + np.arange(width)]
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return x[good] / norm[good, None], place[good]


def _summed(vectors: DataFrame, width: int, part) -> np.ndarray:
    """The sum of ``part`` (unit vectors to one array) over all vectors, added as a tree of tasks."""

    def rows(batches):
        total = None
        for b in batches:
            for at in range(0, len(b), BLOCK):
                x, _ = _matrix(b.column(0).slice(at, BLOCK), width)
                here = part(x)
                total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = vectors.mapInArrow(rows, "part binary").rdd.map(lambda r: np.frombuffer(r[0], np.float64))
    return parts.treeReduce(np.add, depth=3)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return np.argmax(x @ centres.T - (centres * centres).sum(1) / 2, axis=1)


def _sums(own: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Per centre its members' sum and number."""
    out = np.zeros((k, x.shape[1] + 1))
    np.add.at(out[:, :-1], own, x)
    out[:, -1] = np.bincount(own, minlength=k)
    return out


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        model = spark.read.parquet(f"{self.path}/model").orderBy("kind", "number").collect()
        of = lambda kind: np.array([r["values"] for r in model if r["kind"] == kind])
        self.centres = of("centre")
        words = of("words")
        self.words = words.reshape(PARTS, -1, words.shape[1])

    @property
    def lists(self) -> int:
        return len(self.centres)

    @classmethod
    def build(cls, vectors: DataFrame, lists: int | None = None, path: str | None = None, rounds: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> VectorIndex:
        """Index every vector of ``vectors``; null, zero and non-finite ones, and those of another length than most, are never found."""
        spark = vectors.sparkSession
        path = (path or f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}").rstrip("/")
        plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("size(v) > 0")
        seen = plain.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").collect()
        if not seen:
            raise ValueError("there are no vectors")
        width, n = seen[0]["d"], seen[0]["count"]
        k = min(lists or max(1, round(n**0.5)), MOST_LISTS, n)
        part = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < min(1.0, SAMPLE * k / n) * 1_000_000
        sample = f"{path}/_sample"
        plain.where(part & (F.size("v") == width)).select("v", F.xxhash64("id").alias("h")).write.parquet(sample)
        learned = spark.read.parquet(sample)
        unit = lambda rows: _matrix(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), width)[0]
        centres = unit(learned.orderBy("h").limit(k).collect())
        if not len(centres):
            raise ValueError("there are no vectors")
        for _ in range(rounds):
            now = centres
            got = _summed(learned.select("v"), width, lambda x, now=now: _sums(_nearest(x, now), x, len(now))).reshape(len(now), width + 1)
            full = got[:, -1] > 0
            centres = now.copy()
            centres[full] = got[full, :-1] / np.maximum(np.linalg.norm(got[full, :-1], axis=1, keepdims=True), 1e-12)
            if np.abs(centres - now).max() < 1e-6:
                break
        step = -(-width // PARTS)
        cut = lambda x: np.pad(x, ((0, 0), (0, PARTS * step - width))).reshape(len(x), PARTS, step)
        residual = lambda x: cut(x - centres[_nearest(x, centres)])
        words = residual(unit(learned.orderBy(F.desc("h")).limit(WORDS).collect())).transpose(1, 0, 2).copy()
        for _ in range(max(3, rounds // 2)):
            now = words

            def parts(x, now=now):
                r = residual(x)
                return np.stack([_sums(_nearest(r[:, j], now[j]), r[:, j], now.shape[1]) for j in range(PARTS)])

            got = _summed(learned.select("v"), width, parts).reshape(PARTS, now.shape[1], step + 1)
            words = np.where(got[:, :, -1:] > 0, got[:, :, :-1] / np.maximum(got[:, :, -1:], 1), now)
        model = [("centre", i, c.tolist()) for i, c in enumerate(centres)] + [("words", j * words.shape[1] + i, words[j, i].tolist()) for j in range(PARTS) for i in range(words.shape[1])]
        spark.createDataFrame(model, "kind string, number int, values array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

        def place(batches):
            for b in batches:
                x, at = _matrix(b.column(1), width)
                yield pa.RecordBatch.from_arrays([pa.array(_nearest(x, centres).astype(np.int32)), *(c.take(pa.array(at)) for c in b.columns)], ["list", "id", "v"])

        # A large list fills several partitions, and so several files.
        placed = plain.mapInArrow(place, "list int, id long, v array<double>").select("list", "id", F.col("v").cast(vectors.schema[vector].dataType).alias("v"))
        placed.repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")

        def blocks(batches):
            for b in batches:
                owner = np.asarray(b.column(0))
                x, _ = _matrix(b.column(2).cast(pa.list_(pa.float64())), width)
                r = cut(x - centres[owner])
                code = np.stack([_nearest(r[:, j], words[j]) for j in range(PARTS)], axis=1).astype(np.uint8)
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(owner)], strict=True):
                    for at in range(s, e, BLOCK):
                        to = min(at + BLOCK, e)
                        yield pa.RecordBatch.from_arrays([pa.array([int(owner[s])], pa.int32()), pa.array([b.column(1).slice(at, to - at).to_pylist()], pa.list_(pa.int64())), pa.array([code[at:to].tobytes()], pa.binary())], ["list", "ids", "codes"])

        stored = spark.read.parquet(f"{path}/vectors").select("list", "id", "v")
        # A file holds vectors of one list, so blocks are made where the files are read.
        stored.mapInArrow(blocks, "list int, ids array<long>, codes binary").write.mode("overwrite").partitionBy("list").parquet(f"{path}/codes")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sample)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return cls(spark, path)

    def table(self, name: str, lists: list[int]) -> DataFrame:
        """Rows of the given lists: a filter on the partition column, so no other file is opened."""
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("list").isin(*lists) if len(lists) < self.lists else F.lit(True))

    def _probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """The queries of each list in blocks: ``list``, ``names`` and their unit vectors as bytes."""
        centres, width = self.centres, self.centres.shape[1]

        def spread(batches):
            for b in batches:
                q, at = _matrix(b.column(1), width)
                near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes]
                names = np.asarray(b.column(0))[at]
                raw = [v.tobytes() for v in q]
                yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1).astype(np.int32)), pa.array(np.repeat(names, near.shape[1])), pa.array([raw[i] for i in np.repeat(np.arange(len(q)), near.shape[1])], pa.binary())], ["list", "name", "q"])

        plain = queries.select(F.col(queries.columns[0]).cast("long"), F.col(queries.columns[1]).cast("array<double>"))
        each = plain.where(F.size(plain.columns[1]) == width).mapInArrow(spread, "list int, name long, q binary")
        # Groups of about TOGETHER queries, by a hash, so that a list that all ask for is many rows.
        n = max(1, queries.count() // TOGETHER)
        return each.groupBy("list", F.pmod(F.xxhash64("name"), F.lit(n)).alias("g")).agg(F.sort_array(F.collect_list(F.struct("name", "q"))).alias("asked")).drop("g")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, survivors: int | None = None) -> DataFrame:
        """``query_id``, ``id`` and ``similarity``: about the ``k`` nearest of each query (id, vector), best first by exact cosine, ties by id.

        ``probes`` lists are read for each query (a tenth by default), and
        ``survivors`` of a query's codes are compared exactly (10 k by default).
        """
        probes = min(self.lists, probes or max(1, self.lists // 10))
        survivors = max(k, survivors or 10 * k)
        centres, words = self.centres, self.words
        step = words.shape[2]
        asked = self._probed(queries, probes)
        wanted = sorted(r["list"] for r in asked.select("list").distinct().collect())
        pairs = self.table("codes", wanted).join(asked, "list").select("list", "ids", "codes", "asked.name", "asked.q")

        def score(batches):
            for b in batches:
                for i in range(len(b)):
                    owner = b.column(0)[i].as_py()
                    ids = np.asarray(b.column(1)[i].values)
                    code = np.frombuffer(b.column(2)[i].as_py(), np.uint8).reshape(-1, PARTS)
                    names = np.asarray(b.column(3)[i].values)
                    q = np.frombuffer(b"".join(b.column(4)[i].as_py())).reshape(len(names), -1)
                    split = np.pad(q, ((0, 0), (0, PARTS * step - q.shape[1]))).reshape(len(q), PARTS, step)
                    near = np.repeat((q @ centres[owner])[:, None], len(code), axis=1)
                    for j in range(PARTS):
                        near += (split[:, j] @ words[j].T)[:, code[:, j]]
                    m = min(survivors, len(code))
                    best = np.argpartition(-near, m - 1, axis=1)[:, :m]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, m)), pa.array(ids[best].reshape(-1)), pa.array(np.full(best.size, owner, np.int32)), pa.array(np.take_along_axis(near, best, 1).reshape(-1))], ["query_id", "id", "list", "near"])

        found = pairs.mapInArrow(score, "query_id long, id long, list int, near double")
        kept = op.top_per_key(found, ["query_id"], survivors, F.desc("near"), F.asc("id")).select("query_id", "list", "id")
        vectors = self.table("vectors", wanted)
        named = queries.select(F.col(queries.columns[0]).cast("long").alias("query_id"), F.col(queries.columns[1]).cast("array<double>").alias("q"))
        exact = vectors.join(kept, ["list", "id"]).join(named, "query_id").select("query_id", "id", F.round(vx.cosine(F.col("v"), F.col("q")), 6).alias("similarity"))
        return op.top_per_key(exact.where("similarity IS NOT NULL"), ["query_id"], k, F.desc("similarity"), F.asc("id"))

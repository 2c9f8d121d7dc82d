"""The approximate vector index: recall against exact search, files read, layout."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import retrieval as rt
from marlstone.operators.vectorindex import VectorIndex

SF = "/root/testdata/sf0.01"
COPIES = 40


def spread(spark):
    """Clusters: every vector of the table with copies that a hash moves a little."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("j"))
    moved = F.transform("embedding", lambda x, i: x.cast("double") + 0.05 * (F.pmod(F.xxhash64("vec_id", "j", i), F.lit(2001)) / 1000 - 1))
    return e.select((F.col("vec_id") * COPIES + F.col("j")).alias("vec_id"), moved.cast("array<float>").alias("embedding"))


def recall(exact, found):
    have = {(r["query_id"], r["vec_id"]) for r in exact}
    return len(have & {(r["query_id"], r["id"]) for r in found}) / len(have)


@pytest.fixture(scope="module")
def clustered(spark):
    return spread(spark).persist()


@pytest.fixture(scope="module")
def index(clustered):
    return VectorIndex.build(clustered, lists=100)


def test_a_tenth_of_the_lists_finds_nearly_all(spark, clustered, index):
    queries = clustered.where("vec_id % 100 = 0").select("vec_id", "embedding")
    exact = rt.semantic_batch(clustered, queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 10).collect()
    found = index.search(queries, 10, probes=10).collect()
    assert len(found) == 10 * queries.count() and recall(exact, found) >= 0.95
    cosine = {(r["query_id"], r["vec_id"]): r["similarity"] for r in exact}
    assert all(math.isclose(r["similarity"], cosine[r["query_id"], r["id"]], abs_tol=2e-6) for r in found if (r["query_id"], r["id"]) in cosine)
    by_query = {}
    for r in found:
        by_query.setdefault(r["query_id"], []).append(r)
    assert all([(-r["similarity"], r["id"]) for r in sorted(rs, key=lambda r: r["rn"])] == sorted((-r["similarity"], r["id"]) for r in rs) for rs in by_query.values())


def test_one_query_reads_a_tenth_of_the_files(spark, clustered, index):
    one = clustered.where("vec_id = 4000").select("vec_id", "embedding")
    probed = index._probed(one, 10)
    wanted = [r["list"] for r in probed.select("list").distinct().collect()]
    assert len(wanted) == 10
    for name in ("codes", "vectors"):
        part = index.table(name, wanted)
        files, every = part.select(F.input_file_name()).distinct().count(), len(index.table(name, list(range(index.lists))).inputFiles())
        assert files <= 0.2 * every and "PartitionFilters: [list" in part._jdf.queryExecution().executedPlan().toString()
    found = index.search(one, 10, probes=10).collect()
    assert len(found) == 10 and found[0]["id"] == 4000 and found[0]["similarity"] == 1.0


def test_every_vector_is_in_one_list_and_one_block(clustered, index):
    n = clustered.count()
    every = list(range(index.lists))
    assert index.table("vectors", every).select("id").distinct().count() == index.table("vectors", every).count() == n
    ids = index.table("codes", every).select(F.explode("ids").alias("id"), F.length("codes").alias("b"), F.size("ids").alias("n"))
    assert ids.count() == ids.select("id").distinct().count() == n and ids.where("b <> 16 * n").isEmpty()


def test_all_codes_find_nearly_all_of_scattered_vectors(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    index = VectorIndex.build(e)
    queries = e.where("vec_id % 25 = 0")
    exact = rt.semantic_batch(e, queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 10).collect()
    full = recall(exact, index.search(queries, 10, probes=index.lists).collect())
    half = recall(exact, index.search(queries, 10, probes=index.lists // 2).collect())
    assert full >= 0.95 and half < full
    again = VectorIndex(spark, index.path)
    assert np.array_equal(again.centres, index.centres) and recall(exact, again.search(queries, 10, probes=index.lists).collect()) == full


def test_odd_vectors_are_never_found(spark):
    rows = [(k, [math.cos(k), math.sin(k), 0.1 * k]) for k in range(30)] + [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [math.nan, 1.0, 1.0]), (104, [1.0, 2.0]), (105, [None, 1.0, 1.0]), (7, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    index = VectorIndex.build(df, lists=4)
    found = index.search(df, 40, probes=4).collect()
    assert {r["id"] for r in found} == set(range(30)) and {r["query_id"] for r in found} == set(range(30))
    with pytest.raises(ValueError, match="no vectors"):
        VectorIndex.build(df.where("vec_id = 100"))

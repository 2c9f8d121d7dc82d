"""Files of the n-gram Jaccard join's own tables: a local file system starts a process or more for each."""

from pathlib import Path

import pytest

import corpus_pipeline
from marlstone.llm import jaccard
from marlstone.llm.store import Scratch

ROWS = [(100 * j + i, " ".join(f"w{1000 * j + k + i}" for k in range(60)), "en", "s", 1) for j in range(40) for i in range(4)]


@pytest.fixture
def files(spark, monkeypatch):
    found, keep = {}, Scratch.keep

    def kept(self, df, name):
        out = keep(self, df, name)
        found[name] = len(list(Path(self.paths[name].removeprefix("file://")).glob("*.parquet")))
        return out

    monkeypatch.setattr(Scratch, "keep", kept)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield found
    for k, v in before.items():
        spark.conf.set(k, v)


def small(files):
    some = {k: n for k, n in files.items() if k not in ("incidence", "entries")}
    assert {"stars", "links", "label", "open", "rest", "owner", "result"} <= set(some)
    return some


def documents(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(8)


def test_small_tables_are_written_as_one_file(spark, files):
    got = jaccard.ngram_jaccard_join(documents(spark), percent=80).collect()
    assert all(r["component_id"] == r["id"] // 100 * 100 for r in got) and len(got) == 160
    assert set(small(files).values()) == {1}, files


def test_so_are_those_of_the_pipelines_stage(spark, files):
    before = {k: spark.conf.get(k) for k in corpus_pipeline.SETTINGS}
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, documents(spark), "").collect())
    for k, v in before.items():
        spark.conf.set(k, v)
    assert got == [100 * j for j in range(40)]
    assert set(small(files).values()) == {1}, files

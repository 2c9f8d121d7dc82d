"""What stages of the pipeline hold in Python's workers."""

import re

import public_tokenizers
from pyspark.sql import functions as F

from marlstone.llm import jaccard, packing, passages, secrets
from marlstone.llm.store import Scratch

PATH = public_tokenizers.path("word_bpe_49k.json")


def python_steps(plan):
    """The most steps of Python that one stage of a plan has in a row."""
    above, most = [], 0
    for line in plan.splitlines():
        at = re.search(r"[A-Za-z]", line)
        if at is None:
            continue
        while above and above[-1][0] >= at.start():
            above.pop()
        n = above[-1][1] if above else 0
        name = re.sub(r"^[*(\d) ]*", "", line[at.start() :])
        n = 0 if re.match(r"(Exchange|ShuffleQueryStage|BroadcastExchange)", name) else n + name.startswith("MapInArrow")
        above.append((at.start(), n))
        most = max(most, n)
    return most


def test_no_stage_has_two_steps_of_python(spark):
    rows = [(i, f"word{i} AKIA{'ABCDEFGHIJKLMNOP'[i % 7 :]}{i}QX7 and " + " ".join(f"w{k}" for k in range(60)), "s") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cut = passages.cut_passages(docs, passages.repeated_passages(docs))
    for out in (secrets.redact(docs), cut):
        assert python_steps(out._jdf.queryExecution().executedPlan().toString()) == 1
    assert cut.where(F.length("text") < 60).count() == 19


def test_few_words_are_kept_where_room_is_needed():
    encoder = packing.WordEncoder(PATH)
    encoder.limit = 20
    texts = [" ".join(f"w{k}x{j}" for j in range(9)) for k in range(30)]
    for t in texts * 2:
        assert list(memoryview(encoder.encode(t)).cast("I")) == encoder.model.encode(t, add_special_tokens=False).ids
        assert len(encoder.known) + len(encoder.old) <= 2 * (20 + 9)


def test_the_product_compiles_to_small_methods(spark, monkeypatch):
    """The JVM's compiler took some 300 MB of an executor for one method of 3732 bytes, and the process kept them."""
    sizes, keep = {}, Scratch.keep

    def kept(self, df, name):
        if name == "rest":
            found = df._jdf.queryExecution().debug().codegenToSeq()
            sizes.update((k, found.apply(k)._3().maxMethodCodeSize()) for k in range(found.size()))
        return keep(self, df, name)

    monkeypatch.setattr(Scratch, "keep", kept)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    rows = [(i, " ".join(f"w{k + 3 * i}" for k in range(60))) for i in range(30)]
    got = jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()
    for k, v in before.items():
        spark.conf.set(k, v)
    assert {r["component_id"] for r in got} == {0}
    assert sizes and max(sizes.values()) < 2500, sizes

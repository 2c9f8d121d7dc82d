import io
import zipfile
from email.message import EmailMessage

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import chunking as ch
from marlstone.operators import relational as op
from marlstone.operators import retrieval as rt
from marlstone.operators import sinks
from marlstone.sources import extract, tables
from marlstone.streaming import changes, stateful

TEXT = st.text(alphabet="ab .\n", max_size=400)


@settings(max_examples=60, deadline=None)
@given(TEXT, st.integers(5, 60))
def test_recursive_chunks_keep_all_characters(text, size):
    found = ch.recursive(text, size)
    assert all(len(c) <= size for c in found)
    assert "".join("".join(found).split()) == "".join(text.split())


@settings(max_examples=60, deadline=None)
@given(TEXT, st.integers(10, 60), st.integers(0, 9))
def test_windows_cover_and_advance(text, size, overlap):
    spans = ch.snapped(text, size, overlap)
    covered = set().union(*[range(a, b) for a, b in spans]) if spans else set()
    assert covered == set(range(len(text)))
    assert all(b - a <= size for a, b in spans) and all(x[0] < y[0] for x, y in zip(spans, spans[1:], strict=False))


@settings(max_examples=60, deadline=None)
@given(TEXT, st.integers(10, 60))
def test_paragraph_spans_cover_the_words(text, size):
    covered = set().union(*[range(a, b) for a, b in ch.paragraphs(text, size)] or [set()])
    assert {i for i, c in enumerate(text) if not c.isspace()} <= covered


def test_segments_of_a_mail():
    body = "Hello,\nplease see below.\n\nBest regards,\nSynthetic Sender\nThis email and any attachments are confidential.\n\nOn Monday, 3 May, someone at court.example wrote:\n> first\n> second\n> third\n"
    assert [k for k, _, _ in ch.segments(body)] == ["body", "signature", "disclaimer", "quoted"]
    assert ch.segments("> a\n> b\n> c\nanswer")[0][0] == "quoted"
    assert [k for k, _, _ in ch.segments("Hola\n\nDesde: ana@x.example\nEnviado: lunes\nPara: b\n")] == ["body", "quoted"]
    assert [k for k, _, _ in ch.segments("Oi\nDA : rui\n data: 1 de maio\ntexto")] == ["body", "quoted"]
    assert [k for k, _, _ in ch.segments("Hi\n----- original message -----\nx")] == ["body", "quoted"] and len(ch.segments("Hi\n---- Original Message ----\nx")) == 1
    for words in ch.DISCLAIMERS:
        assert [k for k, _, _ in ch.segments(f"Text.\nNote: {words.lower()} and so on\nmore")] == ["body", "disclaimer"]
    for words in ch.CLOSERS:
        assert [k for k, _, _ in ch.segments(f"Text.\n{words.upper()},\nA. Writer")] == ["body", "signature"]
        assert len(ch.segments(f"Text.\n{words},\n" + "long tail " * 60)) == 1
    assert [k for k, _, _ in ch.segments("Text.\n-- \nMe\nThe information contained in this mail\n> a\n> b\n> c")] == ["body", "signature", "disclaimer", "quoted"]
    assert len(ch.segments("an arrow\n> a\n> b\nno")) == 1
    assert ch.segments("") == [] and ch.segments("plain")[0] == ("body", "plain", 0)


def test_query_parser():
    assert tx.parse_query('apache -version or "public license"') == [([["apache"]], [["version"]]), ([["public", "license"]], [])]
    assert tx.parse_query("the of") == []


def test_gateway_refuses_commands(spark):
    assert op.select_only(spark, "WITH x AS (SELECT 1 AS created_at) SELECT * FROM x").count() == 1
    for bad in ("DROP TABLE x", "CREATE TABLE y (a INT)", "INSERT INTO z VALUES (1)", "SET a = b"):
        with pytest.raises(PermissionError):
            op.select_only(spark, bad)


def test_weights_and_fusion(spark):
    assert rt.weights(-1, 0) == (0.7, 0.3) and rt.weights(2, 2) == (0.5, 0.5)
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rn long")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rn long")
    assert [r["id"] for r in rt.rank_fusion(a, b, "id").collect()] == [2, 1, 3]


def test_zero_vectors_are_not_found(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None)], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in rt.semantic(v, [1.0, 1.0]).collect()] == [2]


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 1, "b")], "k int, n int, v string")
    new = spark.createDataFrame([(1, 2, None), (3, 4, "c")], "k int, n int, v string")
    assert sorted(map(tuple, op.upsert(old, new, ["k"], {"n": "add"}).collect())) == [(1, 7, "a"), (2, 1, "b"), (3, 4, "c")]


def test_versioned_table_is_idempotent(spark, tmp_path):
    docs = sinks.VersionedTable(spark, str(tmp_path / "d"), "source_path string, text string")
    chunks = sinks.VersionedTable(spark, str(tmp_path / "c"), "chunk_id string, source_path string")
    batch = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x")], "source_path string, text string")
    cut = spark.createDataFrame([("a0", "a"), ("b0", "b")], "chunk_id string, source_path string")
    for _ in range(2):
        sinks.ingest(spark, docs, chunks, batch, cut)
    assert docs.read().count() == 2 and chunks.read().count() == 2
    docs.delete(spark.createDataFrame([("a",)], "source_path string"), ["source_path"])
    assert [r["source_path"] for r in docs.read().collect()] == ["b"]


def test_memory_wraps_plain_text(spark):
    empty = spark.createDataFrame([], "agent string, key string, value string, at long")
    new = spark.createDataFrame([("a", "k", "plain", 1), ("a", "j", '{"x":1}', 1), ("a", "j", '{"x":2}', 2)], "agent string, key string, value string, at long")
    assert {r["key"]: r["value"] for r in sinks.remember(empty, new).collect()} == {"k": '{"text":"plain"}', "j": '{"x":2}'}


def test_tombstones(spark):
    state = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k long, v string, deleted_at long")
    ch_ = spark.createDataFrame([(1, None, "delete", 7), (2, None, "delete", 8), (3, None, "delete", 9), (4, "d", "upsert", 9)], "k long, v string, op string, seq long")
    assert sorted(map(tuple, changes.apply_changes(state, ch_, "k", "seq").collect())) == [(1, "a", 7), (2, "b", 5), (4, "d", None)]
    assert sorted(map(tuple, changes.apply_changes(state, ch_, "k", "seq", bootstrap=True).collect())) == [(1, "a", None), (2, "b", 5), (4, "d", None)]


def _fold(name, events, **kw):
    fold, state, _ = stateful.FOLDS[name]
    out = []
    for at, row in events:
        state, said = fold(state, at, row, **kw)
        out.append(said["action"])
    return out


def test_folds():
    assert _fold("suppress", [(0, {}), (10, {}), (21600, {})]) == ["send", "suppress", "send"]
    bad, good = {"ok": False}, {"ok": True}
    assert _fold("breaker", [(0, bad), (1, bad), (2, good), (70, good), (71, good), (72, good)], failures=2) == ["pass", "open", "reject", "probe", "close", "pass"]
    assert _fold("bucket", [(0.0, {}), (0.0, {}), (0.0, {}), (1.0, {})], capacity=2.0) == ["pass", "pass", "limit", "pass"]
    assert _fold("batching", [(23 * 3600, {}), (12 * 3600 + 86400, {}), (12 * 3600 + 86500, {})]) == ["hold", "send", "hold"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"k{i % 3}", float(i * 4000)) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, k string, at double")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("id long, k string, at double").parquet(str(tmp_path / "in"))
    out = stateful.stream(src, "suppress", "k", "at", ["id"])
    out.writeStream.outputMode("append").format("memory").queryName("alerts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    got = sorted(map(tuple, spark.table("alerts").select("id", "action").collect()))
    assert got == sorted(map(tuple, stateful.batch(df, "suppress", "k", "at", ["id"]).select("id", "action").collect()))


def test_change_stream_applies_batches(spark, tmp_path):
    table = sinks.VersionedTable(spark, str(tmp_path / "t"), "k long, v string, deleted_at long")
    schema = "k long, v string, op string, seq long"
    spark.createDataFrame([(1, "a", "upsert", 1), (2, "b", "upsert", 2)], schema).repartition(1).write.json(str(tmp_path / "in"))
    step = lambda batch, n: table.write(changes.apply_changes(table.read(), batch, "k", "seq"))
    src = changes.watch_folder(spark, str(tmp_path / "in"), schema)
    changes.run(spark, src, step, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(1, None, "delete", 3)], schema).repartition(1).write.mode("append").json(str(tmp_path / "in"))
    changes.run(spark, src, step, str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", 3), (2, "b", None)]


def test_extractors(spark, tmp_path):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Message-ID"], m["References"] = "A <a@counsel.example>", "b@court.example", "Hi", "<1@x>", "<0@x> <00@x>"
    m.set_content("body text")
    m.add_attachment(b"z" * 600, maintype="application", subtype="pdf", filename="f.pdf")
    m.add_attachment(b"z", maintype="application", subtype="pdf", filename="small.pdf")
    got = extract.mail(m.as_bytes())
    assert got["body"] == "body text" and got["thread_id"] == "<0@x>" and [a["filename"] for a in got["attachments"]] == ["f.pdf"]
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p></w:d>')
    assert extract.docx(z.getvalue()) == "one two"
    for name, data in (("a.eml", m.as_bytes()), ("b.docx", z.getvalue()), ("c.csv", b"x,,y\n,\n1,2,"), ("d.bin", b"\0"), ("e.docx", b"broken")):
        (tmp_path / name).write_bytes(data)
    files = tables.files(spark, str(tmp_path), ["eml", "docx", "csv", "bin"])
    got = {r["path"].rsplit("/", 1)[1]: (r["method"], r["text"]) for r in extract.extract_text(files).collect()}
    assert got["b.docx"] == ("docx", "one two") and got["c.csv"] == ("delimited", "x | y\n1 | 2") and got["d.bin"] == ("unsupported", "") and got["e.docx"] == ("failed", "")
    assert extract.parse_mail(files.where("path LIKE '%.eml'")).select("subject").first()["subject"] == "Hi"
    assert extract.clinical(b"<D><setId root='s'/><recordTarget><patient><name>P Q</name></patient></recordTarget><section><title>T</title><text>x</text></section></D>")["sections"] == [{"title": "T", "text": "x"}]


def test_urls_and_magic(spark):
    df = spark.createDataFrame([("HTTP://A.example/x?q=1#f",), ("https://b.example",), ("mailto:x",)], "u string")
    assert [r[0] for r in df.select(tables.normalise_url(F.col("u"))).collect()] == ["http://a.example/x?q=1", "https://b.example/", None]
    kinds = spark.createDataFrame([(b"%PDF-1",), (b"PK\3\4",), (b"<!DOCTYPE html>",), (b"From: a",), (b"",), (None,)], "c binary")
    assert [r[0] for r in kinds.select(tables.magic(F.col("c"))).collect()] == ["pdf", "zip", "html", "eml", "unknown", "unknown"]

"""Patterns whose words are parted by white space, and rules of one pattern."""

import duckdb

from marlstone.operators import patterns
from marlstone.plans import registry


def test_words_parted_by_white_space_are_one_literal():
    assert patterns.required("(?i) Foo +bar ") == {" foo bar "} and patterns.required(r"foo[ \t]+bar\n{2}x") == {"foo bar x"} and patterns.required(r"foo\sbar  ") == {"foo bar "}
    for lone in (r"foo\s*bar", r"foo[^\s]bar", r"foo[\S ]bar", r"foo(?: x)?bar", r"foo ?bar"):
        assert patterns.required(lone) == {"foo"}
    assert patterns.required(" +") is None


def test_white_space_of_any_kind_is_tried_as_rlike_does(spark):
    gaps = ["", " ", "   ", "\t", "\n\n", " \r\n", "\x0b", "\x1c", "\x85", " ", " ", "   "]
    texts = spark.createDataFrame([(k, f"{a}one{g}Two{z}") for k, (a, g, z) in enumerate((a, g, z) for a in ("", " ", "x") for g in gaps for z in ("", " ", "\n", "y"))] + [(900, None)], "id long, body string")
    forms = ["(?i) one +two ", r"one\s+Two", r"one\sTwo", r"(?i)ONE[ \t]+two", " one  +Two", r"one\nTwo", r"one\n+Two", r"one\s*Two", r"one[^\s]+Two", r"^one Two$", r" +one", r"one {2,}Two", "one\x1cTwo", r"one(?: )+Two\s", r"one[\s\x85]Two", r"(?m)^one +Two$"]
    rules = spark.createDataFrame(list(enumerate(forms)), "rule int, pattern string")
    got = sorted((r["id"], r["rule"]) for r in patterns.pattern_join(texts, rules, "body", "pattern").collect())
    assert got == sorted((r["id"], r["rule"]) for r in texts.crossJoin(rules).where("body RLIKE pattern").collect()) and len(got) > 100


def test_rules_of_one_pattern_and_of_one_id(spark, tmp_path):
    """Rules of one pattern are counted alike, and those of one id together."""
    docs = spark.createDataFrame([(k % 40, f"x {'the Of' if k % 3 else 'a  a'} {'the and of ' * 20} w{k} ") for k in range(50)] + [(None, "y THE  of z"), (5, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.queries()["many_rules"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, df.select("rule", "n", "first_doc").collect())) == sorted(con.sql(registry.oracle_sql()["many_rules"]).fetchall())

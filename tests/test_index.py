"""The index: stems by rule, cover density against all ranges, segments against a fresh index."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.functions.stemming import stem
from marlstone.operators import retrieval as rt
from marlstone.operators.chunking import windows_sql
from marlstone.operators.index import KEY, RetrievalIndex
from marlstone.plans import retrieval as plans

SF = "/root/testdata/sf0.001"
#: Words and stems that the rules are published with.
PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist
consistent consist consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori
console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol
consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu
conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack
knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel
kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight
knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock
knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()


@pytest.mark.parametrize(("word", "want"), list(zip(PAIRS[::2], PAIRS[1::2], strict=True)))
def test_published_stems(word, want):
    assert stem(word) == want


#: Words for each rule, made so that the region is there or not.
RULES = {
    "1a": [("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("this", "this"), ("gaps", "gap"), ("kiwis", "kiwi"), ("focus", "focus")],
    "1b": [("agreed", "agre"), ("feed", "feed"), ("hopped", "hop"), ("hoping", "hope"), ("luxuriated", "luxuri"), ("troubled", "troubl"), ("sized", "size"), ("bed", "bed"), ("sing", "sing")],
    "1c": [("cry", "cri"), ("by", "by"), ("say", "say"), ("enjoy", "enjoy")],
    "2": [("relational", "relat"), ("conditional", "condit"), ("valency", "valenc"), ("digitizer", "digit"), ("radically", "radic"), ("decisiveness", "decis"), ("sensibility", "sensibl"), ("analogies", "analog"), ("geology", "geolog"), ("boldly", "bold"), ("early", "earli")],
    "3": [("triplicate", "triplic"), ("formative", "format"), ("electrical", "electr"), ("hopeful", "hope"), ("goodness", "good")],
    "4": [("revival", "reviv"), ("allowance", "allow"), ("adjustable", "adjust"), ("adoption", "adopt"), ("communism", "communism"), ("effective", "effect"), ("bowdlerize", "bowdler")],
    "5": [("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controlling", "control"), ("roll", "roll")],
    "own": [("skies", "sky"), ("dying", "die"), ("news", "news"), ("proceeded", "proceed"), ("innings", "inning"), ("generously", "generous"), ("generate", "generat"), ("x2s", "x2s"), ("größen", "größen"), ("ox", "ox")],
}


@pytest.mark.parametrize(("word", "want"), [p for pairs in RULES.values() for p in pairs])
def test_rules_of_each_step(word, want):
    assert stem(word) == want


WORDS = ["license", "licenses", "licensing", "public", "publicly", "general", "version", "the", "of", "x"]
QUERIES = ["license", "license public", '"public license"', "license -public", "version or general", '"general public" license or version', "licens*", 'public "the license" x', "x x", "general -version or publicly x", "gen* public"]


def made(n=150, seed=1):
    rng = random.Random(seed)
    texts = [None, "", " ,, ", "License", "the public of LICENSES", *(" ".join(rng.choice(WORDS) + rng.choice(["", "", ",", " ..."]) for _ in range(rng.randint(0, 25))) for _ in range(n))]
    return [(i, t) for i, t in enumerate(texts)]


def brute(text, query):
    """Rank and the first of the shortest covers, from all ranges of positions; None where the query is not answered."""
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    prefixes = {w[:-1] for w in query.replace('"', " ").split() if w.endswith("*")}
    same = lambda w, q: w not in tx.STOP and (w.startswith(q) if q in prefixes else stem(w) == stem(q))
    places = lambda p: [(i, i + len(p) - 1) for i in range(len(words) - len(p) + 1) if all(same(words[i + k], w) for k, w in enumerate(p))]
    ways = tx.parse_query(query)
    if not any(all(places(p) for p in yes) and not any(places(p) for p in no) for yes, no in ways):
        return None
    holds = lambda a, b: any(all(any(a <= s and e <= b for s, e in places(p)) for p in yes) for yes, _ in ways)
    # A cover begins and ends with a word of the query.
    ends = [i for i, w in enumerate(words) if any(same(w, q) for yes, _ in ways for p in yes for q in p)]
    ranges = [(a, b) for k, a in enumerate(ends) for b in ends[k:] if holds(a, b)]
    covers = [(a, b) for a, b in ranges if not any((c, d) != (a, b) and a <= c and d <= b for c, d in ranges)]
    asked = {w for yes, _ in ways for p in yes for w in p}
    noise = {(a, b): sum(not any(same(w, q) for q in asked) for w in words[a : b + 1]) for a, b in covers}
    best = min(covers, key=lambda c: (noise[c], c[0]))
    return round(sum(0.1 / (1 + n) for n in noise.values()), 6), *best


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), "doc_id long, text string").repartition(4).persist()


@pytest.fixture(scope="module")
def index(spark, docs):
    found = RetrievalIndex(spark, embedder=False)
    assert found.refresh(docs) == {"added": len(made()), "changed": 0, "deleted": 0}
    return found


@pytest.mark.parametrize("query", QUERIES)
def test_ranks_equal_all_covers(index, query):
    want = {i: b for i, t in made() if (b := brute(t, query)) is not None}
    got = {r["doc_id"]: (r["rank"], r["start"], r["stop"]) for r in index.hits(query).collect()}
    assert got.keys() == want.keys() and want
    for i, (rank, start, stop) in got.items():
        assert rank == pytest.approx(want[i][0], abs=2e-6) and (start, stop) == want[i][1:]


def test_ranks_of_the_tables_texts(spark):
    sf, want = "/root/testdata/sf0.01", {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").where("text ILIKE '%licens%' AND text ILIKE '%public%'").collect():
        if (b := brute(r["text"], "license public")) is not None:
            want[r["doc_id"]] = b[0]
    got = {r["doc_id"]: r["rank"] for r in plans.document_index(spark, sf).hits("license public").collect()}
    assert got == pytest.approx(want, abs=2e-6) and want


def test_what_is_not_asked_finds_nothing(index):
    assert index.hits("").count() == index.hits("the of").count() == index.hits("absent").count() == 0
    with pytest.raises(ValueError, match="wanted"):
        index.hits("-license")


def test_searches_read_the_query_words_only(index):
    plan = index.hits("license public")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(word" in plan and "/units" not in plan and "content" not in plan


def test_headline_shows_the_best_cover(index):
    found = index.fulltext("license public", 20)
    texts = dict(made())
    for r in index.headlines(found, "license public").collect():
        plain = r["headline"].replace("**", "")
        assert plain in re.sub(r"\s+", " ", texts[r["doc_id"]]) and len(re.findall(r"\w+", plain)) <= 60
        words = [w for w in re.split(r"\W+", texts[r["doc_id"]].lower()) if w]
        cover = words[r["start"] : r["stop"] + 1]
        shown = [w for w in re.split(r"\W+", plain.lower()) if w]
        assert any(shown[i : i + len(cover)] == cover for i in range(len(shown)))
        assert {w.lower() for w in re.findall(r"\*\*(\w+)\*\*", r["headline"])} <= {"license", "licenses", "licensing", "public", "publicly"}


def _cut(docs):
    return windows_sql(docs, "text", 40, 10).select("doc_id", "chunk_index", "content")


def answers(index):
    vector = rt.hashed_embedder()(pd.Series(["public license"]))[0]
    out = [sorted(tuple(r) for r in index.hits(q).select(*KEY, "rank").collect()) for q in QUERIES]
    out.append([tuple(r) for r in index.semantic(vector, 25).collect()])
    out.append([tuple(r) for r in index.bm25("license public", 25).collect()])
    return out


def test_segments_answer_as_a_fresh_index(spark, monkeypatch):
    from marlstone.operators import index as module

    monkeypatch.setattr(module, "SEGMENTS", 3)
    rng = random.Random(9)
    texts = dict(made(60, 2))
    index = RetrievalIndex(spark, cut=_cut)
    frame = lambda: spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    index.refresh(frame())
    merged = False
    for step in range(4):
        gone = rng.sample(sorted(texts), 5)
        for i in gone:
            del texts[i]
        changed = rng.sample(sorted(texts), 3 if step < 3 else 1)
        for i in changed:
            texts[i] = f"{texts[i] or ''} a public version {step}"
        new = [1000 + step, 1010 + step]
        texts.update({i: f"general license {i}" for i in new})
        if step == 2:
            texts[gone[0]] = "public again, licensing"
        before = list(index.segments)
        told = index.refresh(frame())
        back = step == 2
        assert told == {"added": 2, "changed": 3 + back if step < 3 else 1, "deleted": 5 - back}
        if len(index.segments) == len(before) + 1:
            own = spark.read.parquet(f"{index.path}/units/segment={index.segments[-1]}")
            assert {r[0] for r in own.select("doc_id").collect()} == {*changed, *new, *([gone[0]] if back else [])}
        merged = merged or len(index.segments) <= len(before)
        assert index.refresh(frame()) == {"added": 0, "changed": 0, "deleted": 0}
        if step in (1, 3):
            fresh = RetrievalIndex(spark, cut=_cut)
            fresh.refresh(frame())
            assert answers(index) == answers(fresh)
    assert merged and len(index.segments) <= 4
    index.merge()
    assert len(index.segments) == 1 and not index.any_dead
    assert answers(index) == answers(fresh)


def test_changed_files_bring_the_index_up_to_date(spark, tmp_path):
    folder = str(tmp_path / "sf")
    rows = [(k, f"a public license {k}") for k in range(5)]
    write = lambda r: spark.createDataFrame(r, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    write(rows)
    assert plans.document_index(spark, folder).hits("license").count() == 5
    write([*rows[:4], (4, "nothing of the kind")])
    again = plans.document_index(spark, folder)
    assert again.hits("license").count() == 4 and len(again.segments) == 2
    assert plans.document_index(spark, folder) is again


def test_empty_tables_make_an_empty_index(spark):
    index = RetrievalIndex(spark, embedder=False)
    index.refresh(spark.createDataFrame([], "doc_id long, text string"))
    assert index.hits("license").count() == 0
    assert index.refresh(spark.createDataFrame([(1, "license"), (None, "license"), (1, "license")], "doc_id long, text string"))["added"] == 1
    assert [r["doc_id"] for r in index.hits("license").select(F.col("doc_id")).collect()] == [1]

"""Deep hierarchies, components, percentiles, patterns, trigrams, linkage, sliding counts and timed release, against plain Python."""

import math
import random
import re
from collections import defaultdict
from datetime import datetime
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import hierarchy, linkage, patterns, quantiles
from marlstone.operators import relational as op
from marlstone.operators.tables import Written, numbered
from marlstone.operators.trigrams import TrigramIndex, codes, literals
from marlstone.plans import registry
from marlstone.streaming import release

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()


# ---- hierarchies


def walked(edges):
    up: dict = {}
    for c, p in edges:
        if c is not None:
            up[c] = min(x for x in (up.get(c), p) if x is not None) if (up.get(c), p) != (None, None) else None
        if p is not None:
            up.setdefault(p, None)
    out = {}
    for n in up:
        at, depth, seen = n, 0, set()
        while up[at] is not None and at not in seen:
            seen.add(at)
            at, depth = up[at], depth + 1
        out[n] = (None, None, True) if up[at] is not None else (at, depth, False)
    return out


@pytest.mark.parametrize("kind", ["chain", "forest", "cycles"])
def test_roots(spark, kind):
    rng = random.Random(kind)
    if kind == "chain":
        names = rng.sample(range(100_000), 10_000)
        edges = list(zip(names[1:], names, strict=False))
    elif kind == "forest":
        edges = [(k, rng.randrange(k)) for k in range(1, 400)] + [(500, None), (None, 3), (501, 500), (7, 9000)]
    else:
        edges = [(k, (k + 1) % 7) for k in range(7)] + [(10, 3), (11, 10), (20, 20), (30, 31), (40, 30)]
    got = {r["node"]: (r["root"], r["depth"], r["cycle"]) for r in hierarchy.roots(spark.createDataFrame(edges, "c long, p long").repartition(4), "c", "p").collect()}
    assert got == walked(edges)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000), (None, 4), (2000, 1), (2000, 1)] + [(3000, k) for k in range(3001, 3050)]
    label = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            label[b] = a
    got = {r["node"]: r["component"] for r in hierarchy.components(spark.createDataFrame(edges, "a long, b long").repartition(5), "a", "b").collect()}
    assert got == {x: find(x) for x in label}


def test_empty_edges(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert hierarchy.roots(none, "a", "b").count() == hierarchy.components(none, "a", "b").count() == 0


# ---- percentiles


@pytest.mark.parametrize("rank", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_exact_percentiles(spark, rank):
    rng = random.Random(4)
    rows = [("wide", rng.gauss(0, 1) * 10 ** rng.randrange(-3, 9)) for _ in range(3000)] + [("same", 5.0)] * 500 + [("two", float(k % 2)) for k in range(700)]
    rows += [("near", 1.0 + k % 40 * 1e-15) for k in range(500)] + [("near", 1e12 + k) for k in range(501)] + [("one", -3.5), ("few", 1.0), ("few", 2.0), (None, 7.0), (None, 9.0), ("null", None), ("odd", math.nan), ("odd", math.inf), ("odd", 4.0)]
    got = {r["k"]: (r["n"], r["quantile"]) for r in quantiles.exact(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", rank, few=20).collect()}
    by = defaultdict(list)
    for k, v in rows:
        if v is not None and math.isfinite(v):
            by[k].append(v)
    assert got.keys() == by.keys()
    for k, v in by.items():
        assert got[k][0] == len(v) and got[k][1] == pytest.approx(float(np.quantile(v, rank)), rel=1e-12, abs=1e-12)


def test_sketches_keep_ranks_within_two_percent(spark):
    rng = np.random.default_rng(2)
    rows = [("a", datetime(2024, 1, 1, int(h)), float(v)) for h, v in zip(rng.integers(0, 24, 20_000), rng.lognormal(0, 2, 20_000), strict=True)] + [("b", datetime(2024, 1, 1), 1.0), ("a", datetime(2024, 1, 1), None)]
    hours = quantiles.hourly(spark.createDataFrame(rows, "k string, at timestamp, v double"), ["k"], "at", "v")
    assert hours.count() == 25
    got = {r["k"]: (r["n"], r["values"]) for r in quantiles.from_sketches(hours, ["k"], [0.1, 0.5, 0.95]).collect()}
    v = np.sort([x for k, _, x in rows if k == "a" and x is not None])
    assert got["a"][0] == len(v) and got["b"] == (1, [1.0] * 3)
    for rank, x in zip((0.1, 0.5, 0.95), got["a"][1], strict=True):
        assert abs(np.searchsorted(v, x) / len(v) - rank) < 0.02


def test_percentiles_of_sketches(spark):
    exact = {r["event_type"]: r["v"] for r in spark.read.parquet(f"{SF}/events.parquet").groupBy("event_type").agg(F.sort_array(F.collect_list("value")).alias("v")).collect()}
    for r in QUERIES["percentiles_of_sketches"](spark, SF).collect():
        v = exact[r["event_type"]]
        assert r["n"] == len(v) and all(abs(np.searchsorted(v, x) / len(v) - q) < 0.03 for q, x in zip((0.5, 0.95, 0.99), r["values"], strict=True))


# ---- patterns and trigrams


def test_required_literals():
    assert patterns.required("foo|bar+x") == {"foo", "ba"} and patterns.required("(?i)Hello world") == {"hello world"}
    assert patterns.required(r"\d+abc\d*longer?") == {"longe"} and patterns.required("(?:ab){2,}c") == {"ab"}
    for none in ("a?b*", r"\d{3}", "a|", "[ab]c", r"\Qab\E", r"\p{L}abc", "(?ui)abc", "(?x) a b c", "(", "é{2}"):
        assert patterns.required(none) is None
    assert patterns.required("x(abc|de)y") in ({"abc", "de"},) and patterns.required("(?=abc)xy") == {"xy"}


def test_five_thousand_rules_equal_rlike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    words = sorted({w for r in docs.collect() for w in re.findall(r"[A-Za-z]{2,}", r["text"] or "")})
    rng = random.Random(3)
    forms = ["{a}", "(?i)\\b{a}\\b", "{a}\\s+{b}", "(?i)({a}|{b})x", "^{a}", "{a}[.,]$", "{a}.{{0,9}}{b}", "\\d{{3}}{a}?"]
    rules = [(k, rng.choice(forms).format(a=rng.choice(words), b=rng.choice(words)), f"t{k % 7}") for k in range(4990)] + [(4990 + k, p, None) for k, p in enumerate(["\\d{7}", "[A-Z]{5}", "é", "(?i)ÄB", "\\p{Lu}{4}", "zz|qq", "", None, "a{3}", "[^\\x00-\\x7F]{6}"])]
    frame = spark.createDataFrame(rules, "rule int, pattern string, text string")
    few = docs.where("doc_id < 40")
    found = patterns.pattern_join(few.withColumnRenamed("text", "body"), frame, "body", "pattern")
    assert found.columns == ["doc_id", "body", "rule", "pattern", "text"]
    got = sorted((r["doc_id"], r["rule"]) for r in found.collect())
    want = few.crossJoin(frame.select("rule", "pattern")).where("text RLIKE pattern")
    assert got == sorted((r["doc_id"], r["rule"]) for r in want.collect()) and len(got) > 500
    none = patterns.pattern_join(few.limit(0).withColumnRenamed("text", "body"), frame, "body", "pattern")
    assert none.count() == 0 and patterns.pattern_join(few, frame.limit(0).withColumnRenamed("text", "tag"), "text", "pattern").count() == 0


def test_rule_join_takes_any_number_of_rules(spark):
    df = spark.createDataFrame([(k, f"row{k} end") for k in range(100)], "k long, s string")
    rules = spark.createDataFrame([(k, f"row{k} ") for k in range(90)], "rule long, p string")
    assert sorted((r["k"], r["rule"]) for r in op.rule_join(df, rules, "s", "p").collect()) == [(k, k) for k in range(90)]


def test_literals_of_like_patterns():
    assert literals(r"%ab_cd\%e%") == ["ab", "cd%e"] and literals("%%") == [] and len(codes("abcabc")) == 3


@pytest.mark.parametrize("like", ["%abc%", "%ABC%", "abc%", "%a_c%d%", "%é😀x%", "%ab%", "%50\\%x%", "%zzz%", "%", "", "%STRASSE%", "%İst%"])
def test_trigrams_equal_ilike(spark, like):
    rng = random.Random(8)
    texts = [None, "", "ab", "abc", "x ABC y", "é😀x", "É😀X", "50%x", "50 x", "straße STRASSE", "İstanbul", *("".join(rng.choice("abcd xé") for _ in range(rng.randrange(60))) for _ in range(200))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "abc")], "id long, s string").repartition(3)
    index = TrigramIndex.build(df, "id", "s")
    keyed = df.where("id IS NOT NULL")
    found = index.candidates(like)
    want = sorted(r["id"] for r in keyed.where(F.col("s").ilike(like)).collect())
    assert sorted(r["id"] for r in index.search(like).where("id IS NOT NULL").collect()) == want
    if found is not None:
        n = found.count()
        assert len(want) <= n < len(texts) and {r["id"] for r in found.collect()} >= set(want)


# ---- linkage


def test_linked_records(spark):
    rng = random.Random(6)
    words = ["smith", "jones", "county", "estate", "bank", "north", "of", "king", "trust", "llc"]
    rows = [(k, " ".join(rng.sample(words, rng.randint(1, 4))).title() + rng.choice(["", ".", ", "]), rng.choice(["A", "B", None]), rng.randrange(3)) for k in range(200)] + [(900, None, "A", 1), (901, "", "A", 1), (None, "Smith", "A", 1)]
    df = spark.createDataFrame(rows, "id long, name string, court string, year int").repartition(4)
    got = {r["id"]: r["entity"] for r in linkage.linked(df, "id", F.col("name"), [F.col("court"), F.col("year")], near=1000).collect()}
    form = {i: " ".join(sorted(set(re.findall(r"\w+", (n or "").lower())))) for i, n, _, _ in rows if i is not None}
    label = {i: i for i in form}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    named = [r for r in rows if r[0] is not None]
    for a in named:
        for b in named:
            if a[0] < b[0] and (a[2] is not None and a[2] == b[2] or a[3] == b[3]):
                x, y = set(form[a[0]].split()), set(form[b[0]].split())
                if x == y or x and y and len(x & y) / len(x | y) >= 0.6:
                    p, q = sorted((find(a[0]), find(b[0])))
                    label[q] = p
    assert got == {i: find(i) for i in label}
    near = {r["id"]: r["entity"] for r in linkage.linked(df, "id", F.col("name"), [F.col("court"), F.col("year")]).collect()}
    # Fewer comparisons find no link that is not there.
    assert near.keys() == got.keys() and all(find(near[i]) == find(i) for i in near)


def test_linked_parts(spark):
    got = QUERIES["linked_parts"](spark, SF).collect()
    names = {r["p_partkey"]: r["p_name"] for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    assert {r["id"] for r in got} == set(names) and all(r["entity"] <= r["id"] for r in got)


def test_canonical_records_and_their_links(spark):
    rows = [(1, "c1", "pacer", "x", 1, 5, False), (2, "c1", "pacer", "x", 1, 9, False), (3, "c1", "pacer", "x", 1, 2, True), (4, "c1", "manual", "y", 7, 99, False), (5, "c1", "manual", "z", 7, 1, True), (6, None, "pacer", None, 1, 1, False), (7, None, "other", None, 9, 1, False), (8, "c2", "other", "x", 9, 1, False)]
    df = spark.createDataFrame(rows, "id long, g string, s string, c string, p int, rich int, kept boolean").repartition(3)
    links = spark.createDataFrame([(1, "anna"), (2, "anna"), (4, "bert"), (5, "carl"), (7, "dora"), (99, "emil")], "record long, target string")
    fate, moved = linkage.canonical(df, "id", "g", "s", "c", F.col("p"), F.col("rich"), F.col("kept"), links)
    got = {r["id"]: (r["canonical_id"], r["is_canonical"], r["deleted"], r["into"]) for r in fate.collect()}
    # 3 holds what nothing else does, so it stays and is the source's record; of the best source the richest that is left leads.
    assert got == {1: (3, False, "copy", 3), 2: (3, False, "copy", 3), 3: (3, True, None, None), 4: (3, False, "source", 3), 5: (3, False, None, None), 6: (6, True, None, None), 7: (6, False, "source", 6), 8: (8, True, None, None)}
    assert sorted(map(tuple, moved.collect())) == [(3, "anna"), (3, "bert"), (5, "carl"), (6, "dora"), (99, "emil")]
    rest = linkage.availability(df.withColumnRenamed("c", "e"), fate, "id", "g", "s", "e").collect()
    assert {(r["g"], r["s"], r["e"]): r["id"] for r in rest}["c1", "pacer", "x"] == 3 and len(rest) == 6


# ---- counts and order


def test_sliding_counts(spark):
    rng = random.Random(7)
    rows = [(k, "hot" if k % 3 else rng.choice(["a", "b", None]), None if k == 5 else datetime(2024, 3, 1, rng.randrange(6), rng.randrange(60), rng.randrange(60))) for k in range(600)]
    got = {r["id"]: r["n"] for r in op.sliding_counts(spark.createDataFrame(rows, "id long, c string, at timestamp").repartition(4), ["c"], "at", 600).collect()}
    assert got == {i: 0 if at is None else sum(c2 == c and a2 is not None and 0 <= (at - a2).total_seconds() <= 600 for _, c2, a2 in rows) for i, c, at in rows}


def test_numbered(spark):
    rows = [(k * 7919 % 1000,) for k in range(1000)]
    got = numbered(spark.createDataFrame(rows, "v long").repartition(7), Written(spark), "t", "n", "v").collect()
    assert all(r["n"] == r["v"] + 1 for r in got)


# ---- timed release


def plain_release(events, gap=300.0, most=20, zone="UTC", quiet=(22, 7)):
    """Second by second: what waits goes out at the first second that is allowed."""
    by, out = defaultdict(list), []
    for k, at, i, s in events:
        by[k].append((at, i, s))
    for k, queue in by.items():
        queue.sort()
        last, now = None, math.floor(queue[0][0])
        while queue:
            hour = datetime.fromtimestamp(now, ZoneInfo(zone)).hour
            still = hour >= quiet[0] or hour < quiet[1] if quiet[0] > quiet[1] else quiet[0] <= hour < quiet[1]
            ready = [q for q in queue if q[0] <= now][:most]
            if ready and not still and (last is None or now - last >= gap):
                different = list(dict.fromkeys(s for _, _, s in ready))
                out.append((k, float(now), len(ready), ready[0][1], ready[-1][1], " / ".join(different[:3]) + (f" (+{len(ready) - 3} more)" if len(different) > 3 else "")))
                queue, last = queue[len(ready) :], now
            now += 1 if ready else max(1, math.floor(queue[0][0]) - now) if queue else 1
    return sorted(out)


def messages(seed, zone):
    rng = random.Random(seed)
    start = int(datetime(2024, 3, 9, 20, tzinfo=ZoneInfo(zone)).timestamp())
    # Over a night in which the clocks change in America, with bursts of more than a batch.
    at = [start + rng.randrange(20 * 3600) for _ in range(60)] + [start + 50_000 + rng.randrange(100) for _ in range(90)]
    return [(f"k{i % 3}", float(t), i, f"s{rng.randrange(6)}") for i, t in enumerate(at)]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
@pytest.mark.parametrize("quiet", [(22, 7), (12, 14)])
def test_release(spark, zone, quiet):
    events = messages(1, zone)
    df = spark.createDataFrame(events, "k string, at double, id long, who string").repartition(4)
    got = sorted(map(tuple, release.release(df, "k", "at", "id", "who", zone=zone, quiet=quiet).collect()))
    assert got == plain_release(events, zone=zone, quiet=quiet) and any(r[2] == 20 for r in got)


def test_notification_release(spark):
    events = [(str(r["user_id"]), r["at"], r["event_id"], r["event_type"]) for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")).collect()]
    got = QUERIES["notification_release"](spark, SF).collect()
    assert sum(r["n"] for r in got) == len(events) and sorted(map(tuple, got)) == sorted(release.batches_of(sorted(events), zone="America/Los_Angeles"))
    for r in got:
        hour = datetime.fromtimestamp(r["released_at"], ZoneInfo("America/Los_Angeles")).hour
        assert 7 <= hour < 22


def test_a_stream_releases_without_a_further_message(spark, tmp_path):
    events = messages(2, "UTC")
    end = max(t for _, t, _, _ in events)
    folder = str(tmp_path / "in")
    schema = "k string, at timestamp, id long, who string"
    put = lambda rows: spark.createDataFrame(rows, "k string, s double, id long, who string").select("k", F.timestamp_seconds("s").alias("at"), "id", "who").coalesce(1).write.mode("append").parquet(folder)
    put(events[::2])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        src = spark.readStream.schema(schema).parquet(folder)
        out = release.release_stream(src, "k", "at", "id", "who", delay="2 days")

        def go():
            out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

        go()
        put(events[1::2])
        go()
        # Another recipient's message, days later, moves the watermark; the first ones send nothing any more.
        put([("late", end + 4 * 86400, 10_000, "x")])
        go()
        put([("late", end + 5 * 86400, 10_001, "x")])
        go()
        got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).where("recipient <> 'late'").collect()))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == plain_release(events)

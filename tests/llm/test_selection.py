"""Importance resampling, source mixing and whitening against brute force, with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from test_operators_llm import SCHEMA, corpus

from marlstone.llm import importance, mixing, queries, whitening
from marlstone.llm.ranks import numbered
from marlstone.llm.store import Scratch

SF = "/root/testdata/sf0.001"
FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TARGET = ["one two three", "abc é😀 word word", None, "", "x" * 3000 + " tail"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def feature_buckets(text, longest, buckets):
    w = FEATURE.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    runs = [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    return [zlib.crc32(r.encode()) % buckets for r in runs], len(w)


def brute_resample(rows, target, longest, buckets, percent, least):
    own = [(r[0], *feature_buckets(r[1], longest, buckets)) for r in rows]
    s, t = Counter(b for _, f, _ in own for b in f), Counter(b for x in target for b in feature_buckets(x, longest, buckets)[0])
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets))))
    out = []
    for i, found, words in own:
        weight = sum(map(gain, found))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words >= least])
    some = sorted((r for r in out if r[5]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1]))
    for k, r in enumerate(some[: len(some) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize(("longest", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (3, 97, 50, 1), (2, 1000, 100, 3)])
def test_resampling(spark, docs, longest, buckets, percent, least):
    target = spark.createDataFrame([(k, t) for k, t in enumerate(TARGET)], "score long, text string")
    got = importance.resample(docs, target, longest=longest, buckets=buckets, percent=percent, least_words=least)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(corpus(), TARGET, longest, buckets, percent, least)


def test_resampling_of_empty_tables(spark, docs, empty):
    assert importance.resample(empty, docs).count() == 0
    got = importance.resample(docs, empty)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(corpus(), [], 1, 10_000, 10, 20)


def test_features_do_not_cross_documents():
    texts = ["ab", "cd ef", "", "gh", " ", "é" * 90 + "Z9 z"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    found, owner, words = importance.features(np.frombuffer(b"".join(raw), np.uint8), offsets, 2, 1 << 20)
    got = defaultdict(list)
    for b, o in zip(found.tolist(), owner.tolist(), strict=True):
        got[o].append(b)
    for k, t in enumerate(texts):
        want, n = feature_buckets(t, 2, 1 << 20)
        assert sorted(got[k]) == sorted(want) and words[k] == n


@pytest.mark.parametrize("seed", range(3))
def test_numbered_splits_ties(spark, seed):
    rng = random.Random(seed)
    rows = [(7 if rng.random() < 0.5 else rng.randrange(50), k) for k in range(700)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(6)
    got = sorted((r["n"], r["a"]) for r in numbered(df, Scratch(spark), "t", "n", "a").collect())
    assert got == list(zip(range(1, 701), sorted(a for a, _ in rows), strict=True))


def fill(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets in exact order: hold all that are above, and share again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    held: dict = {}
    while True:
        free = [s for s in names if s not in held]
        if not free:
            return held
        level = (share * sum(sizes.values()) - sum(held.values())) / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] >= most * sizes[s]]
        if not above:
            return held | {s: level * weight[s] for s in free}
        held |= {s: most * sizes[s] for s in above}


def mixing_rows():
    rng = random.Random(3)
    sources = [None, "", "a", "Z", "é", "😀", "b"]
    out = []
    for i in range(900):
        s = "a" if i % 3 == 0 else rng.choice(sources)
        n = rng.choice([0, 1, 3, 40]) if s != "b" else 0
        out.append((i, None if i == 5 else rng.choice(["", " ", "\n\t"]) + " \x0b".join(["w"] * n) + rng.choice(["", "  "]), s, "clash", 1.5, 2))
    return [*out, out[3], out[3], (None, "a null id", "a", None, None, None), (None, None, "Z", None, None, None)]


MIX_SCHEMA = "doc_id long, text string, source string, target string, rate double, size int"


def test_mixing(spark):
    rows = mixing_rows()
    df = spark.createDataFrame(rows, MIX_SCHEMA).repartition(4)
    got = mixing.plan_mix(df).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len(WORD.findall(r[1] or ""))
    want = fill(sizes)
    assert sorted((repr(r["id"]), r["size"]) for r in got) == sorted((repr(r[0]), len(WORD.findall(r[1] or ""))) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-12)
        rate = min(r["target"] / r["source_size"], 2) if r["source_size"] else 0
        assert math.floor(rate) <= r["copies"] <= math.ceil(rate) <= 2
        taken[r["source"]] += r["size"] * r["copies"]
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s, n in taken.items():
        squares = sum(len(WORD.findall(r[1] or "")) ** 2 for r in rows if r[2] == s)
        assert abs(n - want[s]) <= 4 * 0.5 * math.sqrt(squares) + 1e-6
    assert sorted(map(repr, mixing.plan_mix(df.repartition(7)).collect())) == sorted(map(repr, got))


def test_the_mixture_holds_the_planned_copies(spark):
    df = spark.createDataFrame(mixing_rows(), MIX_SCHEMA).repartition(4)
    plan = Counter()
    for r in mixing.plan_mix(df).collect():
        plan[r["id"], r["source"]] += r["copies"]
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert Counter((r["doc_id"], r["source"]) for r in out.collect()) == +plan


def test_mixing_follows_weights_and_limits(spark):
    """Level and limits, with rounds that hold one source after another."""
    sizes = {f"s{k}": 4**k for k in range(6)}
    df = spark.createDataFrame([(k, "w " * n, s) for k, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    for weights, share in (((1,), 1.5), ((5, 2, 1), 1.5), ((1, 9), 0.4), ((3, 1), 1.99)):
        got = {r["source"]: r["target"] for r in mixing.plan_mix(df, weights=weights, share=share).collect()}
        want = fill(sizes, weights, share)
        assert all(math.isclose(got[s], want[s], rel_tol=1e-12) for s in sizes)


def test_mixing_has_no_python_and_takes_empty_tables(spark, empty):
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["copies"]) for r in mixing.plan_mix(blank).collect()] == [(0.0, 0)] * 2
    plan = queries.op12_source_mixing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_whitening(rows, k=4):
    good = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    fit = np.array(sorted({tuple(x.tolist()) for _, x in good}), float)
    n, total = len(fit), fit.sum(0)
    centred = fit - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    return good, n, total.astype(np.int64), values[order], vectors[:, order], values.sum()


def vectors(width, count, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((count, width)) @ np.diag(np.linspace(2, 1, width))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(1000 + k, rows[k % 5][1]) for k in range(40)]
    rows += [(2000, None), (2001, []), (2002, [None, *rows[0][1][1:]]), (2003, [math.nan, *rows[0][1][1:]]), (2004, [*rows[0][1][:-1], math.inf]), (None, rows[1][1])]
    return rows


@pytest.mark.parametrize(("width", "block"), [(3, 32), (6, 32), (64, 32), (90, 8)])
def test_whitening(spark, monkeypatch, width, block):
    rows = vectors(width, 400, width)
    if block == 8:
        monkeypatch.setattr(whitening, "KEPT", 40)
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, n int, whitened double").repartition(5)
    got = whitening.whiten(df, block=block).collect()
    good, n, total, values, parts, trace = brute_whitening(rows)
    k = min(4, width)
    assert len(got) == k * len(good) and Counter(repr(r["id"]) for r in got) == Counter({i: k * c for i, c in Counter(repr(i) for i, _ in good).items()})
    x = dict(good)
    sign: dict = {}
    for r in got:
        c, v = r["component"] - 1, x[r["id"]]
        assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(v.tolist(), total.tolist(), strict=True))
        want = float((v - total / n) @ parts[:, c] / math.sqrt(values[c]))
        if abs(want) > 0.1:
            assert sign.setdefault(c, math.copysign(1, want * r["whitened"])) == math.copysign(1, want * r["whitened"])
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-8
        assert r["explained"] == pytest.approx(values[c] / trace, rel=1e-10) and 0 <= r["identity_error"] < 1e-10


def test_whitening_of_few_directions_and_large_numbers(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(k, [k * 1.0, k * 2.0, 0.0]) for k in range(9)], schema)).collect()
    assert {r["component"] for r in line} == {1} and {round(r["explained"], 12) for r in line} == {1.0}
    other = whitening.whiten(spark.createDataFrame([*((k, [k * 1.0, k % 3 * 2.0]) for k in range(9)), (50, [1.0])], schema)).collect()
    assert {r["id"] for r in other} == set(range(9))
    large = {r["id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame([(1, [3.0e6]), (2, [-1.0]), (3, [1.0e30]), (4, [7.0])], schema)).collect()}
    assert large[3] is None
    far = [768_000_000, -256, 1792]
    whole = {r["id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame([(1, [3.0e6]), (2, [-1.0]), (4, [7.0])], schema)).collect()}
    assert whole == {i: (3 * v - sum(far)) ** 2 for i, v in zip((1, 2, 4), far, strict=True)}


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_source_mixing"])
def test_queries_match_their_oracles(spark, name):
    assert oracle.difference(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.ORACLE_SQL[name]) is None


def test_whitening_query(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.op13_embedding_whitening(spark, SF).collect()
    good, n, total, values, parts, trace = brute_whitening(rows)
    assert len(got) == 4 * len(good)
    x = dict(good)
    for r in got:
        c = r["component"] - 1
        assert abs(abs(r["whitened"]) - abs((x[r["vec_id"]] - total / n) @ parts[:, c] / math.sqrt(values[c]))) < 1e-7

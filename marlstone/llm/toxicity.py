"""Toxicity scores after noisy-channel deobfuscation.

A token written with digits or signs for letters, with letters apart or with
drawn-out letters is a lattice of what its writer may have meant.  Viterbi
decoding picks the likeliest word under a character trigram model counted over
the whole corpus and a channel that charges for each change.  Words, as written
and as restored, and their beginnings are weighed by how much oftener they
stand in toxic documents; a logistic curve turns a document's weights into a
score.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.store import Scratch

#: At most about so many labelled documents are learned from, chosen by hash of the id.
SAMPLE = 20_000
LEAST_TOXIC = 4
LEAST_WEIGHT = 2.0
REMEMBERED = 300_000
PREFIXES = (5, 6, 7, 8)

#: What a sign may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i"}
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_CODE = {c: i + 1 for i, c in enumerate(_LETTERS)}
_LUT = np.zeros(257, np.int64)
for _c, _i in _CODE.items():
    _LUT[ord(_c)] = _i
_SIZE = 64
_EDGE = ".,;:!?\"'()[]{}<>*%&$#|-_=+/\\~`^"
_FRONT = "".join(c for c in _EDGE if c not in LOOKS_LIKE)
#: What the channel charges for reading a sign or digit as a letter, for dropping another sign or a repetition, and for dropping a readable sign.
CHANGE, DROP, DROP_READABLE = 1.5, 0.7, 3.0
#: What a word boundary costs between letters that stand apart, beside the model's price of the word's end and of the next one's start.
BREAK = 1.0
#: After so many characters the likeliest reading so far is settled, so a lattice of any length needs little memory.
BLOCK = 256


def bare(token: str) -> str:
    """A token without the signs around it; one in front that looks like a letter stays."""
    return token.rstrip(_EDGE).lstrip(_FRONT)


def trigram_counts(text: str) -> np.ndarray:
    """Counts of letter trigrams, with 0 for all that is no letter of the model."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.concatenate([[0, 0], _LUT[np.minimum(code, 256)], [0]])
    return np.bincount((x[:-2] * _SIZE + x[1:-1]) * _SIZE + x[2:], minlength=_SIZE**3)


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of a letter after two others, counted over all rows."""

    def count(batches):
        total = np.zeros(_SIZE**3, np.int64)
        for b in batches:
            held, size = [], 0
            for text in b.column(0).to_pylist():
                held.append(text or "")
                size += len(held[-1])
                if size > 1_000_000:
                    total += trigram_counts(" ".join(held))
                    held, size = [], 0
            total += trigram_counts(" ".join(held))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])

    got = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(_SIZE**3)
    n[got["slot"].to_numpy()] = got["n"].to_numpy()
    n = n.reshape(_SIZE, _SIZE, _SIZE)
    back = n.sum(0, keepdims=True) + 0.5
    back = back / back.sum(2, keepdims=True)
    return np.log((n + 5 * back) / (n.sum(2, keepdims=True) + 5)).astype(np.float32)


def suspicious(token: str) -> bool:
    """Whether a token, without signs at its ends, has signs among letters or a letter three times in a row."""
    t = bare(token)
    if t.isalpha():
        return any(t[i] == t[i - 1] == t[i - 2] for i in range(2, len(t)))
    return len(t) > 2 and any(c.isalpha() for c in t)


def _path(way: tuple | None) -> str:
    out = []
    while way:
        way, x = way
        out.append(x)
    return "".join(reversed(out))


def restore(token: str, model: np.ndarray, apart: bool = False) -> str:
    """The likeliest word that a token was written for: Viterbi over the lattice of its readings.

    Each character may be kept (letters), read as a letter it looks like, or
    dropped (signs, and repetitions of the letter before).  States are the last
    two letters; ties go to the reading found first.  With ``apart`` the token
    was put together from single letters and may be several words, which come
    back with spaces between.
    """
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before, settled = "", []
    text = bare(token).lower()
    for at, c in enumerate(text):
        now: dict[tuple[int, int], tuple[float, tuple | None]] = {}

        def add(state, cost, way, now=now):
            if state not in now or cost < now[state][0]:
                now[state] = (cost, way)

        letters = [(c, 0.0)] if c in _CODE else [(x, CHANGE if c.isalnum() else CHANGE + 0.3) for x in LOOKS_LIKE.get(c, "")]
        droppable = c not in _CODE or c == before
        for (a, b), (cost, way) in best.items():
            for x, price in letters:
                k = _CODE[x]
                add((b, k), cost + price - float(model[a, b, k]), (way, x))
            if droppable:
                add((a, b), cost + (DROP_READABLE if c in LOOKS_LIKE else DROP), way)
        if apart and now and at < len(text) - 1:
            ends = [(cost + BREAK - float(model[a, b, 0]), (way, " ")) for (a, b), (cost, way) in now.items() if b]
            if ends:
                add((0, 0), *min(ends, key=lambda e: e[0]))
        best, before = now or best, c
        if at % BLOCK == BLOCK - 1:
            state, (cost, way) = min(best.items(), key=lambda s: s[1][0])
            settled.append(_path(way))
            best = {state: (cost, None)}
    ways = [(cost - float(model[a, b, 0]), _path(way)) for (a, b), (cost, way) in best.items()]
    return "".join(settled) + min(ways, default=(0.0, ""))[1]


def features(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def spaced(words: list[str]) -> list[str]:
    """Words written with their letters apart: runs of four single characters or more, joined; where one word ends is for the lattice to say."""
    sizes = bytes(min(len(w), 255) for w in words)
    if b"\1\1\1\1" not in sizes:
        return []
    out, run = [], []
    for w in [*words, "  "]:
        if len(w) == 1 and (w.isalnum() or w in LOOKS_LIKE):
            run.append(w)
        else:
            if len(run) > 3:
                out.append("".join(run))
            run = []
    return out


class Reader:
    """Readings of tokens, remembered within a task."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}

    def forms(self, token: str) -> tuple[str, ...]:
        found = self.known.get(token)
        if found is None:
            plain = token.strip(_EDGE).lower()
            found = (plain,) if plain else ()
            if suspicious(token):
                found = tuple(dict.fromkeys([*found, restore(token, self.model)]))
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[token] = found
        return found

    def words(self, text: str) -> tuple[set[str], int]:
        """Distinct readings of all words, and the number of words."""
        words = text.split()
        out = {f for w in set(words) for f in self.forms(w)}
        for run in spaced(words):
            out.update((run.lower(), *restore(run, self.model, True).split()))
        return out, len(words)


def _weights(sample: DataFrame, model) -> dict[str, float]:
    """Log odds of features between toxic and other documents of the sample; both counts are of documents."""

    def count(batches):
        reader, held = Reader(model.value), Counter()
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = {f for w in reader.words(text or "")[0] for f in features(w)}
                held.update((f, label) for f in found)
                if len(held) > 400_000:
                    yield batch(held)
                    held.clear()
        yield batch(held)

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([v if k[1] else 0 for k, v in held.items()], pa.int64()), pa.array([0 if k[1] else v for k, v in held.items()], pa.int64())], ["f", "t", "n"])

    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return {}
    counted = sample.select("text", "y").mapInArrow(count, "f string, t long, n long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).where(F.col("t") >= LEAST_TOXIC)
    odds = F.log((F.col("t") + 0.5) / (toxic - F.col("t") + 0.5)) - F.log((F.col("n") + 0.5) / (other - F.col("n") + 0.5))
    rows = counted.withColumn("w", odds).where(F.col("w") >= LEAST_WEIGHT).select("f", "w").collect()
    # The bounded sample bounds the features: each is in LEAST_TOXIC of its documents.
    return {r["f"]: r["w"] for r in rows}


def evidence(found: set[str], n_words: int, weights: dict[str, float]) -> tuple[float, float]:
    """Summed weight of the words that tell, each by its strongest feature, and that sum for each hundred words."""
    total = 0.0
    for w in found:
        best = weights.get(w, 0.0)
        for n in PREFIXES:
            if len(w) > n:
                best = max(best, weights.get(w[:n] + "*", 0.0))
        total += best
    return math.log1p(total), math.log1p(100 * total / max(n_words, 20))


class Scorer:
    def __init__(self, model: np.ndarray, weights: dict[str, float], curve: np.ndarray) -> None:
        self.model, self.weights, self.curve = model, weights, curve

    def score(self, reader: Reader, text: str | None) -> float:
        found, n = reader.words(text or "")
        z = float(self.curve @ np.array([1.0, *evidence(found, n, self.weights)]))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = SAMPLE) -> Scorer:
    """The character model from all of ``docs``; weights and curve from a bounded sample of the documents that ``labels`` marks.

    Rows with a null label or text are not learned from.  Without both labels
    the score is the labels' mean, or 0 without any.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    model = language_model(docs, text_col)
    shared = spark.sparkContext.broadcast(model)
    marked = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y"))
    share = min(1.0, limit / max(marked.count(), 1)) * 1_000_000
    drawn = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1_000_000)) < share
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # Both sides are cut before they meet, so only the sample's texts are shuffled.
    sample = scratch.keep(texts.where(drawn).join(marked.where(drawn), "id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "sample")
    weights = _weights(sample, shared)
    kept = spark.sparkContext.broadcast(weights)

    def vectors(batches):
        reader = Reader(shared.value)
        for b in batches:
            got = [evidence(*reader.words(t), kept.value) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), b.column(1)], ["a", "b", "y"])

    t = sample.select("text", "y").mapInArrow(vectors, "a double, b double, y int").toArrow()
    scratch.drop()
    y = t["y"].to_numpy().astype(float)
    if len(y) and y.min() != y.max():
        order = np.lexsort((t["b"].to_numpy(), t["a"].to_numpy(), y))
        x = np.column_stack([np.ones(len(y)), t["a"].to_numpy(), t["b"].to_numpy()])[order]
        curve = _logistic(x, y[order])
    else:
        mean = min(max(y.mean() if len(y) else 0.0, 1e-6), 1 - 1e-6)
        curve = np.array([math.log(mean / (1 - mean)), 0.0, 0.0])
    return Scorer(model, weights, curve)


def score_documents(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id`` and ``score``; a null or empty text gets the score of no evidence.

    Repeated rows and null ids stay; extra columns are ignored; an empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def rows(batches):
        s = shared.value
        reader = Reader(s.model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.score(reader, t) for t in b.column(1).to_pylist()], pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, docs.select(F.col(id_col).alias("id")).withColumn("score", F.lit(0.0)).schema)

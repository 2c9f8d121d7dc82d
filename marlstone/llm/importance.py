"""Target-distribution importance resampling over hashed n-gram features.

Two passes over the texts as Arrow batches.  The first counts the features of
each partition in one vector of a fixed number of buckets; the vectors are
added as a tree of tasks.  From the corpus' and the target's vectors come the
buckets' gains, which the second pass sums for each document.  Gumbel noise
from a hash of the id makes taking the highest scores a draw without
replacement, and the draw is cut off by an exact distributed rank.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import textkit
from marlstone.llm.ranks import numbered
from marlstone.llm.store import Scratch

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Bytes of a word that are hashed together with other words; longer words are hashed each for itself.
_TOGETHER = 64
#: The draw's cutoff is looked for so far below the share that is drawn; a sketch of four times this precision finds it.
_MARGIN = 0.004

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def _extend(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes ``start`` to ``end`` each."""
    length = end - start
    short = np.minimum(length, _TOGETHER)
    short[length > _TOGETHER] = 0
    order = np.argsort(-short, kind="stable")
    s, at = state[order], start[order]
    # How many words are longer than j bytes.
    longer = len(short) - np.cumsum(np.bincount(short, minlength=_TOGETHER + 1))
    for j in range(_TOGETHER):
        m = int(longer[j])
        if m == 0:
            break
        s[:m] = _CRC[(s[:m] ^ data[at[:m] + j]) & np.uint32(255)] ^ (s[:m] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = s
    for i in np.flatnonzero(length > _TOGETHER).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(state[i] ^ _ONES)) ^ 0xFFFFFFFF
    return out


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and document of every feature, and each document's number of words."""
    data = _LOWER[data]
    n = len(data)
    solid = np.concatenate([[False], _WORD[data], [False]])
    first, last = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] |= solid[1:-1][inner]
    last[inner - 1] |= solid[1:-1][inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    words = np.bincount(doc, minlength=len(offsets) - 1)
    found, owner = [], []
    at = np.arange(len(start))
    state = _extend(np.full(len(start), _ONES), data, start, end)
    for k in range(1, longest + 1):
        if k > 1:
            # Runs that go on in their document: a space and the next word.
            following = at + (k - 1)
            inside = following < len(start)
            inside[inside] = doc[following[inside]] == doc[at[inside]]
            at, following, state = at[inside], following[inside], state[inside]
            state = _CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
            state = _extend(state, data, start[following], end[following])
        found.append((state ^ _ONES) % np.uint32(buckets))
        owner.append(doc[at])
    return np.concatenate(found).astype(np.int64), np.concatenate(owner), words


def _parts(column: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = textkit.utf8(column)
    for i, j in textkit.chunks(offsets):
        part = offsets[i : j + 1]
        yield features(data[part[0] : part[-1]], part - part[0], longest, buckets)


def bucket_counts(texts: DataFrame, text_col: str, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def rows(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for found, _, _ in _parts(b.column(0), longest, buckets):
                total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select(F.col(text_col).cast("string")).mapInArrow(textkit.tidy(rows), "counts binary").rdd
    if vectors.getNumPartitions() == 0:
        return np.zeros(buckets, np.int64)
    return vectors.map(lambda r: np.frombuffer(r[0], np.int64)).treeReduce(np.add, depth=3)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight: 1000 times the log ratio of the smoothed shares, rounded down."""
    n, whole, goal = len(source), float(source.sum()), float(target.sum())
    ratio = [(t + 1.0) * (whole + n) / ((s + 1.0) * (goal + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, longest: int = 1) -> DataFrame:
    """``id``, ``n_features``, ``n_words`` and ``weight``, the sum of the gains of its features, of each document."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def rows(batches):
        table = held.value
        for b in batches:
            counts, words, weights = [], [], []
            for found, owner, n_words in _parts(b.column(1), longest, len(table)):
                counts.append(np.bincount(owner, minlength=len(n_words)))
                weights.append(np.bincount(owner, weights=table[found], minlength=len(n_words)))
                words.append(n_words)
            if counts:
                cells = [pa.array(np.concatenate(x).astype(np.int64)) for x in (counts, words, weights)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cells], ["id", "n_features", "n_words", "weight"])

    bare = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return bare.mapInArrow(textkit.tidy(rows), "id long, n_features long, n_words long, weight long")


def noise(id_col: str, seed: str = SEED):
    """Gumbel noise of an id, in thousandths, rounded down: the highest sums of log weight and noise are a draw without replacement."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    longest: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED,
) -> DataFrame:
    """One row per document: ``id``, ``n_features``, ``weight``, ``score`` and ``rank``, which is null for documents that are not drawn.

    Of the N documents with ``least_words`` words, the floor(N * percent / 100)
    highest scores are drawn, ties going to the smaller id and a null id going
    last.  A null or empty text has no features and weight 0.  Repeated rows
    are drawn each for itself and equal ones get ranks in any order; a null
    id's noise is that of an empty string.  Extra columns are ignored; an empty
    table gives an empty result, and with an empty target every gain is that of
    features never seen there.
    """
    scratch = Scratch(docs.sparkSession)
    source = bucket_counts(docs, text_col, longest, buckets)
    gain = gains(source, bucket_counts(target, target_text_col, longest, buckets))
    scored = scratch.keep(weigh(docs, gain, id_col, text_col, longest).withColumn("score", F.col("weight") + noise("id", seed)), "scored")
    enough = F.col("n_words") >= least_words
    # Most rows are certainly not drawn: only those over a cutoff are put in order.
    low = max(0.0, 1 - percent / 100 - _MARGIN)
    seen = scored.where(enough).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("score", F.lit(low), F.lit(int(4 / _MARGIN))).alias("cut")).first()
    drawn = seen["n"] * percent // 100
    over = F.lit(True) if seen["cut"] is None else F.col("score") >= seen["cut"]
    if scored.where(enough & over).count() < drawn:
        over = F.lit(True)
    some = numbered(scored.where(enough & over), scratch, "placed", "rank", F.desc("score"), F.asc_nulls_last("id"), "n_features")
    columns = ["id", "n_features", "weight", "score"]
    chosen = some.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    out = chosen.unionByName(scored.where(~(enough & over)).select(*columns, F.lit(None).cast("long").alias("rank")))
    scratch.drop("scored", "placed")
    return out


def oracle(docs: str, target: str, id_col: str = "doc_id", buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> str:
    """The rows for single words in DuckDB's SQL, with the checksum written out."""
    words = lambda table, key: rf"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM {table}"
    return rf"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8
), d AS ({words(docs, f"row_number() OVER () AS r, {id_col}")}
), b AS ({words(target, "1 AS r")}
), dw AS (SELECT r, w, count(*) AS c FROM (SELECT r, unnest(words) AS w FROM d) GROUP BY ALL
), bw AS (SELECT w, count(*) AS c FROM (SELECT unnest(words) AS w FROM b) GROUP BY ALL
), vocabulary AS (
  SELECT w, list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT) AS bytes
  FROM (SELECT w FROM dw UNION SELECT w FROM bw)
), hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % {buckets} AS bucket FROM vocabulary, tab
), s AS (SELECT bucket, sum(c)::DOUBLE AS s FROM dw JOIN hashed USING (w) GROUP BY 1
), t AS (SELECT bucket, sum(c)::DOUBLE AS t FROM bw JOIN hashed USING (w) GROUP BY 1
), all_s AS (SELECT coalesce(sum(s), 0) AS n FROM s), all_t AS (SELECT coalesce(sum(t), 0) AS n FROM t
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (all_s.n + {buckets}) / ((s + 1) * (all_t.n + {buckets}))))::BIGINT AS g
  FROM s LEFT JOIN t USING (bucket), all_s, all_t
), weight AS (
  SELECT r, sum(c)::BIGINT AS n, sum(c * g)::BIGINT AS weight FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY 1
), f AS (
  SELECT {id_col}, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce({id_col}::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN weight USING (r)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {least_words} ORDER BY score DESC, {id_col} NULLS LAST, n_features) AS rn, count(*) OVER (PARTITION BY n_features >= {least_words}) AS n FROM f
)
SELECT {id_col}, n_features, weight, score, CASE WHEN n_features >= {least_words} AND rn <= n * {percent} // 100 THEN rn END AS rank FROM ranked"""

"""Language identification by multilingual mixture inference.

Each word of a document is drawn from one of several languages, whose word
likelihoods come from character trigrams.  Expectation maximisation estimates
the languages' shares; languages join the set one by one as long as the gain in
log likelihood exceeds the penalty of another free share.

The trigram tables are trained on a bounded sample of labelled rows and have a
fixed size for each language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import textkit

#: At most about so many labelled documents of each language are learned from, chosen by hash of the id.
SAMPLE_PER_LANGUAGE = 4000
TABLE_BITS = 16
UNKNOWN = "und"
#: Words a language must explain at least, as a share, to stay in the set.
LEAST_SHARE = 0.02

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of the trigrams of all words, and the first trigram of each word.

    Words are runs of letters, lowered, with a boundary at each end; a word of n
    letters has n trigrams.
    """
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.concatenate([[False], _is_letter()[code], [False]])
    code = np.concatenate([[0], code, [0]]).astype(np.uint64)
    code[~letter] = 0
    at = np.flatnonzero(letter)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = code[at - 1] * np.uint64(0x9E3779B97F4A7C15) + code[at] * np.uint64(0xC2B2AE3D27D4EB4F) + code[at + 1] * np.uint64(0x165667B19E3779F9)
    slot = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - TABLE_BITS)
    return slot.astype(np.int64), np.flatnonzero(np.diff(at, prepend=-2) > 1)


class Model:
    """Log likelihoods of trigram slots, one column for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        total = counts.sum(0)
        self.log = np.log((counts + 0.5) / (total + 0.5 * len(counts))).astype(np.float32) if languages else counts.astype(np.float32)

    def shares(self, text: str) -> np.ndarray | None:
        """The languages' shares of the words; None without letters or languages."""
        slot, first = trigrams(text)
        if not len(slot) or not self.languages:
            return None
        each = np.add.reduceat(self.log[slot], first, axis=0).astype(np.float64)
        each -= each.max(1, keepdims=True)
        likely = np.exp(np.maximum(each, -60.0))
        return mixture(likely)


def _fit(likely: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Shares of the columns by expectation maximisation, and the log likelihood."""
    share = np.full(likely.shape[1], 1 / likely.shape[1])
    score = -np.inf
    for _ in range(rounds):
        part = likely * share
        whole = part.sum(1)
        now = float(np.log(whole).sum())
        share = (part / whole[:, None]).mean(0)
        if now - score < 1e-4 * len(likely):
            break
        score = now
    return share, float(np.log(likely @ share).sum())


def mixture(likely: np.ndarray) -> np.ndarray:
    """Shares over the language set of best penalised likelihood, chosen step by step; ties go to the earlier language."""
    n, k = likely.shape
    chosen = [int(np.argmax(np.log(likely).sum(0)))]
    share, score = np.ones(1), float(np.log(likely[:, chosen]).sum())
    penalty = 0.5 * np.log(n) + 2.0
    while len(chosen) < k:
        best = None
        now = likely[:, chosen] @ share
        for j in range(k):
            # Only a language that explains some words better can raise the likelihood.
            if j not in chosen and (likely[:, j] > now).any():
                s, v = _fit(likely[:, [*chosen, j]])
                if v - penalty > score and s[-1] >= LEAST_SHARE and (best is None or v > best[1]):
                    best = (s, v, j)
        if best is None:
            break
        share, score = best[0], best[1]
        chosen.append(best[2])
    out = np.zeros(k)
    out[chosen] = share
    return out


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Count trigrams of a bounded sample of each language.

    Rows with a null text or language are left out, repeated rows count as often
    as they are drawn, extra columns are ignored, and an empty table gives a
    model of no language.  Long texts count whole.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1 << TABLE_BITS, 0)))
    rate = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))])[F.col("lang")]
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000)) < rate * 1_000_000)

    def count(batches):
        total = np.zeros((1 << TABLE_BITS, len(languages)), np.int64)
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                slot, _ = trigrams(text)
                np.add.at(total[:, languages.index(lang)], slot, 1)
        at, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[at, k])], ["slot", "k", "n"])

    got = sample.select("text", "lang").mapInArrow(textkit.tidy(count), "slot int, k int, n long").groupBy("slot", "k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << TABLE_BITS, len(languages)))
    counts[got["slot"].to_numpy(), got["k"].to_numpy()] = got["n"].to_numpy()
    return Model(languages, counts)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the share of that language's words) and ``lang_shares`` (all languages in the set).

    A null text, one without letters, and every text under a model of no
    language are ``und`` with score 0.  Equal shares go to the language first by
    name.  Every row is kept; the three new names replace columns of the same name.
    """
    new = ["lang_pred", "score", "lang_shares"]
    bare = docs.select(*[c for c in docs.columns if c not in new])
    names, place = bare.columns, bare.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        m = shared.value
        for b in batches:
            pred, score, shares = [], [], []
            for text in b.column(place).to_pylist():
                s = m.shares(text) if text else None
                if s is None:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    shares.append([])
                    continue
                k = int(np.argmax(s))
                pred.append(m.languages[k])
                score.append(min(1.0, float(s[k])))
                shares.append([(m.languages[i], float(s[i])) for i in np.flatnonzero(s)])
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(pred, pa.string()), pa.array(score), pa.array(shares, pa.map_(pa.string(), pa.float64()))], [*names, *new])

    schema = bare.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "lang_shares": F.lit(None).cast("map<string,double>")}).schema
    return bare.mapInArrow(textkit.tidy(rows), schema)


def held_out(id_col: str, parts: int, part: int):
    """Whether a row is kept for testing: crc32 of the id as text."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part

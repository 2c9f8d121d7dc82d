"""Secret scan with corpus-wide ownership frequency.

One scan finds candidate values; only they, never the texts, are shuffled.  A
value's distinct repositories and owners are counted over the whole corpus:
what many owners hold, or very many repositories even of one owner, is a copied
example; what one owner holds in few places and looks random is a live-looking
credential.  The counts then judge every candidate,
and bare tokens that no base pattern covers become spans when they turn out to
be live-looking or equal the value of such a span.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import bitmap, textkit
from marlstone.llm.store import Scratch

KINDS = ("assign", "access", "hex", "token")
#: A value that so many owners hold is an example that was copied.
EXAMPLE_OWNERS = 3
#: And one that so many repositories hold, be they of one owner: nobody copies a live credential that widely.
EXAMPLE_REPOSITORIES = 50
#: Bits a character that a live-looking value has at least.
LEAST_ENTROPY = 3.0

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
_SPAN = "struct<kind:int,start:int,stop:int,value:binary,live:boolean>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the three base kinds, by start and then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def bare_tokens(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Random-looking tokens outside the base spans: mixed digits and letters of 20 characters or more."""
    out = []
    for m in _TOKEN.finditer(text):
        v = m[0]
        mixed = any(c.isdigit() for c in v) and any(c.isalpha() for c in v)
        if mixed and entropy(v) >= LEAST_ENTROPY and not any(s < m.end() and m.start() < e for _, s, e, _ in taken):
            out.append((3, m.start(), m.end(), v))
    return out


def _runs(on: np.ndarray, inner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of at least ``least`` bytes; none goes on beyond the offsets ``inner``, where documents begin."""
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    first[inner] |= on[inner]
    last[:-1] &= ~on[1:]
    last[inner - 1] |= on[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    far = end - begin >= least
    return begin[far], end[far]


def _long_runs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents may hold a hex value, an access key or a bare token: 24 hex digits, or 20 token bytes with a digit or a capital A among them."""
    ok, hexa, mark = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    ok[[*range(48, 58), *range(65, 91), *range(97, 123), 43, 47, 95, 61, 45]] = True
    hexa[[*range(48, 58), *range(97, 103)]] = True
    mark[[*range(48, 58), 65]] = True
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begin, end = _runs(ok[data], inner, 20)
    marks = np.concatenate([[0], np.cumsum(mark[data])])
    hit = np.concatenate([begin[marks[end] > marks[begin]], _runs(hexa[data], inner, 24)[0]])
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, hit, "right") - 1] = True
    return out


def candidates(texts: list[str | None], column: pa.Array) -> list[list[tuple[int, int, int, str]]]:
    """Spans of each text.  A document without a long run can hold assignments only."""
    data, offsets = textkit.utf8(column)
    runs = np.zeros(len(texts), bool)
    for i, j in textkit.chunks(offsets):
        part = offsets[i : j + 1]
        runs[i:j] = _long_runs(data[part[0] : part[-1]], part - part[0])
    out = []
    for text, long_run in zip(texts, runs.tolist(), strict=True):
        if not text:
            out.append([])
        elif long_run:
            base = base_spans(text)
            out.append(base + bare_tokens(text, base))
        else:
            low = text.lower()
            some = any(w in low for w in _WORDS)
            out.append([(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if some else [])
    return out


def value_hash(value: str) -> bytes:
    return hashlib.sha256(value.strip("\"'").encode()).digest()[:16]


def scan(docs: DataFrame, id_col: str, text_col: str, *carry: str) -> DataFrame:
    """Per document its id, the columns of ``carry``, and its candidate spans; a span is live if its value looks random."""
    names = [id_col, *carry]

    def rows(batches):
        for b in batches:
            col = b.column(len(names))
            found = candidates(col.to_pylist(), col)
            spans = [[{"kind": k, "start": s, "stop": e, "value": value_hash(v), "live": entropy(v) >= LEAST_ENTROPY} for k, s, e, v in f] for f in found]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(spans, _ARROW)], [*names, "spans"])

    schema = docs.select(*names).withColumn("spans", F.lit(None).cast(f"array<{_SPAN}>")).schema
    return docs.select(*names, F.col(text_col).cast("string")).mapInArrow(textkit.tidy(rows), schema)


_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.binary()), ("live", pa.bool_())]))


def _row_key(*columns: str) -> Column:
    """A key of 128 bits for equal rows."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(_SECOND), *columns).alias("b"))


_SECOND = 0x5EED5EED
_LIVE = f"n_owners = 1 AND n_repositories < {EXAMPLE_REPOSITORIES}"
_EXAMPLE = f"n_owners >= {EXAMPLE_OWNERS} OR n_repositories >= {EXAMPLE_REPOSITORIES}"
_JUDGED = "array<struct<start:int,kind:int,stop:int,live:boolean,example:boolean,n_owners:bigint,n_repositories:bigint>>"


def ownership(found: DataFrame, repository_col: str, owner_col: str) -> DataFrame:
    """Distinct repositories and owners of each candidate value, pre-aggregated before each shuffle; a null one counts as one of its own."""
    each = found.select(F.explode("spans").alias("s"), repository_col, owner_col)
    each = each.select(F.col("s.value").alias("value"), F.coalesce(F.col(repository_col).cast("string"), F.lit("\0")).alias("r"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\0")).alias("o"))
    repositories = each.groupBy("value", "r").agg(F.lit(1).alias("x")).groupBy("value").agg(F.count("x").alias("n_repositories"))
    owners = each.groupBy("value", "o").agg(F.lit(1).alias("x")).groupBy("value").agg(F.count("x").alias("n_owners"))
    return repositories.join(owners, "value")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """One row per document: ``id`` and ``spans``, an array of (kind, start, stop, live, example, n_owners, n_repositories) by start and then kind.

    Base spans are always there; a bare token only if its value is live-looking
    and held by one owner, or is the value of a base span.  Offsets count code
    points, ends exclusive.  ``example``: held by EXAMPLE_OWNERS owners or more,
    or by EXAMPLE_REPOSITORIES repositories; ``live``: random-looking, one owner
    only, and no example.

    Null and empty texts have no spans.  Rows with equal ids are judged each by
    its own text, in as many rows as given; a null id is kept.  Null owners
    count as one owner.  Extra columns are ignored; an empty table gives an
    empty result.
    """
    cols = docs.select(F.col(id_col).alias("id"), F.col(repository_col).cast("string").alias("repository"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("text"))
    cols = cols.withColumn("uid", _row_key("id", "repository", "owner", "text"))
    scratch = Scratch(docs.sparkSession)
    # Without texts this is small, and all that follows reads it.
    found = scratch.keep(scan(cols, "id", "text", "uid", "repository", "owner"), "found")
    some = found.where("size(spans) > 0")
    counts = ownership(some, "repository", "owner").select(F.col("value").alias("v"), "n_repositories", "n_owners")
    based = some.select(F.explode("spans").alias("s")).where("s.kind < 3").select(F.col("s.value").alias("v")).distinct().withColumn("based", F.lit(True))
    each = some.dropDuplicates(["uid"]).select("uid", F.explode("spans").alias("s")).withColumn("v", F.col("s.value"))
    judged = (
        each.join(counts, "v").join(based, "v", "left")
        .withColumn("live", F.expr(f"s.live AND {_LIVE}")).withColumn("example", F.expr(_EXAMPLE))
        .where("s.kind < 3 OR live OR based")
        .groupBy("uid").agg(F.sort_array(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.stop").alias("stop"), "live", "example", "n_owners", "n_repositories"))).alias("judged"))
    )
    none = F.array().cast(_JUDGED)
    with_some = some.select("id", "uid").join(judged, "uid", "left").select("id", F.coalesce("judged", none).alias("spans"))
    out = scratch.keep(found.where("size(spans) = 0").select("id", none.alias("spans")).unionByName(with_some), "spans")
    scratch.drop("spans")
    return out


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """``docs`` with the values of live spans replaced by ``[secret]``; all rows and columns stay.

    Only texts that may hold a live span are shuffled; null and empty ones pass
    through, and equal rows are redacted alike.  An empty table gives an empty
    result.
    """
    names, place = docs.columns, docs.columns.index(text_col)
    scratch = Scratch(docs.sparkSession)
    repository, owner = F.col(repository_col).cast("string").alias("r"), F.col(owner_col).cast("string").alias("o")
    keyed = docs.select("*", repository.alias("__r"), owner.alias("__o")).withColumn("__uid", _row_key(id_col, "__r", "__o", text_col))
    found = scratch.keep(scan(keyed.select("__uid", "__r", "__o", F.col(text_col).alias("__t")), "__uid", "__t", "__r", "__o").where("size(spans) > 0"), "found")
    counts = ownership(found, "__r", "__o")
    each = found.dropDuplicates(["__uid"]).select("__uid", F.explode("spans").alias("s")).withColumn("value", F.col("s.value"))
    live = each.where("s.live").join(counts.where(_LIVE), "value").groupBy("__uid").agg(F.sort_array(F.collect_list(F.struct("s.start", "s.stop"))).alias("__live"))
    live = scratch.keep(live, "live")
    suspects, clean = bitmap.split(keyed, "__uid", live.select("__uid"))
    # Dealt out even where the join is a broadcast one: two steps of Python in one stage take twice the workers, and these stay.
    joined = suspects.repartition("__uid").join(live, "__uid", "left").select(*names, "__live")

    def rows(batches):
        for b in batches:
            texts = []
            for text, spans in zip(b.column(place).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                at, out = 0, []
                for s in spans or []:
                    if s["start"] >= at:
                        out += [text[at : s["start"]], "[secret]"]
                    at = max(at, s["stop"])
                texts.append("".join([*out, text[at:]]) if spans else text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == place else b.column(i) for i in range(len(names))], names)

    return clean.select(*names).unionByName(joined.mapInArrow(textkit.tidy(rows), docs.schema))

"""SentencePiece encoding and decoding as a relational lattice.

A text is cut into units: a run of word marks and the characters up to the next
mark.  No piece reaches over a unit's end, so each distinct unit is encoded
once.  Its substrings of bounded length are joined to the piece table; the
matches are the edges of its lattice, grouped by unit and folded.

Two folds are here.  A unigram model wants the path of the highest total score
(Viterbi).  A BPE model wants merges by priority, which no path score gives: its
fold joins, step by step, the two neighbours whose union has the best score,
the leftmost on ties, until none is left.

``encode_units`` does this to a table of units by DataFrame joins and
higher-order aggregates.  The BPE fold of whole texts is done in the tasks that
read them (``Lattice``), many units at once: the piece table is as small as its
vocabulary, and word occurrences need not be shuffled to meet their pieces.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import textkit

MARK = "▁"
#: Longer units are folded one by one outside the lattice, whose fold grows with the square of the length.
LONGEST = 48
NORMAL, BYTE = 0, 1
_UNITS = re.compile(f"{MARK}+[^{MARK}]*")
#: Ids of so many units are remembered in a task, twice: when a table is full it becomes the old one, and what is used again moves over.
REMEMBERED = 300_000
#: So many texts are encoded together, and so many characters of units are folded together.
TOGETHER, BLOCK = 256, 1 << 16


def piece_table(spark: SparkSession, model_path: str) -> DataFrame:
    """(piece, id, score, kind) of a model file; its size is the vocabulary's."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    rows = []
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            rows.append((model.id_to_piece(i), i, float(model.get_score(i)), BYTE if model.is_byte(i) else NORMAL))
    return spark.createDataFrame(pa.table({"piece": [r[0] for r in rows], "id": pa.array([r[1] for r in rows], pa.int32()), "score": [r[2] for r in rows], "kind": pa.array([r[3] for r in rows], pa.int32())}))


def units(text: Column) -> Column:
    """Units of a text with its leading mark; none of an empty text."""
    marked = F.concat(F.lit(MARK), F.translate(text, " ", MARK))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(marked, F.lit(f"({MARK}+[^{MARK}]*)"), F.lit(1)))


def _merge(edges: Column, n: Column) -> Column:
    """Boundaries after all merges; edges have s, e and score."""

    def step(cuts: Column, _: Column) -> Column:
        after = lambda e, k: F.get(cuts, F.array_position(cuts, e["s"]).cast("int") + k)
        open_ = F.filter(edges, lambda e: F.array_contains(cuts, e["s"]) & after(e, 1).eqNullSafe(e["e"]))
        best = F.array_max(F.transform(open_, lambda e: F.struct(e["score"].alias("score"), (-e["s"]).alias("from"), after(e, 0).alias("middle"))))
        return F.when(F.size(open_) > 0, F.array_remove(cuts, best["middle"])).otherwise(cuts)

    return F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), step)


def _viterbi(edges: Column, n: Column) -> Column:
    """Boundaries of the best path: edges by end, each step keeping the best score and path to every position."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("path")))

    def step(best: Column, e: Column) -> Column:
        ways = F.transform(
            F.filter(edges, lambda x: x["e"] == e),
            lambda x: F.struct((F.get(best, x["s"])["score"] + x["score"]).alias("score"), F.concat(F.get(best, x["s"])["path"], F.array(e)).alias("path")),
        )
        # A character that no piece covers costs more than any piece.
        way = F.struct((F.get(best, e - 1)["score"] - 1e6).alias("score"), F.concat(F.get(best, e - 1)["path"], F.array(e)).alias("path"))
        return F.concat(best, F.array(F.array_max(F.concat(ways, F.array(way)))))

    return F.get(F.aggregate(F.sequence(F.lit(1), n), start, step), n)["path"]


def _bytes(s: Column) -> Column:
    """Byte values of a string."""
    h = F.hex(F.encode(s, "UTF-8"))
    return F.transform(F.sequence(F.lit(0), (F.length(h) / 2 - 1).cast("int")), lambda i: F.conv(F.substring(h, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int"))


def merged_ids(unit: str, known: dict[str, tuple[int, float]], byte_ids: list[int]) -> list[int]:
    """The BPE fold of one unit, with a heap of candidate merges."""
    n = len(unit)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[float, int, int]] = []

    def offer(s: int) -> None:
        if s >= 0 and end[s] < n:
            e = end[end[s]]
            found = known.get(unit[s:e])
            if found:
                heapq.heappush(heap, (-found[1], s, e))

    for s in range(n):
        offer(s)
    while heap:
        _, s, e = heapq.heappop(heap)
        if alive[s] and end[s] < n and end[end[s]] == e and alive[end[s]]:
            alive[end[s]] = False
            end[s] = e
            if e < n:
                before[e] = s
            offer(s)
            offer(before[s])
    out: list[int] = []
    s = 0
    while s < n:
        found = known.get(unit[s : end[s]])
        out += [found[0]] if found else [byte_ids[b] for b in unit[s : end[s]].encode()]
        s = end[s]
    return out


class Lattice:
    """The BPE fold of many units at once; ``known`` has id and score of each piece.

    Pieces are a trie of numbered nodes, so the substrings from one place are
    joined to them character by character.
    """

    #: A character beyond all others, and a rank beyond all pieces.
    PAD, NONE = 0x1FFFFF, 1 << 30

    def __init__(self, known: dict[str, tuple[int, float]], byte_ids: list[int]) -> None:
        self.known, self.byte_ids = known, byte_ids
        self.longest = max(map(len, known), default=1)
        rank = {score: k for k, score in enumerate(sorted({score for _, score in known.values()}, reverse=True))}
        steps: dict[int, int] = {}
        ids, ranks = [-1], [self.NONE]
        for piece, (i, score) in known.items():
            node = 0
            for c in piece:
                key = node << 21 | ord(c)
                if key not in steps:
                    steps[key] = len(ids)
                    ids.append(-1)
                    ranks.append(self.NONE)
                node = steps[key]
            ids[node], ranks[node] = i, rank[score]
        self.step = np.array([*sorted(steps), 1 << 62], np.int64)
        self.child = np.array([*(steps[k] for k in sorted(steps)), 0], np.int64)
        self.id, self.rank = np.array(ids, np.int32), np.array(ranks, np.int64)

    def encode(self, units: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct units, as little-endian 32-bit values."""
        out, block, width = {}, [], 0
        for u in sorted(units, key=len):
            if len(u) > LONGEST:
                out[u] = np.array(merged_ids(u, self.known, self.byte_ids), "<i4").tobytes()
                continue
            if block and (len(block) + 1) * (len(u) + 1) > BLOCK:
                out.update(zip(block, self._fold(block, width), strict=True))
                block = []
            block.append(u)
            width = len(u) + 1
        if block:
            out.update(zip(block, self._fold(block, width), strict=True))
        return out

    def _edges(self, chars: np.ndarray) -> np.ndarray:
        """By place and length, the node of the piece there, or 0."""
        edges = np.zeros((len(chars), self.longest + 1), np.int32)
        at = np.flatnonzero(chars != self.PAD)
        node = np.zeros(len(at), np.int64)
        for n in range(1, self.longest + 1):
            key = node << 21 | chars[at + n - 1]
            k = np.searchsorted(self.step, key)
            hit = self.step[k] == key
            at, node = at[hit], self.child[k[hit]]
            if not len(at):
                break
            whole = self.id[node] >= 0
            edges[at[whole], n] = node[whole]
        return edges

    def _fold(self, units: list[str], width: int) -> list[bytes]:
        """Ids of units shorter than ``width``, one in each row of places; the last place of a row is its end or behind it."""
        size = np.array([len(u) for u in units])
        text = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
        row = np.repeat(np.arange(len(units)), size)
        chars = np.full(len(units) * width, self.PAD, np.int64)
        chars[row * width + np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)] = text
        edges = self._edges(chars)
        first = np.arange(len(units)) * width
        after, before = np.arange(1, len(chars) + 1), np.arange(-1, len(chars) - 1)
        part = chars != self.PAD

        def rank(at: np.ndarray, end: np.ndarray) -> np.ndarray:
            """Of what joins the part at a place to the next one of its unit."""
            out = np.full(len(at), self.NONE, np.int64)
            some = np.flatnonzero(after[at] < end)
            n = after[after[at[some]]] - at[some]
            short = n <= self.longest
            some = some[short]
            out[some] = self.rank[edges[at[some], n[short]]]
            return out

        best = np.full(len(chars), self.NONE, np.int64)
        here = np.flatnonzero(part)
        best[here] = rank(here, (first + size)[row])
        open_ = np.arange(len(units))
        while len(open_):
            at = first[open_] + best.reshape(-1, width)[open_].argmin(axis=1)
            found = best[at] < self.NONE
            open_, at = open_[found], at[found]
            middle, end = after[at], (first + size)[open_]
            after[at] = after[middle]
            before[after[at]] = at
            best[middle], part[middle] = self.NONE, False
            best[at] = rank(at, end)
            left = before[at]
            inside = left >= first[open_]
            best[left[inside]] = rank(left[inside], end[inside])

        here = np.flatnonzero(part)
        ids = self.id[edges[here, after[here] - here]]
        stop = np.cumsum(np.bincount(here // width, minlength=len(units)))
        raw, ends = ids.astype("<i4").tobytes(), [0, *(4 * stop).tolist()]
        out = [raw[x:y] for x, y in zip(ends, ends[1:], strict=False)]
        for k in np.unique(here[ids < 0] // width).tolist():
            # Characters that no piece covers are given by their bytes.
            parts = range(int(stop[k - 1]) if k else 0, int(stop[k]))
            found = [[int(ids[p])] if ids[p] >= 0 else [self.byte_ids[b] for b in chr(chars[here[p]]).encode()] for p in parts]
            out[k] = np.array([i for f in found for i in f], "<i4").tobytes()
        return out


def _known(table: DataFrame) -> tuple[dict[str, tuple[int, float]], list[int]]:
    """Id and score of each piece, and the ids of bytes in their order."""
    rows = table.collect()
    return {r["piece"]: (r["id"], r["score"]) for r in rows if r["kind"] == NORMAL}, [r["id"] for r in sorted(rows, key=lambda r: r["piece"]) if r["kind"] == BYTE]


def _encode_bpe(docs: DataFrame, table: DataFrame) -> DataFrame:
    """``encode`` of (id, text), each task for the texts that it reads."""
    shared = docs.sparkSession.sparkContext.broadcast(_known(table))

    def rows(batches):
        lattice, now, old = Lattice(*shared.value), {}, {}
        for b in textkit.slices(batches, TOGETHER):
            cut = [_UNITS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in b.column(1).to_pylist()]
            if len(now) > REMEMBERED:
                now, old = {}, now
            new = set().union(*cut).difference(now)
            now.update([(u, old[u]) for u in new if u in old])
            now.update(lattice.encode(new.difference(old)))
            found = [b"".join(map(now.__getitem__, units)) for units in cut]
            offsets = np.cumsum([0, *(len(f) // 4 for f in found)])
            ids = pa.array(np.frombuffer(b"".join(found), "<i4"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids)], ["id", "text", "ids"])

    return docs.mapInArrow(textkit.tidy(rows), f"id {docs.schema['id'].dataType.simpleString()}, text string, ids array<int>")


def encode_units(distinct: DataFrame, table: DataFrame, kind: str = "bpe") -> DataFrame:
    """(unit, ids) of a table of distinct units, hash partitioned by unit.  Substrings go up to the table's longest piece."""
    normal = F.broadcast(table.where(F.col("kind") == NORMAL).select("piece", "id", "score"))
    longest_piece = table.where(F.col("kind") == NORMAL).agg(F.coalesce(F.max(F.length("piece")), F.lit(1))).first()[0]
    byte_ids = [r["id"] for r in table.where(F.col("kind") == BYTE).orderBy("piece").select("id").collect()]
    short = distinct.where(F.length("unit") <= LONGEST).withColumn("n", F.length("unit"))
    sub = F.explode(F.expr(f"flatten(transform(sequence(0, n - 1), s -> transform(sequence(1, least({longest_piece}, n - s)), l -> named_struct('s', s, 'e', s + l, 'piece', substring(unit, s + 1, l)))))"))
    edges = short.select("unit", "n", sub.alias("x")).select("unit", "n", "x.s", "x.e", "x.piece").join(normal, "piece", "left")
    lattice = edges.groupBy("unit", "n").agg(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("s", "e", "score", "id"))).alias("edges"))
    if kind == "bpe":
        cuts = _merge(F.filter("edges", lambda e: e["e"] - e["s"] > 1), F.col("n"))
    else:
        cuts = _viterbi(F.col("edges"), F.col("n"))
    folded = lattice.withColumn("cuts", cuts)
    byte_table = F.array(*[F.lit(b) for b in byte_ids]) if byte_ids else F.array().cast("array<int>")

    def ids_of(s: Column, e: Column) -> Column:
        own = F.transform(F.filter("edges", lambda x: (x["s"] == s) & (x["e"] == e)), lambda x: x["id"])
        return F.when(F.size(own) > 0, own).otherwise(F.transform(_bytes(F.substring(F.col("unit"), s + 1, e - s)), lambda b: F.get(byte_table, b)))

    pairs = F.transform(F.slice("cuts", F.lit(1), F.size("cuts") - 1), lambda s, i: F.struct(s.alias("s"), F.get(F.col("cuts"), i + 1).alias("e")))
    done = folded.select("unit", F.flatten(F.transform(pairs, lambda p: ids_of(p["s"], p["e"]))).alias("ids"))
    if kind != "bpe":
        return done
    known = {r["piece"]: (r["id"], r["score"]) for r in table.where(F.col("kind") == NORMAL).collect()}
    shared = distinct.sparkSession.sparkContext.broadcast((known, byte_ids))

    def rows(batches):
        k, b = shared.value
        for batch in batches:
            got = [merged_ids(u, k, b) for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int32()))], ["unit", "ids"])

    return done.unionByName(distinct.where(F.length("unit") > LONGEST).select("unit").mapInArrow(rows, "unit string, ids array<int>"))


def encode(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "bpe") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``text`` and ``ids``.

    A null or empty text has no ids.  Repeated rows and null ids stay; extra
    columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    if kind == "bpe":
        return _encode_bpe(rows, table)
    rows = rows.withColumn("uid", F.xxhash64("id", "text"))
    places = rows.select("uid", F.posexplode(units(F.col("text"))).alias("at", "unit"))
    own = places.groupBy("uid", "unit").agg(F.collect_set("at").alias("at"))
    distinct = places.select("unit").distinct()
    ids = own.join(encode_units(distinct, table, kind), "unit").select("uid", F.explode("at").alias("at"), "ids")
    joined = ids.groupBy("uid").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
    return rows.join(joined, "uid", "left").select("id", "text", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def decode(encoded: DataFrame, table: DataFrame, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: pieces by id, bytes put together, marks made spaces, and the first space dropped.  Ids of no piece give nothing."""
    held = {r["id"]: bytes([int(r["piece"][3:5], 16)]) if r["kind"] == BYTE else r["piece"].encode() for r in table.collect()}
    shared = encoded.sparkSession.sparkContext.broadcast(held)
    at = encoded.columns.index(ids_col)

    def rows(batches):
        held = shared.value
        none = max(held, default=0) + 1
        piece = pa.array([held.get(i, b"") for i in range(none + 1)], pa.binary())
        for b in textkit.slices(batches, TOGETHER):
            ids = b.column(at).flatten().fill_null(none).to_numpy()
            offsets = np.cumsum([0, *pc.list_value_length(b.column(at)).fill_null(0).to_pylist()])
            parts = piece.take(pa.array(np.where((ids >= 0) & (ids < none), ids, none)))
            raw = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts), b"")
            text = pa.array([x.decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ") for x in raw.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], [*b.schema.names, "decoded"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(textkit.tidy(rows), f"{names}, decoded string")

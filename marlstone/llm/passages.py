"""Repeated passages by a sparse suffix array.

A document's suffixes are kept only where content selects them: at the word
positions whose ``seed_words``-gram hash is the least of some window of
``min_words - seed_words + 1`` consecutive grams.  Equal passages of at least
``min_words`` words select the same places in every document, so each holds a
kept suffix at the same offset.

1. One scan finds the seeds met in two documents or more; a filter of fixed
   size holds them.
2. A second scan writes their suffixes: the seed's hash, and the words beside
   it to the right and left, as far as it is the least seed of a passage.  A range partitioning sorts them, so a seed that a large share of all
   documents holds is spread over many tasks.
3. In sorted order all suffixes of a seed stand together.  A passage is looked
   at as its runs of ``min_words`` words whose least seed it is, one for each
   division of the remaining words between left and right.  Of every run the
   least id that holds it is its owner, so each match has its own owner.
4. A seed whose suffixes may go on in another partition, or that has very many,
   is not decided there: the partition tells each of its runs once, with the
   least and greatest id.  Put together over all partitions these tell the runs
   that two ids share, and what a partition has told is answered to it alone.

A run is removed from every document but its owner.  Each removed word is in a
run of a smaller id, which keeps it or loses it to a run of a still smaller one;
so a copy of each word stays, though the words of one run may then be kept by
more than one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import bitmap, textkit
from marlstone.llm.store import Scratch

MIN_WORDS = 50
SEED_WORDS = 25
#: Seeds with more suffixes in a partition are decided by their runs; any number is right.
MANY = 20000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: What a row is: a run (its hash as key, its least id, and its greatest as owner), a suffix not decided, or a span.
RUN, SUFFIX, SPAN = 0, 1, 2
_FOUND = "part int, kind int, id long, first long, last long, owner long, removed boolean, key long, at long, left binary, right binary"
_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary())


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` over each window of ``w`` values."""
    size, out = 1, x
    while size * 2 <= w:
        out = pick(out[:-size], out[size:])
        size *= 2
    return out if size == w else pick(out[: len(x) - w + 1], out[w - size :])


def selected(words: textkit.Words, min_words: int, seed_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word positions of the seeds, their hashes, and the hashes of all grams, over the documents of ``words``."""
    n, w = len(words.hash), min_words - seed_words + 1
    if n < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    g = np.minimum(textkit.long_grams(words.hash, seed_words), _NONE - np.uint64(1))
    # Grams across two documents are none.
    for b in words.first[1:-1]:
        g[max(0, b - seed_words + 1) : b] = _NONE
    least = _sliding(g, w, np.minimum)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    chosen = np.flatnonzero((_sliding(padded, w, np.maximum) == g) & (g != _NONE))
    doc = np.searchsorted(words.first, chosen, "right") - 1
    long_enough = np.diff(words.first)[doc] >= min_words
    return chosen[long_enough], g[chosen[long_enough]], g


def _least_in(g: np.ndarray, at: np.ndarray, beside: int) -> tuple[np.ndarray, np.ndarray]:
    """How many grams before and after each position are more than its own; of equal ones the first is the least."""
    steps = np.arange(1, beside + 1)
    padded = np.concatenate([np.full(beside, _NONE), g, np.full(beside, _NONE)])
    before, after = padded[at[:, None] + beside - steps] <= g[at][:, None], padded[at[:, None] + beside + steps] < g[at][:, None]
    return tuple(np.where(x.any(1), x.argmax(1), beside) for x in (before, after))


def _scan(batch: pa.RecordBatch, min_words: int, seed_words: int):
    """(words, ids, positions, hashes, documents, hashes of all grams) of each chunk of a batch of (id, text)."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    data, offsets = textkit.utf8(batch.column(1))
    for i, j in textkit.chunks(offsets):
        part = offsets[i : j + 1]
        words = textkit.words(data[part[0] : part[-1]], part - part[0])
        at, key, grams = selected(words, min_words, seed_words)
        if len(at):
            doc = np.searchsorted(words.first, at, "right") - 1
            yield words, ids[i:j][doc], at, key, doc, grams


def _seeds(docs: DataFrame, min_words: int, seed_words: int) -> DataFrame:
    def rows(batches):
        for b in batches:
            for _, ids, _, key, _, _ in _scan(b, min_words, seed_words):
                order = np.lexsort((ids, key))
                k, v = key[order], ids[order]
                first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                last = np.concatenate([first[1:], [len(k)]]) - 1
                yield pa.RecordBatch.from_arrays([pa.array(k[first].view(np.int64)), pa.array(v[first]), pa.array(v[last])], ["key", "lo", "hi"])

    each = docs.mapInArrow(textkit.tidy(rows), "key long, lo long, hi long")
    return each.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("key")


def _suffixes(docs: DataFrame, shared, min_words: int, seed_words: int) -> DataFrame:
    reach = min_words - seed_words

    def rows(batches):
        right, left = np.arange(seed_words, seed_words + reach), -1 - np.arange(reach)
        for b in batches:
            for words, ids, at, key, doc, grams in _scan(b, min_words, seed_words):
                take = bitmap.has(shared.value, key)
                at, key, doc, ids = at[take], key[take], doc[take], ids[take]
                low = np.maximum(words.hash.astype(np.uint32), 1)
                begin, end = words.first[doc][:, None], words.first[doc + 1][:, None]

                # A run belongs to its least seed alone: that one is chosen wherever the run stands, another one only where its surroundings allow.
                to_left, to_right = _least_in(grams, at, reach)

                def beside(step, most, at=at, begin=begin, end=end, low=low):
                    to = at[:, None] + step
                    out = low[np.clip(to, 0, len(low) - 1)]
                    out[(to < begin) | (to >= end) | (np.arange(reach) >= most[:, None])] = 0
                    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(reach * 4), len(out), [None, pa.py_buffer(np.ascontiguousarray(out))]).cast(pa.binary())

                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ids), pa.array(at - begin[:, 0]), beside(left, to_left), beside(right, to_right)], ["key", "id", "at", "left", "right"]
                )

    return docs.mapInArrow(textkit.tidy(rows), "key long, id long, at long, left binary, right binary")


def _matrix(column: pa.Array, reach: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), reach)


def _runs(key: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each suffix's runs, by the number of their words left of the seed, and whether the document holds so many words there."""
    n, beside = left.shape
    up = textkit.mix(np.arange(1, 2 * beside + 1, dtype=np.uint64)) | np.uint64(1)
    none = np.zeros((n, 1), np.uint64)
    far_left = np.concatenate([none, np.cumsum(left * up[:beside], axis=1, dtype=np.uint64)], axis=1)
    far_right = np.concatenate([none, np.cumsum(right * up[beside:], axis=1, dtype=np.uint64)], axis=1)[:, ::-1]
    yes = np.ones((n, 1), bool)
    held = np.concatenate([yes, np.logical_and.accumulate(left != 0, axis=1)], axis=1)
    held &= np.concatenate([yes, np.logical_and.accumulate(right != 0, axis=1)], axis=1)[:, ::-1]
    step = np.arange(beside + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = textkit.mix(textkit.mix(far_left + step) + far_right)
    return textkit.mix(mixed ^ textkit.mix(key.view(np.uint64))[:, None]), held


def _distinct(run: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs in order, the least and greatest id of each, and each row's place among them."""
    order = np.argsort(run, kind="stable")
    r, v = run[order], ids[order]
    begins = np.concatenate([[True], r[1:] != r[:-1]])
    first, place = np.flatnonzero(begins), np.empty(len(run), np.int64)
    place[order] = np.cumsum(begins) - 1
    return r[first], np.minimum.reduceat(v, first), np.maximum.reduceat(v, first), place


def _joined(ids, at, row, to_left, owner, min_words: int) -> tuple[np.ndarray, ...]:
    """Spans (id, first, last, owner, removed) of runs that are shared: neighbouring runs of a suffix with the same fate are one."""
    removed = owner < ids[row]
    begins = np.ones(len(row), bool)
    begins[1:] = (row[1:] != row[:-1]) | (to_left[1:] != to_left[:-1] + 1) | (removed[1:] != removed[:-1])
    first = np.flatnonzero(begins)
    if not len(first):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, bool))
    last = np.append(first[1:], len(row)) - 1
    begin = at[row[first]]
    return ids[row[first]], begin - to_left[last], begin - to_left[first] + min_words, np.minimum.reduceat(owner, first), removed[first]


def _held_runs(t: pa.Table, beside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and number of words left of the seed of each run of some suffixes."""
    run, held = _runs(t["key"].to_numpy(), *(_matrix(t[c], beside) for c in ("left", "right")))
    row, to_left = np.nonzero(held)
    return run[row, to_left], row, to_left


def _rows(kind: int, n: int, **columns) -> list[pa.RecordBatch]:
    """``n`` rows of what is found, null but for the columns given."""
    if not n:
        return []
    of = TaskContext.get().partitionId() if TaskContext.get() else 0
    columns |= {"part": np.full(n, of, np.int32), "kind": np.full(n, kind, np.int32)}
    names = [c.split()[0] for c in _FOUND.split(", ")]
    arrays = [columns[c] if c in columns else pa.nulls(n, k) for c, k in zip(names, _TYPES, strict=True)]
    return pa.Table.from_arrays([x if isinstance(x, pa.ChunkedArray | pa.Array) else pa.array(x, k) for x, k in zip(arrays, _TYPES, strict=True)], names).combine_chunks().to_batches()


def _span_rows(spans) -> list[pa.RecordBatch]:
    return _rows(SPAN, len(spans[0]), **dict(zip(("id", "first", "last", "owner", "removed"), spans, strict=True)))


def _compare(sorted_rows: DataFrame, min_words: int, seed_words: int) -> DataFrame:
    """Spans of seeds that are whole in their partition; of all others the suffixes as they came, and their runs."""
    beside = min_words - seed_words

    def open_(t: pa.Table) -> list[pa.RecordBatch]:
        out = _rows(SUFFIX, len(t), **{c: t[c] for c in ("id", "key", "at", "left", "right")})
        for k in range(0, len(t), 4096):
            part = t.slice(k, 4096).combine_chunks()
            run, row, _ = _held_runs(part, beside)
            if len(row):
                run, lo, hi, _ = _distinct(run, part["id"].to_numpy()[row])
                out += _rows(RUN, len(run), key=run.view(np.int64), id=lo, owner=hi)
        return out

    def decided(t: pa.Table) -> list[pa.RecordBatch]:
        # Some thousand suffixes at once, each seed whole.
        out, begin, key = [], 0, t["key"].to_numpy()
        for end in [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]:
            if end - begin < 4096 and end < len(key) or begin == end:
                continue
            part, begin = t.slice(begin, end - begin).combine_chunks(), end
            run, row, to_left = _held_runs(part, beside)
            if len(row):
                ids = part["id"].to_numpy()
                _, lo, hi, place = _distinct(run, ids[row])
                met = (lo < hi)[place]
                out += _span_rows(_joined(ids, part["at"].to_numpy(), row[met], to_left[met], lo[place[met]], min_words))
        return out

    def rows(batches):
        # The first seed may have begun in another partition, and the last one is not known to be whole.
        let_through, held = None, None
        for b in batches:
            if not len(b):
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            key = t["key"].to_numpy()
            let_through = key[0] if let_through is None else let_through
            begin, end = int((key == let_through).sum()), int((key != key[-1]).sum())
            yield from open_(t.slice(0, begin))
            held = None
            if begin < len(key):
                yield from decided(t.slice(begin, end - begin))
                held = t.slice(end).combine_chunks()
                if held.num_rows > MANY:
                    yield from open_(held)
                    let_through, held = key[-1], None
        if held is not None:
            yield from open_(held)

    return sorted_rows.select("key", "id", "at", "left", "right").mapInArrow(textkit.tidy(rows), _FOUND)


def _settled(found: DataFrame, parts: int, min_words: int, seed_words: int) -> DataFrame:
    """All spans: those found, and those of the suffixes not decided, by the answers about their runs."""
    runs = found.where(F.col("kind") == RUN)
    shared = runs.groupBy("key").agg(F.min("id").alias("least"), F.max("owner").alias("most")).where("least < most").select("key", F.col("least").alias("owner"))
    told = runs.select("part", "kind", "key").distinct().join(shared, "key")
    every = found.where(F.col("kind") != RUN).unionByName(told, allowMissingColumns=True)
    beside = min_words - seed_words

    def rows(batches):
        # Answers come first.
        held, run, owner = [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            t = pa.Table.from_batches([b])
            kind = t["kind"].to_numpy()
            if (kind == RUN).any():
                told = t.filter(pa.array(kind == RUN))
                held.append((told["key"].to_numpy().view(np.uint64), told["owner"].to_numpy()))
            if (kind == RUN).all():
                continue
            if held:
                run, at = np.unique(np.concatenate([run, *(h[0] for h in held)]), return_index=True)
                owner = np.concatenate([owner, *(h[1] for h in held)])[at]
                held = []
            suffixes = t.filter(pa.array(kind == SUFFIX))
            for k in range(0, len(suffixes), 4096):
                part = suffixes.slice(k, 4096).combine_chunks()
                mine, row, to_left = _held_runs(part, beside)
                place = np.minimum(np.searchsorted(run, mine), max(len(run) - 1, 0))
                met = run[place] == mine if len(run) else np.zeros(len(mine), bool)
                yield from _span_rows(_joined(part["id"].to_numpy(), part["at"].to_numpy(), row[met], to_left[met], owner[place[met]], min_words))
            yield from t.filter(pa.array(kind == SPAN)).combine_chunks().to_batches()

    order = every.select(*[c.split()[0] for c in _FOUND.split(", ")]).repartition(parts, "part").sortWithinPartitions("kind")
    return order.mapInArrow(textkit.tidy(rows), _FOUND).select("id", "first", "last", "owner", "removed")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """One row per maximal span of a document that another document repeats.

    Columns: ``id``, ``first_word`` (from 0), ``n_words``, ``removed`` and
    ``owner``.  Spans that the document keeps have ``removed`` false and its own
    id as owner; all others name a document with a smaller id that holds the
    passage.  Words are compared with A-Z lowered.

    Null and blank texts, and those under ``min_words`` words, give no rows; a
    null id takes no part.  Rows with equal ids are one document, whose
    repetitions of itself do not count.  Extra columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    scratch = Scratch(spark)
    shared = spark.sparkContext.broadcast(bitmap.build(_seeds(docs, min_words, seed_words), "key"))
    order = ["key", "right", "id", "at"]
    rows = _suffixes(docs, shared, min_words, seed_words)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.keep(_compare(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order), min_words, seed_words), "found")
    seen = _settled(found, parts, min_words, seed_words)
    own = Window.partitionBy("id", "removed").orderBy("first", "last")
    begun = seen.withColumn("reached", F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    part = begun.withColumn("span", F.sum(F.when(F.col("first") <= F.col("reached"), 0).otherwise(1)).over(own))
    spans = part.groupBy("id", "removed", "span").agg(F.min("first").alias("first_word"), F.max("last").alias("last"), F.min("owner").alias("owner"))
    out = scratch.keep(spans.select("id", "first_word", (F.col("last") - F.col("first_word")).alias("n_words"), "removed", "owner"), "spans")
    scratch.drop("spans")
    return out


def cut_passages(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words of all removed spans deleted, each with the white space after it; all columns and rows stay.

    Only documents that may lose words are shuffled.
    """
    own = spans.where("removed").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("__cuts"))
    own = own.withColumnRenamed("id", "__id")
    held, untouched = bitmap.split(docs, id_col, own.select("__id"))
    # Dealt out even where the join is a broadcast one: two steps of Python in one stage take twice the workers, and these stay.
    joined = held.repartition(id_col).join(own, F.col(id_col) == F.col("__id"), "left").select(*docs.columns, "__cuts")
    names, place = docs.columns, docs.columns.index(text_col)

    def rows(batches):
        for b in batches:
            texts = []
            for text, cuts in zip(b.column(place).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if cuts is None or text is None:
                    texts.append(text)
                    continue
                raw = np.frombuffer(text.encode(), np.uint8)
                w = textkit.words(raw, np.array([0, len(raw)]))
                drop = np.zeros(len(raw) + 1, np.int64)
                starts = np.append(w.start, len(raw))
                for c in cuts:
                    a, z = min(c["first_word"], len(w.start)), min(c["first_word"] + c["n_words"], len(w.start))
                    drop[starts[a]] += 1
                    drop[starts[z]] -= 1
                texts.append(raw[np.cumsum(drop)[:-1] == 0].tobytes().decode().rstrip(" \t\n\r\v\f"))
            cols = [pa.array(texts, pa.string()) if k == place else b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(textkit.tidy(rows), docs.schema).unionByName(untouched)

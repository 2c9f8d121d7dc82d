"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence.

Rows of the incidence matrix are classes of documents with equal shingle sets,
columns are shingle hashes.  A product of two rows can reach the wanted
similarity only if they meet in a column of their bounded prefix: the
``n - ceil(t * n) + 1`` columns that come first when frequent columns are put
last.  So only prefix columns take part in the first product; its blocks are
the columns' hash partitions.  Pairs whose sizes rule the similarity out are
discarded, and the overlap of every other pair is counted in full.

A column met by many classes does not emit all their pairs.  Each class is
first compared with the most central class of a column, the one with the fewest
columns of its own; classes that this joins into one component need no further
pair.  Only columns that still hold several components emit pairs, and only
across components, so no link that could change a component is lost.  Of two
classes, the one whose prefix ends first shares none of the prefix columns that
are in no other prefix, which keeps the outliers of a large group from meeting
all of its members.  Of the other class such a column may still be shared, for
the first may hold it behind its prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import bitmap, textkit
from marlstone.llm.graph import components
from marlstone.llm.store import Scratch

#: Columns known to be frequent go last in each prefix; how many are known changes the cost only.
FREQUENT_KEPT = 1 << 18
FREQUENT_FROM = 64
LOCAL_FROM = 3
#: Shingles counted together in a task.
COUNTED = 500_000
#: Classes that a task remembers, so that it need not send the prefix of one twice.
REMEMBERED = 100_000
#: Rows whose prefixes are spread out together.
SLICE = 2000
#: A pair accepted by no more shared shingles above the bound than this is compared once more by whole hashes.
MARGIN = 8


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    data, offsets = textkit.utf8(column)
    for i, j in textkit.chunks(offsets):
        part = offsets[i : j + 1]
        yield from textkit.shingle_sets(textkit.words(data[part[0] : part[-1]], part - part[0]), k)


def _key(s: np.ndarray) -> int:
    """Of a set: one value for equal sets, whatever documents they come from."""
    total = np.add.reduce(textkit.mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)), keepdims=True)
    return int(textkit.mix(total + np.array([len(s)], np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)[0])


_STEP = np.uint64(0xFFFFFFFF)


def pack(s: np.ndarray) -> bytes:
    """A sorted set as 32-bit differences of the upper 40 bits; a larger difference follows as many full steps as it needs."""
    v = s >> np.uint64(24)
    d = np.diff(v, prepend=np.zeros(1, np.uint64))
    last = np.cumsum(d // _STEP + np.uint64(1)).astype(np.int64) - 1
    out = np.full(last[-1] + 1 if len(last) else 0, _STEP, np.uint32)
    out[last] = d % _STEP
    return out.tobytes()


def unpack(b) -> np.ndarray:
    d = np.frombuffer(b, np.uint32)
    return np.cumsum(d, dtype=np.uint64)[d != np.uint32(_STEP)]


def _frequent(docs: DataFrame, k: int) -> np.ndarray:
    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        value = np.sort(np.concatenate([np.zeros(0, np.uint64), *held]))
        first = np.flatnonzero(np.diff(value, prepend=~value[:1]) != 0)
        n = np.diff(first, append=len(value))
        often = n >= LOCAL_FROM
        return pa.RecordBatch.from_arrays([pa.array(value[first[often]].view(np.int64)), pa.array(n[often])], ["h", "c"])

    def count(batches):
        held, size = [], 0
        for b in batches:
            for s in _sets(b.column(0), k):
                held.append(s)
                size += len(s)
                if size > COUNTED:
                    yield counted(held)
                    held, size = [], 0
        yield counted(held)

    rows = (
        docs.select("text").mapInArrow(textkit.tidy(count), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
        .where(F.col("c") >= FREQUENT_FROM).orderBy(F.desc("c"), "h").limit(FREQUENT_KEPT).select("h").toArrow()
    )
    return np.sort(rows.column("h").to_numpy().view(np.uint64))


def _incidence(docs: DataFrame, k: int, percent: int, frequent) -> DataFrame:
    """Per document: its id, set size, class key, and the class's prefix columns and where they end (16 bits of column order) once a task."""

    def rows(batches):
        late, seen = frequent.value, set()
        for b in batches:
            n, key, end, prefix = [], [], [], []
            named = b.column(0).is_valid().to_pylist()
            for s, known in zip(_sets(b.column(1), k), named, strict=True):
                n.append(len(s))
                key.append(_key(s))
                if not len(s) or not known or key[-1] in seen:
                    end.append(None)
                    prefix.append(None)
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key[-1])
                take = len(s) - (percent * len(s) + 99) // 100 + 1
                rare = len(s)
                if len(late):
                    at = np.searchsorted(late, s)
                    at[at == len(late)] = 0
                    often = late[at] == s
                    s = np.concatenate([s[~often], s[often]])
                    rare -= int(often.sum())
                end.append((take > rare) << 15 | int(s[take - 1]) >> 49)
                prefix.append(s[:take].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(end, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], ["id", "n", "key", "e", "prefix"])

    return docs.select("id", "text").mapInArrow(textkit.tidy(rows), "id long, n long, key long, e long, prefix array<long>")


def _columns(classes: DataFrame, shared) -> DataFrame:
    """``classes`` with ``prefix`` replaced by one row for each of its columns that the filter may hold, and ``u``, the number that it does not hold."""
    names = [c for c in classes.columns if c != "prefix"]

    def rows(batches):
        for b in textkit.slices(batches, SLICE):
            lists = b.column(len(names))
            row = np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy()))
            value = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
            take = bitmap.has(shared.value, value)
            own = np.bincount(row[~take], minlength=len(b))
            at = pa.array(row[take])
            yield pa.RecordBatch.from_arrays([pa.array(value[take]), pa.array(own[row[take]]), *[b.column(k).take(at) for k in range(len(names))]], ["col", "u", *names])

    return classes.select(*names, "prefix").mapInArrow(textkit.tidy(rows), ", ".join(["col long", "u long", *[f"{c} long" for c in names]]))


def _size_code(n: np.ndarray) -> np.ndarray:
    """Eight classes of size for each doubling."""
    return np.floor(8 * np.log2(np.maximum(n, 1))).astype(np.uint64)


#: Bits of a class's key that tell it from others in a column, and bytes of a packed entry: 4 of the column, 1 of the size, the rest of the key.
_KEY_BITS, _ENTRY = 48, 11


def _shared_columns(classes: DataFrame, percent: int, bits: int = bitmap.BITS) -> np.ndarray:
    """A filter over the columns that two classes of compatible sizes have in their prefixes.

    Columns are packed by their upper bits into buckets: 32 more bits, the
    class's size code, and bits of its key, for a class may come from several
    tasks.  Columns that only look equal make the filter hold more, never less.
    """
    n_rows = classes.count()
    bucket_bits = min(bits - 6, max(12, (n_rows // 2000).bit_length()))
    apart = int(np.ceil(8 * np.log2(100 / percent)))
    upper = np.uint64(64 - bucket_bits)

    def packed(batches):
        for b in textkit.slices(batches, SLICE):
            lists = b.column(2)
            row = np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy()))
            value = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
            key = b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - _KEY_BITS)
            column = (value << np.uint64(bucket_bits) >> np.uint64(32)) | _size_code(b.column(1).to_numpy())[row] << np.uint64(32)
            # Of a column and a size code two classes say as much as all do: that there are two.
            order = np.lexsort((key[row], column, value >> upper))
            bucket, column, mine = (value >> upper)[order].astype(np.int64), column[order], key[row[order]]
            again = np.zeros(len(order), bool)
            again[1:] = (column[1:] == column[:-1]) & (bucket[1:] == bucket[:-1])
            other = ~again
            other[1:] |= mine[1:] != mine[:-1]
            number = np.cumsum(other)
            two = other & (number - np.maximum.accumulate(np.where(again, 0, number)) < 2)
            bucket, column, mine = bucket[two], column[two], mine[two]
            raw = np.concatenate([column.view(np.uint8).reshape(-1, 8)[:, :5], mine.view(np.uint8).reshape(-1, 8)[:, : _ENTRY - 5]], axis=1).tobytes()
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = [*(_ENTRY * first).tolist(), len(raw)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array([raw[x:y] for x, y in zip(ends, ends[1:], strict=False)], pa.binary())], ["bucket", "held"])

    def words(bucket: int, held: list[bytes]) -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(held), np.uint8).reshape(-1, _ENTRY)
        column, key = np.zeros((2, len(raw), 8), np.uint8)
        # Highest are the column's bits, then the size code.
        column[:, 1:5], column[:, 0], key[:, : _ENTRY - 5] = raw[:, :4], raw[:, 4], raw[:, 5:]
        column, key = column.reshape(-1).view(np.uint64), key.reshape(-1).view(np.uint64)
        order = np.lexsort((key, column))
        column, key = column[order], key[order]
        other = np.ones(len(column), bool)
        other[1:] = (column[1:] != column[:-1]) | (key[1:] != key[:-1])
        column = column[other]
        # In order of size, some two are compatible only if two neighbours are.
        met = (column[1:] >> np.uint64(8) == column[:-1] >> np.uint64(8)) & (column[1:] - column[:-1] <= apart)
        slot = (column[1:][met] >> np.uint64(8) << np.uint64(32) >> np.uint64(bucket_bits) | np.uint64(bucket) << upper) >> np.uint64(64 - bits)
        word, place = np.unique((slot >> np.uint64(6)).astype(np.int64), return_inverse=True)
        out = np.zeros(len(word), np.uint64)
        np.bitwise_or.at(out, place, np.uint64(1) << (slot & np.uint64(63)))
        return pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(out.view(np.int64))], ["w", "b"])

    def reduced(batches):
        now, held = None, []
        for b in batches:
            for bucket, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != now and held:
                    yield words(now, held)
                    held = []
                now = bucket
                held.append(raw)
        if held:
            yield words(now, held)

    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = classes.select("key", "n", "prefix").mapInArrow(textkit.tidy(packed), "bucket int, held binary")
    rows = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(textkit.tidy(reduced), "w int, b long").toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return out


def _compared(docs: DataFrame, incidence: DataFrame, pairs: DataFrame, k: int, percent: int, whole: bool, scratch: Scratch) -> DataFrame:
    """Of pairs (a, b) of classes, those similar enough, as edges (u, v), and whether that is sure.

    Sets travel with 40 bits of each hash unless ``whole``.  Two such sets share
    as many as the true ones or more, so none is missed.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    # One document speaks for each class.
    speaks = incidence.where("id IS NOT NULL").select("key", "id").join(ends, "key").groupBy("key").agg(F.xxhash64(F.min("id")).alias("h"))
    wanted = scratch.send(bitmap.build(speaks, "h"))

    def sets(batches):
        for b in batches:
            hit = bitmap.has(wanted.value, b.column(0).to_numpy())
            found = [s for s in _sets(b.column(1).filter(pa.array(hit)), k) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in found], pa.int64()), pa.array([s.tobytes() if whole else pack(s) for s in found], pa.binary())], ["key", "s"])

    def overlap(batches):
        read = (lambda b: np.frombuffer(b, np.uint64)) if whole else unpack
        for b in batches:
            good, sure = [], []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = read(x.as_buffer()), read(y.as_buffer())
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                met = int((large[at] == small).sum())
                above = (100 + percent) * met - percent * (len(x) + len(y))
                good.append(above >= 0)
                sure.append(whole or above > (100 + percent) * MARGIN)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(sure, pa.bool_()).filter(keep)], ["u", "v", "sure"])

    each = docs.where("id IS NOT NULL").select(F.xxhash64("id").alias("h"), "text").mapInArrow(textkit.tidy(sets), "key long, s binary").groupBy("key").agg(F.first("s").alias("s"))
    one = pairs.join(each.select(F.col("key").alias("a"), F.col("s").alias("x")), "a")
    both = one.join(each.select(F.col("key").alias("b"), F.col("s").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(textkit.tidy(overlap), "u long, v long, sure boolean")


def _verified(docs: DataFrame, incidence: DataFrame, pairs: DataFrame, k: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Of pairs (a, b) of classes, those similar enough, as edges (u, v)."""
    # Every task compares many sets and keeps few pairs, which are gathered before they are written.
    first = scratch.keep_few(_compared(docs, incidence, pairs, k, percent, False, scratch).hint("rebalance"), name)
    close = first.where("NOT sure").select(F.col("u").alias("a"), F.col("v").alias("b"))
    if close.isEmpty():
        return first.select("u", "v")
    again = scratch.keep_few(_compared(docs, incidence, close, k, percent, True, scratch).hint("rebalance"), f"{name}_again")
    return first.where("sure").unionByName(again).select("u", "v")


def _size_bound(na: str, nb: str, percent: int) -> str:
    """Whether sets of these sizes can be similar enough."""
    return f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb})"


def _rest(n: str, percent: int) -> str:
    """How many columns of a set of this size are behind its prefix."""
    return f"(({percent} * {n} + 99) div 100 - 1)"


def _first_rest(a: str, b: str) -> str:
    """The rest of the class whose prefix ends first in column order, by the two classes' rests and ends; where these are equal as far as they are known, either may be first."""
    (ra, ea), (rb, eb) = a.split(), b.split()
    return f"CASE WHEN {ea} < {eb} THEN {ra} WHEN {ea} > {eb} THEN {rb} ELSE greatest({ra}, {rb}) END"


def _own_bound(a: str, b: str, percent: int) -> str:
    """Whether the overlap can suffice when so many prefix columns of two classes are their own.

    ``a`` and ``b`` are the two classes' columns n (size), s (prefix columns
    that are not its own), r (rest) and e (end).  What both share of the prefix
    that ends first is in both prefixes, and no column there is own; after it
    the class has its rest more.
    """
    (na, sa, ra, ea), (nb, sb, rb, eb) = a.split(), b.split()
    return f"{100 + percent} * (least({sa}, {sb}) + {_first_rest(f'{ra} {ea}', f'{rb} {eb}')}) >= {percent} * ({na} + {nb})"


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """One row per input row: ``id``, ``n_shingles`` and ``component_id``.

    Documents link when ``100 * intersection >= percent * union`` of their
    ``k``-word shingle sets; ``component_id`` is the least id reachable by links.

    A null or blank text has no shingles and links with nothing; equal sets
    always link.  A row with a null id is returned with a null component and
    takes no part in links.  Repeated rows are returned as often as given.
    Rows that share an id but not a text are judged by their own texts.  Extra
    columns are ignored.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scratch = Scratch(spark)
    frequent = scratch.send(_frequent(docs, k))
    incidence = scratch.keep(_incidence(docs, k, percent, frequent), "incidence")

    classes = incidence.where("prefix IS NOT NULL").select("key", "n", "e", "prefix")
    shared = scratch.send(_shared_columns(classes, percent))
    # A class is compared with the central class that it shares most columns with; any choice is right, this one settles most.
    entries = scratch.keep(_columns(classes, shared), "entries")
    central = entries.groupBy("col").agg(F.max(F.struct((-F.col("u") / F.col("n")).alias("rank"), "key", "n", "u", "e")).alias("m"))
    central = central.select("col", F.col("m.key").alias("hub"), F.col("m.n").alias("hub_n"), F.col("m.u").alias("hub_u"), F.col("m.e").alias("hub_e"))
    ends = entries.join(central, "col").where("key <> hub")
    for of in ("", "hub_"):
        ends = ends.withColumn(f"{of}r", F.expr(_rest(f"{of}n", percent))).withColumn(f"{of}s", F.expr(f"{of}n - {of}r - {of}u"))
    ends = ends.where(f"{_size_bound('n', 'hub_n', percent)} AND {_own_bound('n s r e', 'hub_n hub_s hub_r hub_e', percent)}")
    best = ends.groupBy("key", "hub").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub"))
    stars = scratch.keep_few(best.select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct(), "stars")
    links = _verified(docs, incidence, stars, k, percent, scratch, "links")
    joined = components(links, scratch, "star").withColumnRenamed("id", "key")

    label = scratch.keep_few(entries.join(joined, "key", "left").select("col", "key", "n", "u", "e", F.coalesce("component", "key").alias("comp")).distinct(), "label")
    mixed = label.groupBy("col").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("col", "least")
    open_ = scratch.keep_few(label.join(mixed, "col").withColumn("r", F.expr(_rest("n", percent))).withColumn("s", F.expr("n - r - u")), "open")
    one = open_.where("comp <> least").select("col", *[F.col(c).alias(f"{c}p") for c in ("n", "s", "r", "e")], F.col("key").alias("p"), F.col("comp").alias("cp"))
    other = open_.select("col", *[F.col(c).alias(f"{c}q") for c in ("n", "s", "r", "e")], F.col("key").alias("q"), F.col("comp").alias("cq"), F.expr("comp = least").alias("main"))
    # The product: one row for each column that two classes of different components share, then their counts.
    apart = F.expr(f"cp <> cq AND (main OR p < q) AND {_size_bound('np', 'nq', percent)} AND {_own_bound('np sp rp ep', 'nq sq rq eq', percent)}")
    cross = one.withColumnRenamed("col", "__c").join(other, (F.col("__c") == F.col("col")) & apart)
    # Both sizes' sum and the first's rest come with the pair: few plain columns keep the join and its counts in code that compiles in little memory.
    counted = cross.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.expr("np + nq").alias("both"), F.expr(_first_rest("rp ep", "rq eq")).alias("rest"))
    # So many columns of both prefixes are shared; all others are behind the prefix that ends first.
    counted = counted.groupBy("a", "b", "both", "rest").agg(F.count(F.lit(1)).alias("c")).where(f"{100 + percent} * (c + rest) >= {percent} * both").select("a", "b")
    rest = scratch.keep_few(counted.join(stars, ["a", "b"], "left_anti"), "rest")
    links = links.unionByName(_verified(docs, incidence, rest, k, percent, scratch, "rest_links"))

    root = components(links, scratch, "all")
    owned = incidence.where("n > 0 AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"))
    grown = owned.join(root.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = grown.groupBy("component").agg(F.min("id").alias("component_id"))
    owner = scratch.keep_few(grown.join(least, "component").select("key", "component_id"), "owner")
    rows = incidence.select("id", F.col("n").alias("n_shingles"), "key").join(owner, "key", "left")
    component = F.expr("if(id IS NULL, NULL, if(n_shingles = 0, id, component_id))")
    out = scratch.keep_few(rows.select("id", "n_shingles", component.alias("component_id")), "result")
    scratch.drop("result")
    return out

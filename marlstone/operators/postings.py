"""Positional postings and cover-density search.

A unit of text (a document or a chunk) is cut into words by the analyser; its
postings are one row per distinct word with the sorted positions, counted over
all words, stop words included.  They are made inside one row, so nothing is
shuffled before they are sorted by word.  Words are kept as they are; queries
meet them by stem through a vocabulary that is stemmed once a distinct word.

A cover is a shortest range of positions that answers a query.  A unit's rank
is the sum over its covers of 0.1 / (1 + noise), noise being the words of the
range that the query does not ask for.  All of it is computed from postings.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import text as tx
from marlstone.functions.stemming import stem

#: Weight of a word without a label, as usual for text without fields.
WEIGHT = 0.1
#: Words of a headline at least and at most.
FEWEST, MOST = 20, 60


def words(text: Column) -> Column:
    """All words of a text in order, empty parts and stop words included; see :func:`positional`."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def positional(units: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per unit and distinct word: ``word``, the keys, ``positions`` (from 0, sorted) and ``length``, the unit's words without stop words."""
    plain = units.select(*keys, words(F.col(text)).alias("__w"))
    fields = [f for f in plain.schema.fields if f.name in keys]
    schema = T.StructType([T.StructField("word", T.StringType()), *fields, T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("length", T.LongType())])
    stop = pa.array(tx.STOP)

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                lists = part.column(len(keys))
                coded = lists.flatten().dictionary_encode()
                code = np.asarray(coded.indices).astype(np.int64)
                row = np.repeat(np.arange(len(part)), np.asarray(lists.value_lengths().fill_null(0)))
                said = np.asarray(pa.compute.not_equal(coded.dictionary, ""))
                kept = said & ~np.asarray(pa.compute.is_in(coded.dictionary, value_set=stop))
                code, row = code[said[code]], row[said[code]]
                if not len(code):
                    continue
                first = np.searchsorted(row, np.arange(len(part)))
                position = np.arange(len(code)) - first[row]
                mine = kept[code]
                code, row, position = code[mine], row[mine], position[mine]
                if not len(code):
                    continue
                length = np.bincount(row, minlength=len(part))
                order = np.lexsort((position, code, row))
                code, row, position = code[order], row[order], position[order]
                begin = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])]))
                offsets = np.append(begin, len(code)).astype(np.int32)
                where = pa.array(row[begin])
                cells = [coded.dictionary.take(pa.array(code[begin])), *(part.column(i).take(where) for i in range(len(keys))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(position.astype(np.int32))), pa.array(length[row[begin]])]
                yield pa.RecordBatch.from_arrays(cells, [f.name for f in schema.fields])

    return plain.mapInArrow(run, schema)


@F.pandas_udf(T.StringType())
def stems(found: pd.Series) -> pd.Series:
    return found.map(stem)


def vocabulary(postings: DataFrame) -> DataFrame:
    """Distinct words with their stems and the number of units that hold them."""
    return postings.groupBy("word").agg(F.count(F.lit(1)).alias("units")).select("word", stems("word").alias("stem"), "units")


class Asked:
    """A parsed query whose words are stems: alternatives of wanted and unwanted phrases, a last ``*`` making a word a prefix."""

    def __init__(self, query: str) -> None:
        self.ways: list[tuple[list[tuple[str, ...]], list[tuple[str, ...]]]] = []
        prefixes = {w[:-1].lower() for w in query.replace('"', " ").replace("-", " ").split() if w.endswith("*") and w[:-1]}
        name = lambda w: f"{w}*" if w in prefixes else stem(w)
        for wanted, unwanted in tx.parse_query(query):
            self.ways.append(([tuple(map(name, p)) for p in wanted], [tuple(map(name, p)) for p in unwanted]))
        if any(not wanted for wanted, _ in self.ways):
            raise ValueError("an alternative of a query needs a wanted word")
        self.units = sorted({p for ways in self.ways for side in ways for p in side})
        self.stems = sorted({w for p in self.units for w in p})

    def forms(self, known: DataFrame, most: int = 20_000) -> dict[str, list[str]]:
        """Words of the vocabulary for each of the query's stems and prefixes: a few rows for stems; over ``most`` words a prefix is refused."""
        plain, prefixes = [s for s in self.stems if not s.endswith("*")], [s for s in self.stems if s.endswith("*")]
        test = reduce(lambda a, b: a | b, [F.col("word").startswith(p[:-1]) for p in prefixes], F.col("stem").isin(*plain) if plain else F.lit(False))
        rows = known.where(test).select("word", "stem").distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError("a prefix of the query has too many words")
        return {s: sorted(r["word"] for r in rows if (r["word"].startswith(s[:-1]) if s.endswith("*") else r["stem"] == s)) for s in self.stems}


def _occurrences(phrase: tuple[str, ...], at: dict[str, Column]) -> Column:
    """Places (stop, start) of a phrase: where its words follow each other."""

    def followed(starts: Column, k: int) -> Column:
        return F.filter(starts, lambda p: F.array_contains(at[phrase[k]], p + F.lit(k)))

    first = reduce(followed, range(1, len(phrase)), at[phrase[0]])
    return F.transform(first, lambda p: F.struct((p + F.lit(len(phrase) - 1)).alias("stop"), p.alias("start")))


def hits(postings: DataFrame, keys: list[str], asked: Asked, forms: dict[str, list[str]]) -> DataFrame:
    """Units that answer a query: the keys, ``length``, ``rank``, and ``start`` and ``stop`` of the best cover, the first of equals.  Only postings of the query's words are read."""
    wanted = sorted({w for ws in forms.values() for w in ws})
    none = F.array().cast("array<int>")
    per = [F.sort_array(F.flatten(F.collect_list(F.when(F.col("word").isin(*forms[s]), F.col("positions"))))).alias(f"__p{i}") if forms[s] else none.alias(f"__p{i}") for i, s in enumerate(asked.stems)]
    found = postings.where(F.col("word").isin(*wanted) if wanted else F.lit(False)).groupBy(*keys, "length").agg(F.count(F.lit(1)).alias("__n"), *per)
    at = {s: F.col(f"__p{i}") for i, s in enumerate(asked.stems)}
    own = found.select(*keys, "length", *[f"__p{i}" for i in range(len(asked.stems))], *[_occurrences(u, at).alias(f"__u{j}") for j, u in enumerate(asked.units)])
    number = {u: j for j, u in enumerate(asked.units)}
    there = lambda u: F.size(f"__u{number[u]}") > 0
    ways = [reduce(lambda a, b: a & b, [*(there(u) for u in yes), *(~there(u) for u in no)]) for yes, no in asked.ways]
    own = own.where(reduce(lambda a, b: a | b, ways))
    # All places of wanted phrases by their ends, and of wanted words, which are no noise.
    yes = sorted({u for y, _ in asked.ways for u in y})

    def marked(k: int) -> Column:
        return F.transform(f"__u{number[yes[k]]}", lambda o: F.struct(o["stop"].alias("stop"), F.lit(k).alias("unit"), o["start"].alias("start")))

    events = F.array_sort(F.concat(*map(marked, range(len(yes)))))
    own = own.withColumn("__e", events).withColumn("__a", F.array_distinct(F.concat(*[at[s] for s in sorted({w for u in yes for w in u})])))
    empty = F.struct(F.array_repeat(F.lit(-1), len(yes)).alias("last"), F.lit(-1).alias("before"), F.lit(0.0).alias("rank"), F.lit(-1).alias("noise"), F.lit(0).alias("start"), F.lit(0).alias("stop"))

    def step(acc: Column, e: Column) -> Column:
        last = F.transform(acc["last"], lambda x, i: F.when(i == e["unit"], F.greatest(x, e["start"])).otherwise(x))

        def close(last: Column) -> Column:
            begins = [reduce(F.least, [F.get(last, F.lit(yes.index(u))) for u in way]) if len(way) > 1 else F.get(last, F.lit(yes.index(way[0]))) for way, _ in asked.ways]
            begin = F.greatest(*begins) if len(begins) > 1 else begins[0]
            fresh = begin > acc["before"]
            noise = e["stop"] - begin + 1 - F.size(F.filter("__a", lambda p: (p >= begin) & (p <= e["stop"])))
            better = fresh & ((acc["noise"] < 0) | (noise < acc["noise"]))
            keep = lambda new, old, test: F.when(test, new).otherwise(old)
            return F.struct(
                last.alias("last"), F.greatest(acc["before"], begin).alias("before"), (acc["rank"] + F.when(fresh, F.lit(WEIGHT) / (1 + noise)).otherwise(F.lit(0.0))).alias("rank"),
                keep(noise, acc["noise"], better).alias("noise"), keep(begin, acc["start"], better).alias("start"), keep(e["stop"], acc["stop"], better).alias("stop"),
            )

        return F.get(F.transform(F.array(last), close), F.lit(0))

    folded = own.select(*keys, "length", F.aggregate("__e", empty, step, lambda acc: F.struct(acc["rank"].alias("rank"), acc["start"].alias("start"), acc["stop"].alias("stop"))).alias("c"))
    return folded.select(*keys, "length", F.round("c.rank", 6).alias("rank"), "c.start", "c.stop")


def headline(text: Column, start: Column, stop: Column, forms: list[str], mark: str = "**") -> Column:
    """A cover with words around it, FEWEST to MOST words in all, the query's words marked; white space is one space."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    # Words and what is between take turns.
    odd = F.when(F.get(parts, F.lit(0)).rlike(r"^[\p{L}\p{N}]"), 0).otherwise(1)
    lead = F.greatest(F.floor((F.lit(FEWEST) - (stop - start + 1)) / 2), F.lit(0))
    begin = F.greatest(start - lead, F.lit(0))
    wide = F.least(F.greatest(F.lit(FEWEST), stop + lead - begin + 1), F.lit(MOST))
    shown = F.slice(parts, (begin * 2 + odd + 1).cast("int"), (wide * 2 - 1).cast("int"))
    marked = F.transform(shown, lambda w: F.when(F.lower(w).isin(*forms), F.concat(F.lit(mark), w, F.lit(mark))).otherwise(w)) if forms else shown
    return F.trim(F.regexp_replace(F.array_join(marked, ""), r"\s+", " "))


def bm25(postings: DataFrame, keys: list[str], asked: Asked, forms: dict[str, list[str]], units: int, mean_length: float, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The keys and ``score`` of units with any of a query's stems; ``units`` and ``mean_length`` are the collection's."""
    wanted = [s for s in asked.stems if forms[s]]
    names = F.create_map(*[x for s in wanted for w in forms[s] for x in (F.lit(w), F.lit(s))]) if wanted else F.create_map().cast("map<string,string>")
    found = postings.where(F.col("word").isin(*[w for s in wanted for w in forms[s]]) if wanted else F.lit(False))
    each = found.groupBy(*keys, "length", F.try_element_at(names, F.col("word")).alias("stem")).agg(F.sum(F.size("positions")).alias("tf"))
    df = each.groupBy("stem").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(units) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / (mean_length or 1.0)))
    # One row for each of the query's stems.
    return each.join(F.broadcast(df), "stem").groupBy(*keys).agg(F.round(F.sum(part), 6).alias("score"))

"""Main text of web pages by differencing each page with its nearest neighbours by URL.

Pages are parsed into text lines with the zones they stand in.  The lines'
digests are sorted by host and path over a range partitioning, so one host may
fill many tasks.
In that order the page with the longest common path stands next to each page.
The lines of both are aligned by a longest common subsequence, and lines found
in both are deleted.  Two zones are decided before that: what plainly is a menu,
a notice, a form or the like goes whether it is shared or not, and an explicit
article keeps its lines, for quotations and licences repeat there for good
reason.  Wherever names leave it open, in an article or outside, and where the
page has no article, the differencing decides.  Which zone is the page's main
one is decided by the lengths of what is left.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import bitmap, htmltext, textkit
from marlstone.llm.store import Scratch


def _best(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``x`` and each beginning of ``y``."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(np.where(y == v, row[:-1] + 1, 0), row[1:]))
    return row


def _aligned(x: np.ndarray, y: np.ndarray, first: int, found: set[int]) -> None:
    """Add the places in ``x`` (from ``first``) of one longest common subsequence, in memory that grows with the lengths only."""
    if not len(x) or not len(y):
        return
    if len(x) == 1:
        if (y == x[0]).any():
            found.add(first)
        return
    half = len(x) // 2
    cut = int(np.argmax(_best(x[:half], y) + _best(x[half:][::-1], y[::-1])[::-1]))
    _aligned(x[:half], y[:cut], first, found)
    _aligned(x[half:], y[cut:], first + half, found)


def common_subsequence(x: list, y: list) -> set[int]:
    """Positions in ``x`` of one longest common subsequence with ``y``."""
    found: set[int] = set()
    lo = 0
    while lo < min(len(x), len(y)) and x[lo] == y[lo]:
        found.add(lo)
        lo += 1
    hi = 0
    while hi < min(len(x), len(y)) - lo and x[-1 - hi] == y[-1 - hi]:
        found.add(len(x) - 1 - hi)
        hi += 1
    a, b = x[lo : len(x) - hi], y[lo : len(y) - hi]
    number = {v: k for k, v in enumerate(set(a) & set(b))}
    at = [i for i, v in enumerate(a) if v in number]
    placed: set[int] = set()
    _aligned(np.array([number[a[i]] for i in at], np.int32), np.array([number[v] for v in b if v in number], np.int32), 0, placed)
    return found | {lo + at[k] for k in placed}


def _nearness(x: str, y: str) -> int:
    n = min(len(x), len(y))
    return next((i for i in range(n) if x[i] != y[i]), n)


def shared_lines(rows: list[tuple[str, str, list]], i: int) -> set[int]:
    """Lines of row i that its nearest neighbour in URL order has as well; the one before wins a tie, and a copy of the page says nothing."""
    host, path, lines = rows[i]
    beside = [rows[j] for j in (i - 1, i + 1) if 0 <= j < len(rows) and rows[j][0] == host and rows[j][2] != lines]
    if not beside or not lines:
        return set()
    near = max(beside, key=lambda r: _nearness(path, r[1]))
    return common_subsequence(lines, near[2])


def _digest(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "little", signed=True)


def _key(*columns: str) -> Column:
    """128 bits for equal rows."""
    plain = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *plain)), 16, "0") for seed in (1, 2)]))


_DECIDED = "uid binary, shared array<int>, edge boolean, host string, path string, lines array<long>"


def _table(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.list_(pa.int32()), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.int64())]
    cols = list(zip(*found, strict=True)) if found else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["uid", "shared", "edge", "host", "path", "lines"])


def _decide(batches):
    """Shared lines of sorted rows.  A partition's first and last row come back whole instead (edge, shared [1]), with the row inside of each (edge, shared [0])."""
    held: list[tuple] = []
    begun = False
    for b in batches:
        t = held + list(zip(*[c.to_pylist() for c in b.columns], strict=True))
        if len(t) < 2:
            held = t
            continue
        if not begun:
            yield _table([(u, [1 - k], True, h, p, x) for k, (u, h, p, x) in enumerate(t[:2])])
            begun = True
        bare = [(h or "", p or "", x) for _, h, p, x in t]
        yield _table([(t[i][0], sorted(shared_lines(bare, i)), False, None, None, None) for i in range(1, len(t) - 1)])
        held = t[-2:]
    yield _table([(u, [k], True, h, p, x) for k, (u, h, p, x) in enumerate(held, 2 - len(held))])


def _decide_edges(batches):
    """Shared lines of the rows marked [1] among all edge rows, sorted."""
    t = [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    bare = [(h or "", p or "", x) for _, h, p, x, _ in t]
    yield _table([(t[i][0], sorted(shared_lines(bare, i)), False, None, None, None) for i in range(len(t)) if t[i][4] == [1]])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``id``, ``url``, ``text`` (blocks joined by newlines), ``n_chars`` in code points and ``n_shared``, the lines that the differencing deleted.

    Null or empty html gives the empty text.  A null url counts as empty and is
    compared with other such pages.  Equal rows get equal texts and all stay;
    extra columns are ignored; an empty table gives an empty result.  The
    neighbour order is by host, path, query and content, so the result does not
    depend on the partitioning.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    bare = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    keyed = bare.withColumns({"uid": _key("url", "html"), "host": host, "path": F.when(path == "", F.col("url")).otherwise(path)})

    def lines(batches):
        for b in batches:
            got = [[_digest(x) for x, _, _ in htmltext.blocks(h)] for h in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(got, pa.list_(pa.int64()))], ["uid", "host", "path", "lines"])

    # Written, for the range partitioning looks at its input twice.
    small = scratch.keep(keyed.select("uid", "host", "path", "html").mapInArrow(textkit.tidy(lines), "uid binary, host string, path string, lines array<long>"), "lines")
    order = ["host", "path", "uid"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    decided = scratch.keep(small.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_decide, _DECIDED), "decided")
    # A few rows for each partition.
    edges = decided.where("edge").groupBy("uid", "host", "path", "lines").agg(F.max("shared").alias("shared"))
    ends = edges.select("uid", "host", "path", "lines", "shared").repartition(1).sortWithinPartitions(*order).mapInArrow(_decide_edges, _DECIDED)
    verdict = decided.where("NOT edge").unionByName(ends).where("size(shared) > 0").groupBy("uid").agg(F.max("shared").alias("shared"))
    verdict = scratch.keep(verdict, "verdict")
    scratch.drop("verdict")

    def texts(batches):
        for b in textkit.slices(batches, 500):
            out, told = [], []
            for html, shared in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                found, gone = htmltext.blocks(html), set(shared or ())
                left, less = htmltext.main_blocks(found, gone)
                out.append("\n".join(found[i][0] for i in left))
                told.append(less)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64()), pa.array(told, pa.int32())], ["id", "url", "text", "n_chars", "n_shared"])

    schema = bare.select("id", "url").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long"), "n_shared": F.lit(0)}).schema
    # Only pages that have shared lines meet the verdicts.
    suspects, clean = bitmap.split(keyed, "uid", verdict.select("uid"))
    both = suspects.join(verdict, "uid", "left").select("id", "url", "html", "shared").unionByName(clean.select("id", "url", "html", F.lit(None).cast("array<int>").alias("shared")))
    return both.mapInArrow(textkit.tidy(texts), schema)

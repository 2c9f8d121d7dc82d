"""Text to retrieval units."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
CHUNKS = "array<struct<chunk_index:int,content:string,start:int,stop:int>>"


def windows_sql(df: DataFrame, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Fixed windows with true overlap, as expressions: one row per window, short texts one window."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step)).cast("int")
    spread = df.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("chunk_index", F.col("chunk_index").cast("long"))
    return spread.withColumn("content", F.substring(F.col(text), (F.col("chunk_index") * step + 1).cast("int"), F.lit(size)))


def recursive(text: str, size: int = 1000, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that does.

    Cuts keep every character that is not white space.  With an overlap each
    piece after the first begins with the end of the one before it.
    """
    def cut(s: str, seps: tuple[str, ...]) -> list[str]:
        if len(s) <= size:
            return [s]
        sep = next((x for x in seps if x == "" or x in s), "")
        if sep == "":
            return [s[i : i + size] for i in range(0, len(s), size)]
        rest = seps[seps.index(sep) + 1 :]
        out, held = [], ""
        for part in re.split(f"(?<={re.escape(sep)})", s):
            if len(held) + len(part) <= size:
                held += part
            else:
                if held:
                    out.append(held)
                held = ""
                if len(part) > size:
                    *whole, held = cut(part, rest)
                    out += whole
                else:
                    held = part
        return [*out, held] if held else out

    found = [p.strip() for p in cut(text, separators)]
    found = [p for p in found if p]
    if overlap:
        found = [found[0], *[(a[-overlap:] + b)[: size + overlap] for a, b in zip(found, found[1:], strict=False)]] if found else []
    return found


def snapped(text: str, size: int = 1000, overlap: int = 200, marks: tuple[str, ...] = (". ",)) -> list[tuple[int, int]]:
    """Spans of windows that end at the last mark past the half, overlap truly and always advance."""
    out, at, n = [], 0, len(text)
    while at < n:
        stop = min(n, at + size)
        if stop < n:
            for mark in marks:
                k = text.rfind(mark, at, stop)
                if k > at + size // 2:
                    stop = k + len(mark)
                    break
        out.append((at, stop))
        if stop == n:
            break
        at = max(stop - overlap, at + 1)
    return out


def paragraphs(text: str, size: int = 1000, overlap: int = 0) -> list[tuple[int, int]]:
    """Spans of whole paragraphs packed up to ``size``; one that is longer is cut at sentence ends; with an overlap a span repeats the last paragraph before it."""
    parts = [(m.start(), m.end()) for m in re.finditer(r"\S(?:.|\n(?!\s*\n))*", text)]
    pieces: list[tuple[int, int]] = []
    for a, b in parts:
        if b - a <= size:
            pieces.append((a, b))
        else:
            pieces += [(a + x, a + y) for x, y in snapped(text[a:b], size, 0, (". ", " "))]
    out: list[list[tuple[int, int]]] = []
    for p in pieces:
        if out and p[1] - out[-1][0][0] <= size:
            out[-1].append(p)
        else:
            last = out[-1][-1] if out and overlap and p[1] - out[-1][-1][0] <= size else None
            out.append([last, p] if last else [p])
    return [(g[0][0], g[-1][1]) for g in out]


METHODS = {
    "recursive": lambda s, size, overlap: [(p, -1, -1) for p in recursive(s, size, overlap)],
    "window": lambda s, size, overlap: [(s[a:b], a, b) for a, b in snapped(s, size, overlap)],
    "snapped": lambda s, size, overlap: [(s[a:b], a, b) for a, b in snapped(s, size, overlap, ("\n\n", "\n", ". ", " "))],
    "paragraph": lambda s, size, overlap: [(s[a:b], a, b) for a, b in paragraphs(s, size, overlap)],
}


def chunk(df: DataFrame, text: str, method: str = "recursive", size: int = 1000, overlap: int = 0) -> DataFrame:
    """One row per chunk: ``chunk_index``, ``total_chunks``, ``content``, ``start`` and ``stop`` (-1 where a method keeps no offsets)."""
    cut = METHODS[method]

    @F.pandas_udf(CHUNKS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda s: [{"chunk_index": i, "content": c, "start": a, "stop": b} for i, (c, a, b) in enumerate(cut(s, size, overlap))])

    held = df.withColumn("__c", run(F.col(text)))
    each = held.withColumn("total_chunks", F.size("__c")).withColumn("__x", F.explode("__c"))
    return each.select(*df.columns, "total_chunks", "__x.chunk_index", "__x.content", "__x.start", "__x.stop")


#: How quoted text begins, each at the start of a line, in any case.
QUOTE_HEADS = (
    r"On\s.{1,200}\s+wrote:\s*$",
    r"(From|De|Von|Desde|Da)\s*:\s*.{1,500}\n\s*(Sent|Envoyé|Gesendet|Enviado|Inviato|Data)\s*:",
    r"-{5,}\s*Original Message\s*-{5,}\s*$",
    r"-{5,}\s*Forwarded message\s*-{5,}\s*$",
    r"_{20,}\s*$",
)
#: Closings of a letter, each a line of its own.
CLOSERS = ("Best", "Best regards", "Sincerely", "Regards", "Thanks", "Thank you", "Cheers", "Kind regards", "Warm regards", "Respectfully")
#: Words that a disclaimer begins with.
DISCLAIMERS = (
    "CONFIDENTIALITY NOTICE",
    "CONFIDENTIAL COMMUNICATION",
    "PRIVILEGED AND CONFIDENTIAL",
    "ATTORNEY-CLIENT PRIVILEGED",
    "ATTORNEY CLIENT PRIVILEGED",
    "ATTORNEY WORK PRODUCT",
    "IRS CIRCULAR 230",
    "This email and any attachments",
    "This message and any attachments",
    "The information contained in this",
    "This e-mail and any files transmitted",
    "If you are not the intended recipient",
    "NOTICE OF CONFIDENTIALITY",
)
#: Lines with a quoting mark that make a quotation, and the end of a text in which a closing is looked for and must be.
QUOTED_LINES, TAIL, LAST = 3, 500, 400

_QUOTE = re.compile(rf"^(?:{'|'.join(QUOTE_HEADS)})|(?:^>.*(?:\n|\Z)){{{QUOTED_LINES},}}", re.M | re.I)
_DASH = re.compile(r"^-- ?\s*$", re.M)
_CLOSER = re.compile(rf"^(?:{'|'.join(c.replace(' ', chr(92) + 's+') for c in CLOSERS)})[,.]?\s*$", re.M | re.I)
_DISCLAIMER = re.compile("|".join(map(re.escape, DISCLAIMERS)), re.I)


def segments(body: str) -> list[tuple[str, str, int]]:
    """A mail's parts in order as (kind, text, offset): body, signature, disclaimer and quoted."""
    end, marks = len(body), []
    # From the end of the mail: each part is looked for in what stands before the part after it.
    if m := _QUOTE.search(body):
        end = m.start()
        marks.append((end, "quoted"))
    if m := _DISCLAIMER.search(body, 0, end):
        end = body.rfind("\n", 0, m.start()) + 1
        marks.append((end, "disclaimer"))
    head = body[:end]
    m = _DASH.search(head)
    if not m and (m := _CLOSER.search(head, max(0, end - TAIL))) and end - m.start() >= LAST:
        m = None
    if m:
        marks.append((m.start(), "signature"))
    marks = [(0, "body"), *reversed(marks)]
    parts = ((kind, body[a:b].strip(), a) for (a, kind), (b, _) in zip(marks, [*marks[1:], (len(body), "")], strict=True))
    return [p for p in parts if p[1]]


def segment(df: DataFrame, body: str) -> DataFrame:
    """One row per mail part: ``part``, ``content`` and ``offset`` in code points."""

    @F.pandas_udf("array<struct<part:string,content:string,offset:int>>")
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.fillna("").map(lambda s: [{"part": k, "content": c, "offset": o} for k, c, o in segments(s)])

    return df.withColumn("__s", F.explode(run(F.col(body)))).select(*df.columns, "__s.part", "__s.content", "__s.offset")

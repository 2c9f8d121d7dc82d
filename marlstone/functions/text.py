"""Text expressions: the analyser, query parsing, ranking, headlines, and extractors."""

from __future__ import annotations

import re
from functools import reduce
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that no query or document is indexed by.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "with")


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, without stop words, in order."""
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(split, lambda w: (w != "") & ~w.isin(*STOP))


def parse_query(query: str) -> list[tuple[list[list[str]], list[list[str]]]]:
    """A web-style query as alternatives of (wanted phrases, unwanted phrases), each phrase a list of terms.

    Words are joined by "and"; ``or`` starts an alternative, quotes make a
    phrase, a minus sign excludes.
    """
    out: list[tuple[list[list[str]], list[list[str]]]] = [([], [])]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if not minus and word.lower() == "or":
            out.append(([], []))
            continue
        found = [w for w in re.split(r"[^\w]+|_", (phrase or word).lower()) if w and w not in STOP]
        if found:
            out[-1][1 if minus else 0].append(found)
    return [a for a in out if a[0] or a[1]]


def _holds(tokens: Column, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.array_contains(tokens, phrase[0])
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return joined.contains(f" {' '.join(phrase)} ")


def matches(tokens: Column, query: str) -> Column:
    """Whether a tokenised text answers a web-style query; an empty query answers nothing."""
    ways = []
    for wanted, unwanted in parse_query(query):
        tests = [_holds(tokens, p) for p in wanted] + [~_holds(tokens, p) for p in unwanted]
        ways.append(reduce(lambda a, b: a & b, tests))
    return reduce(lambda a, b: a | b, ways) if ways else F.lit(False)


def rank(tokens: Column, words: list[str]) -> Column:
    """Occurrences of the query's words over one plus the log of the length: the documented substitute of cover density."""
    hits = F.size(F.filter(tokens, lambda t: t.isin(*words))) if words else F.lit(0)
    return F.round(hits / (F.lit(1.0) + F.log(F.greatest(F.size(tokens), F.lit(1)).cast("double"))), 6)


def query_words(query: str) -> list[str]:
    return sorted({w for wanted, _ in parse_query(query) for p in wanted for w in p})


def headline(text: Column, words: list[str], most: int = 60, before: int = 10, mark: str = "**") -> Column:
    """Up to ``most`` words around the first hit, hits marked."""
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+")
    clean = lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    first = F.coalesce(F.array_position(F.transform(parts, lambda w: clean(w).isin(*words)), F.lit(True)), F.lit(1)) if words else F.lit(1)
    window = F.slice(parts, F.greatest(first - before, F.lit(1)).cast("int"), most)
    if not words:
        return F.array_join(window, " ")
    return F.array_join(F.transform(window, lambda w: F.when(clean(w).isin(*words), F.concat(F.lit(mark), w, F.lit(mark))).otherwise(w)), " ")


#: Case numbers of state courts and of federal courts (court, year, number, judge).
CASE_STATE = r"(\d{2})-(\d)-(\d{5})-(\d{2})"
CASE_FEDERAL = r"(?i)(\d{1,2})[-:]?(\d{2})[-:]?cv[-:]?(\d{5})[-:]?(\w{2,4})?"


def case_numbers(text: Column, scan: int = 5000) -> Column:
    """Distinct case numbers in the first characters, sorted; federal ones as court, year, CV, number and judge, in capitals."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, scan)
    federal = F.transform(F.regexp_extract_all(head, F.lit(CASE_FEDERAL), F.lit(0)), lambda m: F.upper(F.regexp_replace(m, CASE_FEDERAL, "$1$2CV$3$4")))
    return F.array_sort(F.array_distinct(F.concat(federal, F.regexp_extract_all(head, F.lit(CASE_STATE), F.lit(0)))))


def sender_address(raw: Column) -> Column:
    inside = F.regexp_extract(raw, r"<([^<>\s]+@[^<>\s]+)>", 1)
    return F.lower(F.when(inside != "", inside).otherwise(F.regexp_extract(raw, r"([^\s<>,;]+@[^\s<>,;]+)", 1)))


def sender_name(raw: Column) -> Column:
    """The display name without quotes, else the local part."""
    shown = F.trim(F.regexp_replace(F.regexp_extract(raw, r"^\s*\"?([^<\"]*)\"?\s*<", 1), r"\s+", " "))
    return F.when(shown != "", shown).otherwise(F.substring_index(sender_address(raw), "@", 1))


def address_domain(address: Column) -> Column:
    return F.when(address.contains("@"), F.substring_index(address, "@", -1)).otherwise("")


def two_lines(body: Column) -> Column:
    """The first two lines that say something, joined by a middle dot."""
    lines = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 1) & ~x.startswith(">") & x.rlike(r"[\p{L}\p{N}]"))
    return F.array_join(F.slice(lines, 1, 2), " · ")


def garbage(text: Column, head: int = 2000, share: float = 0.4) -> Column:
    """Whether more than a share of the first characters is not ASCII."""
    part = F.substring(F.coalesce(text, F.lit("")), 1, head)
    return F.length(F.regexp_replace(part, r"[\x00-\x7F]", "")) > F.length(part) * share


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def context_prefix(title: Column, domain: Column, kind: Column, case_number: Column) -> Column:
    """The template sentence that stands before a chunk, in its context tags."""
    said = F.concat(F.lit("From "), F.coalesce(F.nullif(title, F.lit("")), F.lit("an untitled document")), F.lit(", a "), domain, F.lit(" "), kind, F.when(case_number.isNotNull(), F.concat(F.lit(" in case "), case_number)).otherwise(""), F.lit("."))
    return F.concat(F.lit("<context>\n"), said, F.lit("\n</context>\n"))


#: Patterns of personal data, by kind.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\(\d{3}\) ?\d{3}-\d{4}|\b\d{3}-\d{3}-\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "card": r"\b(?:\d[ -]*?){13,16}\b",
    "mrn": r"(?i)\bMRN[: ]?\d{6,12}\b",
    "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}


def pii_counts(text: Column) -> dict[str, Column]:
    return {k: F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({p})"), F.lit(1))).cast("long") for k, p in PII.items()}


def fill_template(template: Column, variables: Column, default: str = "") -> Column:
    """``{{name}}`` places filled from a map; missing names get the default."""
    names = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{\s*(\w+)\s*\}\}"), F.lit(1)))
    tight = F.regexp_replace(template, r"\{\{\s*(\w+)\s*\}\}", "{{$1}}")
    return F.aggregate(names, tight, lambda acc, n: F.replace(acc, F.concat(F.lit("{{"), n, F.lit("}}")), F.coalesce(F.try_element_at(variables, n), F.lit(default))))


def match_name(name: Column) -> Column:
    """A file name's letters and digits, lowered, for matching."""
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}]", ""))


def safe_name(name: Column, most: int = 120) -> Column:
    """A name as a path fragment."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.substring(F.when(clean == "", "unnamed").otherwise(clean), 1, most)


@F.pandas_udf(T.StringType())
def decoded(texts: pd.Series) -> pd.Series:
    """Character references as characters, by the standard's whole list of names; texts without any are passed on."""
    return texts.map(lambda s: unescape(s) if s is not None and "&" in s else s)


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and metadata dropped, tags made newlines, blank runs collapsed."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->|<(meta|link)\b[^>]*>", "")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", "\n")
    bare = decoded(bare)
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[ \t]+", " "), r" ?\n ?", "\n"), r"\n{3,}", "\n\n"))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_links(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?href=[\"']([^\"'#][^\"']*)[\"']"), F.lit(1))
    return F.filter(found, lambda u: ~F.lower(u).rlike(r"^(mailto|tel|javascript):"))

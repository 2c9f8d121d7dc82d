"""Many regular expressions over many texts by one automaton.

Of each pattern those literals are taken of which every match holds one.  An
automaton over all of them runs once over each text, in Arrow batches, and
names the patterns that may match; only these are tried, by the JVM, so the
answer is that of ``rlike``.  Patterns without such a literal are tried always.
White space of any kind and length is one space to the automaton, so words
that a pattern parts by ``+`` or ``\\s+`` make one literal.
"""

from __future__ import annotations

import re
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A literal of fewer characters says too little.
LEAST = 2
#: Rules at most: their automaton is sent to every task.
MOST = 200_000


def _best(found: list[frozenset[str]]) -> frozenset[str] | None:
    some = [f for f in found if f and min(map(len, f)) >= LEAST]
    return max(some, key=lambda f: (min(map(len, f)), -len(f)), default=None)


def _is_space(name: str, value) -> bool:
    """Whether every match of a parsed item is white space, one character or more."""
    if name == "LITERAL":
        return chr(value).isspace()
    if name == "IN":
        return all(str(x) == "CATEGORY_SPACE" or _is_space(str(op), x) for op, x in value)
    return name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1 and len(value[2]) == 1 and _is_space(str(value[2][0][0]), value[2][0][1])


def spaced(text: str) -> str:
    """A lower-case text with one space for white space of any length, and one at each end."""
    return f" {' '.join(text.lower().split())} "


def _required(items) -> frozenset[str] | None:
    """Literals of which every match of a parsed sequence holds one, or None where none is certain."""
    found: list[frozenset[str]] = []
    run: list[str] = []

    def end() -> None:
        if run:
            found.append(frozenset([re.sub(r"\s+", " ", "".join(run))]))
            run.clear()

    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            run.append(chr(value))
        elif _is_space(name, value):
            run.append(" ")
        elif name == "AT":
            continue
        elif name == "SUBPATTERN" and not value[1] and not value[2]:
            inner = list(value[3])
            if all(str(o) == "LITERAL" for o, _ in inner):
                run.extend(chr(v) for _, v in inner)
            else:
                end()
                found.append(_required(inner) or frozenset())
        elif name == "BRANCH":
            end()
            ways = [_required(list(w)) for w in value[1]]
            found.append(frozenset().union(*ways) if all(ways) else frozenset())
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            end()
            found.append(_required(list(value[2])) or frozenset())
        else:
            end()
    end()
    return _best(found)


def required(pattern: str) -> frozenset[str] | None:
    """Lower-case literals of which every match's :func:`spaced` text holds one; None where that is not certain, as for syntax that only the JVM knows."""
    from re import _parser  # the library's own reader of patterns

    # Quoting, octal digits, and flags for other alphabets and comments are not read alike.
    if re.search(r"\\Q|\\0|&&|\(\?[a-zA-Z]*[uUx]", pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            found = _required(list(_parser.parse(pattern)))
    except Exception:  # noqa: BLE001  whatever it cannot read is tried on every text
        return None
    return frozenset(w.lower() for w in found) if found and all(w.isascii() for w in found) else None


def pattern_join(df: DataFrame, rules: DataFrame, text: str, pattern: str) -> DataFrame:
    """Rows of ``df`` with the columns of every rule whose pattern their text matches, as ``rlike`` says; null texts and patterns match nothing."""
    import ahocorasick

    given = rules.where(F.col(pattern).isNotNull()).select(*rules.columns).limit(MOST + 1).collect()
    if len(given) > MOST:
        raise ValueError(f"more than {MOST} rules; split them")
    schema = rules.schema
    numbered = df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(given)], f"__rule int, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema.fields)}")
    of: dict[str, list[int]] = {}
    always: list[int] = []
    for i, r in enumerate(given):
        words = required(r[pattern])
        for w in words or ():
            of.setdefault(w, []).append(i)
        if words is None:
            always.append(i)
    sent = df.sparkSession.sparkContext.broadcast((of, always))
    names = df.columns
    # Texts go to Python once, or as a string beside a column of another type.
    some, at = (df, names.index(text)) if dict(df.dtypes)[text] == "string" else (df.withColumn("__text", F.col(text).cast("string")), len(names))

    def candidates(batches):
        of, always = sent.value
        machine = ahocorasick.Automaton()
        for w, own in of.items():
            machine.add_word(w, own)
        if of:
            machine.make_automaton()
        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                if t is None:
                    out.append([])
                    continue
                hit = set(always)
                if of:
                    for _, own in machine.iter(spaced(t)):
                        hit.update(own)
                out.append(sorted(hit))
            keep = [k for k, x in enumerate(out) if x]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(keep, pa.int32())) for c in b.columns[: len(names)]), pa.array([out[k] for k in keep], pa.list_(pa.int32()))], [*names, "__rules"])

    found = some.mapInArrow(candidates, df.withColumn("__rules", F.array(F.lit(0))).schema)
    tried = found.withColumn("__rule", F.explode("__rules")).drop("__rules").join(F.broadcast(numbered.withColumnsRenamed({c: f"__r_{c}" for c in rules.columns})), "__rule")
    return tried.where(F.expr(f"`{text}` RLIKE `__r_{pattern}`")).select(*names, *[F.col(f"__r_{c}").alias(c) for c in rules.columns])

"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule says which documents fail.  In one job over a sample each rule is
run on raw rows between two readings of the clock, which gives its cost with
all that it needs of the text, and its selectivity (share rejected).  The
cascade then asks the rules by rejection per cost, and of a document that has
failed nothing more is computed but the base counts that every row returns.
The order changes the cost and never the verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents that costs and selectivities are measured on, about.
SAMPLE = 2000
WINDOW = 8
_SPACE = " \t\n\u000b\f\r"

_BLANK = r"[ \t\n\x0B\f\r]*"
#: Rules beyond the base ones: name and SQL condition under which a document fails.  What a condition computes from text, words or lines is computed when it is asked.
RULES = (
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("shouting", r"2 * length(regexp_replace(text, r'[^\p{Lu}]', '')) > word_chars"),
    ("exclamations", "2 * (length(text) - length(translate(text, '!', ''))) > n_words"),
    ("vocabulary", "100 * size(array_distinct(words)) < 5 * n_words"),
    ("alphabetic", r"100 * size(filter(words, w -> w rlike r'\p{L}')) < 50 * n_words"),
    ("bullets", f"100 * size(filter(lines, x -> x rlike r'^{_BLANK}[-*•]')) > 90 * n_lines"),
    ("ellipses", f"100 * size(filter(lines, x -> x rlike r'(\\.\\.\\.|…){_BLANK}\\z')) > 30 * n_lines"),
    ("pairs", "100 * size(array_distinct(zip_with(slice(words, 1, greatest(size(words) - 1, 0)), slice(words, 2, greatest(size(words) - 1, 0)), (x, y) -> concat(x, ' ', y)))) < 10 * (n_words - 1)"),
)


def _let(value: Column, name) -> Column:
    """``name(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), name), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more, the first included."""

    def covered(h: Column) -> Column:
        return _let(
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
            lambda s: F.aggregate(
                F.sort_array(
                    F.transform(
                        F.filter(
                            F.transform(
                                s,
                                lambda e, k: F.struct(
                                    e["i"].alias("i"),
                                    (F.get(s, k - 1)["x"].eqNullSafe(e["x"]) | F.get(s, k + 1)["x"].eqNullSafe(e["x"])).alias("twice"),
                                ),
                            ),
                            lambda e: e["twice"],
                        ),
                        lambda e: e["i"],
                    )
                ),
                F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
                lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("n"), i.alias("at")),
                lambda acc: acc["n"],
            ),
        )

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(words, windows)).cast("long")


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    cut = bare.select("id", "text", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, _SPACE, "") != "").alias("lines"))
    return cut.select(
        "id", "text", "words", "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", _SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).alias("n_repeat_words"),
    )


def measured(docs: DataFrame, id_col: str, text_col: str, rules=RULES, sample: int = SAMPLE) -> list[tuple[str, str, float, float]]:
    """The rules with selectivity and cost (seconds a document) on a sample drawn by hash, in the order of the cascade."""
    n = docs.count()
    drawn = docs.select(id_col, text_col).where(F.pmod(F.xxhash64(id_col, F.lit(31)), F.lit(1_000_000)) < min(1.0, sample / max(n, 1)) * 1_000_000)
    clock = F.expr("CAST(reflect('java.lang.System', 'nanoTime') AS BIGINT)")
    # One array, whose elements are computed in their order.
    cells = [clock, *(x for _, test in rules for x in (F.expr(f"CAST(({test}) AS BIGINT)"), clock))]
    probed = features(drawn, id_col, text_col).select(F.array(*cells).alias("p"))
    sums = [x for k in range(len(rules)) for x in (F.sum(F.get("p", F.lit(2 * k + 2)) - F.get("p", F.lit(2 * k))).alias(f"t{k}"), F.sum(F.get("p", F.lit(2 * k + 1))).alias(f"r{k}"))]
    got = probed.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    size = max(got["n"], 1)
    out = [(name, test, (got[f"r{k}"] or 0) / size, max((got[f"t{k}"] or 0) / size / 1e9, 1e-9)) for k, (name, test) in enumerate(rules)]
    return sorted(out, key=lambda r: (-r[2] / r[3], r[3], r[0]))


def quality_cascade(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """One row per document: ``id``, the base counts, ``base_failed``, ``kept`` and the sorted-in rule that failed it first.

    A null text counts as empty and fails the base rules.  Repeated rows and
    null ids stay; extra columns are ignored; an empty table gives an empty
    result.
    """
    order = measured(docs, id_col, text_col, rules, sample)
    base = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
    chain = F.when(F.expr(base), F.lit("base"))
    for name, test, _, _ in order:
        chain = chain.when(F.expr(test), F.lit(name))
    out = features(docs, id_col, text_col).withColumn("base_failed", F.expr(base)).withColumn("failed", chain)
    return out.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.isnull("failed").alias("kept"), "failed")


def oracle(id_col: str, table: str) -> str:
    """The query's rows in DuckDB's SQL; which rule failed first depends on measured costs and is left out."""
    rules = {
        "symbols": "100 * n_symbols > 30 * n_words",
        "short_words": "word_chars < 3 * n_words",
        "long_words": "word_chars > 14 * n_words",
        "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
        "shouting": r"2 * length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) > word_chars",
        "exclamations": "2 * (length(t) - length(replace(t, '!', ''))) > n_words",
        "vocabulary": "100 * len(list_distinct(words)) < 5 * n_words",
        "alphabetic": r"100 * len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) < 50 * n_words",
        "bullets": rf"100 * len(list_filter(lines, lambda x: regexp_matches(x, '^{_BLANK}[-*•]'))) > 90 * n_lines",
        "ellipses": rf"100 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…){_BLANK}\z'))) > 30 * n_lines",
        "pairs": "100 * len(list_distinct(list_transform(range(1, greatest(len(words), 1)), lambda i: words[i] || ' ' || words[i + 1]))) < 10 * (n_words - 1)",
    }
    return rf"""
WITH a AS (
  SELECT {id_col}, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines
  FROM {table}
), g AS (
  SELECT {id_col}, i, array_to_string(words[i + 1:i + {WINDOW}], ' ') AS k
  FROM (SELECT {id_col}, words, unnest(range(0, len(words) - {WINDOW - 1})) AS i FROM a WHERE len(words) >= {WINDOW})
), twice AS (
  SELECT {id_col}, i FROM g QUALIFY count(*) OVER (PARTITION BY {id_col}, k) > 1
), step AS (
  SELECT {id_col}, least({WINDOW}, i - lag(i, 1, -{WINDOW}) OVER (PARTITION BY {id_col} ORDER BY i)) AS s FROM twice
), cov AS (
  SELECT {id_col}, sum(s) AS n FROM step GROUP BY 1
), f AS (
  SELECT a.{id_col}, t, words, lines, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[ \t\n\x0B\f\r]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM a LEFT JOIN cov ON cov.{id_col} = a.{id_col}
)
SELECT {id_col}, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR {" OR ".join(rules.values())}) AS kept
FROM f"""

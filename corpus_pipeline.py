"""A corpus pipeline of five stages, each taking what the one before it kept.

Language identification rejects texts of no language, the n-gram Jaccard join
keeps one document of each group of near copies, the suffix array cuts repeated
passages, the secret scan redacts live-looking credentials, and packing turns
the documents into sequences.  All but the last stage return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bitmap, language, secrets
from marlstone.llm.jaccard import ngram_jaccard_join
from marlstone.llm.packing import pack_documents
from marlstone.llm.passages import cut_passages, repeated_passages
from marlstone.llm.store import Scratch

#: Of the pipeline's session: texts may be long, so batches to Python have few bytes; shuffle files go once a table is written.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _set(spark: SparkSession) -> None:
    """The stages return frames that run later, so their settings stay for the pipeline's session."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)


def _documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of documents, with ``n_chars`` counted anew; a null text stays null, with its own count."""
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.coalesce(F.length(text).cast("long"), F.col("n_chars")).alias("n_chars"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: a text that is null, empty or without letters goes.

    Repeated rows stay as often as they come; extra columns go; an empty table
    gives an empty result.
    """
    _set(spark)
    model = language.train(docs)
    return language.identify(docs.select(*COLUMNS), model).where(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles, the one with the least id.

    Rows without an id are in no group and stay.  Rows with the same id stay or
    go together.
    """
    _set(spark)
    groups = ngram_jaccard_join(docs, k=5, percent=80)
    gone = groups.where("id <> component_id").select(F.col("id").alias("__id")).distinct()
    # Only documents that may go are shuffled.
    suspects, others = bitmap.split(docs, "doc_id", gone)
    return suspects.join(gone, F.col("doc_id") == F.col("__id"), "left_anti").unionByName(others).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words or more that one with a smaller id holds.

    A text that is null or shorter stays as it is, one that loses all its words
    is empty.  Rows with the same id lose the same words and do not count as
    each other's copies; an empty table gives an empty result.
    """
    _set(spark)
    return _documents(cut_passages(docs, repeated_passages(docs)))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with credentials that one owner alone holds, in few of its documents, redacted.

    Null and empty texts stay, equal rows are redacted alike, and an empty table
    gives an empty result.
    """
    _set(spark)
    return _documents(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens.

    A null or empty text is its end id alone, repeated rows are packed each for
    itself, equal fills go to the fullest window, and an empty table gives an
    empty result.
    """
    import public_tokenizers

    _set(spark)
    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return pieces.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: Components, suffix sorting and packing cannot be said in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}_{name}")
        scratch.drop(f"{k}_{name}")
    return docs

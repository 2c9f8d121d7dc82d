"""The training-data queries, each applying its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import importance, language, mixing, pieces, quality, secrets, toxicity, whitening
from marlstone.llm.jaccard import ngram_jaccard_join
from marlstone.llm.media import store_texts
from marlstone.llm.packing import pack_documents
from marlstone.llm.pagediff import extract_pages
from marlstone.llm.passages import repeated_passages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(language.held_out("doc_id", 4, 2), F.lit(False))
    model = language.train(docs.where(~held))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", F.map_keys("lang_shares").alias("lang_set"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets overlap by 85 % of their union."""
    out = ngram_jaccard_join(_table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 50 words or more that documents share, with the one document that keeps each."""
    return repeated_passages(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with the ownership verdicts."""
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in secrets.KINDS])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    of_kind = lambda k: lambda s: s["kind"] == k
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(of_kind(k)).alias(f"n_{secrets.KINDS[k]}") for k in range(3)],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: s["example"]).alias("n_example"),
    )


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """All documents as pieces of sequences of 2048 tokens."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path, with_ids=False, remember=True).withColumnRenamed("id", "doc_id")


def op9_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as lossless WebP images and read back."""
    out = store_texts(_table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learned from the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(language.held_out("doc_id", 5, 0), F.lit(False))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scorer = toxicity.train(docs, labels.where(~held))
    out = toxicity.score_documents(docs, scorer).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdicts of every document."""
    return quality.quality_cascade(_table(spark, sf_dir, "documents")).drop("failed").withColumnRenamed("id", "doc_id")


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Piece ids of every document, and whether decoding them gives the text back."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    table = pieces.piece_table(spark, model_path)
    encoded = pieces.decode(pieces.encode(_table(spark, sf_dir, "documents"), table), table)
    return encoded.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"), "ids",
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn to resemble the benchmark's texts."""
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mixture of its source's target size takes."""
    out = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened components of every embedding."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def unigram_viterbi(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """The benchmark's texts by the best path through their lattices, the model's scores read as those of a unigram model."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode(_table(spark, sf_dir, "benchmark"), pieces.piece_table(spark, model_path), "item_id", kind="unigram")
    return encoded.select(F.col("id").alias("item_id"), F.size("ids").cast("long").alias("n_pieces"), "ids")


QUERIES = {
    "op6_sentencepiece": op6_sentencepiece,
    "op5_quality_cascade": op5_quality_cascade,
    "op7_toxicity": op7_toxicity,
    "op9_lossless_webp": op9_lossless_webp,
    "op8_sum_of_squares_packing": op8_sum_of_squares_packing,
    "op1_language_id": op1_language_id,
    "op2_html_extraction": op2_html_extraction,
    "op4_secret_scan": op4_secret_scan,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_source_mixing": op12_source_mixing,
    "op13_embedding_whitening": op13_embedding_whitening,
    "unigram_viterbi": unigram_viterbi,
}

#: The others cannot be said in SQL; their tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_quality_cascade": quality.oracle("doc_id", "documents"),
    "op11_importance_resampling": importance.oracle("documents", "benchmark"),
    "op12_source_mixing": mixing.oracle("documents"),
}

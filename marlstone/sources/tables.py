"""Table sources: the fixture tables with explicit schemas, and files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}

#: Column names that older clients use, and what they mean; applied where a frame enters the engine.
ALIASES = {"id": "doc_id", "full_content": "text", "domain": "lang", "mailbox": "source", "filed_date": "o_orderdate", "case_id": "o_orderkey", "client_id": "user_id", "tool_name": "event_type", "duration_ms": "value", "created_at": "ts"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture table; no schema is inferred, so no file is opened before the query runs."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names or SCHEMAS:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def with_aliases(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """``df`` with every aliased name renamed to what it means, unless that column exists already."""
    aliases = ALIASES if aliases is None else aliases
    return df.withColumnsRenamed({a: c for a, c in aliases.items() if a in df.columns and c not in df.columns})


def files(spark: SparkSession, base: str, extensions: list[str], recursive: bool = True, largest: int | None = None) -> DataFrame:
    """Files under a folder as (path, modified, length, content), by extension and size, in path order.

    The glob prunes the listing; the size filter is pushed to the file source.
    """
    glob = "*{" + ",".join(f".{e.lstrip('.').lower()},.{e.lstrip('.').upper()}" for e in extensions) + "}"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(base)
    df = df if largest is None else df.where(F.col("length") <= largest)
    return df.select("path", F.col("modificationTime").alias("modified"), "length", "content").orderBy("path")


#: First bytes of file kinds, in the order they are tried.
MAGIC = (("pdf", "25504446"), ("png", "89504E470D0A1A0A"), ("jpg", "FFD8FF"), ("gif", "47494638"), ("zip", "504B0304"))


def magic(content: Column) -> Column:
    """The kind of a file by its first bytes: pdf, png, jpg, gif, zip, html, eml or unknown."""
    head = F.hex(F.substring(content, 1, 32))
    text = F.lower(F.trim(F.decode(F.substring(content, 1, 32), "ISO-8859-1")))
    out = F.when(content.isNull() | (F.length(content) == 0), "unknown")
    for kind, prefix in MAGIC:
        out = out.when(head.startswith(prefix), kind)
    out = out.when(text.startswith("<!doctype html") | text.startswith("<html"), "html")
    out = out.when(text.rlike(r"^(from|to|received|return-path|message-id|date|subject|mime-version|delivered-to|x-[a-z-]+): ?"), "eml")
    return out.otherwise("unknown")


def normalise_url(url: Column, base_host: Column | None = None) -> Column:
    """A URL without its fragment, query kept, host lowered; null for another host than ``base_host`` or no http(s) address."""
    scheme, rest = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    good = scheme.isin("http", "https") & (host != "")
    if base_host is not None:
        good = good & (host == F.lower(base_host))
    return F.when(good, F.concat(scheme, F.lit("://"), host, F.when(rest == "", "/").otherwise(rest)))


#: Extensions that a crawl does not follow.
SKIPPED = ("css", "js", "png", "jpg", "jpeg", "gif", "svg", "ico", "woff", "woff2", "ttf", "mp3", "mp4", "avi", "mov", "zip", "gz", "tar", "exe", "dmg")


def crawlable(url: Column) -> Column:
    ext = F.lower(F.regexp_extract(url, r"^[^?#]*/[^/?#]*\.([A-Za-z0-9]+)(?:[?#]|$)", 1))
    return url.rlike(r"^https?://") & ~ext.isin(*SKIPPED)

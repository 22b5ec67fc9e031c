"""The chunk index as tables: search, statistics, replacement, listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import text as T


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The last delivered row of each key; of equal ones the one whose content sorts first, so reruns agree."""
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), F.xxhash64(*[F.col(c) for c in df.columns if c not in keys]))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def keyword_matches(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks that hold every word of the query, in any case; an empty query matches all."""
    out = chunks
    for term in query.lower().split():
        out = out.where(F.contains(F.lower("text"), F.lit(term)))
    return out


def latest_matches(chunks: DataFrame, query: str, key: str, by: str) -> DataFrame:
    """The matches among the last delivered rows. Texts are filtered where they are read; only keys and times of all rows are shuffled."""
    newest = chunks.groupBy(F.col(key).alias("__k")).agg(F.max(by).alias("__t"))
    hits = keyword_matches(chunks, query)
    last = hits.join(newest, F.col(key).eqNullSafe(F.col("__k")) & F.col(by).eqNullSafe(F.col("__t"))).drop("__k", "__t")
    return latest(last, [key], by)


def keyword_search(chunks: DataFrame, query: str, k: int, order: list[str]) -> DataFrame:
    """The first k matches in index order; at least one."""
    return keyword_matches(chunks, query).orderBy(*order).limit(max(1, k))


def index_stats(chunks: DataFrame) -> DataFrame:
    doc = F.coalesce("document_id", F.lit("unknown"))
    has = F.bool_or(F.col("embedding").isNotNull()) if "embedding" in chunks.columns else F.lit(False)
    return chunks.agg(F.count("*").alias("total_chunks"), F.countDistinct(doc).alias("total_documents"), has.alias("has_embeddings"))


def index_documents(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.coalesce("document_id", F.lit("unknown")).alias("document_id")).distinct()


def list_documents(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """One row per indexed document, with its title; documents without an id are left out."""
    d = chunks.where(F.coalesce("document_id", F.lit("")) != "").groupBy("document_id").agg(F.min("source_file").alias("source_file"), F.count("*").alias("chunks"))
    p = papers.select(F.col("paper_id").alias("document_id"), "title", "authors", "year", "citation_key")
    return d.join(p, "document_id", "left")


def remove_document(index: DataFrame, document_id: str) -> DataFrame:
    """The index without a document. Rows without an id stay."""
    return index.where(~F.col("document_id").eqNullSafe(F.lit(document_id)))


def new_documents(incoming: DataFrame, index: DataFrame) -> DataFrame:
    """What is not indexed yet."""
    return incoming.join(index.select("document_id").distinct(), "document_id", "left_anti")


def replace_documents(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """The index with the incoming documents' rows in place of its own: re-ingesting never doubles."""
    return index.join(incoming.select("document_id").distinct(), "document_id", "left_anti").unionByName(incoming, allowMissingColumns=True)


def upsert(index: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Row by row; blank texts are not taken."""
    rows = incoming.where(T.strip(F.coalesce("text", F.lit(""))) != "")
    return index.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def vector_rows(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """Chunks with their paper's facts, nulls as empty strings."""
    p = papers.select(F.col("paper_id").alias("document_id"), "title", "authors", "year", "doi", "journal", "citation_key")
    j = chunks.join(p, "document_id", "left")
    blank = {c: F.coalesce(F.col(c), F.lit("")) for c in ("section_title", "title", "authors", "year", "doi", "journal", "citation_key")}
    return j.select("chunk_id", "document_id", "source_file", "page_start", "page_end", "chunk_index", "extraction_method", *[c.alias(k) for k, c in blank.items()])


def paper_info(papers: DataFrame, indexed: DataFrame) -> DataFrame:
    """A paper's record, overlaid with what the index says where that is not empty. indexed: document_id, title, authors, year."""
    r = indexed.select(F.col("document_id").alias("paper_id"), *[F.col(c).alias(f"__{c}") for c in ("title", "authors", "year")])
    j = papers.join(r, "paper_id", "left")
    return j.select("paper_id", *[F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), F.col(c)).alias(c) for c in ("title", "authors", "year")], "doi")


def paper_chunks(chunks: DataFrame, document_id: str, k: int) -> DataFrame:
    w = Window.partitionBy("document_id")
    own = chunks.where(F.col("document_id") == document_id).withColumn("total", F.count("*").over(w))
    return own.orderBy("chunk_index", "chunk_id").limit(clamp(k))


def clamp(k: int, most: int = 20) -> int:
    return max(1, min(k, most))

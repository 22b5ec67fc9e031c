"""The pN_ queries of this subpackage and their SQL. Each runs with production parameters over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import langid, leakage, names, neardup, pack, quality, scans, split, subjects, unify
from foliant.llm._bloom import among
from foliant.session import cut, spread, table

WINDOW = "train_window"


def texts_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of texts, over all cores however few files it has."""
    return spread(table(spark, d, name))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that the splitter cuts."""
    return split.split_large(table(spark, d, "chunks"), ["chunk_id"], "text").where("piece = 0").select("chunk_id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all chunks, without the text: one row per piece of each distinct text of a chunk."""
    chunks = table(spark, d, "chunks").select("chunk_id", "text").distinct()
    return split.split_oversized(chunks, ["chunk_id"], "text").select("chunk_id", "piece", "n_pieces", "start", "overlap_chars", "cut", F.char_length("piece_text").alias("piece_chars"))


def not_prose(chunks: DataFrame) -> DataFrame:
    return quality.quality_stats(chunks, ["chunk_id"], "text").where("kind in ('list', 'table', 'junk')").select("chunk_id", "kind").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return not_prose(texts_of(spark, d, "chunks").where("chunk_type = 'text'"))


def p4_stats(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every delivered text row."""
    return quality.quality_stats(texts_of(spark, d, "chunks"), ["chunk_id"], "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    odd = r"[^\x00-\x7F]"  # a text of ASCII only is its own consistent form
    both = [
        table(spark, d, t).where(F.col(c).rlike(odd)).select(F.lit(k).alias("rec_kind"), F.col(i).alias("rec_id"), F.col(c).alias("t"))
        for k, t, i, c in (("chunk", "chunks", "chunk_id", "text"), ("academic", "academic", "paper_id", "title"))
    ]
    rows = both[0].unionByName(both[1])
    return unify.unify_batches(rows, ["rec_kind", "rec_id"], "t").where("changed").select("rec_kind", "rec_id").distinct()


def p5_titles(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every title."""
    return unify.unify(table(spark, d, "academic"), ["paper_id"], "title").distinct()


def capacity_of(spark: SparkSession, d: str, kind: str) -> int:
    return table(spark, d, "containers").where(F.col("container_kind") == kind).first()["capacity_tokens"]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    packed = pack.pack(texts_of(spark, d, "documents"), "doc_id", "text", capacity_of(spark, d, WINDOW))
    return packed.where("n_parts > 1").select("doc_id").distinct()


def p8_bins(spark: SparkSession, d: str) -> DataFrame:
    """Every document's containers."""
    return pack.pack(texts_of(spark, d, "documents"), "doc_id", "text", capacity_of(spark, d, WINDOW))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaked(texts_of(spark, d, "documents"), ["doc_id"], "text", table(spark, d, "eval_items"), "item_id", "text")
    return found.select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item with the number of documents that hold it, and the most of its words found in one."""
    found = leakage.leaked(texts_of(spark, d, "documents"), ["doc_id"], "text", table(spark, d, "eval_items"), "item_id", "text")
    n = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("most_words"))
    return table(spark, d, "eval_items").select("item_id", "suite").join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_words", F.lit(0)).alias("most_words"))


def labelled_texts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks (type text) and abstracts with their labels, hosts and families of hosts."""
    family = F.regexp_extract("source_file", r"^([^_]+)_", 1)
    chunks = texts_of(spark, d, "chunks").where("chunk_type = 'text'").select(F.lit("chunk").alias("rec_kind"), F.col("chunk_id").alias("rec_id"), "text", "lang_label", F.col("document_id").alias("host"), family.alias("family"))
    papers = table(spark, d, "academic").where("abstract is not null").select(F.lit("academic").alias("rec_kind"), F.col("paper_id").alias("rec_id"), F.col("abstract").alias("text"), "lang_label", F.col("paper_id").alias("host"), family.alias("family"))
    return chunks.unionByName(papers)


def languages(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify(labelled_texts(spark, d), ["rec_kind", "rec_id"], "text", "lang_label", "host", "family")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    other = p4_found(spark, d).select(F.lit("chunk").alias("rec_kind"), F.col("chunk_id").alias("rec_id"))
    return langid.cases(languages(spark, d), ["rec_kind", "rec_id"]).join(other, ["rec_kind", "rec_id"], "left_anti")


def p6_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every record's languages with sentences and confidence."""
    return languages(spark, d)


def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every passage of every record with its language and confidence."""
    return langid.segments(labelled_texts(spark, d), ["rec_kind", "rec_id"], "text", "lang_label", "host", "family").distinct()


def subject_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = texts_of(spark, d, "documents")
    areas = table(spark, d, "subject_areas").where("subject is not null").groupBy("subject").agg(F.max("description").alias("description")).orderBy("subject").collect()
    described = [(r.description, [r.subject]) for r in areas if r.description] * subjects.DESCRIPTION
    models = subjects.train(subjects.labelled_rows(docs, "doc_id", "text", table(spark, d, "subject_labels"), "subject") + described, [r.subject for r in areas])
    return subjects.classify(docs, ["doc_id"], "text", models)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subject_rows(spark, d).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source and subject."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return subject_rows(spark, d).join(docs, "doc_id").groupBy("source", "subject").agg(F.countDistinct("doc_id").alias("n_docs"))


def name_links(spark: SparkSession, d: str) -> DataFrame:
    return names.link_papers(table(spark, d, "academic"), "paper_id", "authors", "year", "citation_key", table(spark, d, "author_registry"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return name_links(spark, d).where("not exact").select("paper_id", "author_pos", "author_id").distinct()


def p7_entries(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of each registry entry, exact and otherwise."""
    return name_links(spark, d).where("author_pos > 0").distinct().groupBy("author_id").agg(F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_variant"))


CHUNK_THRESHOLD, CHUNK_WIDTH = 0.5, 3  # as problem 3 is stated for this project


def near_chunks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(texts_of(spark, d, "chunks").where("chunk_type = 'text'"), "chunk_id", "text", CHUNK_THRESHOLD, CHUNK_WIDTH)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cut(neardup.near_pairs(*near_chunks(spark, d), "chunk_id").select("id_a", "id_b"))
    # only chunks in a pair are rated; those that the filter lets through besides are in none
    chunks = texts_of(spark, d, "chunks").where("chunk_type = 'text'").select("chunk_id", "text")
    other = not_prose(among(chunks, "chunk_id", pairs.select(F.explode(F.array("id_a", "id_b"))))).select("chunk_id").distinct()
    for side in ("id_a", "id_b"):
        pairs = pairs.join(other.withColumnRenamed("chunk_id", side), side, "left_anti")
    works = neardup.same_works(table(spark, d, "academic"), "paper_id", "doi", "title")
    return pairs.select(F.lit("chunk").alias("rec_kind"), "id_a", "id_b").unionByName(works.select(F.lit("academic").alias("rec_kind"), "id_a", "id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every text chunk's group and number of links to other texts."""
    return neardup.groups(*near_chunks(spark, d), "chunk_id")


def p3_documents(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate documents: five words, similarity 0.8."""
    return neardup.groups(*neardup.near_duplicates(texts_of(spark, d, "documents"), "doc_id", "text", 0.8, 5), "doc_id")


def scan_noise(spark: SparkSession, d: str, want_text: bool = False) -> DataFrame:
    """Findings over all pages and all chunks."""
    docs, chunks = texts_of(spark, d, "extractions"), texts_of(spark, d, "chunks")
    texts = docs.select(F.explode("raw_text_by_page").alias("t")).unionByName(chunks.select(F.col("text").alias("t")))
    reader = scans.reader_of(texts, "t")
    pages = scans.find_pages(docs.select(F.lit("extraction").alias("rec_kind"), F.col("document_id").alias("rec_id"), "raw_text_by_page"), ["rec_kind", "rec_id"], "raw_text_by_page", reader, want_text)
    marks = scans.page_furniture(docs, "document_id", "raw_text_by_page", reader.headings)
    rows = chunks.withColumns({"rec_kind": F.lit("chunk"), "rec_id": F.col("chunk_id")})
    parts = scans.find_chunks(rows, ["rec_kind", "rec_id"], "document_id", "text", "page_start", "page_end", marks, reader, want_text, F.col("chunk_type").isin("table", "equation"))
    return pages.unionByName(parts)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise(spark, d).select("rec_kind", "rec_id", "page_num", "noise", "token").distinct()


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The repaired text of every extraction and chunk."""
    return scan_noise(spark, d, True).where("noise = 'text'").select("rec_kind", "rec_id", F.col("token").alias("text")).distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p4_found, p4_stats, p5_found, p5_titles, p8_found, p8_bins, p9_found, p9_items, p6_found, p6_languages, p6_segments, p10_found, p10_composition, p7_found, p7_entries, p3_found, p3_groups, p3_documents, p1_found, p1_repaired)}

ORACLES = {
    "p2_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 3000",
}

"""The whole way from files to an index, as frames and as stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.config import Config
from foliant.functions import text as T
from foliant.operators import chunking, index, linking, pages, report, retrieval, structure
from foliant.sources.readers import Decoders, decode
from foliant.sources.writers import exists, replace_in_table, save_table

NO_TEXTS = "array<string>"
STORED = ("inspections", "extractions", "documents", "chunks", "tables", "figures", "equations", "academic", "metadata", "reports")


def _id(kind: str, *parts: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(kind), *[F.col(p).cast("string") for p in parts]), 256), 1, 32)


def elements(extracted: DataFrame, raw_tables: DataFrame | None, images: DataFrame | None, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables, figures and equations of the documents. raw_tables: as ``structure.build_tables``, and images: as ``structure.number_images``, from a decoder."""
    spark = extracted.sparkSession
    eq = structure.equations(pages.page_rows(extracted.select("document_id", "pages"))).select(_id("equation", "document_id", "page_num", "line_no").alias("equation_id"), F.col("document_id").alias("paper_id"), F.col("page_num").alias("page"), "label", "text", "surrounding_text")
    if not config.extract_equations:
        eq = eq.where("false")
    if raw_tables is not None and config.extract_tables:
        t = structure.build_tables(raw_tables).select(_id("table", "document_id", "page_num", "table_no").alias("table_id"), F.col("document_id").alias("paper_id"), F.col("page_num").alias("page"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("caption"), "headers", "rows", "markdown")
    else:
        t = spark.createDataFrame([], "table_id string, paper_id string, page int, label string, caption string, headers array<string>, rows array<array<string>>, markdown string")
    if images is not None:
        f = structure.number_images(images).select(_id("figure", "document_id", "page_num", "image_no").alias("figure_id"), F.col("document_id").alias("paper_id"), F.col("page_num").alias("page"), "label", F.lit(None).cast("string").alias("caption"), F.lit(None).cast("string").alias("surrounding_text"), "filename", "image_index", "width", "height")
    else:
        f = spark.createDataFrame([], "figure_id string, paper_id string, page int, label string, caption string, surrounding_text string, filename string, image_index int, width int, height int")
    return t, f, eq


def frames_of(extracted: DataFrame, config: Config = Config(), raw_tables: DataFrame | None = None, images: DataFrame | None = None, titles_of: DataFrame | None = None) -> dict[str, DataFrame]:
    """Frames of every stage behind ``readers.decode``. Write ``extracted`` and read it back before: all stages read it."""
    some = extracted.where("size(pages) > 0")
    valid = pages.validate(some.select("document_id", "pages", "success"))
    inspected = pages.inspect(some.select("document_id", "pages"))
    usable = some.join(valid.where("quality_status <> 'failed'").select("document_id"), "document_id", "left_semi")
    docs = pages.normalise(usable.select("document_id", "pages"))
    names = extracted.select("document_id", "source_file", F.col("method").alias("extraction_method"))
    text = chunking.chunk(docs, config.chunk_size, config.chunk_overlap, config.min_chunk_size, config.max_chunk_size)
    text = text.join(names, "document_id").join(valid.select("document_id", "quality_score"), "document_id").withColumns({"chunk_type": F.lit("text"), "source_id": F.lit(None).cast("string")})
    tables, figures, equations = elements(usable, raw_tables, images, config)
    special = chunking.special_chunks(tables, equations, figures, F.col("paper_id"), config.min_chunk_size).join(names.drop("extraction_method"), "document_id")
    special = special.withColumns({"chunk_index": F.lit(None).cast("int"), "char_count": F.length("text"), "token_estimate": T.token_estimate(F.col("text"))})
    columns = ["document_id", "source_file", "text", "page_start", "page_end", "chunk_index", "section_title", "extraction_method", "quality_score", "char_count", "token_estimate", "chunk_type", "source_id"]
    part = F.coalesce("source_id", F.col("chunk_index").cast("string"))
    chunks = text.select(columns).unionByName(special.select(columns)).withColumns({"processing_status": F.lit("chunked"), "chunk_id": T.chunk_id(F.col("document_id"), F.col("chunk_type"), part, F.col("text"))})
    chunks = chunks.select("*", *linking.links())
    if config.embeddings_enabled:
        chunks = retrieval.embed(chunks, batch=config.embeddings_batch_size)
    plain = chunks.select("document_id", "chunk_id", "text")
    back = lambda e, kind, key: e.join(linking.mentioned_in(e.withColumnRenamed("paper_id", "document_id"), plain, kind, key).select(key, "mentioned_in_chunks"), key, "left")
    papers = structure.academic(usable.select("document_id", "pages"), titles_of)
    papers = papers if config.extract_academic_metadata else papers.where("false")
    return {
        "extractions": extracted,
        "inspections": inspected,
        "validations": valid,
        "documents": docs,
        "chunks": chunks,
        "tables": back(tables, "table", "table_id"),
        "figures": back(figures, "figure", "figure_id"),
        "equations": back(equations, "equation", "equation_id"),
        "academic": papers,
        "metadata": report.metadata_rows(inspected, extracted, valid, papers.withColumnRenamed("document_id", "paper_id"), plain),
        "reports": report.build_report(extracted, valid, plain, inspected),
    }


def ingest(files: DataFrame, decoders: Decoders = Decoders(), config: Config = Config(), **more: DataFrame) -> dict[str, DataFrame]:
    """Frames of every stage. A file that can't be read has a report with its error."""
    return frames_of(decode(files, decoders), config, **more)


def to_chunks(files: DataFrame, decoders: Decoders = Decoders()) -> DataFrame:
    return ingest(files, decoders)["chunks"]


def ingest_to(files: DataFrame, base: str, decoders: Decoders = Decoders(), config: Config = Config(), again: bool = True, **more: DataFrame) -> DataFrame:
    """Files into the stored tables under ``base``; the reports of this run. Documents that come ``again`` are replaced, else they keep what they have.

    Files are decoded once: the pages are written first and every later stage reads them.
    """
    spark = files.sparkSession
    if not again and exists(spark, f"{base}/extractions"):
        files = index.new_documents(files, spark.read.parquet(f"{base}/extractions"))
    run = f"{base}/_run"
    save_table(decode(files, decoders), run, "overwrite")
    frames = frames_of(spark.read.parquet(run).drop("bucket"), config, **more)
    for name in STORED:
        key = "document_id" if "document_id" in frames[name].columns else "paper_id"
        replace_in_table(frames[name], f"{base}/{name}", key)
    done = spark.read.parquet(run).select("document_id").distinct()
    return spark.read.parquet(f"{base}/reports").join(done, "document_id", "left_semi").drop("bucket")

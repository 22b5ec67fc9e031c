"""Reports of processing runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.index import latest
from foliant.operators.pages import GOOD


def ordered_distinct(*arrays: Column) -> Column:
    """Arrays one after another, the first of equal entries kept."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(a, empty) for a in arrays]))


def final_status(errors: Column, warnings: Column, quality: Column) -> Column:
    return F.when(F.size(F.coalesce(errors, F.array().cast("array<string>"))) > 0, "failed").when((F.size(F.coalesce(warnings, F.array().cast("array<string>"))) > 0) | (F.coalesce(quality, F.lit("failed")) != "ok"), "completed_with_warnings").otherwise("completed")


def pages_with_issues(extractions: DataFrame) -> DataFrame:
    """Pages with warnings or without text, of each extraction."""
    bad = F.filter("pages", lambda p: (F.size(F.coalesce(p["warnings"], F.array().cast("array<string>"))) > 0) | ~F.coalesce(p["has_text"], F.lit(False)))
    return extractions.select("document_id", "pages").distinct().select("document_id", F.size(F.coalesce(bad, F.slice("pages", 1, 0))).alias("pages_with_issues"))


def build_report(extractions: DataFrame, validations: DataFrame, chunks: DataFrame, inspections: DataFrame | None = None) -> DataFrame:
    """One report per document. extractions: latest rows; validations: as ``pages.validate``; chunks: document_id; inspections: as ``pages.inspect``.

    Warnings and errors are those of inspection, extraction and validation, in this order, each once.
    """
    n = chunks.groupBy("document_id").agg(F.count("*").alias("chunks_created"))
    v = validations.select("document_id", "quality_status", "quality_score", F.col("warnings").alias("v_warnings"))
    j = extractions.join(v, "document_id", "left").join(n, "document_id", "left")
    if inspections is not None:
        j = j.join(inspections.select("document_id", F.col("warnings").alias("i_warnings")), "document_id", "left")
    quality = F.coalesce("quality_status", F.lit("failed"))
    made = F.coalesce("chunks_created", F.lit(0))
    stored = F.coalesce("success", F.lit(False))
    warnings = ordered_distinct(*([F.col("i_warnings")] if inspections is not None else []), F.col("warnings"), F.col("v_warnings"))
    errors = ordered_distinct(F.col("errors"))
    text = F.col("pages") if "raw_text_by_page" not in extractions.columns else F.col("raw_text_by_page")
    if dict(extractions.dtypes)["pages"] == "array<string>":
        issues = F.size(F.filter("pages", lambda p: F.length(T.strip(p)) < GOOD))
    else:
        issues = F.size(F.filter(F.coalesce("pages", F.slice("pages", 1, 0)), lambda p: (F.size(F.coalesce(p["warnings"], F.array().cast("array<string>"))) > 0) | ~F.coalesce(p["has_text"], F.lit(False))))
    return j.select(
        "document_id", "source_file", final_status(errors, warnings, quality).alias("status"), quality.alias("quality_status"), F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"), F.size(F.coalesce(text, F.array().cast("array<string>"))).alias("page_count"),
        F.coalesce(issues, F.lit(0)).alias("pages_with_issues"), made.alias("chunks_created"), stored.alias("stored_successfully"), (stored & (quality != "failed") & (made > 0)).alias("ready_for_rag"), warnings.alias("warnings"), errors.alias("errors"),
    )


def metadata_rows(inspections: DataFrame, extractions: DataFrame, validations: DataFrame, papers: DataFrame, chunks: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """The stored record of each document. layouts: as ``pages.layout_votes``; 'unknown' without."""
    n = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    path = F.col("source_path") if "source_path" in extractions.columns else F.col("source_file")
    e = extractions.select("document_id", "source_file", path.alias("source_path"), F.col("method").alias("extraction_method"), "ocr_used", "ocr_pages")
    v = validations.select("document_id", "quality_score", "quality_status")
    p = papers.select(F.col("paper_id").alias("document_id"), F.struct("title", "authors", "year", "doi").alias("academic"))
    i = inspections.select("document_id", "page_count", "has_embedded_text", "appears_scanned")
    j = e.join(i, "document_id", "left").join(v, "document_id", "left").join(p, "document_id", "left").join(n, "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    hint = F.lit("unknown")
    if layouts is not None:
        j, hint = j.join(layouts.select("document_id", F.col("layout_hint").alias("__hint")), "document_id", "left"), F.coalesce("__hint", F.lit("unknown"))
    return j.withColumn("layout_hint", hint).drop("__hint")


def batch_summary(reports: DataFrame) -> DataFrame:
    return reports.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "completed_with_warnings").alias("with_warnings"), F.count_if(F.col("status") == "failed").alias("failed"))


def save_report(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Reports with the newest of each document; a skipped document's keeps."""
    return latest(old.unionByName(new.where("status <> 'skipped'"), allowMissingColumns=True), ["document_id"], by)


def as_json(df: DataFrame) -> DataFrame:
    """Every row as one JSON text with its null fields."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def format_report(row: dict) -> str:
    """A report for people."""
    head = [f"{k}: {row[k]}" for k in ("document_id", "source_file", "status", "quality_status", "quality_score", "page_count", "chunks_created", "ready_for_rag") if k in row]
    return "\n".join([*head, *(f"warning: {w}" for w in row.get("warnings") or ()), *(f"error: {e}" for e in row.get("errors") or ())])

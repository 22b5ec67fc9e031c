"""Mentions of figures, tables and equations in chunks, and the links back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import detect as D
from foliant.functions.text import norm_label

PATTERNS = {"figure": D.FIG_MENTION, "table": D.TABLE_MENTION, "equation": D.EQ_MENTION}


def links() -> list[Column]:
    """``linked_figures, linked_tables, linked_equations`` of a column ``text``."""
    return [D.mentions(F.col("text"), p).alias(f"linked_{k}s") for k, p in PATTERNS.items()]


def link_chunks(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_id, linked_figures, linked_tables, linked_equations)."""
    return chunks.select("document_id", "chunk_id", *links())


def mention_rows(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_id, kind, label_norm), one per mention."""

    def of_kind(kind: str, pattern: str) -> Column:
        return F.transform(D.mentions(F.col("text"), pattern), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("label_norm")))

    found = F.concat(*[of_kind(k, p) for k, p in PATTERNS.items()])
    return chunks.select("document_id", "chunk_id", F.explode(found).alias("m")).select("document_id", "chunk_id", "m.kind", "m.label_norm").distinct()


def mentioned_in(elements: DataFrame, chunks: DataFrame, kind: str, key: str) -> DataFrame:
    """The chunks of an element's document that mention its label; none for an element without one. elements: document_id, key, label."""
    m = mention_rows(chunks).where(F.col("kind") == kind)
    e = elements.select("document_id", key, "label", norm_label(F.col("label")).alias("label_norm"))
    j = e.join(m, ["document_id", "label_norm"], "left")
    return j.groupBy("document_id", key, "label").agg(F.sort_array(F.collect_set("chunk_id")).alias("mentioned_in_chunks"))

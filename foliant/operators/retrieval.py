"""Vectors, hits, sources, context and answers."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from foliant.functions import text as T
from foliant.operators.index import clamp

DIM = 256


class Embedder(Protocol):
    def __call__(self, texts: Sequence[str]) -> np.ndarray: ...


class Generator(Protocol):
    def __call__(self, question: str, context: str) -> str: ...


@functools.lru_cache(maxsize=200_000)
def _place(word: str) -> int:
    import hashlib

    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)


def hashed_words(texts: Sequence[str], dim: int = DIM) -> np.ndarray:
    """The default embedding: hashed words, signed, of unit length. The same everywhere and needs no model."""
    out = np.zeros((len(texts), dim), dtype=np.float64)
    for i, t in enumerate(texts):
        h = np.fromiter(map(_place, (t or "").lower().split()), dtype=np.int64)
        np.add.at(out[i], h % dim, np.where(h & 0x80000000, 1.0, -1.0))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm == 0, 1, norm)).astype(np.float32)


def embed(df: DataFrame, text: str = "text", embedder: Callable[[Sequence[str]], np.ndarray] = hashed_words, batch: int = 32) -> DataFrame:
    """``df`` with ``embedding``; the embedder gets ``batch`` texts at a time. A batch that it fails on has null vectors."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts, out = s.fillna("").tolist(), []
            for k in range(0, len(texts), batch):
                try:
                    out += list(embedder(texts[k : k + batch]))
                except Exception:  # noqa: BLE001
                    out += [None] * len(texts[k : k + batch])
            yield pd.Series(out, dtype=object)

    return df.withColumn("embedding", run(F.col(text)))


def total(parts: list[Column]) -> Column:
    """A balanced sum, so long ones don't nest deeply."""
    while len(parts) > 1:
        parts = [sum(parts[k + 1 : k + 2], parts[k]) for k in range(0, len(parts), 2)]
    return parts[0] if parts else F.lit(0.0)


def cosine_distance(v: Column, query: Sequence[float]) -> Column:
    """From a column of vectors to one vector; only places where that isn't 0 are multiplied. Null for other lengths and vectors of length 0."""
    dot = total([F.get(v, F.lit(i)).cast("double") * float(x) for i, x in enumerate(query) if x])
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(F.size(v) == len(query), F.lit(1.0) - F.try_divide(dot, size * float(np.linalg.norm(np.asarray(query, dtype=np.float64)))))


def vector_topk(vectors: DataFrame, query: Sequence[float], k: int, key: str, vector: str = "embedding") -> DataFrame:
    """The k nearest by cosine distance, exact. Each task keeps its own k; only those are merged."""
    d = F.round(cosine_distance(F.col(vector), query), 4)
    return vectors.withColumn("distance", d).where("distance is not null").orderBy("distance", key).limit(max(1, k))


QUERY_BLOCK = 4096


def vector_neighbours(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str = "embedding") -> DataFrame:
    """For each query row its k nearest of all rows, exact: ``query, neighbour, distance, rank``; ties by id.

    The queries are a stated set; they go out in blocks of ``QUERY_BLOCK``, and each block is one scan. A task multiplies
    its batches with the block and keeps k rows a query, so what is merged is k rows a query and task. Rows without a
    vector, or of length 0, are nobody's neighbours.
    """
    kind = dict(vectors.dtypes)[key]
    qs = queries.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("q"), F.col(vector).alias("v"))
    out = None
    block: list = []
    parts: list[DataFrame] = []

    def search(rows: list) -> DataFrame:
        ids = [r.q for r in rows]
        m = np.array([r.v for r in rows], dtype=np.float64)
        norm = np.linalg.norm(m, axis=1)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best_d = np.full((len(ids), 0), 0.0)
            best_i = np.zeros((len(ids), 0), dtype=object if kind == "string" else np.int64)
            for b in batches:
                b = b[b["v"].map(lambda v: v is not None and len(v) == m.shape[1])]
                if not len(b):
                    continue
                x = np.stack(b["v"].to_numpy()).astype(np.float64)
                size = np.linalg.norm(x, axis=1)
                x, names = x[size > 0] / size[size > 0][:, None], b["i"].to_numpy()[size > 0]
                d = np.round(1 - (m @ x.T) / np.where(norm == 0, np.nan, norm)[:, None], 4)
                best_d = np.concatenate([best_d, d], axis=1)
                best_i = np.concatenate([best_i, np.broadcast_to(names, d.shape)], axis=1)
                if best_d.shape[1] > k:
                    # ids in order give ties their rank; a vector without length has no distance and comes last
                    rank = np.unique(best_i.ravel(), return_inverse=True)[1].reshape(best_i.shape)
                    order = np.lexsort((rank, np.where(np.isnan(best_d), np.inf, best_d)), axis=1)[:, :k]
                    best_d, best_i = np.take_along_axis(best_d, order, 1), np.take_along_axis(best_i, order, 1)
            rows_out = [(ids[r], best_i[r, j], float(best_d[r, j])) for r in range(len(ids)) for j in range(best_d.shape[1]) if not np.isnan(best_d[r, j])]
            yield pd.DataFrame(rows_out, columns=["query", "neighbour", "distance"])

        return vectors.where(F.col(key).isNotNull()).select(F.col(key).alias("i"), F.col(vector).alias("v")).mapInPandas(run, f"query {kind}, neighbour {kind}, distance double")

    for row in qs.toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            parts.append(search(block))
            block = []
    if block or not parts:
        parts.append(search(block) if block else vectors.where("false").select(F.col(key).alias("query"), F.col(key).alias("neighbour"), F.lit(0.0).alias("distance")))
    for p in parts:
        out = p if out is None else out.unionByName(p)
    w = Window.partitionBy("query").orderBy("distance", "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hits_to_sources(hits: DataFrame) -> DataFrame:
    """Ranked citations of hits ``chunk_id, document_id, text, distance`` and what facts they have."""
    w = Window.orderBy("distance", "chunk_id")  # k rows
    has = lambda c: F.coalesce(F.col(c), F.lit("")) if c in hits.columns else F.lit("")
    return hits.select(
        F.row_number().over(w).alias("rank"), "chunk_id", F.col("document_id").alias("paper_id"), has("citation_key").alias("citation_key"), has("title").alias("title"), has("authors").alias("authors"), has("year").alias("year"),
        F.col("page_start").alias("page") if "page_start" in hits.columns else F.lit(None).cast("int").alias("page"), F.nullif(has("section_title"), F.lit("")).alias("section"), "distance", T.preview(F.col("text")).alias("text_preview"),
    )


def context_blocks(hits: DataFrame) -> DataFrame:
    """One text block per hit, ranked by distance."""
    w = Window.orderBy("distance", "chunk_id")
    full = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c))) if c in hits.columns else F.lit(None).cast("string")
    ranked = hits.withColumn("rank", F.row_number().over(w))
    p, q = F.col("page_start"), F.col("page_end")
    pages = F.when(p.isNull(), None).when((F.coalesce(q, F.lit(0)) != 0) & (q != p), F.concat(F.lit("Páginas: "), p.cast("string"), F.lit("-"), q.cast("string"))).otherwise(F.concat(F.lit("Página: "), p.cast("string")))
    block = F.concat_ws("\n", F.concat(F.lit("[Fragmento "), F.col("rank").cast("string"), F.lit("]")), F.coalesce(full("Clave", "citation_key"), full("Documento", "document_id")), full("Título", "title"), full("Autores", "authors"), full("Año", "year"), pages, full("Sección", "section_title"), F.concat(F.lit("Texto:\n"), T.strip(F.col("text"))))
    return ranked.select("rank", block.alias("block"))


def build_context(hits: DataFrame) -> DataFrame:
    """All blocks in one text; no hits give one empty text."""
    b = context_blocks(hits).agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return b.select(F.array_join(F.transform("b", lambda x: x["block"]), "\n\n---\n\n").alias("context"))


class EmptyIndex(RuntimeError):
    """Nothing is indexed."""


class Retriever:
    """Search and answers over an indexed table of chunks with ``embedding``."""

    def __init__(self, index: DataFrame, embedder: Callable[[Sequence[str]], np.ndarray] = hashed_words, generator: Generator | None = None):
        self.index, self.embedder, self.generator = index, embedder, generator

    def nearest(self, question: str, k: int = 5, where: Column | str | None = None) -> DataFrame:
        """The same as a plan only: nothing runs, and an empty index gives no rows."""
        some = self.index if where is None else self.index.where(where)
        return vector_topk(some, self.embedder([question])[0].tolist(), clamp(k), "chunk_id")

    def search(self, question: str, k: int = 5, where: Column | str | None = None) -> DataFrame:
        """The k nearest chunks, of those that ``where`` lets through; it reaches the scan. An empty index is an error."""
        if not self.index.select("chunk_id").take(1):
            raise EmptyIndex("the index is empty")
        return self.nearest(question, k, where)

    def sources(self, question: str, k: int = 5, where: Column | str | None = None) -> DataFrame:
        return hits_to_sources(self.search(question, k, where))

    def answer(self, question: str, k: int = 5, where: Column | str | None = None) -> dict:
        """Answer, sources and a warning; the sources come even if no answer does."""
        got: dict = {"answer": None, "sources": [], "warning": None}
        try:
            hits = self.search(question, k, where)
        except EmptyIndex as e:
            return got | {"warning": str(e)}
        hits = hits.sparkSession.createDataFrame(hits.collect(), hits.schema)  # k rows, searched once
        got["sources"] = [r.asDict() for r in hits_to_sources(hits).collect()]
        if self.generator is None:
            return got | {"warning": "no generator is configured"}
        try:
            got["answer"] = self.generator(question, build_context(hits).first()["context"])
        except RuntimeError as e:
            got["warning"] = str(e)
        return got

    def status(self) -> dict:
        row = self.index.agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents")).first()
        return {"available": True, "chunks": row["chunks"], "documents": row["documents"], "generator": self.generator is not None, "warnings": [] if row["chunks"] else ["the index is empty"]}

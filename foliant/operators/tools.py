"""The nine tools of the knowledge base as texts for people and for language models, over the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from foliant.operators import index, retrieval


class Tools:
    """chunks: with ``embedding`` for the searches; papers: paper_id, title, authors, year, doi, journal, citation_key."""

    def __init__(self, chunks: DataFrame, papers: DataFrame, embedder: Callable = retrieval.hashed_words, generator: retrieval.Generator | None = None):
        self.chunks, self.papers = chunks, papers
        self.facts = papers.withColumnRenamed("paper_id", "document_id").drop("abstract", "keywords", "volume", "pages")
        self.retriever = retrieval.Retriever(chunks.join(self.facts, "document_id", "left"), embedder, generator)

    def _hits(self, question: str, k: int) -> list[dict] | str:
        try:
            return [r.asDict() for r in self.retriever.sources(question, k).collect()]
        except retrieval.EmptyIndex as e:
            return str(e)

    def search_papers(self, query: str, k: int = 5) -> str:
        """Passages that answer a query, with their citations."""
        hits = self._hits(query, k)
        if isinstance(hits, str) or not hits:
            return hits or "nothing found"
        return "\n\n".join(f"[{h['rank']}] {h['citation_key'] or h['paper_id']}: {h['title']} (page {h['page']}, distance {h['distance']:.4f})\n    {h['text_preview']}" for h in hits)

    def get_paper_info(self, document_id: str) -> str:
        row = self.papers.where(self.papers["paper_id"] == document_id).first()
        if row is None:
            return f"no record of {document_id}"
        facts = row.asDict()
        return "\n".join(f"{k}: {facts[k]}" for k in ("title", "authors", "year", "journal", "doi", "citation_key", "abstract") if facts.get(k))

    def list_papers(self) -> str:
        rows = index.list_documents(self.chunks, self.papers).orderBy("document_id").toLocalIterator()
        return "\n".join(f"{r['document_id']}  {r['title'] or r['source_file']}  ({r['chunks']} chunks)" for r in rows) or "the index is empty"

    def get_paper_chunks(self, document_id: str, k: int = 20) -> str:
        rows = index.paper_chunks(self.chunks, document_id, k).collect()
        head = f"{len(rows)} of {rows[0]['total']} chunks" if rows else f"no chunks of {document_id}"
        return "\n\n".join([head, *(f"[{r['chunk_index']}] {r['text']}" for r in rows)])

    def knowledge_base_stats(self) -> str:
        row = index.index_stats(self.chunks).first()
        return f"chunks: {row['total_chunks']}\ndocuments: {row['total_documents']}\nvectors: {'yes' if row['has_embeddings'] else 'no'}"

    def rag_search(self, question: str, k: int = 5) -> str:
        """The context that an answer would be built on."""
        try:
            return retrieval.build_context(self.retriever.search(question, k)).first()["context"]
        except retrieval.EmptyIndex as e:
            return str(e)

    def rag_answer(self, question: str, k: int = 5) -> str:
        got = self.retriever.answer(question, k)
        cited = [f"[{s['rank']}] {s['citation_key'] or s['paper_id']}, page {s['page']}" for s in got["sources"]]
        return "\n".join([got["answer"] or f"no answer: {got['warning']}", *cited])

    def rag_sources(self, question: str, k: int = 5) -> str:
        hits = self._hits(question, k)
        return hits if isinstance(hits, str) else "\n".join(f"[{h['rank']}] {h['citation_key'] or h['paper_id']} | {h['authors']} | {h['year']} | page {h['page']} | {h['section'] or '-'}" for h in hits) or "nothing found"

    def rag_status(self) -> str:
        return "\n".join(f"{k}: {v}" for k, v in self.retriever.status().items())


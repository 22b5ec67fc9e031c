"""Cutting documents into chunks: sections, greedy packing of paragraphs, overlap, page ranges.

Everything that happens to one document happens in one pass over its text: no join, no exchange. The functions on
strings are the model; the frames below run them over Arrow batches. White space and line ends are Unicode's.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.arrow import map_texts

SIZE, OVERLAP, LEAST, MOST, SECTIONS = 1000, 150, 100, 3000, 3
PROBE, STEP, REACH = 120, 50, 400
PARTED = re.compile(r"\n{2,}|" + re.escape(T.PAGE_MARK))
HEADING = [re.compile(p.replace("(?iu)", "(?i)")) for p in T.HEADINGS]


def fill(weights: list[int], size: int) -> Iterator[slice]:
    """Runs of consecutive units, each as long as its weights add up to ``size`` at most; a heavier unit is a run of its own."""
    ends = [0, *accumulate(weights)]
    at = 0
    while at < len(weights):
        to = max(at + 1, bisect_right(ends, ends[at] + size) - 1)
        yield slice(at, to)
        at = to


def split_words(text: str, size: int) -> list[str]:
    """Words filled up to the size, each counting one more than its length; a longer word stays whole."""
    words = text.split()
    return [" ".join(words[s]) for s in fill([len(w) + 1 for w in words], size)]


def pack_paragraphs(text: str, size: int = SIZE, most: int = MOST) -> list[str]:
    """Paragraphs packed greedily; one above ``most`` is split by words on its own. Joints between paragraphs don't count."""
    out: list[str] = []
    held: list[str] = []
    for p in [*filter(None, (x.strip() for x in PARTED.split(text))), None]:
        if p is not None and len(p) <= most:
            held.append(p)
            continue
        out += ["\n\n".join(held[s]) for s in fill([len(x) for x in held], size)]
        held = []
        if p is not None:
            out += split_words(p, size)
    return out or [text]


def is_heading(line: str) -> bool:
    s = line.strip()
    return 3 <= len(s) <= 150 and any(p.search(s) for p in HEADING)


def cut_sections(text: str) -> list[tuple[int, str | None, str]]:
    """(section_no, heading, text): a heading opens a section and stands in it; sections without text are left out."""
    parts: list[tuple[str | None, list[str]]] = [(None, [])]
    for line in text.splitlines():
        if is_heading(line):
            parts.append((line.strip()[:200], []))
        parts[-1][1].append(line)
    return [(k, heading, body) for k, (heading, lines) in enumerate(parts) if (body := "\n".join(lines).strip())]


def tail_words(text: str, n: int) -> str:
    """The last n characters, begun after the first blank among them if there is one beyond the first place."""
    last = text[-n:]
    return last[last.find(" ") + 1 :] if len(text) > n and last.find(" ") > 0 else last


def overlapped(pieces: list[str], overlap: int) -> list[str]:
    """Each piece begins with the tail of the one before, as that was before it got its own."""
    return pieces if overlap <= 0 else [*pieces[:1], *(f"{tail_words(a, overlap)}\n{b}" for a, b in zip(pieces, pieces[1:]))]


class PageFinder:
    """Where a text stands in a document: the first of eight probes that is found places it; pages (1, 1) if none is."""

    def __init__(self, text: str):
        self.full = " ".join(text.split())
        self.starts = [0, *(m.end() for m in re.finditer(re.escape(T.PAGE_MARK), self.full))]

    def pages(self, piece: str) -> tuple[int, int]:
        for s in range(0, min(REACH, len(piece)), STEP):
            probe = " ".join(piece[s : s + PROBE].split())
            if probe and (at := self.full.find(probe)) >= 0:
                return bisect_right(self.starts, at), bisect_right(self.starts, at + len(" ".join(piece.split())))
        return 1, 1


def chunk_text(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, most: int = MOST) -> list[tuple]:
    """(chunk_index, section_title, text, char_count, token_estimate, page_start, page_end) of one document.

    Three sections or more are cut by section, else by paragraph; short chunks are dropped and the rest numbered from 0.
    """
    sections = cut_sections(text)
    pieces: list[tuple[str | None, str]] = []
    for _, heading, body in sections if len(sections) >= SECTIONS else [(0, None, text)]:
        cut = [body] if len(sections) >= SECTIONS and len(body) <= most else pack_paragraphs(body, size, most)
        pieces += [(None if k else heading, x) for k, x in enumerate(cut)]
    finder = PageFinder(text)
    kept = [(title, s) for (title, _), x in zip(pieces, overlapped([x for _, x in pieces], overlap)) if len(s := x.strip()) >= least]
    return [(k, title, s, len(s), max(1, len(s) // 4), *finder.pages(s)) for k, (title, s) in enumerate(kept)]


CHUNK = "chunk_index int, section_title string, text string, char_count int, token_estimate int, page_start int, page_end int"


def chunk(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Documents ``document_id, text`` to chunks with their page ranges."""
    return map_texts(docs, ["document_id"], "text", lambda t: chunk_text(t, size, overlap, least, most), CHUNK)


def sections(docs: DataFrame) -> DataFrame:
    """(document_id, section_no, heading, text)."""
    return map_texts(docs, ["document_id"], "text", cut_sections, "section_no int, heading string, text string")


def paragraph_pieces(docs: DataFrame, size: int = SIZE, most: int = MOST) -> DataFrame:
    """(document_id, pos, text) of the packed paragraphs."""
    return map_texts(docs, ["document_id"], "text", lambda t: enumerate(pack_paragraphs(t, size, most)), "pos int, text string")


def word_pieces(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(document_id, pos, text) of the packed words."""
    return map_texts(docs, ["document_id"], "text", lambda t: enumerate(split_words(t, size)), "pos int, text string")


def overlapped_pieces(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(document_id, chunk_index, text, char_count, token_estimate): packed paragraphs with overlap, short ones dropped."""

    def rows(t: str) -> list[tuple]:
        kept = [s for x in overlapped(pack_paragraphs(t, size, most), overlap) if len(s := x.strip()) >= least]
        return [(k, s, len(s), max(1, len(s) // 4)) for k, s in enumerate(kept)]

    return map_texts(docs, ["document_id"], "text", rows, "chunk_index int, text string, char_count int, token_estimate int")


def special_chunks(tables: DataFrame, equations: DataFrame, figures: DataFrame | None, source: Column, least: int = LEAST) -> DataFrame:
    """Chunks of tables, figures and equations: (document_id, chunk_type, source_id, page, section_title, quality_score, text)."""

    def row(df: DataFrame, kind: str, key: str, text: Column, score: float, method: str) -> DataFrame:
        return df.select(F.col("paper_id").alias("document_id"), F.lit(kind).alias("chunk_type"), F.col(key).alias("source_id"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), F.col("label").alias("section_title"), F.lit(score).alias("quality_score"), F.lit(method).alias("extraction_method"), T.strip(text).alias("text"))

    parts = [row(tables, "table", "table_id", T.table_chunk(F.col("label"), source, F.col("page"), F.col("caption"), F.col("markdown")), 1.0, "table_extractor")]
    if figures is not None:
        parts.append(row(figures, "figure", "figure_id", T.figure_chunk(F.col("label"), source, F.col("page"), F.col("caption"), F.col("surrounding_text")), 1.0, "image_extractor"))
    parts.append(row(equations, "equation", "equation_id", T.equation_chunk(F.col("label"), source, F.col("page"), F.col("text"), F.col("surrounding_text")), 0.9, "equation_extractor"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.length("text") >= least)

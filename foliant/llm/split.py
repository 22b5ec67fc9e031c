"""Problem 2: cutting oversized texts at natural boundaries, with an overlap between consecutive pieces.

Method: pointer doubling. Every boundary of the text (paragraph, line, sentence, word end; within longer runs without
any, code points that do not part a base letter from its marks) is joined to its farthest legal successor: the piece
that starts at the boundary's overlap start and ends at the successor is within the limit, and the successor is of the
strongest kind that fills at least half of the limit. Squaring the successor table (``jump[jump]``) while the set of
cuts reached from the start doubles gives all greedy cuts in about log2(pieces) steps, for all texts of an Arrow batch
at once.

Lengths are in code points, counted on the text as stored; ``char_count`` columns are not read.

Guarantees: no piece is longer than ``max_chars``; consecutive pieces share the last ``overlap`` characters of the
former, cut back to a word start (``overlap_chars`` of the piece; at least half of it where the text has a boundary
there); leaving the overlaps out, the pieces concatenate to the text exactly.

Null text gives one piece with null text; empty text one empty piece; a text within the limit one piece, made in the
JVM. Repeated rows give repeated pieces. Output: the id columns, ``piece int, n_pieces int, start bigint, overlap_chars
int, cut string, piece_text string``; other input columns are left out. ``cut`` is the kind of boundary at the end.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._arrow import id_schema, map_batches

MAX_CHARS, OVERLAP, STRIDE = 3000, 150, 32
KINDS = ("paragraph", "line", "sentence", "word", "inside")
PATTERNS = tuple(
    re.compile(x)
    for x in (
        r"\n[ \t\r]*\n\s*|\f\s*",
        r"\r\n?|\n",
        r"[.!?…。！？][\"'»”’)\]]*\s+(?=[^a-zà-öø-ÿ])|[。！？]",
        r"\s+",
    )
)


def boundaries(text: str, gap: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which the text may be cut, in order, and the kind of each (index into ``KINDS``); never more than ``most`` apart."""
    n = len(text)
    best: dict[int, int] = {}
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            best.setdefault(m.end(), kind)
    best.pop(0, None)
    best[n] = 0
    at = sorted(best)
    last = 0
    for p in at.copy() if at else []:
        if p - last > gap:
            for q in range(last + STRIDE, p, STRIDE):
                while q < p and (unicodedata.combining(text[q]) or text[q] in "‌‍︎️" or text[q - 1] == "‍"):
                    q += 1
                if q < p:
                    best.setdefault(q, 4)
        last = p
    if most:  # a run of marks longer than a piece has to be cut within
        last = 0
        for p in sorted(best):
            for q in range(last + most, p, most):
                best.setdefault(q, 4)
            last = p
    pos = np.array(sorted(best), dtype=np.int64)
    return pos, np.array([best[p] for p in pos.tolist()], dtype=np.int8)


def successors(pos: np.ndarray, kind: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For node 0 (the start of the text) and each boundary: the node of its farthest legal successor, and where its piece starts."""
    ends = np.concatenate([[0], pos])
    kinds = np.concatenate([[0], kind])
    starts = np.zeros(len(ends), dtype=np.int64)
    if overlap:
        # the overlap starts at the first boundary within the last `overlap` characters, or exactly there if there is none
        want = ends - overlap
        k = np.minimum(np.searchsorted(ends, want, "left"), len(ends) - 1)
        starts = np.where(ends[k] < ends - overlap // 2, ends[k], want)
        starts = np.clip(starts, 0, None)
        starts[0] = 0
    else:
        starts = ends.copy()
    reach = starts + limit
    nxt = np.full(len(ends), -1, dtype=np.int64)
    for k in range(len(KINDS)):
        mine = np.flatnonzero(kinds == k)
        mine = mine[mine > 0]
        if not len(mine):
            continue
        j = np.searchsorted(ends[mine], reach, "right") - 1
        cand = np.where(j >= 0, mine[np.maximum(j, 0)], -1)
        ok = (nxt < 0) & (cand > np.arange(len(ends))) & (ends[np.maximum(cand, 0)] - ends >= limit // 2)
        nxt = np.where(ok, cand, nxt)
    whole = ends[-1] <= reach
    nxt[whole] = len(ends) - 1
    far = np.searchsorted(ends, reach, "right") - 1  # whatever is farthest, if nothing fills half of the limit
    nxt = np.where(nxt < 0, far, nxt)
    nxt[-1] = len(ends) - 1
    return nxt, starts


def cuts_by_doubling(jump: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Whether each node is reached from a root: the reached set doubles with every squaring of the table."""
    reached = np.zeros(len(jump), dtype=bool)
    reached[roots] = True
    while True:
        before = int(reached.sum())
        reached[jump[np.flatnonzero(reached)]] = True
        if int(reached.sum()) == before:
            return reached
        jump = jump[jump]


def split_texts(texts: list[str], limit: int, overlap: int) -> list[list[tuple[int, int, int, str]]]:
    """Per text its pieces: (start, end, overlap characters, kind of cut)."""
    tables, offset = [], 0
    jumps = []
    for t in texts:
        pos, kind = boundaries(t, max(STRIDE, (limit - overlap) // 4), limit - overlap)
        nxt, starts = successors(pos, kind, limit, overlap)
        tables.append((offset, np.concatenate([[0], pos]), np.concatenate([[0], kind]), starts))
        jumps.append(nxt + offset)
        offset += len(nxt)
    if not jumps:
        return []
    roots = np.array([x[0] for x in tables], dtype=np.int64)
    reached = cuts_by_doubling(np.concatenate(jumps), roots)
    out = []
    for base, ends, kinds, starts in tables:
        hit = np.flatnonzero(reached[base : base + len(ends)])
        if hit[-1] != len(ends) - 1:
            raise AssertionError("a text's end was not reached")
        out.append([(int(starts[a]), int(ends[b]), int(ends[a] - starts[a]), "end" if b == len(ends) - 1 else KINDS[kinds[b]]) for a, b in zip(hit[:-1], hit[1:])])
    return out


def split_oversized(df: DataFrame, ids: list[str], text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of every row. Only texts over the limit go to Python."""
    if not 0 <= overlap <= max_chars // 4 or max_chars < 2 * STRIDE:
        raise ValueError("the overlap may be a quarter of the limit at most, the limit 64 at least")
    t = F.col(text)
    small = df.where(t.isNull() | (F.char_length(t) <= max_chars)).select(
        *ids, F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), F.lit(0).cast("bigint").alias("start"), F.lit(0).alias("overlap_chars"), F.lit("end").alias("cut"), t.alias("piece_text")
    )
    return small.unionByName(split_large(df, ids, text, max_chars, overlap))


def split_large(df: DataFrame, ids: list[str], text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of the texts over the limit only."""
    n = len(ids)

    def make():
        def work(b: pa.RecordBatch) -> dict:
            texts = b.column(n).to_pylist()
            row, piece, many, start, over, cut, cuts = [], [], [], [], [], [], []
            for i, pieces in enumerate(split_texts(texts, max_chars, overlap)):
                for k, (s, e, o, kind) in enumerate(pieces):
                    for xs, x in zip((row, piece, many, start, over, cut, cuts), (i, k, len(pieces), s, o, kind, texts[i][s:e])):
                        xs.append(x)
            take = pa.array(row, pa.int64())
            got = {c: b.column(k).take(take) for k, c in enumerate(ids)}
            return got | {"piece": pa.array(piece, pa.int32()), "n_pieces": pa.array(many, pa.int32()), "start": pa.array(start, pa.int64()), "overlap_chars": pa.array(over, pa.int32()), "cut": pa.array(cut, pa.string()), "piece_text": pa.array(cuts, pa.string())}

        return work

    schema = f"{id_schema(df, ids)}, piece int, n_pieces int, start bigint, overlap_chars int, cut string, piece_text string"
    large = df.where(F.char_length(F.col(text)) > max_chars).select(*ids, F.col(text).alias("__t"))
    return map_batches(large, make, schema)

"""Problem 9: passages of held-out items in a corpus.

Method: winnowing. Texts become words (case, punctuation, numbering and look-alike characters ignored). Over the
hashes of all runs of ``K`` words, the smallest of every ``W`` consecutive ones is kept, for items and documents
alike. The fingerprints ``(hash, document, position)`` and ``(hash, item, position)`` are joined, and every hit is extended
along its diagonal. Any shared span of ``K + W - 1`` words has a fingerprint in common. Twenty words in two places with
two exchanged words always hold an unaltered run of five, so with K = 4 and W = 2 no case is missed.

A document is reported with an item if the matching places, at most two and in the item's order, hold ``MIN_WORDS`` of
its words with at most ``1 - DENSITY`` of the words of a place exchanged. A place has ``MIN_PLACE`` words at least, as shorter
ones are phrases that any text may hold; all places of a diagonal count.

Scale: one scan gives the documents' fingerprints, whatever the number of items. A Bloom filter of the items'
fingerprints, ``BLOOM`` bits however many there are, leaves out nearly all others before the join; a filter that fills up
costs shuffled rows, never a hit. The join's item side is small or met by key; a fingerprint with very many documents
is split by adaptive execution. A fingerprint carries a byte of each of the ``AROUND`` words before and behind it: a place of
``MIN_PLACE`` words or more always has a hit with so many equal words around, and other hits are left out there and then. The
words of the item that stand equal around any hit of a document are all that can be found there, so pairs with less than
``MIN_WORDS`` of them are left out too. Only documents of the remaining pairs are read again, and only their own hits and
items meet them.

Null or empty texts have no words and give no rows. Repeated documents each give their rows; repeated item ids count
once per text. Output: the id columns, the item column, ``n_words int, places int``. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._arrow import id_schema, map_batches
from foliant.llm.words import NUMBERING, Memo, plain, whole
from foliant.session import cut

K, W, MIN_WORDS, DENSITY, MIN_PLACE, BLOOM, DIAGONALS, AROUND, SMALL = 4, 2, 20, 0.85, 7, 1 << 23, 4096, 12, 32 << 20
MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
END = 0  # stands behind every text, so that no run goes over its end


def word(token: str) -> str:
    return "" if NUMBERING.match(token) else plain(token).replace("-", "")


def hashed(token: str) -> int | None:
    w = word(token)
    return xxhash.xxh64_intdigest(w) | 1 if w else None


def word_hashes(texts: list[str | None], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts in one array, END behind each text, and where the texts begin."""
    flat: list[int] = []
    starts = [0]
    for t in texts:
        if t:
            flat += [x for x in map(memo.__getitem__, whole(t)) if x is not None]
        flat.append(END)
        starts.append(len(flat))
    return np.array(flat, dtype=np.uint64), np.array(starts)


def kgram_hashes(u: np.ndarray) -> np.ndarray:
    """The hash of each run of K words; 0 where END is among them."""
    n = len(u) - K + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    known = np.ones(n, dtype=bool)
    for j in range(K):
        h ^= (u[j : j + n] * MULT[j]) ^ ((u[j : j + n] * MULT[(j + 1) % 4]) >> np.uint64(29))
        known &= u[j : j + n] != END
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    return np.where(known, np.maximum(h, 1), 0)


def winnow(h: np.ndarray) -> np.ndarray:
    """Positions of the minimum of each window of W hashes (a hash of 0, an unknown word, counts as the largest)."""
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    key = np.where(h == 0, np.uint64(0xFFFFFFFFFFFFFFFF), h)
    if len(key) < W:
        return np.array([int(key.argmin())])
    windows = np.lib.stride_tricks.sliding_window_view(key, W)
    picks = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
    return picks[h[picks] != 0]


def best_span(match: np.ndarray) -> tuple[int, int, int]:
    """The longest span that begins and ends in a match and holds at least DENSITY matches: start, end, matches."""
    s = np.concatenate([[0], np.cumsum(match - DENSITY)])
    ons = np.flatnonzero(match)
    if not len(ons):
        return 0, 0, 0
    good = s[ons + 1][None, :] - s[ons][:, None] >= -1e-9
    good &= ons[None, :] >= ons[:, None]
    size = np.where(good, np.arange(len(ons))[None, :] - np.arange(len(ons))[:, None] + 1, 0)
    a, b = np.unravel_index(int(size.argmax()), size.shape)
    return int(ons[a]), int(ons[b]) + 1, int(size[a, b])


def best_places(spans: list[tuple[int, int, int, int]]) -> tuple[int, int]:
    """The most words in at most two places in the item's order, and the number of places. Spans: start, end, words, diagonal.

    Shifted spans that follow one another within three words are one place. Words that both places hold count once."""
    if not spans:
        return 0, 0
    a, b, n, d = np.array(sorted(set(spans)), dtype=np.int64).T
    ending, beginning = n.copy(), n.copy()  # words of the best place that ends, or begins, with each span

    def joined(i, j):  # whether the place goes on from span i to span j
        gap = (a[j] + d[j]) - (b[i] + d[i]) + 1
        return (a[j] >= b[i] - 1) & (gap >= 0) & (gap <= 4)

    for k in range(len(n)):
        ending[k] += ending[:k].max(initial=0, where=joined(np.arange(k), k))
    for k in reversed(range(len(n))):
        later = np.arange(k + 1, len(n))
        beginning[k] += beginning[later].max(initial=0, where=joined(k, later))
    one = int(ending.max())
    # two places: of the many spans at the same words of the item only the best count
    ab, at = np.unique(np.stack([a, b], axis=1), axis=0, return_inverse=True)
    at = at.ravel()
    best_e, best_b = np.zeros(len(ab), dtype=np.int64), np.zeros(len(ab), dtype=np.int64)
    np.maximum.at(best_e, at, ending)
    np.maximum.at(best_b, at, beginning)
    u, v = ab.T
    two = 0
    for i in range(len(ab)):
        behind = (u >= u[i]) & (v > v[i])
        two = max(two, int((best_e[i] + best_b - np.maximum(0, v[i] - u)).max(initial=0, where=behind)))
    return (two, 2) if two > one else (one, 1)


def spans_of(match: np.ndarray, base: int = 0) -> list[tuple[int, int, int]]:
    """All dense spans of a diagonal, none in another, of MIN_PLACE matches at least: start, end, matches."""
    if match.sum() < MIN_PLACE:
        return []
    a, b, n = best_span(match)
    return [] if n < MIN_PLACE else [*spans_of(match[:a], base), (base + a, base + b, n), *spans_of(match[b:], base + b)]


def extend(doc: np.ndarray, item: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[int, int]:
    """The words and places of an item found in a document, from hits at the document's ``p`` and the item's ``q``."""
    spans = []
    diagonals = np.unique(p - q)
    for k in range(0, len(diagonals), DIAGONALS):
        d = diagonals[k : k + DIAGONALS]
        cols = d[:, None] + np.arange(len(item))[None, :]
        match = (cols >= 0) & (cols < len(doc)) & (doc[np.clip(cols, 0, len(doc) - 1)] == item[None, :])
        for m in np.flatnonzero(match.sum(axis=1) >= MIN_PLACE):
            spans += [(a, b, n, int(d[m])) for a, b, n in spans_of(match[m].astype(np.float64))]
    return best_places(spans) if sum(x[2] for x in spans) >= MIN_WORDS else (0, 0)


def surroundings(u: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """A byte of each word around the runs of K words that begin at ``at``, 0 beyond the text from ``begin`` to ``end``."""
    width = K + 2 * AROUND
    k = at[:, None] + np.arange(-AROUND, K + AROUND)[None, :]
    inside = (k >= begin[:, None]) & (k < end[:, None])
    code = np.where(inside, (u[np.clip(k, 0, len(u) - 1)] >> np.uint64(8)) % np.uint64(255) + np.uint64(1), np.uint64(0)).astype(np.uint8)
    ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * width)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, ends.buffers()[1], pa.py_buffer(code.tobytes())])


def in_a_place(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Hits that have MIN_PLACE equal words around them, with ``met array<int>``, these words' positions in the item. rows: with ``x, y``, the
    surroundings on both sides; ``keep`` ends in the item's position."""
    n = len(keep)

    def make():
        def work(b: pa.RecordBatch) -> dict:
            x, y = (np.frombuffer(b"".join(b.column(n + k).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1) for k in (0, 1))
            same = (x == y) & (x > 0)
            many = same.sum(axis=1)
            ok = many >= MIN_PLACE
            q = np.asarray(b.column(n - 1), dtype=np.int64)[ok]
            row, offset = np.nonzero(same[ok])
            met = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many[ok])]), pa.int32()), pa.array(q[row] + offset - AROUND, pa.int32()))
            return {c: b.column(k).filter(pa.array(ok)) for k, c in enumerate(keep)} | {"met": met}

        return work

    return map_batches(rows.select(*keep, "x", "y"), make, f"{id_schema(rows, keep)}, met array<int>")


def item_rows(items: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(item column, words array<bigint>, hs array<bigint>, at array<int>, y array<binary>): words and fingerprints of each item's text."""

    def make():
        memo = Memo(hashed)

        def work(b: pa.RecordBatch) -> dict:
            words, hs, at, y = [], [], [], []
            for t in b.column(1).to_pylist():
                u, _ = word_hashes([t], memo)
                h = kgram_hashes(u)
                w = winnow(h)
                words.append(u[:-1].view(np.int64))
                hs.append(h[w].view(np.int64))
                at.append(w.astype(np.int32))
                y.append(surroundings(u, w, np.zeros(len(w), dtype=np.int64), np.full(len(w), len(u) - 1)).to_pylist())
            return {item_col: b.column(0), "words": pa.array(words, pa.list_(pa.int64())), "hs": pa.array(hs, pa.list_(pa.int64())), "at": pa.array(at, pa.list_(pa.int32())), "y": pa.array(y, pa.list_(pa.binary()))}

        return work

    wanted = items.where(F.col(item_text).isNotNull()).select(item_col, item_text).distinct()
    return map_batches(wanted, make, f"{id_schema(items, [item_col])}, words array<bigint>, hs array<bigint>, at array<int>, y array<binary>")


def bloom(rows: DataFrame) -> np.ndarray:
    """The filter: each task sends its own bits, and these are of fixed size."""

    def run(batches):
        bits = np.zeros(BLOOM, dtype=bool)
        for b in batches:
            h = np.asarray(b.column(0).flatten()).view(np.uint64)
            bits[(h % np.uint64(BLOOM)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    parts = rows.select("hs").coalesce(8).mapInArrow(run, "bits binary").collect()
    return np.bitwise_or.reduce([np.frombuffer(r.bits, dtype=np.uint8) for r in parts]) if parts else np.zeros(BLOOM // 8, dtype=np.uint8)


def fingerprints(df: DataFrame, ids: list[str], text: str, bits: np.ndarray) -> DataFrame:
    """(ids, th, h, p, x): the documents' fingerprints that the filter lets through. ``th``: the text's hash."""
    n = len(ids)
    sent = df.sparkSession.sparkContext.broadcast(bits.tobytes())

    def make():
        memo = Memo(hashed)
        some = np.unpackbits(np.frombuffer(sent.value, dtype=np.uint8)).astype(bool)

        def work(b: pa.RecordBatch) -> dict:
            u, starts = word_hashes(b.column(n + 1).to_pylist(), memo)
            h = kgram_hashes(u)
            at = winnow(h)
            at = at[some[(h[at] % np.uint64(BLOOM)).astype(np.int64)]]
            row = np.searchsorted(starts, at, "right") - 1
            take = pa.array(row, pa.int64())
            return {c: b.column(k).take(take) for k, c in enumerate([*ids, "th"])} | {"h": pa.array(h[at].view(np.int64)), "p": pa.array((at - starts[row]).astype(np.int32)), "x": surroundings(u, at, starts[row], starts[row + 1] - 1)}

        return work

    return map_batches(df.select(*ids, F.xxhash64(text).alias("th"), F.col(text).alias("__t")), make, f"{id_schema(df, ids)}, th bigint, h bigint, p int, x binary")


def leaked(df: DataFrame, ids: list[str], text: str, items: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """One row per document row and item found in it."""
    n, names = len(ids), [f"__i{k}" for k in range(len(ids))]
    base = df.where(F.col(text).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(ids, names)], F.col(text).alias("__t"))
    rows = item_rows(items.select(F.col(item_col).alias("item"), F.col(item_text).alias("t")), "item", "t").withColumn("no", F.xxhash64("item", "words"))
    prints = rows.select("no", F.explode(F.arrays_zip("hs", "at", "y")).alias("e")).select("no", F.col("e.hs").alias("h"), F.col("e.at").alias("q"), F.col("e.y").alias("y"))
    met = in_a_place(fingerprints(base, names, "__t", bloom(rows)).join(prints, "h"), [*names, "th", "no", "p", "q"])
    hits = met.groupBy(*names, "th", "no").agg(F.collect_set(F.struct("p", "q")).alias("at"), F.array_distinct(F.flatten(F.collect_list("met"))).alias("met"))
    hits = hits.where(F.size("met") >= MIN_WORDS).drop("met")
    per = hits.join(rows.select("no", "item", "words"), "no").groupBy(*names, "th").agg(F.collect_list(F.struct("item", "words", "at")).alias("hits"))
    # mostly few: sent to the documents where they are read if their size, which is counted, is small, else both sides are shuffled
    per = cut(per)
    cells = per.agg(F.sum(F.expr("aggregate(hits, 0L, (s, e) -> s + size(e.words) + 2 * size(e.at))"))).first()[0] or 0
    per = F.broadcast(per) if 8 * cells <= SMALL else per
    keys = [F.xxhash64("__t") == F.col("th"), *[F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]]
    met = base.alias("a").join(per.alias("b"), keys).select(*[F.col(f"a.{c}").alias(k) for c, k in zip(names, ids)], F.col("a.__t").alias("__t"), F.col("b.hits").alias("hits"))
    kind = dict(items.dtypes)[item_col]

    def make():
        memo = Memo(hashed)

        def work(b: pa.RecordBatch) -> dict:
            out, found = [], []
            lists = b.column(n + 1)
            for i, t in enumerate(b.column(n).to_pylist()):
                doc, _ = word_hashes([t], memo)
                doc = doc[:-1].view(np.int64)
                mine = lists[i].values  # structs: item, words, hits
                for k in range(len(mine)):
                    words, at = np.asarray(mine.field("words")[k].values), mine.field("at")[k].values
                    many, places = extend(doc, words, np.asarray(at.field("p"), dtype=np.int64), np.asarray(at.field("q"), dtype=np.int64))
                    if many >= MIN_WORDS:
                        out.append((i, many, places))
                        found.append(mine.field("item")[k].as_py())
            take = pa.array([x[0] for x in out], pa.int64())
            got = {c: b.column(j).take(take) for j, c in enumerate(ids)}
            item_type = lists.type.value_type.field("item").type
            return got | {item_col: pa.array(found, item_type), "n_words": pa.array([x[1] for x in out], pa.int32()), "places": pa.array([x[2] for x in out], pa.int32())}

        return work

    return map_batches(met, make, f"{id_schema(df, ids)}, `{item_col}` {kind}, n_words int, places int")

"""Problem 3: groups of near-duplicate records.

Similarity is the share of all distinct shingles of two texts that occur in both (words: runs of ``width`` words;
characters: runs of ``width`` letters of the words without spaces). Letter case, punctuation and spacing are ignored and
characters unified as in problem 5.

Steps

1. One scan turns each text into a text key (equal words, equal key) and its shingle hashes. These few bytes are
   checkpointed; texts are never shuffled. Copies collapse to one representative per text key. ``ROWS * BANDS`` minimum
   hashes give band keys, and ``BITS`` bits of each minimum a signature.
2. Equal band keys make blocks. Blocks of over ``BLOCK`` members are cut into groups and compared group by group, so no
   task holds an unbounded block and no pair is lost. Bands of very many texts are known beforehand from a sample and salted.
3. Bit-sliced comparison: within a block the signatures are stored as vertical bit planes, 64 members to a word; each
   member's distances to all others are counted at once by carry-save bitwise counters, and a row is abandoned as soon
   as all its counters exceed the radius.
4. Pairs within the radius are verified exactly on their shingles.

Null texts and texts without a word are in no pair. Texts of fewer words than a shingle have one shingle, all their
words. Ids that repeat with several texts have each of them. Links are found between representatives; ``near_pairs``
expands members only as asked, ``groups`` never does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm._arrow import id_schema, map_batches
from foliant.llm.words import GONE, LOOK, LOOKALIKE, Memo, whole
from foliant.session import cut

ROWS, BANDS, BITS, BLOCK = 3, 24, 4, 512
SALTS, SAMPLED, LARGEST = 64, 64, 5000
HASHES = ROWS * BANDS
_rng = np.random.default_rng(5)
MUL = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 62, HASHES, dtype=np.uint64)
WORD = re.compile(r"[^\W_]+")


def radius_of(threshold: float, sigmas: float = 3.5) -> int:
    """The signature distance that a pair of the threshold's similarity exceeds with the chance of ``sigmas``."""
    p = 1 - threshold
    mean = HASHES * BITS * p / 2
    # a minimum differs with p, and then each of its bits with one half
    var = HASHES * (p * (BITS / 4 + BITS * BITS / 4) - (p * BITS / 2) ** 2)
    return int(np.ceil(mean + sigmas * np.sqrt(var)))


def parts(token: str) -> tuple[int, ...]:
    """Hashes of the words in a token."""
    if not token.isascii():
        import unicodedata

        token = unicodedata.normalize("NFKC", token.translate(GONE))
        if any(c in LOOKALIKE for c in token) and re.search("[A-Za-z]", token):
            token = token.translate(LOOK)
    return tuple(xxhash.xxh64_intdigest(w) >> 1 for w in WORD.findall(token.lower()))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingles(words: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles: (text number, 32-bit hash), in order. Short texts have one."""
    n = len(words)
    sizes = np.diff(ends)
    text = np.repeat(np.arange(len(sizes)), sizes)
    if n == 0:
        return text, words.astype(np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    at = np.arange(n)
    room = ends[1:][text] - at  # words from here to the end of the text
    for j in range(width):
        ok = room > j
        h[ok] = _mix(h[ok] * np.uint64(0x9E3779B97F4A7C15) + words[at[ok] + j])
    keep = (room >= width) | ((at == ends[:-1][text]) & (sizes[text] < width))
    key = np.unique((text[keep].astype(np.uint64) << np.uint64(32)) | (h[keep] >> np.uint64(32)))
    return (key >> np.uint64(32)).astype(np.int64), key & np.uint64(0xFFFFFFFF)


def minima(text: np.ndarray, sh: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have shingles, and their minimum hashes."""
    has, first = np.unique(text, return_index=True)
    low = np.empty((len(has), HASHES), dtype=np.uint64)
    for k in range(HASHES):
        h = sh * MUL[k] + ADD[k]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        low[:, k] = np.minimum.reduceat(h >> np.uint64(32), first)
    return has, low


def signatures(low: np.ndarray) -> np.ndarray:
    """BITS bits of each minimum, packed: rows of bytes."""
    bits = ((_mix(low * np.uint64(0xC2B2AE3D27D4EB4F))[:, :, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits.reshape(len(low), -1), axis=1)


def band_keys(low: np.ndarray) -> np.ndarray:
    b = low.reshape(len(low), BANDS, ROWS)
    key = np.full((len(low), BANDS), 14695981039346656037, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ b[:, :, r]) * np.uint64(1099511628211)
        key ^= key >> np.uint64(29)
    return (key ^ (np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[None, :]).view(np.int64)


def sketches(df: DataFrame, id_col: str, text: str, width: int, unit: str = "word") -> DataFrame:
    """(id, tkey, sh array<int>) of every text with a word."""

    def make():
        memo = Memo(parts)

        def chars(token: str) -> tuple[int, ...]:
            import unicodedata

            token = unicodedata.normalize("NFKC", token.translate(GONE)) if not token.isascii() else token
            token = token.translate(LOOK) if any(c in LOOKALIKE for c in token) else token
            return tuple(ord(c) + 1000 for w in WORD.findall(token.lower()) if len(w) > 3 for c in w)

        if unit == "char":
            memo = Memo(chars)

        def work(b: pa.RecordBatch) -> dict | None:
            texts = b.column(1).to_pylist()
            out = []
            for a in range(0, len(texts), 2000):
                flat: list[int] = []
                ends = [0]
                for t in texts[a : a + 2000]:
                    if t:
                        for x in whole(t):
                            flat.extend(memo[x])
                    ends.append(len(flat))
                words, e = np.array(flat, dtype=np.uint64), np.array(ends)
                if not len(words):
                    continue
                text_no, sh = shingles(words, e, width)
                has = np.unique(text_no)
                raw = words.tobytes()
                tkey = np.array([xxhash.xxh3_64_intdigest(raw[8 * e[i] : 8 * e[i + 1]]) for i in has], dtype=np.uint64).view(np.int64)
                cuts = np.append(np.searchsorted(text_no, has), len(text_no)).astype(np.int32)
                out.append((has + a, tkey, cuts, sh.astype(np.uint32).view(np.int32)))
            if not out:
                return None
            return {
                id_col: b.column(0).take(pa.array(np.concatenate([x[0] for x in out]), pa.int64())),
                "tkey": pa.array(np.concatenate([x[1] for x in out]), pa.int64()),
                "sh": pa.concat_arrays([pa.ListArray.from_arrays(pa.array(x[2], pa.int32()), pa.array(x[3], pa.int32())) for x in out]),
            }

        return work

    return map_batches(df.select(id_col, F.col(text).alias("__t")), make, f"{id_schema(df, [id_col])}, tkey bigint, sh array<int>")


def list_minima(lists: pa.ListArray) -> np.ndarray:
    """Minimum hashes of each list of shingles; lists are not empty."""
    sh = np.asarray(lists.flatten()).view(np.uint32).astype(np.uint64)
    return minima(np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets))), sh, len(lists))[1]


def band_rows(sk: DataFrame, large: dict[int, int] | None = None) -> DataFrame:
    """(tkey, band, part) of every text; copies within a batch count once, before anything is shuffled. ``part``: 0, or for a band
    in ``large`` (band -> groups) its number of groups and a salt, as ``groups * SALTS + salt``."""
    names, sizes = (np.array(sorted(large), dtype=np.int64), np.array([large[k] for k in sorted(large)], dtype=np.int64)) if large else (np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))

    def make():
        def work(b: pa.RecordBatch) -> dict:
            tkey, first = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_index=True)
            keys = band_keys(list_minima(b.column(1).take(pa.array(first, pa.int64())))).ravel()
            owner = np.repeat(tkey, BANDS)
            at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
            part = np.where((names[at] == keys) & (sizes[at] > 0), sizes[at] * SALTS + (owner.view(np.uint64) % np.uint64(SALTS)).astype(np.int64), 0)
            return {"tkey": pa.array(owner, pa.int64()), "band": pa.array(keys, pa.int64()), "part": pa.array(part, pa.int64())}

        return work

    return map_batches(sk.select("tkey", "sh"), make, "tkey bigint, band bigint, part bigint")


def large_bands(sk: DataFrame) -> dict[int, int]:
    """Bands of very many texts with the groups to cut them into, from a sample of the texts by their keys' hash. At most LARGEST of them, the
    largest; which bands are among them decides how rows are spread, never which pairs are found."""
    some = sk.where(F.pmod(F.xxhash64("tkey"), F.lit(SAMPLED)) == 0)
    seen = band_rows(some).groupBy("band").agg(F.countDistinct("tkey").alias("n")).where(F.col("n") * SAMPLED > 4 * BLOCK)
    return {r.band: -(-r.n * SAMPLED // BLOCK) for r in seen.orderBy(F.desc("n"), "band").limit(LARGEST).collect()}


def close_pairs(block: np.ndarray, side: np.ndarray, sig: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs (i < j) of members of one block within the radius, by bit-sliced counting; of a two-sided block, only pairs of different sides.

    ``block`` is sorted. Every (member, word of 64 block members) is a row; the rows of all blocks advance together.
    """
    n = len(block)
    bits = np.unpackbits(sig, axis=1)[:, : HASHES * BITS].astype(bool)
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if n else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(starts, n))
    words = -(-sizes // 64)
    base = np.concatenate([[0], np.cumsum(words)])
    # vertical planes: planes[bit, word]
    which = np.repeat(np.arange(len(starts)), sizes)
    inner = np.arange(n) - starts[which]
    word_of, lane = base[which] + inner // 64, (inner % 64).astype(np.uint64)
    order = np.lexsort((lane, word_of))
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(word_of[order]) > 0])) if n else starts
    masked = np.where(bits, np.uint64(1) << lane[:, None], np.uint64(0))[order]
    planes = np.bitwise_or.reduceat(masked, cuts, axis=0).T.copy()
    live = np.bitwise_or.reduceat((np.uint64(1) << lane)[order], cuts)
    rows_q = np.repeat(np.arange(n), words[which])
    k = np.arange(len(rows_q)) - np.repeat(np.concatenate([[0], np.cumsum(words[which])[:-1]]), words[which])
    rows_w = base[which[rows_q]] + k
    ahead = rows_w >= word_of[rows_q]  # each pair once: words before the member's own are its partners' rows
    rows_q, rows_w = rows_q[ahead], rows_w[ahead]
    depth = int(radius).bit_length() + 1
    over = np.uint64(0) * live[rows_w]
    counters = [np.zeros(len(rows_q), dtype=np.uint64) for _ in range(depth)]
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(HASHES * BITS):
        carry = planes[b][rows_w] ^ np.where(bits[rows_q, b], ones, np.uint64(0))
        for c in counters:
            carry, c[:] = c & carry, c ^ carry
        over |= carry  # ran out of the counter: beyond the radius
        if b % 24 == 23 and b > radius:
            gone = over | beyond(counters, radius)
            keep = (~gone & live[rows_w]) != 0
            if not keep.all():
                rows_q, rows_w, over = rows_q[keep], rows_w[keep], over[keep]
                counters = [c[keep] for c in counters]
            if not len(rows_q):
                return []
    near = ~(over | beyond(counters, radius)) & live[rows_w]
    first = np.append(np.flatnonzero(np.concatenate([[True], np.diff(word_of[order]) > 0])), n)
    out = []
    for r in np.flatnonzero(near):
        i, m = int(rows_q[r]), int(near[r])
        members = order[first[rows_w[r]] : first[rows_w[r] + 1]]
        while m:
            low = m & -m
            j = int(members[low.bit_length() - 1])
            if j > i and (side[i] != side[j] or side[i] == 0):
                out.append((i, j))
            m ^= low
    return out


def beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is larger than the radius: a bitwise comparison from the top plane down."""
    more = np.zeros_like(counters[0])
    same = ~more
    for k in range(len(counters) - 1, -1, -1):
        if (radius >> k) & 1:
            same = same & counters[k]
        else:
            more |= same & counters[k]
            same = same & ~counters[k]
    return more


def links(sk: DataFrame, threshold: float) -> DataFrame:
    """Pairs of text keys ``a < b`` with their ``similarity``, at least the threshold. ``sk``: sketches."""
    radius = radius_of(threshold)
    w = Window.partitionBy("band", "part")
    members = band_rows(sk, large_bands(sk)).repartition("band", "part").dropDuplicates(["band", "part", "tkey"]).withColumn("n", F.count("*").over(w)).where("n > 1 or part > 0")
    # large blocks: groups of members, and a block for each pair of groups; those of very many members go over SALTS tasks; a small one is one group
    parts_n = F.when(F.col("part") > 0, F.floor(F.col("part") / F.lit(SALTS))).otherwise(F.ceil(F.col("n") / F.lit(BLOCK))).cast("int")
    grouped = members.withColumn("p", parts_n).withColumn("g", F.when(F.col("p") > 1, F.pmod(F.xxhash64("tkey", "band"), F.col("p"))).otherwise(F.lit(0)).cast("int"))
    blocks = grouped.select("tkey", "band", "g", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("h")).select(
        "tkey",
        F.xxhash64("band", F.least("g", "h"), F.greatest("g", "h")).alias("block"),
        F.when(F.col("g") == F.col("h"), 0).when(F.col("g") < F.col("h"), 1).otherwise(2).alias("side"),
    )
    one = sk.groupBy("tkey").agg(F.first("sh").alias("sh"))
    signed = map_batches(blocks.join(one, "tkey").select("block", "side", "tkey", "sh"), sign_rows, "block bigint, side int, tkey bigint, sig binary")
    # sorted blocks go over from one Arrow batch to the next
    ordered = signed.repartition("block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def compare(t: pa.Table) -> pa.RecordBatch | None:
            if t.num_rows < 2:
                return None
            key = t.column("tkey").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint8).reshape(t.num_rows, -1)
            found = {(int(min(key[i], key[j])), int(max(key[i], key[j]))) for i, j in close_pairs(t.column("block").to_numpy(), t.column("side").to_numpy(), sig, radius) if key[i] != key[j]}
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"]) if found else None

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            last = t.column("block")[t.num_rows - 1].as_py()
            whole_rows = int(np.searchsorted(t.column("block").to_numpy(), last, "left"))
            out, held = compare(t.slice(0, whole_rows)), t.slice(whole_rows)
            if out is not None:
                yield out
        if held is not None and (out := compare(held)) is not None:
            yield out

    pairs = ordered.mapInArrow(run, "a bigint, b bigint").distinct()
    both = pairs.join(one.select(F.col("tkey").alias("a"), F.col("sh").alias("x")), "a").join(one.select(F.col("tkey").alias("b"), F.col("sh").alias("y")), "b").select("a", "b", "x", "y")
    return map_batches(both, similarities, "a bigint, b bigint, similarity double").where(F.col("similarity") >= threshold)


def sign_rows():
    def work(b: pa.RecordBatch) -> dict:
        key = b.column(2).to_numpy(zero_copy_only=False)
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        sig = pa.array([s.tobytes() for s in signatures(list_minima(b.column(3).take(pa.array(first, pa.int64()))))], pa.binary())
        return {"block": b.column(0), "side": b.column(1), "tkey": b.column(2), "sig": sig.take(pa.array(at, pa.int64()))}

    return work


def similarities():
    """The exact check on the shingles of both texts."""

    def work(b: pa.RecordBatch) -> dict:
        x, y = b.column(2), b.column(3)
        xo, xs, yo, ys = np.asarray(x.offsets), np.asarray(x.values), np.asarray(y.offsets), np.asarray(y.values)
        out = []
        for i in range(b.num_rows):
            p, q = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both / (len(p) + len(q) - both))
        return {"a": b.column(0), "b": b.column(1), "similarity": pa.array(out, pa.float64())}

    return work


def near_duplicates(df: DataFrame, id_col: str, text: str, threshold: float, width: int, unit: str = "word") -> tuple[DataFrame, DataFrame]:
    """Membership ``(id, tkey)`` and links ``(a, b, similarity)`` between text keys."""
    sk = cut(sketches(df, id_col, text, width, unit))
    return sk.select(id_col, "tkey"), links(sk, threshold)


def near_pairs(members: DataFrame, linked: DataFrame, id_col: str) -> DataFrame:
    """All pairs of ids ``id_a < id_b``: of linked texts, and of one text's copies."""
    m = members.select(F.col(id_col).alias("i"), "tkey").repartition("tkey")  # one exchange serves all joins below
    many = m.groupBy("tkey").agg(F.count("*").alias("n")).where("n > 1").select("tkey")
    copies = m.join(many, "tkey")
    same = copies.join(copies.withColumnRenamed("i", "j"), "tkey").where("i < j").select(F.col("i").alias("id_a"), F.col("j").alias("id_b"), F.lit(1.0).alias("similarity"))
    left = linked.join(m.select(F.col("tkey").alias("a"), F.col("i").alias("x")), "a")
    both = left.join(m.select(F.col("tkey").alias("b"), F.col("i").alias("y")), "b").where("x <> y")
    cross = both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")
    return same.unionByName(cross).groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))


def groups(members: DataFrame, linked: DataFrame, id_col: str, rounds: int = 20) -> DataFrame:
    """One row per id: ``(id, group bigint, n_links bigint)``; group is the least text key of the connected texts.

    Labels spread by repeated minima over the links, with a checkpoint every round, until none changes.
    """
    edges = cut(linked.select("a", "b").unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = edges.select(F.col("a").alias("k")).distinct().withColumn("g", F.col("k"))
    label = cut(label)
    while True:
        spread = edges.join(label, edges["b"] == label["k"]).groupBy("a").agg(F.min("g").alias("m"))
        nxt = label.join(spread, label["k"] == spread["a"], "left").select("k", F.least("g", F.coalesce("m", "g")).alias("g"))
        # the label of one's label: paths halve every round
        up = nxt.select(F.col("k").alias("k2"), F.col("g").alias("g2"))
        nxt = cut(nxt.join(up, nxt["g"] == up["k2"], "left").select("k", F.least("g", F.coalesce("g2", "g")).alias("g")))
        changed = nxt.join(label.withColumnRenamed("g", "old"), "k").where("g <> old").limit(1).count()
        label = nxt
        if not changed:
            break
    degree = edges.groupBy("a").agg(F.count("*").alias("d"))
    members = members.groupBy(id_col, "tkey").count()
    named = members.join(label, members["tkey"] == label["k"], "left").join(degree, members["tkey"] == degree["a"], "left")
    return named.select(id_col, F.coalesce("g", "tkey").alias("group"), F.coalesce("d", F.lit(0)).alias("n_links"))


def plain_doi(doi):
    """A DOI apart from the way it is written: null if there is none."""
    s = F.lower(F.regexp_replace(F.trim(doi), r"\s+", ""))
    s = F.regexp_replace(s, r"^(?:https?:/*)?(?:www\.)?(?:dx\.)?(?:doi\.org/)?(?:doi:?/*)?(?:https?:/*)?(?:dx\.)?(?:doi\.org/)?", "")
    s = F.regexp_replace(s, r"[.,;)\]]+$", "")
    return F.when(s.rlike(r"^10\.\d{3,}"), s)


def same_title(a: str, b: str) -> bool:
    """Equal apart from case, spacing, punctuation, short words and slips inside words (one slip; two in words of ten letters or more)."""
    from foliant.llm.names import edit

    def words(t: str) -> list[str]:
        import unicodedata

        t = unicodedata.normalize("NFKC", t.translate(GONE))
        return [w.translate(LOOK) if re.search("[a-z]", w) else w for w in WORD.findall(t.lower()) if len(w) > 3]

    x, y = words(a), words(b)
    if len(x) != len(y):
        x, y = ["".join(x)], ["".join(y)]
        return x == y
    slips = 0
    for u, v in zip(x, y):
        if u != v:
            d = edit(u, v, 2)
            if d > (2 if min(len(u), len(v)) >= 10 else 1) or min(len(u), len(v)) < 4:
                return False
            slips += d
    return slips <= max(2, len(x) // 2)


TITLE_THRESHOLD, TITLE_WIDTH = 0.55, 3


def same_works(papers: DataFrame, paper: str, doi: str, title: str) -> DataFrame:
    """Pairs ``id_a < id_b`` of records of one work: equal DOIs, or, if one is missing, equal titles."""
    base = cut(papers.select(F.col(paper).alias("i"), plain_doi(F.col(doi)).alias("doi"), F.col(title).alias("t")).distinct())
    d = base.where("doi is not null").select("i", "doi").distinct()
    by_doi = d.join(d.withColumnRenamed("i", "j"), "doi").where("i < j").select(F.col("i").alias("id_a"), F.col("j").alias("id_b"))
    titles = base.where("t is not null").withColumn("rec", F.to_json(F.struct("i", "t", "doi")))
    members, linked = near_duplicates(titles, "rec", "t", TITLE_THRESHOLD, TITLE_WIDTH, "char")
    fields = "struct<i:string,t:string,doi:string>"
    pairs = near_pairs(members, linked, "rec").select(F.from_json("id_a", fields).alias("x"), F.from_json("id_b", fields).alias("y"))
    open_pairs = pairs.where("(x.doi is null or y.doi is null) and x.i <> y.i").select("x.i", F.col("x.t").alias("t"), F.col("y.i").alias("j"), F.col("y.t").alias("u"))

    def make():
        def work(b: pa.RecordBatch) -> dict:
            ok = pa.array([same_title(t, u) for t, u in zip(b.column(1).to_pylist(), b.column(3).to_pylist())], pa.bool_())
            return {"i": b.column(0).filter(ok), "j": b.column(2).filter(ok)}

        return work

    by_title = map_batches(open_pairs, make, "i string, j string").select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))
    return by_doi.unionByName(by_title).distinct()

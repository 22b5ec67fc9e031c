"""Problem 4: text quality statistics of each document, and what the text is: prose, list, table or junk.

``quality_stats`` gives per row: ``n_chars n_words mean_word_len symbol_ratio digit_ratio alpha_word_share
common_share n_common n_lines punct_line_share bullet_line_share table_line_share dots_line_share unique_word_share``, ``failures``
(one reason per rule that failed, in a fixed order) and ``kind``.

Everything is counted over whole Arrow batches: characters by a class table and ``np.add.reduceat``, words and lines by
Arrow's string kernels, and the rules are comparisons of columns; no loop runs over rows, lines or words. The thresholds
follow the published rules for web corpora (mean word length 3 to 10, bullets at most 0.9 of the lines, ellipsis lines at
most 0.3, at least 0.8 of the words with a letter, at least two common words, repeated words; other signs at most 0.1 of the
characters) and apply to whole texts. ``RULES`` names each with the kind that it decides; a text's kind is that of the
first rule it fails that decides one, else 'prose'. A line is of one sort only: a leader line ('.... 7') is a list entry.

Null or empty text: all counts 0, ``failures`` is ['empty'], ``kind`` 'junk' for empty text and null for null text.
Very long texts are read whole. Repeated rows give repeated rows. Other input columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._arrow import id_schema, map_batches

# Very common words of the languages in use.
COMMON = frozenset(
    """the of and to in a is was were be been at with for by that from an as on or it its this these those our we not no only each
    between than both which although how has had have are one
    de la el los las en un una y que con por para se es fue era del al como no su más cuando según aunque
    le les des du et une que qui est a été dans pour par sur avec plus au aux ce cette son sa il elle ne pas lorsque selon entre bien
    der die das und den dem des ein eine ist war nicht mit für von zu im auf als auch wie wir wird wurde hat haben bei nach obwohl noch
    o os as um uma do da dos das em no na e é foi não com mais se ao pela pelo quando embora segundo seu sua""".split()
)
MAX_SYMBOLS, MIN_LEN, MAX_LEN, MAX_BULLETS, MAX_DOTS, MIN_ALPHA, MIN_COMMON, MIN_SHARE = 0.1, 3.0, 10.0, 0.9, 0.3, 0.8, 2, 0.06
MIN_TABLE, MIN_UNIQUE, MIN_PUNCT = 0.75, 0.12, 0.1

LONG_LINE, MAX_CELL, MEAN_CELL = 200, 45, 22
# Patterns of a trimmed line
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"
MARK = r"^(?:(?:[-+*>•◦▪–·]|\[\d{1,4}\])\s*\S|(?:o|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+\S)"
LEADER = r"(?:\.{4,}|(?:\. ){4,}|…)\s*\d+$"
SYMBOL_ENTRY = r"^\S{1,3}(?:[ _]\S{1,3})?\s*[:=]\s+\S"
NUMBERS = r"^[\s\d.,;:%+|-]*\d$"
CELL = r"\||\t| {2,}|;"
HEX = r"^[0-9a-fA-F]{4,8}:?(?: [0-9a-fA-F]{2})+"
STOP = r"[.!?:…]$|[.!?:…][\"'»”)\]]$"
# name, kind decided
RULES = (
    ("byte_dump", "junk"), ("long_words", "junk"), ("cell_lines", "table"), ("bullet_lines", "list"), ("cell_and_bullet_lines", "table"), ("common_words", "junk"), ("repeated_words", "junk"), ("single_letters", "junk"),
    ("mean_word_length", None), ("symbols", None), ("ellipsis_lines", None), ("alphabetic_words", None), ("punctuated_lines", None),
)

STATS = "n_chars bigint, n_words bigint, mean_word_len double, symbol_ratio double, digit_ratio double, alpha_word_share double, common_share double, n_common bigint, n_lines bigint, punct_line_share double, bullet_line_share double, table_line_share double, dots_line_share double, unique_word_share double, failures array<string>, kind string"


def _classes() -> np.ndarray:
    """Class by code point below U+3000: 1 letter, 2 digit, 3 space, 0 other sign."""
    return np.array([1 if (c := chr(i)).isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 0 for i in range(0x3000)], dtype=np.int8)


def char_counts(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters, digits and other signs of each text."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32)
    kinds = np.where(code < 0x3000, classes[np.minimum(code, 0x2FFF)], 1)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return tuple((c := np.concatenate([[0], np.cumsum(kinds == k)]))[ends[1:]] - c[ends[:-1]] for k in (1, 2, 0))


def flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All entries, and the number of the row that each is of."""
    return lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))


def yes(mask: pa.Array) -> np.ndarray:
    return np.asarray(mask.to_numpy(zero_copy_only=False), dtype=bool)


def has(x: pa.Array, pattern: str) -> np.ndarray:
    return yes(pc.match_substring_regex(x, pattern))


def cell_rows(x: pa.Array) -> np.ndarray:
    """Lines of cells: two or more short fields, or numbers only."""
    bar, tab, gap, semi = (yes(pc.match_substring(x, t)) for t in ("|", "\t", "  ", ";"))
    some = np.flatnonzero(bar | tab | gap | semi)
    fields, of = flat(pc.split_pattern_regex(x.take(pa.array(some)), CELL))
    fields = pc.utf8_trim_whitespace(fields)
    sizes = np.asarray(pc.utf8_length(fields))
    words = ~yes(pc.match_substring(fields, " ")) & (sizes > 0)
    of, full = of[sizes > 0], sizes[sizes > 0]
    n = np.bincount(of, minlength=len(some))
    total, plain = np.bincount(of, weights=full, minlength=len(some)), np.bincount(of, weights=words[sizes > 0], minlength=len(some))
    most = np.zeros(len(some))
    np.maximum.at(most, of, full)
    short = (most <= MAX_CELL) & (total <= MEAN_CELL * n)
    open_end = ~has(x.take(pa.array(some)), "[;,.]$")
    row = np.where(n < 2, bar[some], short & (bar[some] | tab[some] | gap[some] & open_end | semi[some] & (plain > 0.8 * n)))
    out = has(x, NUMBERS)
    out[some] |= row
    return out


def line_shares(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Per text: lines, and their shares that end in punctuation, are list entries, rows of cells, leaders, dumps of bytes."""
    x, of = flat(pc.split_pattern_regex(texts, LINE_ENDS))
    x = pc.utf8_trim_whitespace(x)
    size = np.asarray(pc.utf8_length(x))
    x, of, size = x.filter(pa.array(size > 0)), of[size > 0], size[size > 0]
    short = size <= LONG_LINE
    dump = short & has(x, HEX) & (np.asarray(pc.count_substring(x, " ")) >= 4)
    dots = short & ~dump & has(x, LEADER)
    table = short & ~dump & ~dots & cell_rows(x)
    entry = has(x, MARK) | has(x, "[;,]$") & (size <= 82) | has(x, SYMBOL_ENTRY)
    bullets = dots | short & ~dump & ~table & entry
    n = np.bincount(of, minlength=len(texts))
    share = [np.bincount(of, weights=m, minlength=len(texts)) / np.maximum(n, 1) for m in (has(x, STOP), bullets, table, dots, dump)]
    return n, *share


def word_shares(texts: pa.Array) -> dict[str, np.ndarray]:
    """Per text: words, distinct common ones, and the shares of common, alphabetic, distinct and single-letter words."""
    k = len(texts)
    x, of = flat(pc.utf8_split_whitespace(texts))
    size = np.asarray(pc.utf8_length(x))
    x, of, size = x.filter(pa.array(size > 0)), of[size > 0], size[size > 0]
    lower = pc.utf8_trim(pc.utf8_lower(x), ".,;:()[]")
    code = np.asarray(lower.dictionary_encode().indices).astype(np.int64)
    common = yes(pc.is_in(lower, pa.array(sorted(COMMON))))
    n = np.bincount(of, minlength=k)
    count = lambda m: np.bincount(of, weights=m, minlength=k)
    distinct = lambda m: np.bincount(np.unique(of[m] * (len(x) + 1) + code[m]) // (len(x) + 1), minlength=k)
    longest = np.zeros(k)
    np.maximum.at(longest, of, size)
    alpha, some = count(yes(pc.utf8_is_alpha(lower))) / np.maximum(n, 1), count(has(x, r"\p{L}")) / np.maximum(n, 1)
    return {
        "n": n, "chars": count(size), "longest": longest, "common": count(common) / np.maximum(n, 1), "n_common": distinct(common), "unique": distinct(np.ones(len(of), dtype=bool)) / np.maximum(n, 1),
        "alpha": np.where(alpha < MIN_ALPHA, some, alpha), "singles": count(size == 1) / np.maximum(n, 1),
    }


def broken_rules(w: dict[str, np.ndarray], mean: np.ndarray, symbols: np.ndarray, punct: np.ndarray, bullets: np.ndarray, table: np.ndarray, dots: np.ndarray, dump: np.ndarray) -> np.ndarray:
    """A row per text, a column per rule of RULES: whether it fails."""
    return np.stack(
        [
            dump >= 0.5,
            (w["longest"] > 60) & (w["longest"] > 0.2 * np.maximum(1, w["chars"])),
            (table >= MIN_TABLE) & (table >= bullets),
            (bullets >= MAX_BULLETS) | (bullets + table >= MAX_BULLETS) & (bullets > table),
            (bullets + table >= MAX_BULLETS) & (bullets <= table),
            (w["n_common"] < MIN_COMMON) | (w["common"] < MIN_SHARE),
            (w["n"] >= 20) & (w["unique"] < MIN_UNIQUE) & (w["common"] < 0.15),
            w["singles"] > 0.6,
            (mean < MIN_LEN) | (mean > MAX_LEN),
            symbols > MAX_SYMBOLS,
            dots > MAX_DOTS,
            w["alpha"] < MIN_ALPHA,
            punct < MIN_PUNCT,
        ],
        axis=1,
    )


def quality_stats(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    n = len(ids)
    names, kinds = [r[0] for r in RULES], [r[1] for r in RULES]

    def make():
        classes = _classes()

        def work(b: pa.RecordBatch) -> dict:
            raw = b.column(n)
            texts = raw.fill_null("").cast(pa.string())
            letters, digits, signs = char_counts(texts.to_pylist(), classes)
            w = word_shares(texts)
            n_lines, punct, bullets, table, dots, dump = line_shares(texts)
            seen = letters + digits + signs
            mean, symbols, digit = seen / np.maximum(w["n"], 1), signs / np.maximum(seen, 1), digits / np.maximum(seen, 1)
            broken = broken_rules(w, mean, symbols, punct, bullets, table, dots, dump)
            empty = w["n"] == 0
            decided = np.array([k or "" for k in kinds], dtype=object)
            deciding = broken[:, decided != ""]
            kind = np.where(empty, "junk", np.where(deciding.any(axis=1), decided[decided != ""][deciding.argmax(axis=1)], "prose"))
            broken = np.concatenate([empty[:, None], broken & ~empty[:, None]], axis=1)
            failures = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(broken.sum(axis=1))]), pa.int32()), pa.array(["empty", *names]).take(pa.array(np.nonzero(broken)[1])))
            whole = lambda x: pa.array(x.astype(np.int64))
            got = {
                "n_chars": pc.utf8_length(texts).cast(pa.int64()), "n_words": whole(w["n"]), "mean_word_len": mean, "symbol_ratio": symbols, "digit_ratio": digit, "alpha_word_share": w["alpha"], "common_share": w["common"], "n_common": whole(w["n_common"]), "n_lines": whole(n_lines),
                "punct_line_share": punct, "bullet_line_share": bullets, "table_line_share": table, "dots_line_share": dots, "unique_word_share": w["unique"], "failures": failures, "kind": pa.array(kind.tolist(), pa.string(), mask=np.asarray(raw.is_null())),
            }
            return {c: b.column(k) for k, c in enumerate(ids)} | got

        return work

    return map_batches(df.select(*ids, F.col(text).alias("__t")), make, f"{id_schema(df, ids)}, {STATS}")

"""Pages and documents: classification, inspection, validation, repeated lines, normalisation.

A frame of documents has ``document_id, pages array<string>``, one row per document, so what concerns the pages of one
document is computed within its row, without an exchange. A frame of pages has ``document_id, page_num, text``.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import text as T

GOOD, EMPTY, FULL = 50, 10, 500
EMBEDDED, SCANNED, EMPTY_SHARE = 0.1, 0.4, 0.15
GARBAGE_MOST, REPEATED_MOST, THIN = 0.05, 0.15, 100
REVIEW, FAIL = 0.5, 0.25
LAYOUT_PAGES, LEFT, RIGHT = 5, 0.45, 0.55
FALLBACK_BELOW, FALLBACK_GAIN = 0.5, 1.3


def documents_of(extractions: DataFrame, *others: str) -> DataFrame:
    """``document_id, pages array<string>`` and the other columns named: the last delivery with pages of each document.

    One exchange; Spark keeps only the first row of each key before it. Whatever follows works on the one row of a document.
    """
    pages = F.transform("raw_text_by_page", lambda p: F.coalesce(p, F.lit("")))
    rows = extractions.where("size(raw_text_by_page) > 0").select("document_id", pages.alias("pages"), F.col("ingested_at").alias("__at"), *others)
    w = Window.partitionBy("document_id").orderBy(F.col("__at").desc_nulls_last(), F.md5(F.array_join("pages", "\f")))
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__at")


def with_pages(extractions: DataFrame, *others: str) -> DataFrame:
    """The same columns of extractions that are one row per document already."""
    pages = F.transform("raw_text_by_page", lambda p: F.coalesce(p, F.lit("")))
    return extractions.where("size(raw_text_by_page) > 0").select("document_id", pages.alias("pages"), *others)


def page_rows(docs: DataFrame) -> DataFrame:
    """One row per page."""
    return docs.select("document_id", F.posexplode("pages").alias("p", "text")).select("document_id", (F.col("p") + 1).alias("page_num"), "text")


def classify(pages: DataFrame) -> DataFrame:
    n = F.length(T.strip(F.col("text")))
    return pages.select("document_id", "page_num", n.alias("char_count"), (n >= GOOD).alias("has_text"), (n < GOOD).alias("is_scanned"), (n < EMPTY).alias("is_empty"), F.least(F.lit(1.0), n / F.lit(float(FULL))).alias("quality_score"))


def _sizes(docs: DataFrame) -> DataFrame:
    """With the characters of each page."""
    return docs.withColumn("__n", of_pages(lambda pages: [len(p.strip()) for p in pages], "array<int>")("pages"))


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _many(c: str, test) -> Column:
    return F.size(F.filter(c, test))


def quality_proxy(docs: DataFrame) -> DataFrame:
    """Share of pages with text, of each document."""
    return _sizes(docs).select("document_id", (_many("__n", lambda n: n >= GOOD) / F.size("__n")).alias("score"))


def inspect(docs: DataFrame) -> DataFrame:
    """Counts and warnings of each document's pages."""
    i = _sizes(docs).select(
        "document_id",
        F.size("__n").alias("page_count"),
        _total(F.col("__n")).alias("chars"),
        _many("__n", lambda n: n >= GOOD).alias("good"),
        F.filter(F.transform("__n", lambda n, k: F.when(n < EMPTY, k + 1)), lambda k: k.isNotNull()).alias("empty_pages"),
    )
    ratio, avg, empty = F.col("good") / F.col("page_count"), F.col("chars") / F.col("page_count"), F.size("empty_pages") / F.col("page_count")
    scanned = ratio < SCANNED
    notes = F.array_compact(
        F.array(
            F.when(scanned, "appears scanned"),
            F.when(empty > EMPTY_SHARE, "many empty pages"),
            F.when((avg < GOOD) & ~scanned, "little text per page"),
        )
    )
    return i.select("document_id", "page_count", F.round(ratio, 3).alias("text_page_ratio"), F.round(avg, 1).alias("avg_chars_per_page"), "empty_pages", (ratio > EMBEDDED).alias("has_embedded_text"), scanned.alias("appears_scanned"), notes.alias("warnings"))


def page_lines(pages: DataFrame) -> DataFrame:
    return pages.select("document_id", "page_num", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))


# What is asked of the lines of one document's pages: one Arrow pass over its row. White space and line ends are Unicode's.
DIGITS = re.compile("[0-9]+")


def short_key(line: str) -> str:
    """A line with its digits ignored."""
    return DIGITS.sub("#", line.strip())


def full_key(line: str) -> str:
    """A line with its digits and case ignored."""
    return DIGITS.sub("#", line.lower()).strip()


def key_counts(pages: Iterable[str], longest: int, key: Callable[[str], str]) -> Counter[str]:
    """The number of pages that each short line's key stands on."""
    n: Counter[str] = Counter()
    for p in pages:
        n.update({key(x) for x in p.splitlines() if 1 <= len(x.strip()) <= longest})
    return n


def repeated(pages: Sequence[str]) -> dict[str, int]:
    """Keys of lines on at least 60 % of the pages of a document of over three pages, with their pages."""
    return {k: n for k, n in key_counts(pages, 120, full_key).items() if n >= 0.6 * len(pages)} if len(pages) > 3 else {}


def duplicate_share(pages: Sequence[str]) -> float:
    """The share of a document's pages with a line that stands on over 60 % of them; 0 below three pages."""
    if len(pages) < 3:
        return 0.0
    bad = {k for k, n in key_counts(pages, 80, short_key).items() if n > 0.6 * len(pages)}
    return sum(any(short_key(x) in bad for x in p.splitlines()) for p in pages) / len(pages) if bad else 0.0


def without_repeated(pages: Sequence[str]) -> list[str]:
    """Pages without the repeated lines; a page of nothing else stays, empty. Blank lines stay, and lines too long to be any."""
    bad = repeated(pages)
    return ["\n".join(x for x in p.splitlines() if len(x.strip()) > 120 or full_key(x) not in bad) for p in pages]


def composed(pages: Sequence[str]) -> list[str]:
    """Compatibility composition, which the JVM lacks."""
    return [unicodedata.normalize("NFKC", p) for p in pages]


def of_pages(f: Callable[[Sequence[str]], object], kind: str) -> Callable[..., Column]:
    """``f`` of every row's pages, null for null."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else f(p) for p in s], dtype=object)

    return run


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """With ``duplicate_line_ratio``."""
    return docs.withColumn("duplicate_line_ratio", F.round(of_pages(duplicate_share, "double")("pages"), 4))


def duplicate_line_ratio(docs: DataFrame) -> DataFrame:
    return duplicate_lines(docs).select("document_id", F.col("duplicate_line_ratio").alias("ratio"))


def boilerplate(docs: DataFrame) -> DataFrame:
    """(document_id, key, n_pages, pages) of the repeated lines."""
    counts = of_pages(repeated, "map<string,int>")("pages")
    return docs.select("document_id", F.size("pages").alias("pages"), F.explode(counts).alias("key", "n_pages")).select("document_id", "key", "n_pages", "pages")


def largest_share(docs: DataFrame) -> DataFrame:
    """The share of its pages that the most repeated line of a document stands on; documents without a line have no row."""
    most = of_pages(lambda pages: max(key_counts(pages, 120, full_key).values(), default=0), "int")("pages")
    return docs.select("document_id", (most / F.size("pages")).alias("share")).where("share > 0")


def strip_boilerplate(docs: DataFrame) -> DataFrame:
    return docs.withColumn("pages", of_pages(without_repeated, "array<string>")("pages"))


def join_pages(docs: DataFrame, sep: str, drop_blank: bool = False) -> DataFrame:
    pages = F.filter("pages", lambda p: T.strip(p) != "") if drop_blank else F.col("pages")
    return docs.select("document_id", F.array_join(pages, sep).alias("text"))


def clean(docs: DataFrame, compose: bool = True) -> DataFrame:
    """Every page cleaned. Only documents with other than ASCII characters go to Python for their composed form."""
    docs = docs.withColumn("pages", F.transform("pages", T.clean_signs))
    if compose:
        odd = F.exists("pages", lambda p: p.rlike(r"[^\x00-\x7F]"))
        docs = docs.withColumn("pages", F.coalesce(of_pages(composed, "array<string>")(F.when(odd, F.col("pages"))), F.col("pages")))
    return docs.withColumn("pages", F.transform("pages", T.clean_breaks))


def normalise(docs: DataFrame, strip_repeated: bool = True, compose: bool = True) -> DataFrame:
    """Whole documents: pages cleaned, repeated lines gone, blank pages dropped, page marks between."""
    made = clean(docs, compose)
    return join_pages(strip_boilerplate(made) if strip_repeated else made, T.PAGE_JOIN, True).select("document_id", T.final_cleanup(F.col("text")).alias("text"))


def validate(docs: DataFrame) -> DataFrame:
    """Score and status of each extraction. Documents without a column ``success`` all succeed."""
    garbage = re.compile(T.GARBAGE)
    ok = F.coalesce(F.col("success"), F.lit(True)) if "success" in docs.columns else F.lit(True)
    v = duplicate_lines(_sizes(docs)).select(
        "document_id",
        ok.alias("ok"),
        F.size("__n").alias("pages"),
        _many("__n", lambda n: n >= GOOD).alias("with_text"),
        _many("__n", lambda n: n < EMPTY).alias("empty"),
        _total(F.col("__n")).alias("chars"),
        of_pages(lambda pages: sum(len(garbage.findall(p)) for p in pages), "int")("pages").alias("g"),
        (_total(F.transform("pages", F.length)) + F.size("pages") - 1).alias("n"),
        "duplicate_line_ratio",
    )
    total = F.greatest(F.col("pages"), F.lit(1))
    cover, avg = F.col("with_text") / total, F.col("chars") / total
    ratio = F.when(F.col("n") > 0, F.col("g") / F.col("n")).otherwise(F.lit(0.0))
    repeated = F.col("duplicate_line_ratio") > REPEATED_MOST
    score = (
        F.lit(1.0)
        - F.when(cover < 0.5, 0.3).otherwise(0.0)
        - F.when(ratio > GARBAGE_MOST, F.least(F.lit(0.3), 3 * ratio)).otherwise(F.lit(0.0))
        - F.when(repeated, 0.1).otherwise(0.0)
        - F.when(avg < THIN, 0.1).otherwise(0.0)
    )
    some = F.col("with_text") > 0
    score = F.when(~some, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    notes = F.array_compact(
        F.array(
            F.when(~some, "no page has text"),
            F.when((cover < 0.5) & some, "low coverage"),
            F.when((ratio > GARBAGE_MOST) & some, "garbage characters"),
            F.when(repeated & some, "repeated lines"),
            F.when((avg < THIN) & some, "thin pages"),
        )
    )
    status = F.when((score == 0) | ~F.col("ok") | (score < FAIL), "failed").when(score < REVIEW, "review_recommended").when(F.size(notes) > 0, "ok_with_warnings").otherwise("ok")
    return v.select("document_id", status.alias("quality_status"), F.round(score, 3).alias("quality_score"), F.col("with_text").alias("pages_with_text"), F.col("empty").alias("pages_empty"), F.round(avg, 1).alias("avg_chars_per_page"), F.round(ratio, 4).alias("garbage_char_ratio"), "duplicate_line_ratio", notes.alias("warnings"))


def layout_votes(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Columns of a layout from text blocks ``document_id, page_num, page_width, x0, text`` of the first five pages.

    documents: ``document_id, page_count``; pages without blocks count among them, and a document without pages is 'unknown'.
    """
    left = F.count_if((T.strip(F.col("text")) != "") & (F.col("x0") < LEFT * F.col("page_width")))
    right = F.count_if((T.strip(F.col("text")) != "") & (F.col("x0") > RIGHT * F.col("page_width")))
    page = blocks.where(F.col("page_num") <= LAYOUT_PAGES).groupBy("document_id", "page_num").agg(left.alias("l"), right.alias("r"))
    found = page.groupBy("document_id").agg(F.count_if((F.col("l") >= 2) & (F.col("r") >= 2)).alias("votes"))
    doc = documents.select("document_id", F.least("page_count", F.lit(LAYOUT_PAGES)).alias("n")).join(found, "document_id", "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    hint = F.when(F.col("n") < 1, "unknown").when(F.col("votes") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2)), "two_column").otherwise("single_column")
    return doc.select("document_id", "votes", hint.alias("layout_hint"))


def choose_extraction(first: DataFrame, second: DataFrame) -> DataFrame:
    """The fallback is tried where under half the pages are good, and taken where it scores 1.3 times as much. Frames: document_id, score, method."""
    j = first.join(second.select("document_id", F.col("score").alias("score2"), F.col("method").alias("method2")), "document_id", "left")
    take = (F.col("score") < FALLBACK_BELOW) & (F.coalesce("score2", F.lit(0.0)) > FALLBACK_GAIN * F.col("score"))
    return j.select("document_id", F.when(take, F.col("method2")).otherwise(F.col("method")).alias("method"), F.when(take, F.col("score2")).otherwise(F.col("score")).alias("score"), take.alias("fallback_used"))


def upgrade_with_ocr(docs: DataFrame) -> DataFrame:
    """A weak page takes the recognised text if that is longer. docs: with ``ocr array<string>``, by page, null for no reading."""
    better = lambda p, o: (F.length(T.strip(p)) < GOOD) & (F.length(T.strip(F.coalesce(o, F.lit("")))) > F.length(p))
    reading = F.coalesce("ocr", F.array().cast("array<string>"))
    chosen = F.transform("pages", lambda p, k: F.when(better(p, F.get(reading, k)), F.get(reading, k)).otherwise(p))
    taken = F.filter(F.transform("pages", lambda p, k: F.when(better(p, F.get(reading, k)), k + 1)), lambda k: k.isNotNull())
    d = docs.withColumn("ocr_pages", taken).withColumn("pages", chosen).drop("ocr")
    return d.withColumn("ocr_used", F.size("ocr_pages") > 0)

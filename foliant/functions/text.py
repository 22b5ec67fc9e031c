"""String expressions on columns. White space is what Python's ``str.strip`` takes for it, whatever the JVM does."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space and line ends as in Unicode text handling.
WS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WS_CLASS = f"[{WS}]"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
PAGE_MARK = "[PAGE_BREAK]"
PAGE_JOIN = "\n\n" + PAGE_MARK + "\n\n"
RAW_JOIN = "\n\f\n"
# Characters that show a failed extraction.
GARBAGE = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\\ufffd\\ufffe\\uffff]"
# What a heading looks like. Only the last ignores case.
HEADINGS = (
    r"^(\d+\.)+\s+\S",
    r"^[IVX]+\.\s+\S",
    r"^[A-Z][A-Z\s\-:]{4,60}$",
    r"(?iu)^(Abstract|Introduction|Methods?|Results?|Discussion|Conclusion|References?|Acknowledgem\w+|Appendix)\b",
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def lines(c: Column) -> Column:
    """The lines of a text without their ends; no line after a final end, none for an empty text."""
    body = F.regexp_replace(c, f"(?:{LINE_END})\\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_END))


def collapse(c: Column) -> Column:
    """White space runs to one blank, trimmed."""
    return strip(F.regexp_replace(c, f"{WS_CLASS}+", " "))


def norm_label(c: Column) -> Column:
    return F.lower(collapse(c))


def final_cleanup(c: Column) -> Column:
    s = F.regexp_replace(c, " {2,}", " ")
    s = F.regexp_replace(s, "\r\n|\r", "\n")
    return strip(F.regexp_replace(s, "\n{3,}", "\n\n"))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; the JVM has no such function. Callers send only texts that are not ASCII."""
    import unicodedata

    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def clean_signs(c: Column) -> Column:
    """Form feeds and control characters of a page, before its characters are composed."""
    return F.regexp_replace(F.regexp_replace(c, "\f", " "), GARBAGE, "")


def clean_breaks(c: Column) -> Column:
    """Hyphenation, blanks at line ends and runs of empty lines, after that."""
    s = F.regexp_replace(c, "-\n([a-záéíóúñü])", "$1")
    s = F.regexp_replace(s, "[ \t]+\n", "\n")
    s = F.regexp_replace(s, "\n[ \t]+", "\n")
    return strip(F.regexp_replace(s, "\n{3,}", "\n\n"))


def clean_page(c: Column, compose: bool = True) -> Column:
    """One page: form feeds, control characters, compatibility forms, hyphenation and blanks at line ends."""
    s = clean_signs(c)
    if compose:
        s = F.when(s.rlike(r"[^\x00-\x7F]"), nfkc(s)).otherwise(s)
    return clean_breaks(s)


def garbage_ratio(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(GARBAGE)) / F.length(c)).otherwise(F.lit(0.0))


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def caption_slug(c: Column) -> Column:
    s = F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", "")
    return F.when(s == "", "").otherwise(F.concat(F.lit("_"), s))


def figure_filename(page: Column, image: Column, label: Column, ext: Column) -> Column:
    return F.concat(F.format_string("p%02d_img%02d", page, image), caption_slug(label), F.lit("."), ext)


def is_heading(line: Column) -> Column:
    s = strip(line)
    hit = F.lit(False)
    for p in HEADINGS:
        hit = hit | s.rlike(p)
    return F.length(s).between(3, 150) & hit


def tail_words(c: Column, n: int) -> Column:
    """The last n characters, begun after the first blank among them if there is one beyond the first place."""
    last = F.right(c, F.lit(n))
    at = F.instr(last, " ")
    return F.when(F.length(c) <= n, c).when(at > 1, F.substring(last, at + 1, F.lit(n))).otherwise(last)


def indent(c: Column, n: int) -> Column:
    return F.regexp_replace(c, "(?m)^", " " * n)


def preview(c: Column, n: int = 220) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def document_id(name: Column) -> Column:
    """A file's id: of its base name, so equal names in other folders are one document."""
    return F.substring(F.sha2(name, 256), 1, 32)


def chunk_id(document: Column, kind: Column, index: Column, text: Column) -> Column:
    """The same chunk gets the same id in every run."""
    return F.substring(F.sha2(F.concat_ws("|", document, kind, index.cast("string"), text), 256), 1, 32)


def table_chunk(label: Column, source: Column, page: Column, caption: Column, markdown: Column) -> Column:
    name = F.coalesce(F.nullif(label, F.lit("")), F.lit("Table"))
    cap = F.when((F.coalesce(caption, F.lit("")) != "") & (caption != name), F.concat(F.lit("Caption: "), caption))
    md = F.when(F.coalesce(markdown, F.lit("")) != "", F.concat(F.lit("Markdown:\n"), markdown))
    return F.concat_ws("\n", F.concat(F.lit("["), name, F.lit("]")), F.concat(F.lit("Paper: "), source), F.concat(F.lit("Page: "), F.coalesce(page.cast("string"), F.lit("?"))), cap, md)


def figure_chunk(label: Column, source: Column, page: Column, caption: Column, around: Column) -> Column:
    name = F.coalesce(F.nullif(label, F.lit("")), F.lit("Figure"))
    cap = F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.lit("Caption: "), caption))
    rel = F.when(F.coalesce(around, F.lit("")) != "", F.concat(F.lit("Related text:\n"), around))
    return F.concat_ws("\n", F.concat(F.lit("["), name, F.lit("]")), F.concat(F.lit("Paper: "), source), F.concat(F.lit("Page: "), F.coalesce(page.cast("string"), F.lit("?"))), cap, rel)


def equation_chunk(label: Column, source: Column, page: Column, text: Column, around: Column) -> Column:
    name = F.coalesce(F.nullif(label, F.lit("")), F.lit("Equation"))
    eq = F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit("Equation:\n"), text))
    rel = F.when(F.coalesce(around, F.lit("")) != "", F.concat(F.lit("Related text:\n"), around))
    return F.concat_ws("\n", F.concat(F.lit("["), name, F.lit("]")), F.concat(F.lit("Paper: "), source), F.concat(F.lit("Page: "), F.coalesce(page.cast("string"), F.lit("?"))), eq, rel)


def _cell(v: Column) -> Column:
    return strip(F.replace(F.replace(F.coalesce(v, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, _cell), " | "), F.lit(" |"))


def markdown(headers: Column, rows: Column) -> Column:
    """A table as text: short rows are filled up, long rows kept. No headers: empty."""
    pad = lambda r: F.concat(r, F.array_repeat(F.lit("").cast("string"), F.greatest(F.lit(0), F.size(headers) - F.size(r))))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.array_join(F.concat(F.array(_row(headers), rule), F.transform(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: _row(pad(r)))), "\n")
    return F.when(F.size(F.coalesce(headers, F.array().cast("array<string>"))) > 0, body).otherwise(F.lit(""))


def clean_table(raw: Column) -> Column:
    """White space in cells collapsed, missing cells null, rows without content gone."""
    cells = F.transform(raw, lambda r: F.transform(r, lambda c: F.when((c.isNotNull()) & (c != ""), collapse(c))))
    return F.filter(cells, lambda r: F.exists(r, lambda c: F.coalesce(c, F.lit("")) != ""))


def citation(authors: Column, year: Column, title: Column, journal: Column, doi: Column) -> Column:
    full = lambda c, a="", b="": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(a), c, F.lit(b)))
    text = F.concat_ws(". ", full(authors), full(year, "(", ")"), full(title, '"', '"'), full(journal), full(doi, "https://doi.org/"))
    return F.when(text == "", "Unknown source").otherwise(text)


def inline_citation(authors: Column, year: Column, title: Column, journal: Column, doi: Column, source: Column) -> Column:
    full = lambda c, a="", b="": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(a), c, F.lit(b)))
    text = F.concat_ws(". ", full(authors), full(year, "(", ")"), full(title, '"', '"'), full(journal), full(doi, "DOI: "))
    return F.when(text == "", source).otherwise(text)

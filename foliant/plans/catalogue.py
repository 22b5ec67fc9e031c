"""All queries of the core, over whole tables, with the SQL that gives the same rows.

Patterns and limits are written out in the SQL, not taken from the engine, so that a slip in the engine shows.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import detect as D
from foliant.functions import text as T
from foliant.operators import chunking, index, linking, pages, report, retrieval, structure
from foliant.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WORDS = "measurement reference"
ONE_DOCUMENT = "(SELECT min(document_id) FROM chunks)"
BIG, DOUBLE, FLAG = "bigint", "double", "boolean"


def query(sql: str | None = None):
    """Registers a query, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def lit(s: str) -> str:
    """As an SQL string."""
    return "'" + s.replace("'", "''") + "'"


def cast(df: DataFrame, kind: str, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(kind) for c in columns})


# Fixed values, as in the engine: white space, line ends, signs of a failed extraction, headings, mentions, facts.
WS = lit(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
WS_CLASS = "[" + WS[1:-1] + "]"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
GARBAGE = lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}\\x{fffd}\\x{fffe}\\x{ffff}]")
HEADING_FORMS = (r"^(\d+\.)+\s+\S", r"^[IVX]+\.\s+\S", r"^[A-Z][A-Z\s\-:]{4,60}$", r"(?i)^(Abstract|Introduction|Methods?|Results?|Discussion|Conclusion|References?|Acknowledgem\w+|Appendix)\b")
FIG_MENTION = r"(?i)\b(fig(?:ure|ura?)?\.?\s*\d+(?:\.\d+)?)"
TABLE_MENTION = r"(?i)\b(tab(?:le|la?)?\.?\s*(?:[IVX]+|\d+))"
EQ_MENTION = r"(?i)\b(eq(?:uation)?s?\.?\s*\(\s*\d{1,3}[a-z]?\s*\)|ecuaci[oó]n\s*\(\s*\d{1,3}[a-z]?\s*\))"
EQ_NUMBER_END = r"\(\s*\d{1,3}[a-z]?\s*\)\s*$"
TABLE_CAPTION = r"(?i)(?:^|\n)\s*(tab(?:le|la?)?\.?\s*(?:[IVX]+|\d+)(?:[.:]\s*[^\n]{0,200})?)"
TABLE_LABEL = r"(?i)^\s*(tab(?:le|la?)?\.?\s*(?:[IVX]+|\d+))"
FIG_LABEL = r"(?i)^\s*(fig(?:ure|ura?)?\.?\s*\d+(?:\.\d+)?)"
MATH_SIGNS = "αβγδεζηθικλμνξοπρστυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ∑∫∂∇±×÷√∞≈≠≤≥∝∈∉⊂⊃∪∩⁰¹²³⁴⁵⁶⁷⁸⁹⁻"
MATH_WORDS = r"\b(COP|NTU|Re|Nu|Pr|Gr|Bi|Fo|Ra|We|Pe|Le|Sh|EER|DIEC|EEI)\b"
DOI = r'(?i)\b(10\.\d{4,9}/[^\s,"\]\[<>(){}|\\^`]{3,})'
YEAR = r"\b(19[5-9]\d|20[0-2]\d)\b"
VOLUME = r"(?i)\bvol(?:ume)?\.?\s*(\d+)"
PAGE_SPAN = r"(?i)\bpp?(?:ages?)?\.\s*(\d{1,6}\s*[-–—]\s*\d{1,6})"
KEYWORDS = r"(?im)^\s*(?:keywords?|index terms?)\s*[:\-]\s*(.+)"
ABSTRACT_HEAD = r"(?im)^\s*abstract\s*[:\-]?\s*$|^\s*abstract\s*[\n\r]"
ABSTRACT_START = r"(?i)\babstract\s*[:\-—]\s*"
ABSTRACT_END = r"(?i)\n\s*(?:[1-9IVX]+[\.\s]|[A-Z]{3,}\s*\n|keywords?|introduction)"
ABSTRACT_LINE = r"(?i)^\s*abstract\s*[:\-]?\s*$"
AFFILIATION = r"(?i)^\s*[\d\*†‡§¶]+\s|university|institute|department|laboratory|lab\b|@[a-z]+\.[a-z]{2,}|corresponding author"
HISTORY = r"(?i)^(?:received|accepted|published|keywords?)"


def line_list(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN []::VARCHAR[] ELSE string_split_regex(regexp_replace({c}, {lit('(' + LINE_END + ')$')}, ''), {lit(LINE_END)}) END"


LATEST_PAGES = """e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ingested_at DESC NULLS LAST, md5(array_to_string(list_transform(raw_text_by_page, lambda p: coalesce(p, '')), chr(12)))) AS rn FROM extractions WHERE len(raw_text_by_page) > 0) WHERE rn = 1)"""


def pages_sql(name: str) -> str:
    return f"{LATEST_PAGES}, {name} AS (SELECT document_id, success, p AS page_num, coalesce(raw_text_by_page[p], '') AS text FROM (SELECT *, unnest(range(1, len(raw_text_by_page) + 1)) AS p FROM e))"


def lines_sql(name: str, source: str, keys: str = "document_id, page_num") -> str:
    return f"{name} AS (SELECT {keys}, k - 1 AS line_no, x[k] AS line FROM (SELECT *, unnest(range(1, len(x) + 1)) AS k FROM (SELECT {keys}, {line_list('text')} AS x FROM {source})))"


PAGES, CLASS, LINES = pages_sql("pages"), f"c AS (SELECT document_id, page_num, length(trim(text, {WS})) AS n FROM pages)", lines_sql("l", "pages")


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, {lit(WS_CLASS + '+')}, ' ', 'g'), {WS})"


def read_documents(spark: SparkSession, d: str, *others: str) -> DataFrame:
    return pages.documents_of(table(spark, d, "extractions"), *others)


# ---- pages and documents


@query(f"WITH {PAGES}, {CLASS} SELECT document_id, page_num, n AS char_count, n >= 50 AS has_text, n < 50 AS is_scanned, n < 10 AS is_empty, round(least(1.0, n / 500.0), 4) AS quality_score FROM c")
def page_classify(spark, d):
    c = pages.classify(pages.page_rows(read_documents(spark, d)))
    return cast(c.withColumn("quality_score", F.round("quality_score", 4)), BIG, "page_num", "char_count")


@query(f"WITH {PAGES}, {CLASS} SELECT document_id, round(avg(CASE WHEN n >= 50 THEN 1.0 ELSE 0.0 END), 4) AS score FROM c GROUP BY 1")
def extraction_quality(spark, d):
    return pages.quality_proxy(read_documents(spark, d)).withColumn("score", F.round("score", 4))


INSPECT = f"""g AS (SELECT document_id, count(*) AS n_pages, sum(n) AS chars, count(*) FILTER (n >= 50) AS good, count(*) FILTER (n < 10) AS empty,
  coalesce(list(page_num ORDER BY page_num) FILTER (n < 10), []) AS empty_list FROM c GROUP BY 1),
inspected AS (SELECT document_id, n_pages AS page_count, round(good / n_pages, 3) AS text_page_ratio, round(chars / n_pages, 1) AS avg_chars_per_page, array_to_string(empty_list, ',') AS empty_pages,
  good / n_pages > 0.1 AS has_embedded_text, good / n_pages < 0.4 AS appears_scanned,
  list_filter([CASE WHEN good / n_pages < 0.4 THEN 'appears scanned' END, CASE WHEN empty / n_pages > 0.15 THEN 'many empty pages' END, CASE WHEN chars / n_pages < 50 AND NOT good / n_pages < 0.4 THEN 'little text per page' END], lambda x: x IS NOT NULL) AS warnings FROM g)"""


@query(f"WITH {PAGES}, {CLASS}, {INSPECT} SELECT * REPLACE (array_to_string(warnings, ',') AS warnings) FROM inspected")
def doc_inspection(spark, d):
    i = pages.inspect(read_documents(spark, d))
    return cast(i, BIG, "page_count").withColumns({"empty_pages": F.array_join(F.transform("empty_pages", lambda x: x.cast("string")), ","), "warnings": F.array_join("warnings", ",")})


DUP = f"""t AS (SELECT document_id, count(DISTINCT page_num) AS n FROM pages GROUP BY 1),
k AS (SELECT DISTINCT document_id, page_num, regexp_replace(trim(line, {WS}), '\\d+', '#', 'g') AS key FROM l WHERE length(trim(line, {WS})) BETWEEN 1 AND 80),
bad AS (SELECT k.document_id, key FROM k JOIN t USING (document_id) GROUP BY 1, 2, n HAVING n >= 3 AND count(*) > 0.6 * n),
hit AS (SELECT l.document_id, count(DISTINCT page_num) AS h FROM l JOIN bad ON l.document_id = bad.document_id AND regexp_replace(trim(line, {WS}), '\\d+', '#', 'g') = bad.key GROUP BY 1),
dup AS (SELECT t.document_id, round(coalesce(h, 0) / n, 4) AS ratio FROM t LEFT JOIN hit USING (document_id))"""


@query(f"WITH {PAGES}, {LINES}, {DUP} SELECT * FROM dup")
def duplicate_line_ratio(spark, d):
    return pages.duplicate_line_ratio(read_documents(spark, d))


VALID = f"""r AS (SELECT document_id, count(*) AS n_pages, count(*) FILTER (n >= 50) AS w, count(*) FILTER (n < 10) AS em, sum(n) AS chars FROM c GROUP BY 1),
gc AS (SELECT document_id, bool_and(success) AS success, sum(length(regexp_replace(text, {GARBAGE}, '', 'g'))) AS clean, sum(length(text)) AS len, sum(length(text)) + count(*) - 1 AS n FROM pages GROUP BY 1),
j AS (SELECT r.*, ratio AS dup, CASE WHEN gc.n > 0 THEN (len - clean) / gc.n ELSE 0.0 END AS garbage, w / n_pages AS cover, chars / n_pages AS mean, success FROM r JOIN gc USING (document_id) JOIN dup USING (document_id)),
s AS (SELECT *, CASE WHEN w = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0 - CASE WHEN cover < 0.5 THEN 0.3 ELSE 0.0 END - CASE WHEN garbage > 0.05 THEN least(0.3, 3 * garbage) ELSE 0.0 END - CASE WHEN dup > 0.15 THEN 0.1 ELSE 0.0 END - CASE WHEN mean < 100 THEN 0.1 ELSE 0.0 END)) END AS score FROM j),
u AS (SELECT *, CASE WHEN w = 0 THEN ['no page has text'] ELSE list_filter([CASE WHEN cover < 0.5 THEN 'low coverage' END, CASE WHEN garbage > 0.05 THEN 'garbage characters' END, CASE WHEN dup > 0.15 THEN 'repeated lines' END, CASE WHEN mean < 100 THEN 'thin pages' END], lambda x: x IS NOT NULL) END AS warnings FROM s),
valid AS (SELECT document_id, CASE WHEN score = 0 OR NOT coalesce(success, true) OR score < 0.25 THEN 'failed' WHEN score < 0.5 THEN 'review_recommended' WHEN len(warnings) > 0 THEN 'ok_with_warnings' ELSE 'ok' END AS quality_status,
  round(score, 3) AS quality_score, w AS pages_with_text, em AS pages_empty, round(mean, 1) AS avg_chars_per_page, round(garbage, 4) AS garbage_char_ratio, dup AS duplicate_line_ratio, warnings FROM u)"""


@query(f"WITH {PAGES}, {LINES}, {DUP}, {CLASS}, {VALID} SELECT * REPLACE (array_to_string(warnings, ',') AS warnings) FROM valid")
def doc_validation(spark, d):
    v = pages.validate(read_documents(spark, d, "success"))
    return cast(v, BIG, "pages_with_text", "pages_empty").withColumn("warnings", F.array_join("warnings", ","))


def boilerplate_sql(source: str, lines: str) -> str:
    return f"""t AS (SELECT document_id, count(DISTINCT page_num) AS n FROM {source} GROUP BY 1),
k AS (SELECT DISTINCT document_id, page_num, trim(regexp_replace(lower(line), '\\d+', '#', 'g'), {WS}) AS key FROM {lines} WHERE length(trim(line, {WS})) BETWEEN 1 AND 120),
b AS (SELECT k.document_id, key, count(*) AS n_pages, n AS pages FROM k JOIN t USING (document_id) GROUP BY 1, 2, n HAVING n > 3 AND count(*) >= 0.6 * n),
kept AS (SELECT z.* FROM {lines} z LEFT JOIN b ON z.document_id = b.document_id AND trim(regexp_replace(lower(line), '\\d+', '#', 'g'), {WS}) = b.key AND length(trim(line, {WS})) <= 120 WHERE b.key IS NULL),
x AS (SELECT document_id, page_num, string_agg(line, chr(10) ORDER BY line_no) AS text FROM kept GROUP BY 1, 2),
stripped AS (SELECT document_id, page_num, coalesce(x.text, '') AS text FROM {source} LEFT JOIN x USING (document_id, page_num))"""


BOIL = f"WITH {PAGES}, {LINES}, {boilerplate_sql('pages', 'l')}"


@query(f"{BOIL} SELECT * FROM b")
def boilerplate_keys(spark, d):
    return cast(pages.boilerplate(read_documents(spark, d)), BIG, "n_pages", "pages")


@query(f"{BOIL} SELECT * FROM stripped")
def boilerplate_strip(spark, d):
    return cast(pages.page_rows(pages.strip_boilerplate(read_documents(spark, d))), BIG, "page_num")


@query(f"""{BOIL}, s AS (SELECT document_id, key, count(*) AS c FROM k GROUP BY 1, 2)
SELECT document_id, round(max(c / n), 4) AS share FROM s JOIN t USING (document_id) GROUP BY 1""")
def repeated_line_share(spark, d):
    return pages.largest_share(read_documents(spark, d)).withColumn("share", F.round("share", 4))


def compatibility() -> str:
    """The rule behind compatibility composition: each character with such a form, and its full decomposition."""
    odd = [(c, x) for c in map(chr, range(0x80, sys.maxunicode + 1)) if (x := unicodedata.normalize("NFKD", c)) != c and unicodedata.normalize("NFKC", c) != unicodedata.normalize("NFC", c)]
    return f"compat(c, d) AS (VALUES {', '.join(f'({lit(c)}, {lit(x)})' for c, x in odd)})"


def composed(source: str, target: str, rest: str) -> str:
    """Texts in compatibility composition: every such character replaced, then composed. Only characters in use are looked up."""
    return f"""{compatibility()}, used AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS c FROM {source}),
m AS (SELECT map_from_entries(coalesce(list((c, d)), [])) AS forms FROM compat WHERE c IN (SELECT c FROM used)),
{target} AS (SELECT {rest}, CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN nfc_normalize(array_to_string(list_transform(string_split(text, ''), lambda h: coalesce(forms[h], h)), '')) ELSE text END AS text FROM {source}, m)"""


FINAL = f"trim(regexp_replace(regexp_replace(regexp_replace(text, ' {{2,}}', ' ', 'g'), '\\r\\n|\\r', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {WS})"
BREAKS = f"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '-\\n([a-záéíóúñü])', '\\1', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n[ \\t]+', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {WS})"""
SIGNS = f"regexp_replace(replace(text, chr(12), ' '), {GARBAGE}, '', 'g')"
NORMAL = f"""{pages_sql('raw')}, p0 AS (SELECT document_id, page_num, {SIGNS} AS text FROM raw), {composed('p0', 'p1', 'document_id, page_num')},
pages AS (SELECT document_id, page_num, {BREAKS} AS text FROM p1), {LINES}, {boilerplate_sql('pages', 'l')},
docs AS (SELECT document_id, {FINAL} AS text FROM (SELECT document_id, coalesce(string_agg(text, chr(10) || chr(10) || '[PAGE_BREAK]' || chr(10) || chr(10) ORDER BY page_num) FILTER (trim(text, {WS}) <> ''), '') AS text FROM stripped GROUP BY 1))"""


@query(f"WITH {NORMAL} SELECT document_id, text FROM docs")
def normalised_documents(spark, d):
    """Cleaned, composed, stripped and joined."""
    return pages.normalise(read_documents(spark, d))


@query(f"WITH {PAGES}, s AS (SELECT document_id, page_num, {SIGNS} AS text FROM pages) SELECT document_id, page_num, {BREAKS} AS text FROM s")
def clean_pages(spark, d):
    """Page cleaning but for the composition of compatibility forms."""
    return cast(pages.page_rows(pages.clean(read_documents(spark, d), compose=False)), BIG, "page_num")


@query(f"WITH {composed('documents', 'made', 'doc_id')} SELECT doc_id, text FROM made")
def nfkc_documents(spark, d):
    """Every document; texts of ASCII only are in the form already and never leave the JVM."""
    t, docs = F.col("text"), table(spark, d, "documents")
    odd = t.rlike(r"[^\x00-\x7F]")
    return docs.where(odd).select("doc_id", T.nfkc(t).alias("text")).unionByName(docs.where(t.isNull() | ~odd).select("doc_id", "text"))


@query(f"SELECT doc_id, {FINAL} AS text FROM documents")
def final_cleanup(spark, d):
    return table(spark, d, "documents").select("doc_id", T.final_cleanup(F.col("text")).alias("text"))


@query(f"WITH {LATEST_PAGES} SELECT document_id, md5(array_to_string(list_transform(raw_text_by_page, lambda p: coalesce(p, '')), chr(10) || chr(12) || chr(10))) AS joined FROM e")
def joined_pages(spark, d):
    return pages.join_pages(read_documents(spark, d), T.RAW_JOIN).select("document_id", F.md5("text").alias("joined"))


# ---- chunks

ADAPTED = "docs AS (SELECT doc_id AS document_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents WHERE text IS NOT NULL), src AS (SELECT document_id, 0 AS section_no, text, false AS entire FROM docs)"


def adapted(spark: SparkSession, d: str) -> DataFrame:
    """Documents with each line a paragraph."""
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("document_id"), F.regexp_replace("text", "\n", "\n\n").alias("text"))


def fill_sql(units: str, keys: str) -> str:
    """``filled``: runs of units (keys, g, k, u, weight, sep) that add up to 1,000 at most, or one unit. g: units of other g never share a run."""
    on = " AND ".join(f"f.{c} = q.{c}" for c in keys.split(", "))
    return f"""grp AS (SELECT {keys}, g, sep, list(u ORDER BY k) AS us, list(cum ORDER BY k) AS cums FROM (SELECT *, sum(weight) OVER (PARTITION BY {keys}, g ORDER BY k) AS cum FROM {units}) GROUP BY ALL),
f AS (SELECT {keys}, g, 1 AS i, greatest(1, len(list_filter(cums, lambda c: c <= 1000))) AS j FROM grp
  UNION ALL SELECT {', '.join('q.' + c for c in keys.split(', '))}, q.g, f.j + 1, greatest(f.j + 1, len(list_filter(q.cums, lambda c: c - q.cums[f.j] <= 1000))) FROM f JOIN grp q ON {on} AND f.g = q.g WHERE f.j < len(q.us)),
filled AS (SELECT {', '.join('q.' + c for c in keys.split(', '))}, q.g, f.i, CASE WHEN q.sep = ' ' THEN array_to_string(q.us[f.i:f.j], ' ') ELSE array_to_string(q.us[f.i:f.j], chr(10) || chr(10)) END AS text FROM f JOIN grp q ON {on} AND f.g = q.g)"""


def words_sql(c: str) -> str:
    return f"list_filter(string_split_regex({c}, {lit(WS_CLASS + '+')}), lambda w: w <> '')"


# pieces of src (document_id, section_no, text, entire); a paragraph of over 3,000 characters is a group of words of its own
PACK = f"""para AS (SELECT document_id, section_no, k, ps[k] AS p FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM (SELECT document_id, section_no, list_filter(list_transform(string_split_regex(text, '\\n{{2,}}|\\[PAGE_BREAK\\]'), lambda x: trim(x, {WS})), lambda x: x <> '') AS ps FROM src WHERE NOT entire))),
runs AS (SELECT *, sum((length(p) > 3000)::INT) OVER (PARTITION BY document_id, section_no ORDER BY k) AS before FROM para),
units AS (SELECT document_id, section_no, 2 * before AS g, k, p AS u, length(p) AS weight, chr(10) || chr(10) AS sep FROM runs WHERE length(p) <= 3000
  UNION ALL SELECT document_id, section_no, 2 * before - 1, k, ws[k], length(ws[k]) + 1, ' ' FROM (SELECT document_id, section_no, before, ws, unnest(range(1, len(ws) + 1)) AS k FROM (SELECT document_id, section_no, before, {words_sql('p')} AS ws FROM runs WHERE length(p) > 3000))),
{fill_sql('units', 'document_id, section_no')},
pieces AS (SELECT document_id, section_no, g, i, text FROM filled UNION ALL SELECT document_id, section_no, 0, 0, text FROM src WHERE entire OR (document_id, section_no) NOT IN (SELECT (document_id, section_no) FROM para)),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY section_no, g, i) - 1 AS pos FROM pieces)"""
TAIL = "CASE WHEN length(b) <= 150 THEN b WHEN instr(right(b, 150), ' ') > 1 THEN substr(right(b, 150), instr(right(b, 150), ' ') + 1) ELSE right(b, 150) END"
LAPPED = f"""o AS (SELECT *, lag(text) OVER (PARTITION BY document_id ORDER BY pos) AS b, row_number() OVER (PARTITION BY document_id, section_no ORDER BY pos) = 1 AS opens FROM r),
x1 AS (SELECT document_id, section_no, opens, pos, trim(CASE WHEN b IS NULL THEN text ELSE {TAIL} || chr(10) || text END, {WS}) AS text FROM o),
made AS (SELECT document_id, section_no, opens, row_number() OVER (PARTITION BY document_id ORDER BY pos) - 1 AS chunk_index, text, length(text) AS char_count, greatest(1, length(text) // 4) AS token_estimate FROM x1 WHERE length(text) >= 100)"""


@query(f"WITH RECURSIVE {ADAPTED}, {PACK} SELECT document_id, pos, text FROM r")
def paragraph_chunks(spark, d):
    return cast(chunking.paragraph_pieces(adapted(spark, d)), BIG, "pos")


@query(f"""WITH RECURSIVE w AS (SELECT doc_id, {words_sql('text')} AS ws FROM documents WHERE text IS NOT NULL), units AS (SELECT doc_id, 0 AS g, k, ws[k] AS u, length(ws[k]) + 1 AS weight, ' ' AS sep FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM w)), {fill_sql('units', 'doc_id')}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, text FROM filled""")
def hard_split(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return cast(chunking.word_pieces(docs), BIG, "pos").withColumnRenamed("document_id", "doc_id")


@query(f"WITH RECURSIVE {ADAPTED}, {PACK}, {LAPPED} SELECT document_id, chunk_index, text, char_count, token_estimate FROM made")
def overlap_chunks(spark, d):
    return cast(chunking.overlapped_pieces(adapted(spark, d)), BIG, "chunk_index", "char_count", "token_estimate")


HEAD = f"length(s) BETWEEN 3 AND 150 AND ({' OR '.join(f'regexp_matches(s, {lit(h)})' for h in HEADING_FORMS)})"


def sections_sql(source: str) -> str:
    """``s``: document_id, section_no, text, heading of the texts of ``source``, blank sections left out."""
    return f"""{lines_sql('sl', source, 'document_id')}, h AS (SELECT *, trim(line, {WS}) AS s FROM sl), hd AS (SELECT *, {HEAD} AS head FROM h),
z AS (SELECT *, sum(head::INT) OVER (PARTITION BY document_id ORDER BY line_no) AS section_no FROM hd),
s AS (SELECT * FROM (SELECT document_id, section_no, trim(string_agg(line, chr(10) ORDER BY line_no), {WS}) AS text, first(CASE WHEN head THEN substr(s, 1, 200) END ORDER BY line_no) AS heading FROM z GROUP BY ALL) WHERE text <> '')"""


PLACED = f"""full_text AS (SELECT document_id, {collapse('text')} AS whole FROM docs), cutup AS (SELECT *, string_split(whole, '[PAGE_BREAK]') AS parts FROM full_text),
starts AS (SELECT document_id, whole, list_prepend(0, list_transform(range(1, len(parts)), lambda q: list_sum(list_transform(parts[1:q], lambda y: length(y) + 12)))) AS marks FROM cutup),
hits AS (SELECT made.*, whole, marks, list_filter(list_transform([0, 50, 100, 150, 200, 250, 300, 350], lambda q: CASE WHEN length(text) > q AND {collapse('substr(text, q + 1, 120)')} <> '' THEN nullif(strpos(whole, {collapse('substr(text, q + 1, 120)')}), 0) END), lambda y: y IS NOT NULL)[1] - 1 AS hit FROM made JOIN starts USING (document_id))"""


@query(f"""WITH RECURSIVE {NORMAL}, {sections_sql('docs')}, many AS (SELECT document_id FROM s GROUP BY 1 HAVING count(*) >= 3),
src AS (SELECT document_id, section_no, text, length(text) <= 3000 AS entire FROM s WHERE document_id IN (SELECT document_id FROM many) UNION ALL SELECT document_id, 0, text, false FROM docs WHERE document_id NOT IN (SELECT document_id FROM many)),
{PACK}, {LAPPED}, {PLACED}
SELECT hits.document_id, chunk_index, CASE WHEN opens AND hits.document_id IN (SELECT document_id FROM many) THEN heading END AS section_title, hits.text, char_count, token_estimate,
  CASE WHEN hit IS NULL THEN 1 ELSE len(list_filter(marks, lambda y: y <= hit)) END AS page_start, CASE WHEN hit IS NULL THEN 1 ELSE len(list_filter(marks, lambda y: y <= hit + length({collapse('hits.text')}))) END AS page_end
FROM hits LEFT JOIN s ON hits.document_id = s.document_id AND hits.section_no = s.section_no""")
def document_chunks(spark, d):
    """The whole chunker over normalised extractions, with page ranges."""
    return cast(chunking.chunk(pages.normalise(read_documents(spark, d))), BIG, "chunk_index", "char_count", "token_estimate", "page_start", "page_end")


@query(f"WITH {PAGES}, leaf AS (SELECT document_id || '#' || page_num AS document_id, text FROM pages), {sections_sql('leaf')} SELECT document_id, section_no, heading, text FROM s")
def heading_sections(spark, d):
    """Sections of every page."""
    p = pages.page_rows(read_documents(spark, d)).select(F.concat("document_id", F.lit("#"), F.col("page_num").cast("string")).alias("document_id"), "text")
    return cast(chunking.sections(p), BIG, "section_no")


TABLE_TEXT = """concat_ws(chr(10), '[' || coalesce(nullif(label, ''), 'Table') || ']', 'Paper: ' || paper_id, 'Page: ' || coalesce(page::VARCHAR, '?'),
  CASE WHEN coalesce(caption, '') <> '' AND caption <> coalesce(nullif(label, ''), 'Table') THEN 'Caption: ' || caption END, CASE WHEN coalesce(markdown, '') <> '' THEN 'Markdown:' || chr(10) || markdown END)"""
EQ_TEXT = """concat_ws(chr(10), '[' || coalesce(nullif(label, ''), 'Equation') || ']', 'Paper: ' || paper_id, 'Page: ' || coalesce(page::VARCHAR, '?'),
  CASE WHEN coalesce(text, '') <> '' THEN 'Equation:' || chr(10) || text END, CASE WHEN coalesce(surrounding_text, '') <> '' THEN 'Related text:' || chr(10) || surrounding_text END)"""


@query(f"""WITH a AS (SELECT paper_id AS document_id, 'table' AS chunk_type, table_id AS source_id, page AS page_start, page AS page_end, label AS section_title, 1.0 AS quality_score, 'table_extractor' AS extraction_method, trim({TABLE_TEXT}, {WS}) AS text FROM paper_tables
UNION ALL SELECT paper_id, 'equation', equation_id, page, page, label, 0.9, 'equation_extractor', trim({EQ_TEXT}, {WS}) FROM equations) SELECT * REPLACE (quality_score::DOUBLE AS quality_score) FROM a WHERE length(text) >= 100""")
def special_chunks(spark, d):
    return chunking.special_chunks(table(spark, d, "paper_tables"), table(spark, d, "equations"), None, F.col("paper_id"))


CELL = "trim(replace(replace(coalesce(c, ''), '|', '\\|'), chr(10), ' '), " + WS + ")"


@query(f"""SELECT table_id, CASE WHEN len(coalesce(headers, [])) = 0 THEN '' ELSE array_to_string(list_concat(['| ' || array_to_string(list_transform(headers, lambda c: {CELL}), ' | ') || ' |', '| ' || array_to_string(list_transform(headers, lambda c: '---'), ' | ') || ' |'],
  list_transform(coalesce(rows, []), lambda r: '| ' || array_to_string(list_transform(list_concat(r, list_transform(range(greatest(0, len(headers) - len(r))), lambda q: '')), lambda c: {CELL}), ' | ') || ' |')), chr(10)) END AS markdown FROM paper_tables""")
def markdown_tables(spark, d):
    return table(spark, d, "paper_tables").select("table_id", T.markdown(F.col("headers"), F.col("rows")).alias("markdown"))


@query(f"""WITH x AS (SELECT table_id, list_filter(list_transform(list_concat([headers], coalesce(rows, [])), lambda r: list_transform(r, lambda c: CASE WHEN c <> '' THEN {collapse('c')} END)), lambda r: len(list_filter(r, lambda c: coalesce(c, '') <> '')) > 0) AS t FROM paper_tables)
SELECT table_id, len(t) AS n_rows, md5(array_to_string(list_transform(t, lambda r: array_to_string(list_transform(r, lambda c: coalesce(c, '~')), '|')), '/')) AS cells FROM x""")
def clean_tables(spark, d):
    raw = F.concat(F.array("headers"), F.coalesce("rows", F.array().cast("array<array<string>>")))
    x = table(spark, d, "paper_tables").select("table_id", T.clean_table(raw).alias("t"))
    flat = F.array_join(F.transform("t", lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit("~"))), "|")), "/")
    return x.select("table_id", F.size("t").cast("bigint").alias("n_rows"), F.md5(flat).alias("cells"))


@query("""SELECT table_id, substr(trim(regexp_replace(lower(coalesce(label, 'table')), '[^a-z0-9]+', '_', 'g'), '_'), 1, 20) || '_' || table_id || '.csv' AS file, k - 1 AS row_no,
  array_to_string(list_transform(cells[k], lambda c: CASE WHEN regexp_matches(coalesce(c, ''), '[",\\n]') THEN '"' || replace(c, '"', '""') || '"' ELSE coalesce(c, '') END), ',') AS line
FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS k FROM (SELECT table_id, label, list_concat([headers], coalesce(rows, [])) AS cells FROM paper_tables))""")
def table_csv(spark, d):
    from foliant.sources.writers import table_csv_rows

    return cast(table_csv_rows(table(spark, d, "paper_tables")), BIG, "row_no")


# ---- index

LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM chunks) WHERE rn = 1)"


def current(spark: SparkSession, d: str) -> DataFrame:
    return index.latest(table(spark, d, "chunks"), ["chunk_id"], "ingested_at")


@query("SELECT chunk_id, max(ingested_at) AS ingested_at FROM chunks GROUP BY 1")
def latest_chunks(spark, d):
    return current(spark, d).select("chunk_id", "ingested_at")


@query("SELECT DISTINCT chunk_id, document_id, chunk_index FROM chunks WHERE contains(lower(text), 'measurement') AND contains(lower(text), 'reference')")
def keyword_matches(spark, d):
    return index.keyword_matches(table(spark, d, "chunks"), WORDS).select("chunk_id", "document_id", "chunk_index").distinct()


@query(f"WITH {LATEST} SELECT chunk_id, document_id, chunk_index, substr(text, 1, 200) AS preview FROM latest WHERE contains(lower(text), 'measurement') AND contains(lower(text), 'reference') ORDER BY document_id, chunk_index, chunk_id LIMIT 20")
def keyword_chunks(spark, d):
    hits = index.keyword_search(index.latest_matches(table(spark, d, "chunks"), WORDS, "chunk_id", "ingested_at"), WORDS, 20, ["document_id", "chunk_index", "chunk_id"])
    return hits.select("chunk_id", "document_id", "chunk_index", F.substring("text", 1, 200).alias("preview"))


@query("SELECT count(*) AS total_chunks, count(DISTINCT coalesce(document_id, 'unknown')) AS total_documents, false AS has_embeddings FROM chunks")
def index_stats(spark, d):
    return index.index_stats(table(spark, d, "chunks"))


PAPER = "paper AS (SELECT paper_id AS document_id, max(title) AS title, max(authors) AS authors, max(year) AS year, max(doi) AS doi, max(journal) AS journal, max(citation_key) AS citation_key FROM academic GROUP BY 1)"


def papers(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "academic")
    return a.groupBy("paper_id").agg(*[F.max(c).alias(c) for c in ("title", "authors", "year", "doi", "journal", "citation_key")])


@query(f"WITH {PAPER}, g AS (SELECT document_id, min(source_file) AS source_file, count(*) AS chunks FROM chunks WHERE coalesce(document_id, '') <> '' GROUP BY 1) SELECT g.*, title, authors, year, citation_key FROM g LEFT JOIN paper USING (document_id)")
def list_documents(spark, d):
    return index.list_documents(table(spark, d, "chunks"), papers(spark, d))


def first_document(spark: SparkSession, d: str) -> str:
    return table(spark, d, "chunks").agg(F.min("document_id")).first()[0]


@query(f"SELECT document_id, count(*) AS n FROM chunks WHERE document_id IS DISTINCT FROM {ONE_DOCUMENT} GROUP BY 1")
def remove_document(spark, d):
    return index.remove_document(table(spark, d, "chunks"), first_document(spark, d)).groupBy("document_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT document_id FROM extractions WHERE document_id NOT IN (SELECT document_id FROM chunks WHERE document_id IS NOT NULL)")
def new_documents(spark, d):
    return index.new_documents(table(spark, d, "extractions").select("document_id").distinct(), table(spark, d, "chunks"))


REPLACED = """WITH old AS (SELECT * FROM chunks WHERE chunk_type = 'text'), inc AS (SELECT * FROM chunks WHERE chunk_type <> 'text')
SELECT document_id, chunk_type, count(*) AS n FROM (SELECT document_id, chunk_type FROM old WHERE document_id NOT IN (SELECT document_id FROM inc WHERE document_id IS NOT NULL) UNION ALL SELECT document_id, chunk_type FROM inc) GROUP BY 1, 2"""


@query(REPLACED)
def replace_documents(spark, d):
    c = table(spark, d, "chunks").where("document_id is not null")
    return index.replace_documents(c.where("chunk_type = 'text'"), c.where("chunk_type <> 'text'")).groupBy("document_id", "chunk_type").agg(F.count("*").alias("n"))


@query("SELECT chunk_type, count(*) AS n FROM (SELECT chunk_id, chunk_type FROM chunks WHERE chunk_type = 'text' UNION ALL SELECT table_id, 'table' FROM paper_tables UNION ALL SELECT equation_id, 'equation' FROM equations) GROUP BY 1")
def union_chunks(spark, d):
    a = table(spark, d, "chunks").where("chunk_type = 'text'").select("chunk_id", "chunk_type")
    b = table(spark, d, "paper_tables").select(F.col("table_id").alias("chunk_id"), F.lit("table").alias("chunk_type"))
    c = table(spark, d, "equations").select(F.col("equation_id").alias("chunk_id"), F.lit("equation").alias("chunk_type"))
    return a.unionByName(b).unionByName(c).groupBy("chunk_type").agg(F.count("*").alias("n"))


@query(f"WITH {PAPER} SELECT chunk_id, document_id, source_file, page_start, page_end, chunk_index, extraction_method, coalesce(section_title, '') AS section_title, coalesce(title, '') AS title, coalesce(authors, '') AS authors, coalesce(year, '') AS year, coalesce(doi, '') AS doi, coalesce(journal, '') AS journal, coalesce(citation_key, '') AS citation_key FROM chunks LEFT JOIN paper USING (document_id)")
def chunk_metadata(spark, d):
    return index.vector_rows(table(spark, d, "chunks"), papers(spark, d))


@query(f"WITH {PAPER} SELECT p.document_id AS paper_id, coalesce(nullif(x.title, ''), p.title) AS title, coalesce(nullif(x.authors, ''), p.authors) AS authors, coalesce(nullif(x.year, ''), p.year) AS year, p.doi FROM paper p LEFT JOIN (SELECT document_id, max(section_title) AS title, '' AS authors, max(created_at)[1:4] AS year FROM chunks WHERE chunk_type = 'table' GROUP BY 1) x USING (document_id)")
def paper_info(spark, d):
    x = table(spark, d, "chunks").where("chunk_type = 'table'").groupBy("document_id").agg(F.max("section_title").alias("title"), F.lit("").alias("authors"), F.substring(F.max("created_at"), 1, 4).alias("year"))
    return index.paper_info(papers(spark, d), x)


@query(f"SELECT chunk_id, chunk_index, text, total FROM (SELECT *, count(*) OVER () AS total FROM chunks WHERE document_id = {ONE_DOCUMENT}) ORDER BY chunk_index, chunk_id LIMIT 20")
def paper_chunks(spark, d):
    return index.paper_chunks(table(spark, d, "chunks"), first_document(spark, d), 20).select("chunk_id", "chunk_index", "text", "total")


@query(f"""WITH {LATEST} SELECT chunk_id, document_id, lag(chunk_id) OVER w AS before_id, lead(chunk_id) OVER w AS after_id, count(*) OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n_near FROM latest WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index, chunk_id)""")
def context_window(spark, d):
    w = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")
    c = current(spark, d)
    return c.select("chunk_id", "document_id", F.lag("chunk_id").over(w).alias("before_id"), F.lead("chunk_id").over(w).alias("after_id"), F.count("*").over(w.rowsBetween(-2, 2)).alias("n_near"))


# ---- structure


def mention_sql(pattern: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all(text, {lit(pattern)}, 1), lambda m: lower({collapse('m')}))))"


MENTIONS = f"""m AS (SELECT document_id, chunk_id, {mention_sql(FIG_MENTION)} AS f, {mention_sql(TABLE_MENTION)} AS t, {mention_sql(EQ_MENTION)} AS e FROM chunks)"""


@query(f"WITH {MENTIONS} SELECT document_id, chunk_id, array_to_string(f, ';') AS figures, array_to_string(t, ';') AS tables, array_to_string(e, ';') AS equations FROM m")
def chunk_links(spark, d):
    c = linking.link_chunks(table(spark, d, "chunks"))
    return c.select("document_id", "chunk_id", *[F.array_join(f"linked_{k}", ";").alias(k) for k in ("figures", "tables", "equations")])


def linked_sql(kind: str, source: str, key: str) -> str:
    return f"""WITH {MENTIONS}, r AS (SELECT DISTINCT document_id, chunk_id, unnest({kind}) AS label_norm FROM m),
x AS (SELECT paper_id AS document_id, {key}, label, lower({collapse('label')}) AS label_norm FROM {source})
SELECT x.document_id, x.{key}, x.label, coalesce(string_agg(DISTINCT r.chunk_id, ';' ORDER BY r.chunk_id), '') AS chunks FROM x LEFT JOIN r ON x.document_id = r.document_id AND x.label_norm = r.label_norm GROUP BY ALL"""


@query(linked_sql("t", "paper_tables", "table_id"))
def table_mentions(spark, d):
    e = table(spark, d, "paper_tables").withColumnRenamed("paper_id", "document_id")
    return linking.mentioned_in(e, table(spark, d, "chunks"), "table", "table_id").select("document_id", "table_id", "label", F.array_join("mentioned_in_chunks", ";").alias("chunks"))


@query(linked_sql("e", "equations", "equation_id"))
def equation_mentions(spark, d):
    e = table(spark, d, "equations").withColumnRenamed("paper_id", "document_id")
    return linking.mentioned_in(e, table(spark, d, "chunks"), "equation", "equation_id").select("document_id", "equation_id", "label", F.array_join("mentioned_in_chunks", ";").alias("chunks"))


LABEL = f"coalesce(nullif(trim(regexp_extract(s, {lit(EQ_MENTION)}, 1), {WS}), ''), nullif(trim(regexp_extract(s, {lit(EQ_NUMBER_END)}), {WS}), ''))"
BARE = "regexp_replace(s, '\\s', '', 'g')"
DENSE = f"length({BARE}) >= 8 AND (length({BARE}) - length(regexp_replace({BARE}, {lit('[' + MATH_SIGNS + ']')}, '', 'g'))) / length({BARE}) >= 0.1"


@query(f"""WITH {PAGES}, {LINES}, a AS (SELECT *, trim(line, {WS}) AS s FROM l), w AS (SELECT *, list({{'n': line_no, 's': s}}) OVER (PARTITION BY document_id, page_num ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM a),
b AS (SELECT *, {LABEL} AS label FROM w WHERE length(s) >= 5), c AS (SELECT * FROM b WHERE label IS NOT NULL OR ({DENSE}) OR regexp_matches(s, {lit(MATH_WORDS)})),
f AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_num, coalesce(label, substr(s, 1, 40)) ORDER BY line_no) AS rn FROM c)
SELECT document_id, page_num, line_no, label, s AS text, substr(array_to_string(list_transform(list_filter(near, lambda x: x.n <> line_no AND x.s <> '' AND x.s <> s), lambda x: x.s), ' | '), 1, 300) AS surrounding_text FROM f WHERE rn = 1""")
def equation_lines(spark, d):
    e = structure.equations(pages.page_rows(read_documents(spark, d)))
    return e.withColumns({"page_num": F.col("page_num").cast("bigint"), "line_no": F.col("line_no").cast("bigint")})


@query("SELECT paper_id, " + f"CASE WHEN t = '' THEN 'Unknown source' ELSE t END AS citation, CASE WHEN u = '' THEN source_file ELSE u END AS inline_citation FROM (SELECT paper_id, source_file, concat_ws('. ', nullif(authors, ''), '(' || nullif(year, '') || ')', '\"' || nullif(title, '') || '\"', nullif(journal, ''), 'https://doi.org/' || nullif(doi, '')) AS t, concat_ws('. ', nullif(authors, ''), '(' || nullif(year, '') || ')', '\"' || nullif(title, '') || '\"', nullif(journal, ''), 'DOI: ' || nullif(doi, '')) AS u FROM academic)")
def citations(spark, d):
    a = [F.col(c) for c in ("authors", "year", "title", "journal", "doi")]
    return table(spark, d, "academic").select("paper_id", T.citation(*a).alias("citation"), T.inline_citation(*a, F.col("source_file")).alias("inline_citation"))


KEY = """SELECT paper_id, coalesce(CASE WHEN w IS NOT NULL THEN upper(w[1]) || lower(w[2:]) END, CASE WHEN f <> '' THEN upper(f[1]) || lower(f[2:]) END, 'Unknown') || coalesce(nullif(year, ''), '????') AS made_key FROM
(SELECT paper_id, year, list_filter(string_split_regex(authors, '[,;&\\s]+'), lambda t: length(t) > 3 AND regexp_matches(t, '^\\p{L}+$'))[1] AS w, regexp_replace(string_split_regex(title, '\\s+')[1], '[^A-Za-z]', '', 'g') AS f FROM academic)"""


@query(KEY)
def citation_keys(spark, d):
    return table(spark, d, "academic").select("paper_id", D.citation_key(F.col("authors"), F.col("year"), F.col("title")).alias("made_key"))


@query(f"""SELECT chunk_id, rtrim(nullif(regexp_extract(text, {lit(DOI)}, 1), ''), '.') AS doi, list_max(regexp_extract_all(text, {lit(YEAR)}, 1)) AS year, nullif(regexp_extract(text, {lit(VOLUME)}, 1), '') AS volume,
regexp_replace(regexp_replace(nullif(regexp_extract(text, {lit(PAGE_SPAN)}, 1), ''), '[–—]', '-', 'g'), '\\s+', '', 'g') AS page_range, nullif(substr(trim(trim(nullif(regexp_extract(text, {lit(KEYWORDS)}, 1), ''), {WS}), ';., '), 1, 300), '') AS keywords FROM chunks""")
def bibliographic_facts(spark, d):
    t = F.col("text")
    return table(spark, d, "chunks").select("chunk_id", D.doi(t).alias("doi"), D.year(t).alias("year"), D.volume(t).alias("volume"), D.page_range(t).alias("page_range"), D.keywords(t).alias("keywords"))


NO_PAGE = "coalesce(list_position(list_transform({}, lambda y: regexp_matches(y, {})), true), 0)"
AUTHORS = f"""a1 AS (SELECT *, {line_list('page1')} AS rows FROM front), a2 AS (SELECT *, {NO_PAGE.format('rows', lit(ABSTRACT_LINE))} AS stop FROM a1),
a3 AS (SELECT *, list_transform(rows[2:1 + least(CASE WHEN stop > 0 THEN stop - 1 ELSE len(rows) END - 1, 15)], lambda y: trim(y, {WS})) AS near FROM a2),
a4 AS (SELECT *, list_filter(near, lambda y: y <> '' AND length(y) <= 200 AND NOT (upper(y) = y AND lower(y) <> y) AND NOT regexp_matches(y, {lit(AFFILIATION)})) AS names FROM a3),
a5 AS (SELECT *, {NO_PAGE.format('names', lit(HISTORY))} AS off FROM a4),
a6 AS (SELECT *, array_to_string(names[1:CASE WHEN off > 0 THEN off - 1 ELSE len(names) END], ', ') AS joined FROM a5),
a7 AS (SELECT *, nullif(substr(trim({collapse("regexp_replace(regexp_replace(joined, '[0-9*†‡§¶]+', '', 'g'), '\\s*,\\s*,\\s*', ', ', 'g')")}, ', '), 1, 500), '') AS authors FROM a6)"""
# the SQL's patterns have no look-ahead: an inline abstract is its first 50 characters and what follows up to an empty line or the end
INLINE = f"regexp_extract(t, {lit('(?s)' + ABSTRACT_START + '(.{50}.*)')}, 1)"
ABSTRACTS = f"""b1 AS (SELECT *, regexp_matches(t, {lit(ABSTRACT_HEAD)}) AS headed, regexp_extract(t, {lit('(?s)(' + ABSTRACT_HEAD + ')(.*)')}, 2) AS rest, {INLINE} AS line1 FROM a7),
b2 AS (SELECT *, substr(line1, 1, 50) || regexp_extract(substr(line1, 51), '(?s)^(.*?)(?:\\n\\s*\\n|\\z)', 1) AS inlined FROM b1),
b3 AS (SELECT *, {collapse(f"CASE WHEN headed THEN CASE WHEN regexp_matches(rest, {lit(ABSTRACT_END)}) THEN regexp_replace(rest, {lit('(?s)' + ABSTRACT_END + '.*')}, '') ELSE substr(rest, 1, 2000) END WHEN length(inlined) <= 1500 THEN inlined ELSE '' END")} AS body FROM b2)"""


@query(f"""WITH {LATEST_PAGES}, front AS (SELECT document_id, array_to_string(list_transform(raw_text_by_page[1:3], lambda p: coalesce(p, '')), chr(10)) AS t, coalesce(raw_text_by_page[1], '') AS page1 FROM e), {AUTHORS}, {ABSTRACTS},
b4 AS (SELECT document_id, NULL::VARCHAR AS title, authors, list_max(regexp_extract_all(t, {lit(YEAR)}, 1)) AS year, rtrim(nullif(regexp_extract(t, {lit(DOI)}, 1), ''), '.') AS doi, CASE WHEN length(body) >= 30 THEN substr(body, 1, 2000) END AS abstract,
  nullif(substr(trim(trim(nullif(regexp_extract(t, {lit(KEYWORDS)}, 1), ''), {WS}), ';., '), 1, 300), '') AS keywords, nullif(regexp_extract(t, {lit(VOLUME)}, 1), '') AS volume,
  regexp_replace(regexp_replace(nullif(regexp_extract(t, {lit(PAGE_SPAN)}, 1), ''), '[–—]', '-', 'g'), '\\s+', '', 'g') AS pages, NULL::VARCHAR AS journal, list_filter(string_split_regex(authors, '[,;&\\s]+'), lambda y: length(y) > 3 AND regexp_matches(y, '^\\p{{L}}+$'))[1] AS w FROM b3)
SELECT * EXCLUDE (w), coalesce(CASE WHEN w IS NOT NULL THEN upper(w[1]) || lower(w[2:]) END, 'Unknown') || coalesce(nullif(year, ''), '????') AS citation_key FROM b4""")
def academic_metadata(spark, d):
    return structure.academic(read_documents(spark, d))


@query(f"SELECT table_id, trim(regexp_replace(lower(coalesce(label, '')), '[^a-z0-9]+', '_', 'g'), '_') AS slug, CASE WHEN regexp_replace(coalesce(label, ''), '[^A-Za-z0-9]', '', 'g') = '' THEN '' ELSE '_' || regexp_replace(label, '[^A-Za-z0-9]', '', 'g') END AS caption_slug, printf('p%02d_img%02d', page, 1) || CASE WHEN regexp_replace(coalesce(label, ''), '[^A-Za-z0-9]', '', 'g') = '' THEN '' ELSE '_' || regexp_replace(label, '[^A-Za-z0-9]', '', 'g') END || '.png' AS file FROM paper_tables")
def slugs(spark, d):
    return table(spark, d, "paper_tables").select("table_id", T.slug(F.coalesce("label", F.lit(""))).alias("slug"), T.caption_slug(F.col("label")).alias("caption_slug"), T.figure_filename(F.col("page"), F.lit(1), F.col("label"), F.lit("png")).alias("file"))


# ---- vectors

VECTOR = "round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))), 4)"


def first_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").orderBy("vec_id").first()["embedding"]


@query(f"SELECT vec_id, {VECTOR} + 0.0 AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 20")
def vector_topk(spark, d):
    hits = retrieval.vector_topk(table(spark, d, "embeddings"), first_vector(spark, d), 20, "vec_id")
    return hits.select("vec_id", (F.col("distance") + 0.0).alias("distance"))


@query("""SELECT q.vec_id AS query, x.vec_id AS neighbour, x.distance, x.rank FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0) q, LATERAL (SELECT vec_id, distance, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM (SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q.v), 4) + 0.0 AS distance FROM embeddings)) x WHERE x.rank <= 10""")
def vector_neighbours(spark, d):
    """Queries: every row whose id is divisible by 20, against all rows."""
    v = table(spark, d, "embeddings")
    return retrieval.vector_neighbours(v, v.where("vec_id % 20 = 0"), 10, "vec_id").withColumn("distance", F.col("distance") + 0.0)


QUESTION = "effect of the refrigerant on the cooling load"
# the default embedding: words hashed to 256 places with a sign, of unit length
EMBEDDED = f"""{LATEST}, {PAPER}, texts AS (SELECT chunk_id AS id, text FROM latest UNION ALL SELECT '?', {lit(QUESTION)}),
hashed AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::UBIGINT AS h FROM (SELECT id, unnest({words_sql('lower(text)')}) AS w FROM texts)),
vec AS (SELECT id, h % 256 AS dim, sum(CASE WHEN h & 2147483648 > 0 THEN 1.0 ELSE -1.0 END) AS v FROM hashed GROUP BY 1, 2),
unit AS (SELECT id, dim, (v / sqrt(sum(v * v) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS v FROM vec),
size AS (SELECT id, sqrt(sum(v * v)) AS n FROM unit GROUP BY 1 HAVING sum(v * v) > 0),
dot AS (SELECT u.id, sum(u.v * coalesce(q.v, 0)) AS s FROM unit u LEFT JOIN (SELECT * FROM unit WHERE id = '?') q USING (dim) GROUP BY 1),
near AS (SELECT size.id AS chunk_id, round(1 - s / (n * (SELECT n FROM size WHERE id = '?')), 4) + 0.0 AS distance FROM size JOIN dot USING (id) WHERE size.id <> '?' ORDER BY distance, chunk_id LIMIT 10)"""
HITS = f"""{EMBEDDED}, r AS (SELECT l.chunk_id, l.document_id, l.text, page_start, page_end, section_title, title, authors, year, citation_key, distance, row_number() OVER (ORDER BY distance, chunk_id) AS rank FROM near JOIN latest l USING (chunk_id) LEFT JOIN paper USING (document_id))"""


def retriever(spark: SparkSession, d: str, facts: bool) -> retrieval.Retriever:
    """Over all chunks, with the default embedding."""
    c = retrieval.embed(current(spark, d))
    return retrieval.Retriever(c.join(papers(spark, d).withColumnRenamed("paper_id", "document_id"), "document_id", "left") if facts else c)


SOURCES = "nullif(coalesce(section_title, ''), '') AS section, distance, CASE WHEN length(text) > 220 THEN substr(text, 1, 220) || '...' ELSE text END AS text_preview"


@query(f"WITH {HITS} SELECT rank, chunk_id, document_id AS paper_id, coalesce(citation_key, '') AS citation_key, coalesce(title, '') AS title, coalesce(authors, '') AS authors, coalesce(year, '') AS year, page_start AS page, {SOURCES} FROM r")
def hit_sources(spark, d):
    """Ranked citations of the chunks nearest to a question."""
    return cast(retrieval.hits_to_sources(retriever(spark, d, True).nearest(QUESTION, 10)), BIG, "rank").withColumn("distance", F.col("distance") + 0.0)


@query(f"""WITH {HITS}, b AS (SELECT rank, concat_ws(chr(10), '[Fragmento ' || rank || ']', coalesce('Clave: ' || nullif(citation_key, ''), 'Documento: ' || nullif(document_id, '')), 'Título: ' || nullif(title, ''), 'Autores: ' || nullif(authors, ''), 'Año: ' || nullif(year, ''),
  CASE WHEN page_start IS NULL THEN NULL WHEN coalesce(page_end, 0) <> 0 AND page_end <> page_start THEN 'Páginas: ' || page_start || '-' || page_end ELSE 'Página: ' || page_start END, 'Sección: ' || nullif(section_title, ''), 'Texto:' || chr(10) || trim(text, {WS})) AS block FROM r)
SELECT coalesce(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank), '') AS context FROM b""")
def context_text(spark, d):
    return retrieval.build_context(retriever(spark, d, True).nearest(QUESTION, 10))


@query(f"WITH {HITS} SELECT rank, chunk_id, document_id AS paper_id, '' AS citation_key, '' AS title, '' AS authors, '' AS year, page_start AS page, {SOURCES} FROM r")
def embedded_search(spark, d):
    """The same over the chunks alone, without their papers' facts."""
    return cast(retrieval.hits_to_sources(retriever(spark, d, False).nearest(QUESTION, 10)), BIG, "rank").withColumn("distance", F.col("distance") + 0.0)


@query(f"""WITH {EMBEDDED.replace("WHERE size.id <> '?'", "JOIN latest t ON size.id = t.chunk_id WHERE t.chunk_type = 'table'")} SELECT chunk_id, distance FROM near""")
def filtered_search(spark, d):
    """The nearest of the tables' chunks: the predicate comes before the ranking."""
    hits = retriever(spark, d, False).nearest(QUESTION, 10, "chunk_type = 'table'")
    return hits.select("chunk_id", (F.col("distance") + 0.0).alias("distance"))


# ---- reports


def latest_extractions(spark: SparkSession, d: str) -> DataFrame:
    return index.latest(table(spark, d, "extractions"), ["document_id"], "ingested_at")


@query("SELECT document_id, len(list_filter(pages, lambda p: len(coalesce(p.warnings, [])) > 0 OR NOT coalesce(p.has_text, false))) AS pages_with_issues FROM (SELECT DISTINCT document_id, pages FROM extractions)")
def pages_with_issues(spark, d):
    return report.pages_with_issues(table(spark, d, "extractions")).withColumn("pages_with_issues", F.col("pages_with_issues").cast("bigint"))


def reports(spark: SparkSession, d: str) -> DataFrame:
    e = latest_extractions(spark, d)
    docs = pages.with_pages(e, "success")
    return report.build_report(e, pages.validate(docs), table(spark, d, "chunks").select("document_id", "chunk_id").distinct(), pages.inspect(docs))


def distinct_in_order(c: str) -> str:
    return f"list_filter({c}, lambda v, i: list_position({c}, v) = i)"


LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM extractions) WHERE rn = 1)"
LAST_PAGES = f"{LAST}, pages AS (SELECT document_id, success, p AS page_num, coalesce(raw_text_by_page[p], '') AS text FROM (SELECT *, unnest(range(1, len(raw_text_by_page) + 1)) AS p FROM last WHERE len(raw_text_by_page) > 0))"
REPORT = f"""{LAST_PAGES}, {LINES}, {DUP}, {CLASS}, {VALID}, {INSPECT}, made AS (SELECT document_id, count(DISTINCT chunk_id) AS n FROM chunks GROUP BY 1),
q AS (SELECT last.document_id, source_file, coalesce(quality_status, 'failed') AS quality_status, coalesce(quality_score, 0.0)::DOUBLE AS quality_score, coalesce(len(raw_text_by_page), 0) AS page_count,
  coalesce(len(list_filter(last.pages, lambda p: len(coalesce(p.warnings, [])) > 0 OR NOT coalesce(p.has_text, false))), 0) AS pages_with_issues, coalesce(n, 0) AS chunks_created, coalesce(success, false) AS stored_successfully,
  list_concat(list_concat(coalesce(inspected.warnings, []), coalesce(last.warnings, [])), coalesce(valid.warnings, [])) AS all_warnings, coalesce(errors, []) AS all_errors
  FROM last LEFT JOIN valid USING (document_id) LEFT JOIN inspected USING (document_id) LEFT JOIN made USING (document_id)),
reports AS (SELECT document_id, source_file, CASE WHEN len(all_errors) > 0 THEN 'failed' WHEN len(all_warnings) > 0 OR quality_status <> 'ok' THEN 'completed_with_warnings' ELSE 'completed' END AS status, quality_status, quality_score, page_count, pages_with_issues, chunks_created, stored_successfully,
  stored_successfully AND quality_status <> 'failed' AND chunks_created > 0 AS ready_for_rag, {distinct_in_order('all_warnings')} AS warnings, {distinct_in_order('all_errors')} AS errors FROM q)"""


@query(f"WITH {REPORT} SELECT * REPLACE (array_to_string(warnings, ';') AS warnings, array_to_string(errors, ';') AS errors) FROM reports")
def processing_reports(spark, d):
    r = cast(reports(spark, d), BIG, "page_count", "pages_with_issues", "chunks_created")
    return r.withColumns({"warnings": F.array_join("warnings", ";"), "errors": F.array_join("errors", ";")})


@query(f"WITH {REPORT} SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'completed_with_warnings') AS with_warnings, count(*) FILTER (status = 'failed') AS failed FROM reports")
def batch_summary(spark, d):
    return report.batch_summary(reports(spark, d))


@query(f"WITH {REPORT} SELECT to_json(reports)::VARCHAR AS json FROM reports")
def report_json(spark, d):
    return report.as_json(reports(spark, d))


@query(f"""WITH {LAST_PAGES}, {LINES}, {DUP}, {CLASS}, {VALID}, {INSPECT}, {PAPER}, made AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1)
SELECT last.document_id, last.source_file, last.source_file AS source_path, method AS extraction_method, ocr_used, array_to_string(ocr_pages, ',') AS ocr_pages, page_count, has_embedded_text, appears_scanned, quality_score, quality_status, title, authors, year, doi, coalesce(n, 0) AS chunk_count, 'unknown' AS layout_hint
FROM last LEFT JOIN inspected USING (document_id) LEFT JOIN valid USING (document_id) LEFT JOIN paper USING (document_id) LEFT JOIN made USING (document_id)""")
def metadata_rows(spark, d):
    e = latest_extractions(spark, d)
    docs = pages.with_pages(e, "success")
    m = report.metadata_rows(pages.inspect(docs), e, pages.validate(docs), papers(spark, d), table(spark, d, "chunks"))
    facts = {c: F.col(f"academic.{c}") for c in ("title", "authors", "year", "doi")}
    flat = m.withColumns({**facts, "ocr_pages": F.array_join(F.transform("ocr_pages", lambda x: x.cast("string")), ",")}).drop("academic")
    return cast(flat, BIG, "page_count", "chunk_count")


@query("SELECT coalesce(avg(CASE WHEN trim(coalesce(text, ''), " + WS + ") = '' THEN 1.0 ELSE 0.0 END), 0.0) AS ratio FROM chunks")
def empty_chunk_ratio(spark, d):
    return table(spark, d, "chunks").agg(F.coalesce(F.avg((T.strip(F.coalesce("text", F.lit(""))) == "").cast("double")), F.lit(0.0)).alias("ratio"))


@query("SELECT DISTINCT document_id, CASE WHEN len(coalesce(errors, [])) > 0 THEN 'failed' WHEN len(coalesce(warnings, [])) > 0 OR NOT success THEN 'completed_with_warnings' ELSE 'completed' END AS status FROM extractions")
def run_status(spark, d):
    return table(spark, d, "extractions").select("document_id", report.final_status(F.col("errors"), F.col("warnings"), F.when(F.col("success"), "ok").otherwise("failed")).alias("status")).distinct()


@query("SELECT document_id, method, score, fallback_used FROM (SELECT a.document_id, CASE WHEN t THEN 'second' ELSE method END AS method, CASE WHEN t THEN s2 ELSE a.score END AS score, t AS fallback_used FROM (SELECT document_id, max(method) AS method, round(avg(list_aggregate(list_transform(pages, lambda p: CASE WHEN p.char_count >= 50 THEN 1.0 ELSE 0.0 END), 'avg')), 4) AS score, 0.65 AS s2, (round(avg(list_aggregate(list_transform(pages, lambda p: CASE WHEN p.char_count >= 50 THEN 1.0 ELSE 0.0 END), 'avg')), 4) < 0.5 AND 0.65 > 1.3 * round(avg(list_aggregate(list_transform(pages, lambda p: CASE WHEN p.char_count >= 50 THEN 1.0 ELSE 0.0 END), 'avg')), 4)) AS t FROM extractions WHERE len(pages) > 0 GROUP BY 1) a)")
def extraction_choice(spark, d):
    """The choice between two extractions, the second scoring 0.65 everywhere."""
    share = F.expr("aggregate(pages, 0D, (a, p) -> a + if(p.char_count >= 50, 1D, 0D)) / size(pages)")
    a = table(spark, d, "extractions").where("size(pages) > 0").groupBy("document_id").agg(F.max("method").alias("method"), F.round(F.avg(share), 4).alias("score"))
    b = a.select("document_id", F.lit(0.65).alias("score"), F.lit("second").alias("method"))
    return pages.choose_extraction(a, b)


# ---- layout, on fixtures: no table has words, blocks or spans


def values(spark: SparkSession, name: str) -> DataFrame:
    rows, schema = FIXTURES[name]
    return spark.createDataFrame(rows, schema)


FIXTURES: dict[str, tuple[list[tuple], str]] = {
    "blocks": (
        [("a", p, 600.0, x, t) for p in (1, 2, 3) for x, t in ((50.0, "left one"), (60.0, "left two"), (340.0, "right one"), (345.0, "right two"))]
        + [("b", p, 600.0, x, t) for p in (1, 2) for x, t in ((50.0, "wide"), (55.0, "wide too"), (400.0, " "))]
        + [("c", p, 600.0, x, t) for p in (2, 6) for x, t in ((50.0, "left one"), (60.0, "left two"), (340.0, "right one"), (345.0, "right two"))],
        "document_id string, page_num int, page_width double, x0 double, text string",
    ),
    "page_counts": ([("a", 3), ("b", 2), ("c", 7), ("d", 0)], "document_id string, page_count int"),
    "words": (
        [("a", 1, 100.0, 20.0, "of"), ("a", 1, 99.0, 5.0, "Table"), ("a", 1, 102.5, 12.0, "1."), ("a", 1, 102.1, 30.0, "costs"), ("a", 1, 130.0, 5.0, "Body"), ("a", 1, 131.0, 15.0, "text that stands near the grid"), ("a", 1, 300.0, 5.0, "Tabla"), ("a", 1, 300.0, 15.0, "2: otros"), ("b", 1, 50.0, 5.0, "Table"), ("b", 1, 50.0, 9.0, "9")],
        "document_id string, page_num int, top double, x0 double, text string",
    ),
    "grids": ([("a", 1, 1, 110.0, 125.0), ("a", 1, 2, 310.0, 350.0), ("b", 1, 1, 400.0, 500.0)], "document_id string, page_num int, table_no int, top double, bottom double"),
    "spans": ([("a", 1, 100.0, 20.0, "A long title"), ("a", 2, 122.0, 19.0, "that goes on"), ("a", 3, 300.0, 20.0, "and ends far below"), ("a", 4, 150.0, 10.0, "Some Author"), ("b", 1, 80.0, 12.0, "12345")], "document_id string, span_no int, y double, size double, text string"),
    "images": (
        [("a", 1, 1, 500, 500, 20000, 50.0, 100.0, 300.0, 250.0, "Fig. 1", "png"), ("a", 1, 2, 399, 900, 20000, 50.0, 400.0, 300.0, 500.0, "Fig. 2", "png"), ("a", 2, 1, 450, 450, 20000, 50.0, 100.0, 300.0, 250.0, None, "png"), ("a", 2, 2, 400, 400, 20000, 0.0, 0.0, 9.0, 9.0, None, "png"), ("a", 2, 3, 800, 600, 9999, 0.0, 0.0, 9.0, 9.0, None, "png")],
        "document_id string, page_num int, image_no int, width int, height int, bytes int, x0 double, y0 double, x1 double, y1 double, label string, ext string",
    ),
    "figure_blocks": (
        [("a", 1, 1, 40.0, 60.0, 300.0, 90.0, "Figure 7 stands above"), ("a", 1, 2, 40.0, 260.0, 300.0, 280.0, "Fig. 1.2  shows the course"), ("a", 1, 3, 40.0, 300.0, 300.0, 330.0, "Text around the figure that is long enough"), ("a", 2, 1, 40.0, 60.0, 300.0, 90.0, "Figura 3 arriba")],
        "document_id string, page_num int, block_no int, bx0 double, by0 double, bx1 double, by1 double, text string",
    ),
}


def values_sql(name: str) -> str:
    rows, schema = FIXTURES[name]
    one = lambda v: "NULL" if v is None else lit(v) if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return f"{name}({', '.join(c.split()[0] for c in schema.split(', '))}) AS (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)})"


@query(f"""WITH {values_sql('blocks')}, {values_sql('page_counts')}, p AS (SELECT document_id, page_num, count(*) FILTER (trim(text) <> '' AND x0 < 0.45 * page_width) AS l, count(*) FILTER (trim(text) <> '' AND x0 > 0.55 * page_width) AS r FROM blocks WHERE page_num <= 5 GROUP BY 1, 2),
v AS (SELECT document_id, least(page_count, 5) AS n, (SELECT count(*) FROM p WHERE p.document_id = c.document_id AND l >= 2 AND r >= 2) AS votes FROM page_counts c)
SELECT document_id, votes, CASE WHEN n = 0 THEN 'unknown' WHEN votes >= greatest(1, n // 2) THEN 'two_column' ELSE 'single_column' END AS layout_hint FROM v""")
def layout_vote(spark, d):
    return pages.layout_votes(values(spark, "blocks"), values(spark, "page_counts"))


LAYOUT_LINES = """v AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_num ORDER BY top, x0, text) AS k FROM words),
w AS (SELECT document_id, page_num, k, 0 AS line_no, top AS y, text AS word FROM v WHERE k = 1 UNION ALL
  SELECT v.document_id, v.page_num, v.k, CASE WHEN abs(v.top - w.y) > 3 THEN w.line_no + 1 ELSE w.line_no END, CASE WHEN abs(v.top - w.y) > 3 THEN v.top ELSE w.y END, v.text FROM w JOIN v ON v.document_id = w.document_id AND v.page_num = w.page_num AND v.k = w.k + 1),
lines AS (SELECT document_id, page_num, line_no, min(y) AS y, string_agg(word, ' ' ORDER BY k) AS text FROM w GROUP BY 1, 2, 3)"""


@query(f"WITH RECURSIVE {values_sql('words')}, {LAYOUT_LINES} SELECT * FROM lines")
def layout_lines(spark, d):
    return structure.words_to_lines(values(spark, "words"))


CAPTIONS = f"""c AS (SELECT *, nullif({collapse(f"regexp_extract(text, {lit(TABLE_CAPTION)}, 1)")}, '') AS caption FROM lines),
j AS (SELECT g.*, c.y, c.line_no, c.caption, c.y BETWEEN top - 60 AND top + 5 OR c.y BETWEEN bottom - 5 AND bottom + 60 AS near FROM grids g LEFT JOIN c ON g.document_id = c.document_id AND g.page_num = c.page_num AND c.caption IS NOT NULL),
cap AS (SELECT document_id, page_num, table_no, coalesce(first(caption ORDER BY y, line_no) FILTER (near), first(caption ORDER BY y, line_no) FILTER (caption IS NOT NULL)) AS caption FROM j GROUP BY 1, 2, 3)"""


@query(f"WITH RECURSIVE {values_sql('words')}, {values_sql('grids')}, {LAYOUT_LINES}, {CAPTIONS} SELECT *, nullif(trim(regexp_extract(caption, {lit(TABLE_LABEL)}, 1)), '') AS label FROM cap")
def caption_lookup(spark, d):
    return structure.table_captions(values(spark, "grids"), structure.words_to_lines(values(spark, "words")))


@query(f"""WITH RECURSIVE {values_sql('words')}, {values_sql('grids')}, {LAYOUT_LINES}, {CAPTIONS}, n AS (SELECT g.*, l.y, l.line_no, l.text FROM grids g JOIN cap USING (document_id, page_num, table_no) JOIN lines l ON g.document_id = l.document_id AND g.page_num = l.page_num
  WHERE (l.y BETWEEN top - 80 AND top OR l.y BETWEEN bottom AND bottom + 80) AND length(l.text) >= 15 AND NOT coalesce(starts_with(l.text, substr(cap.caption, 1, 30)), false))
SELECT g.document_id, g.page_num, g.table_no, coalesce(substr(string_agg(n.text, ' … ' ORDER BY n.y, n.line_no), 1, 400), '') AS surrounding_text FROM grids g LEFT JOIN n USING (document_id, page_num, table_no) GROUP BY 1, 2, 3""")
def table_context(spark, d):
    lines = structure.words_to_lines(values(spark, "words"))
    grids = values(spark, "grids")
    captions = structure.table_captions(grids, lines).drop("label")
    return structure.table_context(grids.join(captions, ["document_id", "page_num", "table_no"]), lines)


@query(f"""WITH {values_sql('spans')}, m AS (SELECT *, max(size) OVER (PARTITION BY document_id) AS most FROM spans WHERE length(trim(text)) > 3 AND size > 0), b AS (SELECT *, y - lag(y) OVER (PARTITION BY document_id ORDER BY y, span_no) AS gap FROM m WHERE size >= 0.85 * most),
o AS (SELECT *, max((coalesce(gap, 0) > 2.5 * most)::INT) OVER (PARTITION BY document_id ORDER BY y, span_no) AS off FROM b), t AS (SELECT document_id, string_agg(text, ' ' ORDER BY y, span_no) AS t FROM o WHERE off = 0 GROUP BY 1)
SELECT document_id, CASE WHEN length(t) >= 5 AND NOT regexp_matches(t, '^\\d+$') THEN substr(t, 1, 400) END AS title FROM t""")
def titles(spark, d):
    return structure.titles(values(spark, "spans"))


@query(f"""WITH {values_sql('images')}, k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_num, image_no) AS image_index, row_number() OVER (PARTITION BY document_id, page_num ORDER BY image_no) AS page_image FROM images WHERE width >= 400 AND height >= 400 AND width * height >= 200000 AND bytes >= 10000)
SELECT document_id, page_num, image_no, image_index, page_image, printf('p%02d_img%02d', page_num, page_image) || CASE WHEN coalesce(label, '') = '' THEN '' ELSE '_' || regexp_replace(label, '[^A-Za-z0-9]', '', 'g') END || '.' || ext AS filename FROM k""")
def numbered_images(spark, d):
    return structure.number_images(values(spark, "images")).select("document_id", "page_num", "image_no", "image_index", "page_image", "filename")


@query(f"""WITH {values_sql('images')}, {values_sql('figure_blocks')}, j AS (SELECT i.document_id, i.page_num, i.image_no, block_no, text, CASE WHEN bx1 >= x0 - 20 AND bx0 <= x1 + 20 AND by1 >= y1 AND by0 <= y1 + 80 THEN 0 WHEN bx1 >= x0 - 20 AND bx0 <= x1 + 20 AND by1 >= y0 - 80 AND by0 <= y0 THEN 1 END AS z FROM images i LEFT JOIN figure_blocks b ON i.document_id = b.document_id AND i.page_num = b.page_num),
f AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_num, image_no ORDER BY z, block_no) AS rn FROM j WHERE z IS NOT NULL AND regexp_matches(text, {lit(FIG_LABEL)}))
SELECT i.document_id, i.page_num, i.image_no, {collapse('f.text')} AS caption, trim(regexp_extract(f.text, {lit(FIG_LABEL)}, 1)) AS label FROM images i LEFT JOIN f ON i.document_id = f.document_id AND i.page_num = f.page_num AND i.image_no = f.image_no AND rn = 1""")
def figure_captions(spark, d):
    return structure.figure_captions(values(spark, "images").drop("label"), values(spark, "figure_blocks"))


@query(f"""WITH {values_sql('images')}, {values_sql('figure_blocks')}, j AS (SELECT i.document_id, i.page_num, i.image_no, block_no, text FROM images i JOIN figure_blocks b ON i.document_id = b.document_id AND i.page_num = b.page_num WHERE bx1 >= x0 - 30 AND bx0 <= x1 + 30 AND by1 >= y0 - 150 AND by0 <= y1 + 150 AND length(trim(text)) >= 20 AND NOT regexp_matches(text, {lit(FIG_LABEL)}))
SELECT i.document_id, i.page_num, i.image_no, coalesce(substr(string_agg({collapse('j.text')}, ' … ' ORDER BY block_no), 1, 400), '') AS surrounding_text FROM images i LEFT JOIN j USING (document_id, page_num, image_no) GROUP BY 1, 2, 3""")
def figure_context(spark, d):
    return structure.figure_context(values(spark, "images").drop("label"), values(spark, "figure_blocks"))

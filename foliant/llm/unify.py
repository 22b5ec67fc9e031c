"""Problem 5: one consistent form of text whose characters differ but look the same.

``unify`` runs DuckDB over the Arrow batches of each partition. The embedded SQL

1. removes invisible characters (zero-width space, word joiner, byte order mark, soft hyphen; joiners only where the
   letter before them is of a script that does not use them),
2. maps compatibility forms to plain characters: full- and half-width forms, mathematical alphabets, joined letters,
   spaces of other widths, the non-breaking hyphen,
3. composes with ``nfc_normalize``,
4. maps look-alike letters of other alphabets, word by word: in a word that also has Latin letters and no letter that
   only the other alphabet has; or, if the whole text shows no genuine word of that alphabet, in a word made of
   look-alikes only. Single small Greek letters stay (symbols).

Raised and lowered digits, fractions, guillemets and accented letters stay as they are.

Null text gives null and ``changed`` false; empty text stays empty. Repeated rows are each treated alike, so every
input row gives one output row. Output: the id columns, ``text_norm``, ``changed``; other input columns are left out.
"""

from __future__ import annotations

import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._arrow import id_schema, map_batches

# Letters of other alphabets that look like a Latin letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХЗаеѕіјорсухԁһԛԝ", "ABESIJKMHOPCTYX3aesijopcyxdhqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυκ", "ABEZHIKMNOPTYXavopuk"))
GREEK.pop("α"), GREEK.pop("υ"), GREEK.pop("κ")
del CYRILLIC["З"]
# The same of rarer alphabets and of phonetic letters; these are mapped only within words of Latin letters.
ARMENIAN = dict(zip("օոսհցյզՕՍՏԼ", "onuhgjqOUSL"))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏙᏚᏞᏟᏢᏦᏧ", "DRTAJEWMHGZRWVSLCPKd"))
PHONETIC = dict(zip("ɡɑɩ", "gai"))
RARER = ARMENIAN | LISU | CHEROKEE | PHONETIC
LOOKALIKE = CYRILLIC | GREEK


def _compat() -> tuple[dict[str, str], dict[str, str]]:
    """Compatibility forms that look like plain text, from the Unicode decompositions: one to one, one to many."""
    one, many = {}, {}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        kind = unicodedata.decomposition(ch)
        if not kind.startswith("<"):
            continue
        tag, plain = kind.split(">")[0][1:], unicodedata.normalize("NFKC", ch)
        joined = tag == "compat" and 0xFB00 <= cp <= 0xFB06 or cp in (0x132, 0x133)
        space = unicodedata.category(ch) == "Zs"
        if not (tag in ("wide", "narrow", "font", "noBreak") or joined or space):
            continue
        plain = {"‐": "-"}.get(plain, plain)
        if any(ord(x) > 0x7F for x in plain) and tag not in ("wide", "narrow"):
            continue
        if len(plain) == 1:
            one[ch] = plain
        else:
            many[ch] = plain
    one["\u00a0"] = " "
    one["\u2010"] = "-"  # as its non-breaking form
    return one, many


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def unify_sql(source: str, text: str, ids: str) -> str:
    """The SQL that DuckDB runs over a batch. ``ids``: the other columns to keep, ending in a comma."""
    one, many = _compat()
    every = LOOKALIKE | RARER
    look, plain = "".join(every), "".join(every.values())
    cyr, gre = "".join(CYRILLIC), "".join(GREEK)
    step = f"translate(t0, {_lit(''.join(one))}, {_lit(''.join(one.values()))})"
    for ch, to in many.items():
        if 0xFB00 <= ord(ch) <= 0xFB06 or ord(ch) in (0x132, 0x133):
            step = f"replace({step}, {_lit(ch)}, {_lit(to)})"
    gone = "[\u200b\u2060\ufeff\u00ad]"
    joiner = "(^|[\\x{0000}-\\x{05FF}\\x{1E00}-\\x{1FFF}\\x{2000}-\\x{200B}\\x{2010}-\\x{2BFF}])[\u200c\u200d]+"
    return f"""
WITH clean AS (
  SELECT *, regexp_replace(regexp_replace({text}, {_lit(gone)}, '', 'g'), {_lit(joiner)}, '\\1', 'g') AS t0 FROM {source}
), plain AS (SELECT *, nfc_normalize({step}) AS t1 FROM clean
), seen AS (
  SELECT *, regexp_matches(t1, '[{look}]') AS look,
    regexp_matches(regexp_replace(t1, '[{cyr}]', '', 'g'), '\\p{{Cyrillic}}') AS own_cyr,
    regexp_matches(regexp_replace(t1, '[{gre}]', '', 'g'), '\\p{{Greek}}\\p{{Greek}}') AS own_gre FROM plain
)
SELECT {ids} CASE WHEN NOT look THEN t1 ELSE array_to_string(list_transform(
    regexp_extract_all(t1, '[\\p{{L}}\\p{{M}}''’]+|[^\\p{{L}}\\p{{M}}''’]+'),
    lambda w: CASE
      WHEN NOT regexp_matches(w, '[{look}]') THEN w
      WHEN regexp_matches(w, '\\p{{Latin}}') THEN
        CASE WHEN regexp_matches(regexp_replace(w, '[{look}]', '', 'g'), '[\\p{{Cyrillic}}\\p{{Greek}}\\p{{Armenian}}\\p{{Lisu}}\\p{{Cherokee}}]') THEN w ELSE translate(w, {_lit(look)}, {_lit(plain)}) END
      WHEN regexp_matches(w, '^[{cyr}{gre}''’]+$') AND NOT regexp_matches(w, '^[νρ]$')
        AND (NOT own_cyr OR NOT regexp_matches(w, '\\p{{Cyrillic}}')) AND (NOT own_gre OR NOT regexp_matches(w, '\\p{{Greek}}'))
        THEN translate(w, {_lit(look)}, {_lit(plain)})
      ELSE w END), '') END AS text_norm
FROM seen"""


def unify_batches(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """Every row through DuckDB: the id columns, ``text_norm``, ``changed``."""
    schema = f"{id_schema(df, ids)}, text_norm string, changed boolean"
    n = len(ids)

    def make():
        import duckdb

        con = duckdb.connect()
        con.execute("SET threads=1; SET memory_limit='300MB'; SET preserve_insertion_order=true")
        sql = unify_sql("batch", "t", "".join(f"i{k}, " for k in range(n)) + "t, ")

        def work(b: pa.RecordBatch) -> dict:
            t = pa.Table.from_arrays([*(b.column(k) for k in range(n)), b.column(n)], names=[*(f"i{k}" for k in range(n)), "t"])
            con.register("batch", t)
            out = con.sql(f"SELECT *, coalesce(text_norm <> t, false) AS changed FROM ({sql})").to_arrow_table()
            con.unregister("batch")
            got = {c: out.column(f"i{k}").cast(b.column(k).type) for k, c in enumerate(ids)}
            return got | {"text_norm": out.column("text_norm").cast(pa.string()), "changed": out.column("changed")}

        return work

    return map_batches(df.select(*ids, F.col(text).alias("__t")), make, schema)


def unify(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """One row per input row. Texts of ASCII only are already in the form and never leave the JVM."""
    odd = F.col(text).rlike(r"[^\x00-\x7F]")
    plain = df.where(F.col(text).isNull() | ~odd).select(*ids, F.col(text).alias("text_norm"), F.lit(False).alias("changed"))
    return plain.unionByName(unify_batches(df.where(odd), ids, text))

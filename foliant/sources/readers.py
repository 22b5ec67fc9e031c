"""Reading files, chunk and report tables, and decoding documents."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import document_id
from foliant.operators.pages import FALLBACK_BELOW, FALLBACK_GAIN, GOOD

CHUNKS = "chunk_id string, document_id string, source_file string, text string, page_start int, page_end int, chunk_index int, section_title string, extraction_method string, quality_score double, processing_status string, char_count int, token_estimate int, created_at string, chunk_type string, source_id string, linked_figures array<string>, linked_tables array<string>, linked_equations array<string>"
Decoder = Callable[[bytes], list[str]]


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """Files with their ids. A folder without any gives no rows; a missing folder is an error.

    Spark's reader passes over files of no bytes.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("source_file"), document_id(name).alias("document_id"), "length", "modificationTime", "content")


def read_jsonl(spark: SparkSession, path: str, schema: str = CHUNKS) -> DataFrame:
    """Records line by line; blank and malformed lines are skipped."""
    text = spark.read.text(path).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = text.select(F.from_json("value", f"{schema}, _bad string", options).alias("r")).select("r.*")
    return rows.where(F.col("_bad").isNull()).drop("_bad")


def plain_decoder(content: bytes) -> list[str]:
    """Pages of a text file: form feeds part them."""
    return content.decode("utf-8", "replace").split("\f")


def pdf_decoder(content: bytes) -> list[str]:
    """Pages of a PDF, if a library that reads them is installed."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("no PDF library is installed") from e
    with fitz.open(stream=content, filetype="pdf") as doc:
        if doc.is_encrypted:
            raise Encrypted("a password is needed")
        return [p.get_text() for p in doc]


@dataclasses.dataclass(frozen=True)
class Decoders:
    """How files become pages: the first decoder, another for weak results, and a reader of one page's image."""

    first: Decoder = plain_decoder
    second: Decoder | None = None
    recognise: Callable[[bytes, int], str] | None = None
    names: tuple[str, str] = ("first", "second")


class Encrypted(ValueError):
    """Raised by a decoder for a file that needs a password."""


class NoRecogniser(RuntimeError):
    """Raised by a page reader that can't work at all; the rest of the pages isn't tried."""


EXTRACTED = "document_id string, source_file string, file_size_bytes bigint, can_open boolean, is_encrypted boolean, is_corrupted boolean, method string, pages array<string>, success boolean, fallback_used boolean, ocr_used boolean, ocr_pages array<int>, warnings array<string>, errors array<string>"


def share_good(pages: list[str]) -> float:
    return sum(len(p.strip()) >= GOOD for p in pages) / len(pages) if pages else 0.0


def extract_one(content: bytes, d: Decoders) -> dict:
    """One file's pages, the second decoder tried where under half are good, weak pages recognised; what goes wrong is noted."""
    got: dict = {"can_open": False, "is_encrypted": False, "is_corrupted": False, "method": "failed", "pages": [], "success": False, "fallback_used": False, "ocr_pages": [], "warnings": [], "errors": []}
    if not content:
        return got | {"is_corrupted": True, "errors": ["empty file"]}
    try:
        got |= {"pages": [p or "" for p in d.first(content)], "can_open": True, "method": d.names[0]}
    except Encrypted as e:
        return got | {"can_open": True, "is_encrypted": True, "warnings": [f"encrypted: {e}"]}
    except Exception as e:  # noqa: BLE001
        got |= {"is_corrupted": True, "errors": [str(e)]}
    if d.second and share_good(got["pages"]) < FALLBACK_BELOW:
        try:
            other = [p or "" for p in d.second(content)]
            if share_good(other) > FALLBACK_GAIN * share_good(got["pages"]):
                got |= {"pages": other, "can_open": True, "is_corrupted": False, "errors": [], "method": d.names[1], "fallback_used": True}
        except Exception as e:  # noqa: BLE001
            got["warnings"].append(f"second decoder: {e}")
    if got["can_open"] and not got["pages"]:
        got["warnings"].append("no pages")
    for k, p in enumerate(got["pages"]) if d.recognise else ():
        if len(p.strip()) >= GOOD:
            continue
        try:
            text = d.recognise(content, k + 1)  # type: ignore[misc]
        except NoRecogniser as e:
            got["warnings"].append(str(e))
            break
        except Exception as e:  # noqa: BLE001
            got["warnings"].append(f"page {k + 1}: {e}")
            continue
        if len(text.strip()) > len(p):
            got["pages"][k] = text
            got["ocr_pages"].append(k + 1)
    if got["ocr_pages"]:
        got["method"] = "hybrid"
    return got | {"success": got["can_open"] and any(p.strip() for p in got["pages"])}


def decode(files: DataFrame, decoders: Decoders = Decoders()) -> DataFrame:
    """One row per file with its pages; a file that can't be read is a row with its error, never a failed job."""
    names = [x.split()[0] for x in EXTRACTED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                content = bytes(r.content) if r.content is not None else b""
                got = extract_one(content, decoders)
                rows.append(got | {"document_id": r.document_id, "source_file": r.source_file, "file_size_bytes": len(content), "ocr_used": bool(got["ocr_pages"])})
            yield pd.DataFrame(rows, columns=names)

    return files.select("document_id", "source_file", "content").mapInPandas(run, EXTRACTED)

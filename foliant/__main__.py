"""Command line: process-file, process-folder, search, index-stats, list-docs, show-report, status, ask, tool."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.config import load_config
from foliant.operators import index, report
from foliant.operators.retrieval import Retriever
from foliant.operators.tools import Tools
from foliant.plans.pipeline import ingest_to
from foliant.sources.readers import Decoders, pdf_decoder, plain_decoder, scan_folder

TOOLS = ("search_papers", "get_paper_info", "list_papers", "get_paper_chunks", "knowledge_base_stats", "rag_search", "rag_answer", "rag_sources", "rag_status")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliant")
    p.add_argument("--config")
    p.add_argument("--data")
    sub = p.add_subparsers(dest="cmd", required=True)
    one = sub.add_parser("process-file")
    one.add_argument("file")
    f = sub.add_parser("process-folder")
    f.add_argument("folder")
    f.add_argument("--pattern", default="*.pdf")
    f.add_argument("--recursive", action="store_true")
    for c in (one, f):
        c.add_argument("--skip-known", action="store_true", help="leave out documents that are stored already; else they are replaced")
    for name in ("search", "ask"):
        s = sub.add_parser(name)
        s.add_argument("query")
        s.add_argument("-k", type=int, default=5)
    for name in ("index-stats", "list-docs", "status"):
        sub.add_parser(name)
    r = sub.add_parser("show-report")
    r.add_argument("document_id")
    t = sub.add_parser("tool")
    t.add_argument("name", choices=TOOLS)
    t.add_argument("argument", nargs="?")
    return p


def process(spark: SparkSession, a: argparse.Namespace, base: str, config) -> int:
    folder, pattern, deep = (a.folder, a.pattern, a.recursive) if a.cmd == "process-folder" else (str(Path(a.file).parent), Path(a.file).name, False)
    files = scan_folder(spark, folder, pattern, deep)
    decoders = Decoders(pdf_decoder if pattern.endswith(".pdf") else plain_decoder)
    row = report.batch_summary(ingest_to(files, base, decoders, config, again=not a.skip_known)).first()
    print(row.asDict())
    return int(row["failed"] > 0)


def papers_of(table: DataFrame) -> DataFrame:
    return table.drop("bucket").withColumnRenamed("document_id", "paper_id")


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    config = load_config(a.config)
    base = a.data or str(config.data_dir)
    spark = SparkSession.builder.appName("foliant").getOrCreate()
    if a.cmd.startswith("process-"):
        return process(spark, a, base, config)
    read = lambda name: spark.read.parquet(f"{base}/{name}")
    if a.cmd == "show-report":
        row = read("reports").where(F.col("document_id") == a.document_id).first()
        print(report.format_report(row.asDict()) if row else "no report")
        return int(row is None)
    chunks = read("chunks").drop("bucket")
    if a.cmd == "search":
        for row in index.keyword_search(chunks, a.query, a.k, ["document_id", "chunk_index"]).collect():
            print(row["source_file"], row["chunk_index"], row["text"][:200].replace("\n", " "))
    elif a.cmd == "index-stats":
        print(index.index_stats(chunks).first().asDict())
    elif a.cmd == "status":
        print(Retriever(chunks).status())
    else:
        tools = Tools(chunks, papers_of(read("academic")))
        if a.cmd == "list-docs":
            print(tools.list_papers())
        elif a.cmd == "ask":
            print(tools.rag_answer(a.query, a.k))
        else:
            print(getattr(tools, a.name)(*([a.argument] if a.argument is not None else [])))
    return 0


if __name__ == "__main__":
    sys.exit(main())

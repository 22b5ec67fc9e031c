"""Incremental ingestion: new files become chunks once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import document_id
from foliant.operators.index import new_documents
from foliant.sources.readers import Decoders
from foliant.sources.writers import save_table

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_stream(spark: SparkSession, folder: str, pattern: str, target: str, state: str, to_chunks: Callable[[DataFrame, Decoders], DataFrame], decoders: Decoders = Decoders()):
    """Reads what is new in the folder, leaves out documents that ``target`` has, and appends the rest's chunks.

    The checkpoint ``state`` remembers the files; the anti-join makes a batch that is run again harmless.
    """
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(folder)

    def batch(df: DataFrame, _: int) -> None:
        name = F.element_at(F.split("path", "/"), -1)
        files = df.select("path", name.alias("source_file"), document_id(name).alias("document_id"), "length", "modificationTime", "content")
        try:
            files = new_documents(files, df.sparkSession.read.parquet(target))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        save_table(to_chunks(files, decoders), target)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()

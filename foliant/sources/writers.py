"""Writing tables, exports and the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import slug
from foliant.session import checkpoint_dir

BUCKETS, ROWS_A_FILE = 256, 200_000


def bucket(df: DataFrame, key: str = "document_id", buckets: int = BUCKETS) -> DataFrame:
    """A table's parts: the id's hash, so any ids spread evenly and an id's part is known."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def save_table(df: DataFrame, path: str, mode: str = "append", key: str = "document_id", buckets: int = BUCKETS) -> None:
    """Parts of rows of equal hash. A part goes over 16 tasks by the hash of its rows' content, so one id with a third of all rows isn't
    one task; files hold at most ROWS_A_FILE rows. ``buckets`` is a table's property and must stay the same."""
    b = bucket(df, key, buckets)
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if not dict(df.dtypes)[c].startswith("map")]), F.lit(16))
    b.repartition("bucket", salt).write.mode(mode).option("maxRecordsPerFile", ROWS_A_FILE).partitionBy("bucket").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table, on whatever file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def replace_in_table(df: DataFrame, path: str, key: str = "document_id", buckets: int = BUCKETS) -> None:
    """The table with ``df``'s rows in place of those of the same keys: only the parts that these keys fall into are written anew.

    The new parts are written beside the table first, as a part can't be read and overwritten at once.
    """
    spark = df.sparkSession
    if not exists(spark, path):
        return save_table(df, path, "overwrite", key, buckets)
    made = f"{checkpoint_dir(spark)}/replace-{spark.sparkContext.applicationId}-{abs(hash(path)) % 10**12}"
    save_table(df, f"{made}-new", "overwrite", key, buckets)
    kind = df.withColumn("bucket", F.lit(0)).schema  # given, as a table without rows has no file to infer it from
    new = spark.read.schema(kind).parquet(f"{made}-new")
    touched = new.select("bucket").distinct()  # at most ``buckets`` rows
    old = spark.read.schema(kind).parquet(path).join(F.broadcast(touched), "bucket", "left_semi").join(new.select(key).distinct(), key, "left_anti")
    both = old.unionByName(new, allowMissingColumns=True)
    save_table(both.drop("bucket"), f"{made}-both", "overwrite", key, buckets)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        save_table(spark.read.schema(kind).parquet(f"{made}-both").drop("bucket"), path, "overwrite", key, buckets)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def save_entities(base: str, **tables: DataFrame) -> None:
    """One Parquet table per entity: figures, tables, equations, chunks, metadata, reports. Documents that come again are replaced."""
    for name, df in tables.items():
        replace_in_table(df, f"{base}/{name}", "document_id" if "document_id" in df.columns else "paper_id")


def export_json(df: DataFrame, path: str) -> None:
    """A registry (figures, tables, equations, reports) as JSON lines."""
    df.write.mode("overwrite").json(path)


def append_index(chunks: DataFrame, path: str) -> bool:
    """Chunks appended to a JSONL index; False for none."""
    if chunks.limit(1).count() == 0:
        return False
    chunks.write.mode("append").json(path)
    return True


def table_csv_rows(tables: DataFrame) -> DataFrame:
    """(table_id, file, row_no, line): the lines of each table's CSV. The id in the name keeps equal labels apart."""
    name = F.concat(F.substring(slug(F.coalesce("label", F.lit("table"))), 1, 20), F.lit("_"), F.col("table_id"), F.lit(".csv"))
    quote = lambda c: F.when(F.coalesce(c, F.lit("")).rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    all_rows = F.concat(F.array("headers"), F.coalesce("rows", F.array().cast("array<array<string>>")))
    return tables.select("table_id", name.alias("file"), F.posexplode(all_rows).alias("row_no", "cells")).select("table_id", "file", "row_no", F.array_join(F.transform("cells", quote), ",").alias("line"))


def figures_index(figures: DataFrame) -> DataFrame:
    """The registry of stored images: their number, page, file, size and caption."""
    return figures.select("document_id", "image_index", "page_num", "filename", "width", "height", "caption")


def save_figures(figures: DataFrame, base: str) -> int:
    """Image bytes to files, on the executors; how many. ``figures``: document_id, filename, data.

    ``base`` must be a folder that all executors share; on a cluster a machine's own temporary folder is refused.
    """
    import os
    import tempfile

    if not figures.sparkSession.sparkContext.master.startswith("local[") and os.path.abspath(base).startswith(tempfile.gettempdir()):
        raise ValueError("images go to shared storage, not to a machine's temporary folder")

    def put(rows):
        for r in rows:
            os.makedirs(f"{base}/{r.document_id}", exist_ok=True)
            with open(f"{base}/{r.document_id}/{r.filename}", "wb") as f:
                f.write(r.data)

    kept = figures.where("data is not null").select("document_id", "filename", "data")
    kept.foreachPartition(put)
    return kept.count()

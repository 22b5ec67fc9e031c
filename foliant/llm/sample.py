"""A bounded sample of rows for fitting a model: always the same rows, whatever the partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 1_000_000


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those of the smallest hashes of the key. Rows beyond the share that is needed are left out where they
    are read, so the final sort sees little more than ``most`` rows however many partitions there are."""
    h = F.xxhash64(F.col(key).cast("string"))
    n = df.count()
    if n > most:
        df = df.where(F.pmod(h, F.lit(PARTS)) < int(PARTS * min(1.0, 1.2 * most / n)) + 1)
    return df.orderBy(F.pmod(h, F.lit(PARTS)), h, *[c for c in df.columns if c != key]).limit(most)

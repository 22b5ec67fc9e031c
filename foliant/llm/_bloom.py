"""A Bloom filter of one table's keys, which leaves out most rows of another before costly work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROBES, PER_KEY, LEAST_BITS, MOST_BITS = 4, 12, 1 << 16, 1 << 27


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, a row of PROBES. ``bits``: the size of the filter, a power of 2."""
    h = hashes.view(np.uint64)[:, None]
    return (h + ((h >> np.uint64(32)) | np.uint64(1)) * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)


def among(df: DataFrame, col: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``col`` is in the one column of ``keys`` (of the same type), and few others.

    The filter has PER_KEY bits a key and MOST_BITS (16 MB) at most: with more keys than fit, more of the other rows stay, and
    none of those asked for is lost. ``keys`` is read twice. Null keys are in no table.
    """
    key = F.col(keys.columns[0])
    n = keys.agg(F.approx_count_distinct(key)).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (PER_KEY * n).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(bits // 8, dtype=np.uint8)
        for b in batches:
            at = places(b.column(0).to_numpy(zero_copy_only=False), bits).ravel()
            np.bitwise_or.at(mine, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([mine.tobytes()], pa.binary())], names=["bits"])

    parts = keys.where(key.isNotNull()).select(F.xxhash64(key).alias("h")).coalesce(4).mapInArrow(build, "bits binary").toLocalIterator()
    whole = np.zeros(bits // 8, dtype=np.uint8)
    for r in parts:
        whole |= np.frombuffer(r.bits, dtype=np.uint8)
    sent = df.sparkSession.sparkContext.broadcast(whole.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.frombuffer(sent.value, dtype=np.uint8)
        for b in batches:
            at = places(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False), bits)
            met = ((there[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
            if met.any():
                yield b.select(range(b.num_columns - 1)).filter(pa.array(met))

    return df.where(F.col(col).isNotNull()).withColumn("__h", F.xxhash64(col)).mapInArrow(run, df.schema)

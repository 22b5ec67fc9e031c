"""One Python pass over texts in Arrow batches, for what has no expression on columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_texts(df: DataFrame, keys: list[str], text: str, rows_of: Callable[[str], Iterable[tuple]], fields: str) -> DataFrame:
    """For each row the rows that ``rows_of`` makes of its text (null gives none), behind its keys. ``fields``: 'name type, ...', of string, int."""
    kinds = dict(df.dtypes)
    names = [x.split()[0] for x in fields.split(", ")]
    types = [{"string": pa.string(), "int": pa.int32()}[x.split()[1]] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            took: list[int] = []
            made: list[tuple] = []
            for i, t in enumerate(b.column(len(keys)).to_pylist()):
                if t is not None:
                    got = list(rows_of(t))
                    took += [i] * len(got)
                    made += got
            if made:
                columns = [pa.array(c, kind) for c, kind in zip(zip(*made), types)]
                at = pa.array(took, pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(len(keys))), *columns], names=[*keys, *names])

    front = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return df.select(*keys, F.col(text).alias("__text")).mapInArrow(run, f"{front}, {fields}")

"""Running a function over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """``make`` is called once a task and gives the function that turns a batch into columns (names as in ``schema``).

    Empty partitions and batches give no rows.
    """
    names = [x.strip().split(" ")[0].strip("`") for x in _split_top(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for b in batches:
            if not b.num_rows:
                continue
            work = work or make()
            out = work(b)
            if out is None:
                continue
            arrays = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in (out[n] for n in names)]
            arrays = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in arrays]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


def _split_top(schema: str) -> list[str]:
    parts, depth, now = [], 0, ""
    for ch in schema:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            parts.append(now)
            now = ""
        else:
            now += ch
    return [*parts, now]


def arrow_type(schema_type: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[schema_type]


def id_schema(df: DataFrame, ids: list[str]) -> str:
    """The DDL of the id columns, for the front of an output schema."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {kinds[c]}" for c in ids)

"""Problem 8: filling containers of fixed capacity with whole items.

Sizes are tokens of a public tokenizer (a tiktoken rank file whose path is a parameter). Items go, by a hash of their
id, into shards of about ``SHARD`` items, so no task holds an unbounded group and every shard packs by itself; only
ids and sizes are shuffled, never texts.

Method: minimum bin slack. Each bin is seeded with the largest item left; a bitset subset-sum (one big integer, bit s
set if the sum s can be reached) over the lengths left finds the fullest feasible combination with it, which is taken
out. The search of a bin ends when the capacity is met exactly. An item over the capacity is cut into full containers
and a rest; the rest is packed like an item. Nothing else is split.

Null text has 0 tokens, as empty text; a 0-token item is placed in the first bin of its shard. An id counts once: of
repeated ids the largest size is kept; rows with a null id are one item. Output: the id column, ``n_tokens int, part
int, n_parts int, part_tokens int, bin_id string``. An empty table gives no rows.
"""

from __future__ import annotations

import base64

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._arrow import id_schema, map_batches

SHARD = 2000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer's vocabulary cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, ids: list[str], text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The id columns and ``n_tokens``; texts are read whole."""
    n = len(ids)

    def make():
        enc = encoding(tokenizer)

        def work(b: pa.RecordBatch) -> dict:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(n).to_pylist()]
            return {c: b.column(k) for k, c in enumerate(ids)} | {"n_tokens": pa.array(sizes, pa.int32())}

        return work

    return map_batches(df.select(*ids, F.col(text).alias("__t")), make, f"{id_schema(df, ids)}, n_tokens int")


def fullest(sizes: list[int], room: int) -> list[int]:
    """Indexes of the items whose sizes add up to the most within the room."""
    full = (1 << (room + 1)) - 1
    reach, steps = 1, [1]
    for s in sizes:
        reach |= (reach << s) & full
        steps.append(reach)
        if reach >> room:
            break
    total = reach.bit_length() - 1
    taken = []
    for i in range(len(steps) - 1, 0, -1):
        if not (steps[i - 1] >> total) & 1:
            taken.append(i - 1)
            total -= sizes[i - 1]
    return taken


def pack_shard(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; sizes are within the capacity."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins = [0] * len(sizes)
    left = [i for i in order if sizes[i] > 0]
    now = 0
    while left:
        seed, rest = left[0], left[1:]
        taken = {seed}
        room = capacity - sizes[seed]
        if room and rest:
            fits = [i for i in rest if sizes[i] <= room]
            taken |= {fits[k] for k in fullest([sizes[i] for i in fits], room)}
        for i in taken:
            bins[i] = now
        left = [i for i in left if i not in taken]
        now += 1
    return bins


def pack(df: DataFrame, id_col: str, text: str, capacity: int, tokenizer: str = TOKENIZER, shard: int = SHARD) -> DataFrame:
    sized = token_counts(df, [id_col], text, tokenizer).groupBy(id_col).agg(F.max("n_tokens").alias("n_tokens"))
    shards = max(1, -(-df.select(id_col).count() // shard))
    keyed = sized.withColumn("__shard", F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int"))
    schema = f"{id_schema(df, [id_col])}, n_tokens int, part int, n_parts int, part_tokens int, bin_id string"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col, na_position="first", ignore_index=True)
        rows, sizes = [], []
        for item, n in zip(pdf[id_col], pdf["n_tokens"]):
            parts = [capacity] * (n // capacity) + ([n % capacity] if n % capacity else []) if n > capacity else [n]
            for k, p in enumerate(parts):
                rows.append([item, n, k, len(parts), p])
                sizes.append(p)
        bins = pack_shard(sizes, capacity)
        out = pd.DataFrame(rows, columns=[id_col, "n_tokens", "part", "n_parts", "part_tokens"])
        out["bin_id"] = [f"{key[0]}-{b}" for b in bins]
        if not len(out) or out[id_col].isna().any():
            out[id_col] = out[id_col].astype("Int64" if pd.api.types.is_numeric_dtype(pdf[id_col]) else object)
        return out

    # tasks by shard: left to itself, adaptive execution would put so few bytes into one task
    spark = df.sparkSession
    tasks = min(shards, 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    return keyed.repartition(tasks, "__shard").groupBy("__shard").applyInPandas(one, schema)

"""Per-key results where a few keys hold most rows.

Keys are dictionary-encoded in every input split (the splits that Spark cuts files into are of equal
bytes), the rows' values are added into dense accumulator arrays by code (``bincount`` and scatter
reduction), and array blocks are summed through a distributed reduction tree (``blocks``).  A task's
work is its input split, whatever its keys; what is shuffled is one entry per key and split, never
rows, so a key with a third of all rows weighs as much as any other.

Nulls: a null key part is a value of its own, as is an empty text; texts may be of any length; a null
value counts as a row but not in sum, least or most, which are null where there is no value.
Repeated rows count each time.  Blocks with equal counts are all kept or all left out.  An empty
table has no blocks.  Keys may have any name but those of the results, which can be chosen: a clash
raises ``ValueError``.  Keys are strings, values whole numbers; sums beyond 64 bits raise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.blocks import encode, reduce_blocks

_MOST, _LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _own_names(df: DataFrame, keys: list[str], results: list[str]) -> tuple[list[Column], list[str]]:
    if set(results) & set(keys) or len(set(keys)) < len(keys):
        raise ValueError(f"keys must differ from each other and from {results}")
    own = [f"k{i}" for i in range(len(keys))]
    return [df[f"`{k}`"].cast("string").alias(o) for o, k in zip(own, keys, strict=True)], own


def _scatter(code: np.ndarray, size: int, values: np.ndarray, how, start: int) -> np.ndarray:
    out = np.full(size, start, dtype=np.int64)
    how.at(out, code, values)
    return out


def _checked_sum(code: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
    rough = np.bincount(code, weights=values.astype(np.float64), minlength=size)
    if len(rough) and np.abs(rough).max() >= 2.0**63:
        raise OverflowError("a sum has more than 64 bits")
    return _scatter(code, size, values, np.add, 0)


def key_results(df: DataFrame, keys: list[str], value: str | None = None, count: str = "n") -> DataFrame:
    """(keys, n) of every key, and (total, least, most) of a whole-numbered column if one is named."""
    results = [count, *(["total", "least", "most"] if value else [])]
    named, own = _own_names(df, keys, results)
    number = df[f"`{value}`"].cast("bigint") if value else F.lit(None).cast("bigint")
    rows = df.select(*named, F.pmod(F.xxhash64(*named), F.lit(2**62)).alias("hash"), number.alias("value"))
    schema = pa.schema([*[(o, pa.string()) for o in own], ("hash", pa.int64()), ("n", pa.int64()), ("seen", pa.int64()), ("total", pa.int64()), ("least", pa.int64()), ("most", pa.int64())])
    ddl = ", ".join([*[f"{o} string" for o in own], "hash bigint", "n bigint", "seen bigint", "total bigint", "least bigint", "most bigint"])

    def table(source: pa.Table, first: np.ndarray, results: list[np.ndarray]) -> pa.Table:
        at = pa.array(first)
        columns = [source.column(c).combine_chunks().take(at).cast(schema.field(c).type) for c in [*own, "hash"]]
        return pa.Table.from_arrays([*columns, *[pa.array(r, pa.int64()) for r in results]], schema=schema)

    def accumulate(source: pa.Table) -> pa.Table:
        first, code = encode([source.column(o) for o in own])
        size = len(first)
        values = source.column("value").combine_chunks()
        there = values.is_valid().to_numpy(zero_copy_only=False)
        v, c = values.fill_null(0).to_numpy(zero_copy_only=False)[there], code[there]
        n = np.bincount(code, minlength=size)
        return table(source, first, [n, np.bincount(c, minlength=size), _checked_sum(c, size, v), _scatter(c, size, v, np.minimum, _MOST), _scatter(c, size, v, np.maximum, _LEAST)])

    def merge(source: pa.Table) -> pa.Table:
        first, code = encode([source.column(o) for o in own])
        size = len(first)
        get = lambda c: source.column(c).to_numpy()
        adds = [_checked_sum(code, size, get(c)) for c in ("n", "seen", "total")]
        return table(source, first, [*adds, _scatter(code, size, get("least"), np.minimum, _MOST), _scatter(code, size, get("most"), np.maximum, _LEAST)])

    distinct = rows.agg(F.approx_count_distinct("hash", 0.1)).first()[0]
    found = reduce_blocks(rows, accumulate, merge, schema, ddl, distinct)
    back = [F.col(o).alias(k) for o, k in zip(own, keys, strict=True)]
    extra = [F.when(F.col("seen") > 0, F.col(c)).alias(c) for c in ("total", "least", "most")] if value else []
    return found.select(*back, F.col("n").alias(count), *extra)


def key_counts(df: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Rows per key over all keys."""
    return key_results(df, keys, count=count)


def heavy_blocks(df: DataFrame, keys: list[str], share: int = 200, count: str = "n") -> DataFrame:
    """The key combinations holding at least one in ``share`` of all rows, with their row counts."""
    rows = df.count()
    return key_counts(df, keys, count).filter(F.col(f"`{count}`") * share >= rows)

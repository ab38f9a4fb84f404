"""Array blocks: what input splits accumulate per key, summed through a distributed reduction tree.

Every input split turns its rows into accumulators for the keys it has seen and sends them out as
arrays, one row per block of keys, a block being a range of the keys' hashes.  A node of the tree
merges the arrays of at most ``FAN_IN`` children, so neither the splits' number nor a key's share of
the rows decides what one task holds: a key has one entry per split however many rows it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 32
#: keys that a block has, about
KEYS = 1 << 14
#: rows of accumulators that a split holds before it merges them, and merged ones before it sends them out
HELD, SENT = 1 << 18, 1 << 20

Merge = Callable[[pa.Table], pa.Table]


def encode(columns: list[pa.ChunkedArray]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct key, code of every row): the keys' dictionary; nulls are values of their own."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        coded = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
        index = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
        code = np.unique(code * (len(coded.dictionary) + 1) + index, return_inverse=True)[1]
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    return first, inverse


def _packed(table: pa.Table, blocks: int, part: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of a table as lists, one row for each block."""
    if not table.num_rows:
        return
    block = table.column("hash").to_numpy() % blocks
    order = np.argsort(block, kind="stable")
    block = block[order]
    start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    offsets = pa.array(np.append(start, len(block)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, table.column(f.name).combine_chunks().take(pa.array(order)).cast(f.type)) for f in schema]
    yield pa.RecordBatch.from_arrays([pa.array(block[start], pa.int64()), pa.array([part] * len(start), pa.int64()), *lists], names=["block", "part", *schema.names])


def _unpacked(table: pa.Table, schema: pa.Schema) -> pa.Table:
    columns = []
    for f in schema:
        chunks = [c.flatten() for c in table.column(f.name).chunks]
        columns.append(pa.chunked_array(chunks, f.type) if chunks else pa.chunked_array([[]], f.type))
    return pa.Table.from_arrays(columns, schema=schema)


def splits_of(df: DataFrame) -> int:
    """Into how many splits a DataFrame is read."""
    return df.rdd.getNumPartitions()


def reduce_blocks(rows: DataFrame, accumulate: Merge, merge: Merge, schema: pa.Schema, ddl: str, distinct: int, finish: Merge | None = None, finish_ddl: str = "") -> DataFrame:
    """The accumulators of every key, merged over all splits, as rows of ``schema`` or as ``finish`` turns a block's into.

    ``rows`` has a column ``hash`` of each row's key; ``accumulate`` turns rows of a split into
    accumulators, ``merge`` makes those of equal keys one.  Both must keep ``hash``.
    """
    blocks = max(1, -(-distinct // KEYS))
    lists = ", ".join(f"{f.split()[0]} array<{f.split()[1]}>" for f in ddl.split(", "))
    packed = f"block bigint, part bigint, {lists}"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        held: list[pa.Table] = []
        fresh = 0
        for batch in batches:
            if batch.num_rows:
                held.append(accumulate(pa.Table.from_batches([batch])))
                fresh += held[-1].num_rows
            if fresh >= HELD:
                held, fresh = [merge(pa.concat_tables(held))], 0
                if held[0].num_rows >= SENT:
                    yield from _packed(held.pop(), blocks, part, schema)
        if held:
            yield from _packed(merge(pa.concat_tables(held)), blocks, part, schema)

    def node(table: pa.Table) -> pa.Table:
        merged = merge(_unpacked(table, schema))
        out = list(_packed(merged, 1, 0, schema))
        lead = [pa.array([table.column("block")[0].as_py()], pa.int64()), pa.array([table.column("part")[0].as_py()], pa.int64())]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([*lead, *b.columns[2:]], names=b.schema.names) for b in out])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                table = _unpacked(pa.Table.from_batches([batch.slice(k, 1)]), schema)
                yield from (finish(table) if finish else table).to_batches()

    parts = splits_of(rows)
    tree = rows.mapInArrow(split, packed)
    while True:
        parts = -(-parts // FAN_IN)
        tree = tree.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("block", "part").applyInArrow(node, packed)
        if parts <= 1:
            break
    return tree.mapInArrow(unpack, finish_ddl or ddl)

"""Continuous periods and the gaps between them, per group of validity intervals.

A group's accumulator is a list of sorted disjoint intervals.  Every input split makes one per group,
and lists are combined by merging through the reduction tree of ``blocks``: in a node the lists of
all its groups are put in order by group and start (a stable merge of sorted runs) and swept once.
A group that holds most rows has one list per split like any other; as intervals are whole days, no
list is longer than the days there are.  At the end come the lists and their complements.

A null or open end is ongoing, to 9999-12-31; a null start is from 0001-01-01.  Rows with neither
date or ending before they start assert nothing.  Both days are included, and periods on adjoining
days are one.  A null scope is ''; a null subject or predicate is a value of its own.  Repeated rows
change nothing; an empty table has no periods.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.blocks import encode, reduce_blocks

FIRST, LAST = "0001-01-01", "9999-12-31"
#: more than the days there are
_SPAN = 1 << 23


def sweep(code: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, s, e) of the maximal runs of covered days of each code."""
    order = np.lexsort((s, code))
    code, s, e = code[order], s[order], e[order]
    reach = np.maximum.accumulate(code * _SPAN + e)
    fresh = np.concatenate([[True], code[1:] * _SPAN + s[1:] > reach[:-1] + 1])
    start = np.flatnonzero(fresh)
    last = np.append(start[1:], len(code)) - 1
    return code[start], s[start], reach[last] - code[start] * _SPAN


def merge(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s, e, after): the maximal runs of covered days of each key, from whole day numbers s to e, and the next run's start."""
    own = [f"k{i}" for i in range(len(keys))]
    named = [F.col(f"`{k}`").cast("string").alias(o) for o, k in zip(own, keys, strict=True)]
    rows = df.select(*named, F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in keys]), F.lit(2**62)).alias("hash"), F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"))
    schema = pa.schema([*[(o, pa.string()) for o in own], ("hash", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])
    ddl = ", ".join([*[f"{o} string" for o in own], "hash bigint", "s bigint", "e bigint"])

    def combine(source: pa.Table) -> pa.Table:
        first, code = encode([source.column(o) for o in own])
        shift = 1 << 21  # day numbers before 1970 are negative
        code, s, e = sweep(code.astype(np.int64), source.column("s").to_numpy() + shift, source.column("e").to_numpy() + shift)
        at = pa.array(first[code])
        return pa.Table.from_arrays([*[source.column(c).combine_chunks().take(at).cast(schema.field(c).type) for c in [*own, "hash"]], pa.array(s - shift), pa.array(e - shift)], schema=schema)

    def complement(source: pa.Table) -> pa.Table:
        # a block has whole lists, in order
        code, s = encode([source.column(o) for o in own])[1], source.column("s").to_numpy()
        same = np.append(code[1:] == code[:-1], False)
        return source.drop_columns(["hash"]).append_column("after", pa.array(np.append(s[1:], 0), pa.int64(), mask=~same))

    distinct = rows.agg(F.approx_count_distinct("hash", 0.1)).first()[0]
    found = reduce_blocks(rows, combine, combine, schema, ddl, distinct, complement, ddl.replace("hash bigint, ", "") + ", after bigint")
    return found.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], "s", "e", "after")


def periods_and_gaps(claims: DataFrame) -> DataFrame:
    """(subject, org_scope, predicate, kind, starts, ends) of the state claims."""
    keys = ["subject", "org_scope", "predicate"]
    ongoing = F.col("valid_to").isNull() | F.coalesce(F.col("valid_to_is_open"), F.lit(False))
    held = (
        claims.filter("claim_type = 'state' AND (valid_from IS NOT NULL OR valid_to IS NOT NULL)")
        .select(
            "subject",
            F.coalesce("org_scope", F.lit("")).alias("org_scope"),
            "predicate",
            F.unix_date(F.coalesce("valid_from", F.lit(FIRST).cast("date"))).alias("s"),
            F.unix_date(F.when(ongoing, F.lit(LAST).cast("date")).otherwise(F.col("valid_to"))).alias("e"),
        )
        .filter("e >= s")
    )
    both = merge(held, keys).select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit("period").alias("kind"), F.col("s"), F.col("e")),
                F.struct(F.lit("gap").alias("kind"), (F.col("e") + 1).alias("s"), (F.col("after") - 1).alias("e")),
            )
        ).alias("x"),
    )
    day = lambda c: F.date_from_unix_date(F.col(c).cast("int")).cast("string")
    return both.filter("x.e IS NOT NULL").select(*keys, "x.kind", day("x.s").alias("starts"), day("x.e").alias("ends"))

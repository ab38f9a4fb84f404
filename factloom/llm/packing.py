"""Texts packed into containers of a fixed number of tokens by the sum of squares.

Each item goes to the open container, or a new one, for which the sum over the residual gaps of the
squared number of open containers with that gap becomes smallest; equal sums go to the smaller gap
left.  That keeps open containers of every gap at hand and so the unused space small.

Items are packed in hash shards of at most about ``SHARD`` items, in the order of a hash (which fills
better than larger ones first: 99.8 % against 99.4 % of the given texts); what lies in
containers that a shard leaves with more than ``SLACK`` of their space unused is packed again in a
second round across shards, so few containers stay half empty whatever the number of shards.

A text is split only if it alone exceeds a container: into whole containers and a rest, which is
packed like any other.  Null and empty texts have no tokens and join a container at no cost.
Repeated rows are items of their own; ties are broken by id; an empty table fills no container.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tokens import VOCABULARY, sizes
from factloom.session import cut

SHARD = 20_000
SLACK = 0.002


def sum_of_squares(items: list[int] | np.ndarray, capacity: int) -> np.ndarray:
    """The number of the container of each item; items must not exceed the capacity."""
    open_at = np.zeros(capacity + 1, dtype=np.int64)  # containers by how full they are; a full one counts for nothing
    held: dict[int, list[int]] = defaultdict(list)
    out = np.zeros(len(items), dtype=np.int64)
    opened = 0
    for k, size in enumerate(items):
        size = int(size)
        if size == 0:
            # any container will do; it keeps its level
            if not opened:
                opened = 1
                held[0].append(0)
                open_at[0] = 1
            out[k] = out[k - 1] if k else 0
            continue
        before = open_at[: capacity - size + 1]
        after = open_at[size : capacity + 1]
        change = 2 * (after - before) + 2
        change[-1] = 1 - 2 * before[-1]  # it becomes full
        change[before == 0] = np.iinfo(np.int64).max
        level = int(len(change) - 1 - np.argmin(change[::-1]))
        fresh = 2 * open_at[size] + 1 if size < capacity else 0
        if before[level] == 0 or (not before[0] and fresh < change[level]):
            at, level = opened, 0
            opened += 1
        else:
            at = held[level].pop()
            open_at[level] -= 1
        if level + size < capacity:
            held[level + size].append(at)
            open_at[level + size] += 1
        out[k] = at
    return out


def _round(items: DataFrame, shards: int, number: int, capacity: int) -> DataFrame:
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "doc_id", "piece_no", "salt"], kind="stable", ignore_index=True)
        at = sum_of_squares(rows["n_tokens"].to_numpy(), capacity)
        filled = np.bincount(at, weights=rows["n_tokens"], minlength=1)[at] if len(rows) else np.zeros(0)
        return rows.assign(container_id=[f"{number}-{key[0]}-{k}" for k in at], unused=(capacity - filled).astype(np.int64)).drop(columns=["shard", "rank"])

    rank = F.xxhash64("doc_id", "piece_no", "salt", F.lit(number))
    spread = items.withColumn("rank", rank).withColumn("shard", F.pmod(F.xxhash64("rank"), F.lit(shards)).cast("int"))
    return spread.groupBy("shard").applyInPandas(pack, "doc_id bigint, piece_no int, token_start bigint, n_tokens bigint, salt bigint, container_id string, unused bigint")


def containers(documents: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_id, doc_id, piece_no, token_start, n_tokens) of every text or piece of one."""
    if capacity < 1:
        raise ValueError("a container must hold a token")
    renamed = documents.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sized = cut(sizes(renamed, ["doc_id"], vocabulary=vocabulary))
    whole = F.when(F.col("n_tokens") > capacity, F.floor((F.col("n_tokens") - 1) / capacity)).otherwise(0).cast("int")
    sized = sized.withColumn("whole", whole)
    full = sized.filter("whole > 0").select("doc_id", F.explode(F.expr("sequence(0, whole - 1)")).alias("piece_no"), "salt")
    full = full.select(
        F.concat_ws("-", F.lit("0"), "doc_id", "salt", "piece_no").alias("container_id"),
        "doc_id",
        "piece_no",
        (F.col("piece_no").cast("bigint") * capacity).alias("token_start"),
        F.lit(capacity).cast("bigint").alias("n_tokens"),
    )
    start = F.col("whole").cast("bigint") * capacity
    rest = sized.select("doc_id", F.col("whole").alias("piece_no"), start.alias("token_start"), (F.col("n_tokens") - start).alias("n_tokens"), "salt")
    first = cut(_round(rest, max(1, -(-rest.count() // SHARD)), 1, capacity))
    loose = F.col("unused") > SLACK * capacity
    left = first.filter(loose)
    again = _round(left.drop("container_id", "unused"), max(1, -(-left.count() // SHARD)), 2, capacity)
    columns = ["container_id", "doc_id", "piece_no", "token_start", "n_tokens"]
    return full.unionByName(first.filter(~loose).select(*columns)).unionByName(again.select(*columns))


def report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: items, containers, tokens, the fewest containers that could hold them and the share of space used."""
    filled = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("items"))
    tally = filled.agg(
        F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.coalesce(F.max("n"), F.lit(0)).alias("fullest"),
    )
    fewest = F.ceil(F.col("tokens") / capacity)
    return tally.withColumn("fewest", fewest).withColumn("used", F.when(F.col("containers") > 0, F.round(F.col("tokens") / (F.col("containers") * capacity), 6)))

"""Exact cosine search: a stated set of query vectors against all rows, in blocks.

Query vectors are sent out in blocks of bounded size, one narrow pass over the rows for each: every
batch is one matrix product, and a batch's best rows per query are all that is shuffled.

Null, empty or zero vectors are similar to nothing, as are vectors of another length.  Equal scores go
to the smaller id.  Empty tables have no results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: query vectors sent out at once
BLOCK = 16_384


def _matrix(vectors: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the vectors of that size that point anywhere."""
    at = [k for k, v in enumerate(vectors) if v is not None and len(v) == size and not any(x is None for x in v)]
    m = np.array([vectors[k] for k in at], dtype=np.float64).reshape(len(at), size)
    norm = np.linalg.norm(m, axis=1)
    good = norm > 0
    return np.array(at, dtype=np.int64)[good], m[good] / norm[good][:, None]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, floor: float = 0.6, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query, rank, other, cos) of the k rows most similar to each query vector, itself left out."""
    n = queries.count()
    numbered = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // BLOCK)))))
    found = []
    for block in range(max(1, -(-n // BLOCK))):
        asked = numbered.filter(F.col("block") == block).select("id", "v").toArrow()  # about BLOCK rows
        vectors = asked.column("v").to_pylist()
        size = max((len(v) for v in vectors if v), default=0)
        at, matrix = _matrix(vectors, size)
        ids = asked.column("id").to_numpy()[at] if len(at) else np.zeros(0, dtype=np.int64)
        shared = rows.sparkSession.sparkContext.broadcast((ids, matrix))

        def score(batches: Iterator[pa.RecordBatch], shared=shared, size=size) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            for batch in batches:
                at, m = _matrix(batch.column(1).to_pylist(), size)
                if not len(at) or not len(ids):
                    continue
                others = batch.column(0).to_numpy(zero_copy_only=False)[at]
                cos = matrix @ m.T
                cos[ids[:, None] == others[None, :]] = -2
                order = np.lexsort((np.broadcast_to(others, cos.shape), -np.round(cos, 12)))[:, :k]
                query = np.repeat(np.arange(len(ids)), order.shape[1])
                best = cos[query, order.ravel()]
                good = best >= floor
                yield pa.RecordBatch.from_arrays([pa.array(ids[query][good]), pa.array(others[order.ravel()][good], pa.int64()), pa.array(best[good])], names=["query", "other", "cos"])

        found.append(rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).mapInArrow(score, "query bigint, other bigint, cos double"))
    both = reduce(DataFrame.unionByName, found)
    best = Window.partitionBy("query").orderBy(F.round("cos", 12).desc(), "other")
    return both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query", "rank", "other", "cos")

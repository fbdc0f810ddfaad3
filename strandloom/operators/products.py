"""A stated set of vectors against all rows, as blocks of a matrix product.

Up to ``QUERY_BLOCK`` asked vectors are held on each executor, so that rows are
compared where they lie.  Beyond it both sides are dealt to cells, one for each
block of asked vectors and part of the rows; no vector goes to the driver.

Defined results: null ids and null vectors fall away, as do vectors of another
width than most asked ones; a zero vector has cosine 0; scores are rounded to 6
digits; empty sides give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Asked vectors of a block, and rows of a part where both sides are shuffled.
QUERY_BLOCK, ROW_PART = 20_000, 100_000


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _found(names: pa.Array, asked: np.ndarray, ids: pa.Array, rows: np.ndarray, metric: str, limit: int | None, least: float | None) -> Iterator[pa.RecordBatch]:
    if metric != "l2":
        asked, rows = _units(asked), _units(rows)
    for s in range(0, len(asked), 256):
        q = asked[s : s + 256]
        if metric == "l2":
            away = ((q[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2) if len(rows) * len(q) < 40_000 else (q * q).sum(1)[:, None] + (rows * rows).sum(1)[None] - 2 * q @ rows.T
        else:
            away = q @ rows.T if metric == "similarity" else 1 - q @ rows.T
        away = np.round(away, 6) + 0.0
        if limit is not None:
            key = -away if metric == "similarity" else away
            last = np.partition(key, min(limit, key.shape[1]) - 1, axis=1)[:, min(limit, key.shape[1]) - 1]
            i, j = np.nonzero(key <= last[:, None])  # ties at the edge go on
        else:
            i, j = np.nonzero(away >= least) if metric == "similarity" else np.nonzero(away <= least)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(i + s)), ids.take(pa.array(j)), pa.array(away[i, j])], ["query_id", "id", "score"])


def products(rows: DataFrame, asked: DataFrame, metric: str = "l2", limit: int | None = None, least: float | None = None, block: int = QUERY_BLOCK, part: int = ROW_PART) -> DataFrame:
    """(query_id, id, score): for each of ``asked`` (query_id, v) its rows (id, v).

    ``metric``: ``l2`` (squared distance), ``cosine`` (1 - cosine) or
    ``similarity`` (cosine).  ``limit``: at least the best so many of each row
    batch; ``least``: scores up to it, or from it on for ``similarity``.
    """
    spark = rows.sparkSession
    asked = asked.select("query_id", "v").filter("query_id is not null and v is not null")
    widths = asked.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    schema = f"query_id {dict(asked.dtypes)['query_id']}, id {dict(rows.dtypes)['id']}, score double"
    if not widths:
        return spark.createDataFrame([], schema)
    width, many = widths[0]["width"], widths[0]["n"]
    asked = asked.filter(F.size("v") == width)
    rows = rows.select("id", "v").filter(F.col("id").isNotNull() & (F.size("v") == width))
    if many <= block:
        held = asked.toArrow()
        held = spark.sparkContext.broadcast((held["query_id"].combine_chunks(), _matrix(held["v"])))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = held.value
            for batch in batches:
                if batch.num_rows:
                    yield from _found(names, matrix, batch["id"], _matrix(batch["v"]), metric, limit, least)

        return rows.mapInArrow(near, schema)

    def cell(q: pa.Table, r: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and r.num_rows:
            out = list(_found(q["query_id"].combine_chunks(), _matrix(q["v"]), r["id"].combine_chunks(), _matrix(r["v"]), metric, limit, least))
        return pa.Table.from_batches(out) if out else pa.table({"query_id": q["query_id"].slice(0, 0), "id": r["id"].slice(0, 0), "score": pa.array([], pa.float64())})

    blocks, parts = -(-many // block), max(1, -(-rows.count() // part))
    left = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(cell, schema)

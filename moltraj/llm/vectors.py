"""Vectors as whole numbers, for the operators on embeddings.

A component c becomes floor(256 * c), taken as double. Vectors that are null or hold null or non-finite components take
no part; shorter ones are padded with zeros to the longest. Components must stay below 2^53 once scaled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


def usable(vector: str) -> Column:
    """Whether a vector is there with all its components, and all of them are finite."""
    broken = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & ~F.coalesce(broken, F.lit(True))


def whole_numbers(vector: str, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def longest(rows: DataFrame, vector: str) -> int:
    """Dimensions of the longest vector; 0 for an empty table."""
    return rows.agg(F.max(F.size(vector))).first()[0] or 0


def padded(vector: str, dims: int) -> Column:
    return F.concat(vector, F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size(vector)))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int, dtype=np.int64) -> np.ndarray:
    """A list column whose lists all have `dims` entries, as a two-dimensional array."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [np.asarray(chunk.flatten(), dtype=dtype).reshape(-1, dims) for chunk in chunks]
    return np.concatenate(parts) if parts else np.zeros((0, dims), dtype)


def summed(rows: DataFrame, partial, cells: int, kind: str = "double") -> np.ndarray:
    """Sum over all batches of `partial(batch)`, an array of `cells` numbers; tasks add up their own batches first.

    Only `cells` sums reach the driver, whatever the number of rows.
    """

    def run(batches):
        total = None
        for batch in batches:
            found = partial(batch)
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells), pa.int32()), pa.array(total)], names=["cell", "part"])

    parts = rows.mapInArrow(run, f"cell int, part {kind}").groupBy("cell").agg(F.sum("part").alias("part")).collect()
    result = np.zeros(cells, np.int64 if kind == "long" else np.float64)
    for row in parts:
        result[row["cell"]] = row["part"]
    return result

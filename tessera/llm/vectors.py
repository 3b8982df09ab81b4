"""Vector tables: which rows take part, and numpy views of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vec: Column) -> Column:
    """Not null, not empty, no null, NaN or infinite component."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & ~odd, F.lit(False))


def usual_length(rows: DataFrame, vec: str) -> tuple[int, int]:
    """The commonest length of a vector (of equally common ones the largest),
    and how many rows have it; (0, 0) for an empty table."""
    best = (rows.groupBy(F.size(vec).alias("d")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.desc("d")).limit(1).collect())
    return (best[0].d, best[0].n) if best else (0, 0)


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix of the components' own type."""
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in
            (column.chunks if isinstance(column, pa.ChunkedArray) else [column])]
    return np.concatenate(flat).reshape(-1, dims) if flat else np.zeros((0, dims))

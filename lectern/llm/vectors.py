"""Vectors of whole numbers, made of columns of floats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024


def finite(vector: Column) -> Column:
    """True where vector is there and every entry is a finite number; an empty vector is."""
    ok = F.forall(vector, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(ok, F.lit(False))


def whole(rows: DataFrame, vector: str = "embedding", scale: int = SCALE, plus: int = 0) -> DataFrame:
    """vec_id and x (array of long, floor(scale * entry) + plus) of the rows whose vector is finite."""
    x = F.transform(F.col(vector).cast("array<double>"), lambda e: F.floor(F.lit(float(scale)) * e) + F.lit(plus).cast("long"))
    return rows.filter(finite(F.col(vector).cast("array<double>"))).select("vec_id", x.alias("x"))


def matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """The rows of an Arrow column of lists of long as a matrix of int64, with dims columns or as many as the longest has; shorter ones are filled with zeros, longer ones cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    n = len(column)
    ends = np.asarray(column.offsets)
    values, lengths = np.asarray(column.values)[: ends[-1]] if n else np.zeros(0, np.int64), np.diff(ends)
    d = (int(lengths.max()) if n else 0) if dims is None else dims
    if n and d and (lengths == d).all():
        return values[ends[0] :].reshape(n, d)
    out = np.zeros((n, d), np.int64)
    for i in range(n):
        part = values[ends[i] : ends[i + 1]][:d]
        out[i, : len(part)] = part
    return out

"""Rows of vectors as the two vector operators need them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, x (array<float> where the input is, else array<double>) of vectors that are neither null nor zero nor hold null or non-finite components. A row without
    vec_id takes no part."""
    single = rows.schema[embedding].dataType == ArrayType(FloatType())
    x = F.col(embedding) if single else F.col(embedding).cast("array<double>")
    good = (
        F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
        & F.exists(x, lambda v: v != 0)
    )
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & good)


def matrix(lists: list, dim: int | None = None) -> np.ndarray:
    """Rows of equal length as one float64 matrix."""
    return np.array(lists, np.float64) if len(lists) else np.zeros((0, dim or 0))


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, summed from the first component to the last: the result of a pair depends on
    nothing but the two vectors."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total

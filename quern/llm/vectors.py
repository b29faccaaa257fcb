"""What the operators on embeddings share: which vectors count, and equal ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (double) of the rows whose vector isn't null, empty or zero and has no null or non-finite component."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())


def exact_type(vectors: DataFrame) -> str:
    """The element type of the table's vectors, in which they are kept without loss."""
    kind = vectors.schema["embedding"].dataType
    return "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"


def matrix(column: pd.Series | pa.Array, kind=np.float64) -> np.ndarray:
    """Rows of equal length as a matrix."""
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(kind, copy=False) if len(column) else np.zeros((0, 0), kind)
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(lists), -1)

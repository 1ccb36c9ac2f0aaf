"""Vector functions that need matrix products: Arrow batches, the weights closed over."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def project(vector: Column, first: np.ndarray, second: np.ndarray, *, residual: bool = False) -> Column:
    """A head of two layers, ``relu(v @ first) @ second``, plus v itself if residual, scaled to length one.

    A null vector, one of another length than the weights' or a zero result gives null.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), index=vectors.index, dtype=object)
        fits = vectors.map(lambda v: v is not None and len(v) == len(first))
        if fits.any():
            x = np.array([np.asarray(v, float) for v in vectors[fits]])
            y = np.maximum(x @ first, 0) @ second + (x if residual else 0)
            norm = np.linalg.norm(y, axis=1)
            out[fits] = pd.Series([list(r / n) if n > 1e-12 else None for r, n in zip(y, norm, strict=True)], index=vectors.index[fits], dtype=object)
        return out

    return run(vector)

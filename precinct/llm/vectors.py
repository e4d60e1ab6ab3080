"""Integer vectors from embeddings, shared by clustering and search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from precinct.runtime import send_to_workers

# Largest scaled component in absolute value: sums of 512 squared differences of such stay within 64 bits.
LARGEST = 1 << 27

send_to_workers(__name__)


def usable(vector: str, scale: int, size: int | None = None) -> Column:
    """Whether a vector has `size` components (any number if None), all finite and within LARGEST after scaling."""
    whole = F.col(vector).cast("array<double>")
    inside = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST / scale))
    sized = F.size(whole) >= 0 if size is None else F.size(whole) == size
    return F.coalesce(whole.isNotNull() & sized & inside, F.lit(False))


def integers(vectors: pa.Array, size: int, scale: int) -> np.ndarray:
    """floor(scale * component) of vectors of one size, a row each."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(-1, size)

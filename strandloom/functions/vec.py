"""Vector and score functions as Columns; arithmetic in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for null, empty, ragged or zero vectors."""
    fine = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(fine, dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def l2_squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def mean_vector(v: str, width: int) -> Column:
    """Elementwise mean, an aggregate with partial sums on the map side."""
    return F.array(*[F.avg(F.col(v)[i].cast("double")) for i in range(width)])


def usable(v: str, width: int) -> Column:
    """A vector of the width, finite, not all zero."""
    finite = F.forall(F.col(v), lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce((F.size(v) == width) & finite & F.exists(F.col(v), lambda x: x != 0), F.lit(False))


def age_hours(now: Column, ts: Column, floor: float = 0.0) -> Column:
    """Hours between two times in micros, at least ``floor``; null for no time."""
    return F.when(ts.isNotNull(), F.greatest(F.lit(float(floor)), (now - ts) / F.lit(3.6e9)))


def squash(x: Column) -> Column:
    """x / (1 + x)."""
    return x / (1 + x)


def min_max(x: Column, low: Column, high: Column, flat: float) -> Column:
    """Scaled to the pool; ``flat`` where the pool is."""
    return F.when(high > low, (x - low) / F.greatest(high - low, F.lit(1e-300))).otherwise(F.lit(flat))


def blend(old: Column, new: Column, weight: float) -> Column:
    """The unit mean of two vectors; the new one where the old is empty or of another width."""
    mixed = F.zip_with(old, new, lambda a, b: (1 - weight) * a + weight * b)
    fine = old.isNotNull() & (F.size(old) > 0) & (F.size(old) == F.size(new))
    return F.when(fine, F.transform(mixed, lambda x: x / F.greatest(norm(mixed), F.lit(1e-300)))).otherwise(new)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, at least 0; 2 where it is undefined."""
    fine = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(fine, F.greatest(F.lit(0.0), 1 - cosine(a, b))).otherwise(F.lit(2.0))


@F.pandas_udf(T.BinaryType())
def packed(vectors: pd.Series) -> pd.Series:
    """Vectors as bytes: single precision, the lowest byte first; null stays null."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpacked(data: pd.Series) -> pd.Series:
    """Bytes of ``packed`` as vectors; bytes that are no whole elements are null."""
    return data.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4"))


def stub_embedding(text: Column) -> Column:
    """A vector of 32 elements of length 1 from a text's hash: a stand-in for tests."""
    code = F.sha2(text, 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1)
    return F.transform(raw, lambda x: x / norm(raw))

"""Integer vectors: what of a table takes part, exact products and distances of any size, sums as limbs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a limb of a sum.
LIMB = 32


def finite(column: Column | str, scale: int = 1) -> Column:
    """True for vectors of which no component is null, NaN or infinite, also when it is multiplied by scale."""
    inside = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < F.lit(float("inf"))))
    return F.coalesce(inside, F.lit(False))


def matrix(column: pa.Array, length: int, scale: int = 1) -> np.ndarray:
    """Vectors of one length as rows of floor(scale * x), which doubles hold exactly for a power of two."""
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length) * scale)


def whole(values: np.ndarray) -> np.ndarray:
    """Whole doubles as Python integers."""
    return np.array([int(x) for x in values.ravel().tolist()], dtype=object).reshape(values.shape)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a and b, side by side: int64 where these can't overflow, else Python integers.

    Rows are whole doubles or Python integers.
    """
    if a.dtype != object and b.dtype != object:
        most = float(np.abs(a).max(initial=0)) + float(np.abs(b).max(initial=0))
        if most < 2**52 and most**2 * max(1, a.shape[1]) < 2**62:
            return ((a.astype(np.int64) - b.astype(np.int64)) ** 2).sum(1)
    a, b = (x if x.dtype == object else whole(x) for x in (a, b))
    return ((a - b) ** 2).sum(1) if len(a) else np.zeros(0, dtype=object)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with the rows of b (whole doubles): int64 where these can't overflow, else Python integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)  # sums of doubles are exact up to there
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return whole(a) @ whole(b).T


def held(number: int) -> int:
    """A number held at the bounds of 64 bits."""
    return max(-(2**63), min(2**63 - 1, int(number)))


def limbs(total: int) -> Iterator[tuple[int, int]]:
    """(place, value) with total = sum of value * 2^(LIMB * place), so that Spark's sums of longs stay exact over 2^23 tasks."""
    place = 0
    while not -(2**40) <= total < 2**40:
        yield place, total & (2**LIMB - 1)
        total, place = total >> LIMB, place + 1
    yield place, total


def columns_sum(rows: np.ndarray) -> list[int]:
    """Exact sums of the columns of whole doubles."""
    if float(np.abs(rows).max(initial=0)) * max(1, len(rows)) < 2**62:
        return rows.astype(np.int64).sum(0).tolist()
    return [int(x) for x in whole(rows).sum(0)]

"""Vectors in tiles of bounded size: what the vector operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor NaN nor infinities."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def stacked(vectors, width: int | None = None) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones end in zeros, which no inner product sees."""
    rows = [np.asarray(v, dtype=np.float64) for v in vectors]
    width = max([len(r) for r in rows], default=0) if width is None else width
    if all(len(r) == width for r in rows):
        return np.stack(rows) if rows else np.zeros((0, width))
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r[:width]
    return out


def tiled(rows: DataFrame, tiles: int, into: str, *spread: str) -> DataFrame:
    """Deal rows out to `tiles` tiles by a hash of `spread`: near equal whatever the values are, as
    long as they tell rows apart."""
    return rows.withColumn(into, F.pmod(F.xxhash64(*spread), F.lit(tiles)).cast("int"))


def copied(rows: DataFrame, tiles: int, into: str) -> DataFrame:
    """A copy of every row for each of `tiles` tiles of the other side."""
    return rows.withColumn(into, F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))


def tiles_of(rows: int, size: int) -> int:
    return max(1, -(-rows // size))

"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lowest_hashes(rows: DataFrame, key: Column, n: int, spare: int = 4, total: int | None = None) -> DataFrame:
    """The ``n`` rows with the lowest key hashes, the same ones at any number of tasks.

    A threshold on the hash, from the number of rows, lets through about ``spare * n`` of them, so that what
    reaches the final order does not grow with the data or the number of tasks. ``total`` may give that number, or a close
    one that takes no reading of texts; it decides nothing but the threshold.
    """
    h = F.xxhash64(key)
    total = rows.count() if total is None else total
    if total > spare * n:
        rows = rows.where(h < F.lit(-(1 << 63) + int((1 << 64) * (spare * n / total))))
    return rows.orderBy(h, key).limit(n)

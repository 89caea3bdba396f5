"""Bounded samples of rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(column: str, parts: int) -> F.Column:
    """crc32 of the value as text, modulo `parts`."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def sampled(rows: DataFrame, key: str, wanted: int, total: int | None = None) -> DataFrame:
    """About `wanted` rows (all, if there are fewer), chosen by a hash of `key`, so that they do not
    depend on the order of the table; never more than twice as many."""
    total = rows.count() if total is None else total
    share = min(1.0, wanted / max(total, 1))
    if share == 1.0:
        return rows.limit(2 * wanted)
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(2 * wanted)

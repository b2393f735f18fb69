"""Reproducible shuffles.

A seeded pseudo-random order is the order of ``md5(seed|key)``.  It does not
depend on the partitioning, can be recomputed after an executor is lost, and
needs no sort to be repeatable.  The digest is uniform, so its leading hex
digits cut any group into equal ordered slices (see ``operators.ordering``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shuffle_key(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def slice_digits(rows: int | None, rows_per_slice: int = 250_000) -> int:
    """Hex digits that keep a slice near the given size; 4 when the row count is unknown."""
    if rows is None:
        return 4
    digits = 2
    while digits < 6 and rows > rows_per_slice * 16 ** digits:
        digits += 1
    return digits


def shuffle_slice(digest: Column, digits: int = 4) -> Column:
    """Leading hex digits: 16**digits ordered slices of equal expected size."""
    return F.substring(digest, 1, digits)


def unit_interval(digest: Column) -> Column:
    """Uniform number in [0, 1) from the first eight hex digits of a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)

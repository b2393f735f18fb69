"""Column helpers shared by all operators.  Everything stays inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit0() -> Column:
    return F.lit(0.0)


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """``num / den``; a zero denominator gives ``empty`` instead of an error."""
    fallback = F.lit(empty).cast("double")
    return F.when(den != 0, num.cast("double") / den).otherwise(fallback)


def rnd(col: Column, digits: int = 6) -> Column:
    """Round to the number of digits the reports use."""
    return F.round(col, digits)


def half_even(col: Column) -> Column:
    """Round halves to the even neighbour: the rule behind every share of a count."""
    return F.bround(col, 0).cast("long")


def clip(col: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(col, F.lit(hi)), F.lit(lo))


def nan_to_null(col: Column) -> Column:
    """Medians, averages and ``greatest`` skip NULL but not NaN."""
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)


def widest(cols: list[Column]) -> Column:
    """Row-wise maximum that skips nulls; ``greatest`` itself needs two inputs."""
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def f1_from_counts(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def quoted(name: str) -> str:
    """Back-quote a column name that may hold dots."""
    return "`" + name.replace("`", "``") + "`"

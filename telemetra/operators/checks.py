"""Data assertions as queries: rows checked and violations per check, in one pass per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != float("inf"))


def row_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Checks are row predicates that must hold; all are counted in the same scan."""
    n = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).alias(k)
                                                for k, c in checks.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.col("_n").alias("rows_checked"),
                              F.col(k).alias("violations")) for k in checks])
    return n.select(F.inline(rows))


def one_check(name: str, rows: Column, violations: Column, df: DataFrame) -> DataFrame:
    return df.agg(rows.alias("rows_checked"), violations.alias("violations")).select(
        F.lit(name).alias("check"), F.col("rows_checked").cast("long"), F.col("violations").cast("long"))

"""Exact quantiles of many columns by rank brackets.

A sketch tells between which two values a wanted rank lies.  One scan then
counts the values below each bracket and keeps those inside it, well under one
value in a hundred, and only these are shuffled and ordered.  The counts prove
that the rank lies in its bracket; a column whose bracket misses is read again
with a wider one, so the sketch never decides a result.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from telemetra.functions.numeric import quoted
from telemetra.operators.ordering import add_slices, with_running_sum
from telemetra.session import materialize

#: Sketches of partitions are merged in this many tasks; each returns this many steps per column.
GROUPS = 32
STEPS = 500
ACCURACY = 4000
#: A grid step and the sketch's own error, on either side of a rank.
MARGIN = 1 / STEPS + 2 / ACCURACY

Bracket = tuple[float | None, float | None]     # inclusive ends; None is open


def values_of(name: str) -> Column:
    """The column as double; NaN counts as missing."""
    v = F.col(quoted(name)).cast("double")
    return F.when(~F.isnan(v), v)


def sketch(rows: DataFrame, cols: Sequence[str]) -> list[Row]:
    """Counts and approximate quantile grids of groups of partitions, at most ``GROUPS`` rows."""
    grid = F.expr(f"array({', '.join(f'{i}D / {STEPS}' for i in range(STEPS + 1))})")     # one call, not one per literal
    parts = rows.select(*[values_of(c).alias(f"v{i}") for i, c in enumerate(cols)],
                        (F.spark_partition_id() % GROUPS).alias("_group"))
    return parts.groupBy("_group").agg(*[f.alias(f"{k}{i}") for i in range(len(cols)) for k, f in
                                         (("n", F.count(f"v{i}")), ("q", F.percentile_approx(f"v{i}", grid, ACCURACY)))]).collect()


def brackets(groups: list[Row], i: int, probs: Sequence[float], margin: float) -> list[Bracket]:
    """Disjoint ascending brackets around the wanted ranks of column ``i``."""
    grids = [(r[f"n{i}"], r[f"q{i}"]) for r in groups if r[f"n{i}"]]
    points = np.concatenate([np.asarray(q) for _, q in grids])
    weights = np.concatenate([np.r_[0.0, np.full(STEPS, n / STEPS)] for n, _ in grids])
    order = np.argsort(points, kind="stable")
    points, ranks = points[order], np.cumsum(weights[order])
    n = sum(n for n, _ in grids)
    out: list[Bracket] = []
    for p in sorted(probs):
        first = int(np.searchsorted(ranks, (p - margin) * n - 2, "right")) - 1
        last = int(np.searchsorted(ranks, (p + margin) * n + 2, "left"))
        lo = float(points[first]) if first >= 0 else None
        hi = float(points[last]) if last < len(points) else None
        if out and (lo is None or out[-1][1] is None or lo <= out[-1][1]):
            lo = out.pop()[0]
        out.append((lo, hi))
    return out


def region(i: int, v: Column, found: Sequence[Bracket]) -> Column:
    """(column, region, value): odd regions are brackets, even ones lie below them and carry no value; null beyond the last."""
    def part(j: int, value: Column) -> Column:
        return F.struct(F.lit(i).alias("_col"), F.lit(j).alias("_region"), value.alias("_value"))
    out = F.lit(None)
    for j in reversed(range(len(found))):
        lo, hi = found[j]
        inside = part(2 * j + 1, v)
        out = inside if hi is None else F.when(v <= F.lit(hi), inside).otherwise(out)
        if lo is not None:
            out = F.when(v < F.lit(lo), part(2 * j, F.lit(None).cast("double"))).otherwise(out)
    return F.when(v.isNotNull(), out)


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    where: Column | None = None) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles per column, None for a column without values.

    Two scans of ``df``, which should be cheap to read twice.  NaN counts as
    missing.  The driver receives the grids and a few numbers per column.
    """
    rows = df.filter(where) if where is not None else df
    groups = sketch(rows, cols)
    sizes = [sum(r[f"n{i}"] for r in groups) for i in range(len(cols))]
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    todo, margin = [i for i, n in enumerate(sizes) if n], MARGIN
    while todo:
        found = {i: brackets(groups, i, probs, margin) for i in todo}
        wanted = {i: [p * (sizes[i] - 1) for p in probs] for i in todo}
        got = values_at(rows, {i: values_of(cols[i]) for i in todo}, found,
                        {i: sorted({f(r) for r in wanted[i] for f in (floor, ceil)}) for i in todo})
        for i, at in got.items():
            out[cols[i]] = [at[floor(r)] + (at[ceil(r)] - at[floor(r)]) * (r - floor(r)) for r in wanted[i]]
        todo, margin = [i for i in todo if i not in got], margin * 20
    return out


def values_at(rows: DataFrame, values: dict[int, Column], found: dict[int, list[Bracket]],
              ranks: dict[int, list[int]]) -> dict[int, dict[int, float]]:
    """Values at 0-based ranks; a column with a rank outside its brackets is left out."""
    cells = F.array(*[region(i, v, found[i]) for i, v in values.items()])
    counted = materialize(rows.select(F.inline(F.filter(cells, lambda x: x.isNotNull())))
                          .groupBy("_col", "_region", "_value").agg(F.count(F.lit(1)).alias("_c")))
    totals = {(r["_col"], r["_region"]): r["n"] for r in
              counted.groupBy("_col", "_region").agg(F.sum("_c").alias("n")).collect()}
    wanted, sure = [], []
    for i in values:
        here, before = [], 0
        for j in range(2 * len(found[i])):
            size = totals.get((i, j), 0)
            here += [(i, j, k, k - before) for k in ranks[i] if j % 2 and before <= k < before + size]
            before += size
        if len(here) == len(ranks[i]):
            sure.append(i)
            wanted += here
    if not sure:
        return {}
    inside = counted.filter(F.col("_region") % 2 == 1)
    run = with_running_sum(add_slices(inside, F.col("_value")), ["_col", "_region"], [F.col("_value")], {"_run": F.col("_c")})
    ask = F.expr("array(" + ", ".join(f"struct({i} as c, {j} as r, {k}L as rank, {at}L as at)" for i, j, k, at in wanted) + ")")
    asked = F.filter(ask, lambda a: (a["c"] == F.col("_col")) & (a["r"] == F.col("_region")) & (a["at"] < F.col("_run")))
    hits = run.select("_col", "_value", F.explode(asked).alias("_ask")).select("_col", "_value", "_ask.rank")
    out: dict[int, dict[int, float]] = {i: {} for i in sure}
    for r in hits.groupBy("_col", "rank").agg(F.min("_value").alias("v")).collect():     # a few per column
        out[r["_col"]][r["rank"]] = r["v"]
    return out

"""Sequential recursions (CUSUM, EWMA, gated baselines) over long streams.

The recursion runs over *windows*, not rows.  Even so one stream may hold most
of the windows, so it is cut into chunks of a fixed number of windows and each
chunk is folded by its own task from a state it is given:

    pass 1   every chunk folds from a guessed start state, in parallel
    pass k   chunks whose predecessor ended in another state fold again
    last     all start states agree with their predecessor's end: emit the rows

The states these recursions carry forget their past (an alarm or a clamp resets
CUSUM, EWMA decays geometrically), so a few passes suffice.  In the worst case
every pass fixes at least one more chunk: the result is that of the sequential
fold up to a relative difference of ``tol`` in the states, and no task ever holds
more than one chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.operators.ordering import join_null_safe
from telemetra.session import materialize

#: (rows of one chunk in order, state before) -> (output columns, state after)
Step = Callable[[pd.DataFrame, np.ndarray], tuple[dict[str, Sequence], np.ndarray]]

MAX_CHUNK = 65_536
CHUNK_VALUES = 2 ** 23   # doubles a task may hold for one chunk (64 MB)


def chunk_rows(width: int) -> int:
    """Windows per chunk when each carries ``width`` numbers."""
    return min(MAX_CHUNK, max(256, CHUNK_VALUES // max(1, width)))


def _differs(a: str, b: str, tol: float):
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y) / (1 + F.abs(x))), F.lit(0.0),
                      lambda m, v: F.greatest(m, v))
    return (F.size(a) != F.size(b)) | (gap > tol)


def chunked_scan(df: DataFrame, stream: Sequence[str], ordinal: str, step: Step, init: Sequence[float],
                 out: str, chunk: int = MAX_CHUNK, tol: float = 1e-13,
                 end_state: bool = False) -> DataFrame:
    """Fold ``step`` along ``ordinal`` in each stream.

    ``ordinal`` counts 0, 1, 2, ... within a stream.  ``out`` is the DDL of the
    columns ``step`` returns.  With ``end_state`` the result is one row per
    stream holding the final state instead of one row per window.
    """
    stream = list(stream)
    keys = [*stream, "_chunk"]
    # one number per window: stored once, since every pass reads it again
    data = materialize(df.withColumn("_chunk", F.floor(F.col(ordinal) / F.lit(chunk))))
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.schema.fields if f.name in keys)
    state_ddl = f"{key_ddl}, _out array<double>"
    init_arr = [float(v) for v in init]

    def fold(left: pd.DataFrame, right: pd.DataFrame) -> tuple[dict, np.ndarray]:
        rows = left.sort_values(ordinal, ignore_index=True)
        return step(rows, np.array(right["_in"].iloc[0], dtype=float))

    def end(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({**{k: [] for k in keys}, "_out": []})
        _, state = fold(left, right)
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "_out": [state.tolist()]})

    def emit(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols, _ = fold(left, right)
        rows = left.sort_values(ordinal, ignore_index=True)
        return pd.DataFrame({**{k: v for k, v in zip(stream, key)}, ordinal: rows[ordinal], **cols})

    def run(rows: DataFrame, states: DataFrame, ddl: str, fn) -> DataFrame:
        # fresh column identities: both sides descend from the same table
        given = states.select(*[F.col(c).alias(c) for c in [*keys, "_in"]])
        return rows.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInPandas(fn, ddl)

    start = F.array(*[F.lit(v) for v in init_arr]).cast("array<double>")
    chunks = data.select(*keys).distinct()
    states = chunks.withColumn("_in", start)
    last = data.agg(F.max("_chunk").alias("c")).first()["c"] or 0
    ends = None
    if last > 0:
        ends = materialize(run(data, states, state_ddl, end))
        while True:
            nxt = ends.select(*stream, (F.col("_chunk") + 1).alias("_chunk"), F.col("_out").alias("_new"))
            joined = join_null_safe(states, nxt, keys, "left").withColumn("_new", F.coalesce("_new", start))
            moved = materialize(joined.filter(_differs("_in", "_new", tol))
                                .select(*keys, F.col("_new").alias("_in")))
            states = materialize(join_null_safe(states, moved.select(*keys), keys, "left_anti").unionByName(moved))
            if not moved.take(1):
                break
            todo = join_null_safe(data, moved.select(*keys), keys, "left_semi")
            again = run(todo, moved, state_ddl, end)
            ends = materialize(join_null_safe(ends, moved.select(*keys), keys, "left_anti").unionByName(again))
    if end_state:
        ends = run(data, states, state_ddl, end) if ends is None else ends
        return (ends.groupBy(*stream).agg(F.max_by("_out", "_chunk").alias("state")) if stream
                else ends.agg(F.max_by("_out", "_chunk").alias("state")))
    schema = {f.name: f.dataType.simpleString() for f in data.schema.fields}
    head = ", ".join(f"`{c}` {schema[c]}" for c in [*stream, ordinal])
    return run(data, states, f"{head}, {out}", emit)

"""Missing values, imputation, scaling and variance filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.operators import cleaning
from telemetra.plans.registry import query, r6
from telemetra.session import materialize
from telemetra.sources import fixtures as fx

_SPARSE = ["cell_1_m", "cell_3_m", "cell_1_x", "cell_3_x", "cell_1_ul_retx", "cell_3_ul_retx"]
_KEYS = fx.LI_KEYS[1:5]
_KEY = ", ".join(_KEYS)


@query("missing_percent", f"""with {fx.CELLS_SQL}, t as (
{' union all '.join(f"select '{c}' as column_name, (count(*) - count({c})) * 100.0 / count(*) as m from cells"
                    for c in [*_SPARSE, 't3512', 'imeisv', 'bearer_0_apn'])})
select column_name, {r6('m')} as missing_pct from t order by m desc, column_name limit 8""")
def missing_percent(spark, d):
    c = fx.cells(spark, d)
    out = cleaning.missing_percent(c, [*_SPARSE, "t3512", "imeisv", "bearer_0_apn"], top=8)
    return out.withColumn("missing_pct", F.round("missing_pct", 6))


@query("impute_median", f"""with {fx.CELLS_SQL},
med as (select {', '.join(f'median({c}) as m_{c}' for c in _SPARSE)} from cells)
select {_KEY}, {', '.join(f'coalesce({c}, m_{c}) as {c}' for c in _SPARSE)} from cells, med""")
def impute_median(spark, d):
    c = materialize(fx.cells(spark, d).select(*_KEYS, *_SPARSE))
    return cleaning.impute(c, cleaning.medians(c, _SPARSE))


@query("impute_train_median", f"""with {fx.CELLS_SQL},
c2 as (select *, cast(null as double) as dead from cells),
med as (select {', '.join(f"coalesce(median(case when split = 'train' then {c} end), 0.0) as m_{c}"
                          for c in [*_SPARSE, 'dead'])} from c2)
select {_KEY}, {', '.join(f'coalesce({c}, m_{c}) as {c}' for c in [*_SPARSE, 'dead'])} from c2, med""")
def impute_train_median(spark, d):
    cols = [*_SPARSE, "dead"]
    c = materialize(fx.cells(spark, d).withColumn("dead", F.lit(None).cast("double")).select(*_KEYS, "split", *cols))
    fit = cleaning.medians(c, cols, F.col("split") == "train")
    return cleaning.impute(c.select(*_KEYS, *cols), fit, empty=0.0)


_Z = ["f1", "f2", "f3", "f4", "f5"]


def _z_sql(where: str) -> str:
    cols = ", ".join(f"avg({c}) filter ({where}) as m_{c}, stddev_pop({c}) filter ({where}) as s_{c}" for c in _Z)
    out = ", ".join(r6(f"(li0.{c} - m_{c}) / (case when s_{c} = 0 then 1 else s_{c} end)") + f" as {c}" for c in _Z)
    return f"""with {fx.LIB_SQL}, li0 as (select * from lib), par as (select {cols} from li0)
select {_KEY}, split, {out} from li0, par"""


@query("zscore", _z_sql("true"))
def zscore(spark, d):
    x = fx.li_blocks(spark, d)
    z = cleaning.scale(x, cleaning.fit_moments(x, _Z))
    return z.select(*_KEYS, "split", *[(F.round(c, 6) + 0.0).alias(c) for c in _Z])


@query("zscore_train_only", _z_sql("split = 'train'"))
def zscore_train_only(spark, d):
    x = fx.li_blocks(spark, d)
    z = cleaning.scale(x, cleaning.fit_moments(x, _Z, F.col("split") == "train"))
    return z.select(*_KEYS, "split", *[(F.round(c, 6) + 0.0).alias(c) for c in _Z])


_NUM = [*_SPARSE, "t3512", "imeisv"]


def _dev_sql(agg: str, cond: str, where: str) -> str:
    return f"""with {fx.CELLS_SQL}, t as (
{' union all '.join(f"select '{c}' as column_name, {agg}({c}) filter ({where}) as v from cells" for c in _NUM)})
select column_name, cast({cond} as integer) as kept from t"""


def _report(df, names, kept):
    """Verdict per column, attached to the row count it was based on."""
    pairs = ", ".join(f"'{n}', {int(n in kept)}" for n in names)
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        F.expr(f"stack({len(names)}, {pairs}) as (column_name, kept)"))


@query("constant_columns", _dev_sql("stddev_samp", "v > 0", "true"))
def constant_columns(spark, d):
    c = fx.cells(spark, d)
    gone = cleaning.zero_variance(c, _NUM)
    return _report(c, _NUM, [n for n in _NUM if n not in gone])


@query("variance_filter", _dev_sql("var_pop", "coalesce(v, 0) > 1e-12", "split = 'train'"))
def variance_filter(spark, d):
    c = fx.cells(spark, d)
    return _report(c, _NUM, cleaning.varying(c, _NUM, F.col("split") == "train"))


_PREP = ["m", "x", "ul_retx", "t3512", "dead"]


@query("prepared_dataset", f"""with {fx.CELLS_SQL},
c as (select *, greatest(cell_1_m, case when f4 > 0.07 then null else cell_3_m end) as m, greatest(cell_1_x, cell_3_x) as x,
             greatest(cell_1_ul_retx, cell_3_ul_retx) as ul_retx, cast(null as double) as dead from cells),
md as (select {', '.join(f"coalesce(median({k}) filter (split = 'train'), 0.0) as d_{k}" for k in _PREP)} from c),
i as (select {_KEY}, split, label, {', '.join(f'coalesce({k}, d_{k}) as {k}' for k in _PREP)} from c, md),
par as (select {', '.join(f"avg({k}) filter (split = 'train') as m_{k}, stddev_pop({k}) filter (split = 'train') as s_{k}" for k in ('m', 'x', 'ul_retx'))} from i)
select {_KEY}, split, label, {', '.join(r6(f'(i.{k} - m_{k}) / s_{k}') + f' as {k}' for k in ('m', 'x', 'ul_retx'))} from i, par""")
def prepared_dataset(spark, d):
    """The whole preparation: consolidate, impute, drop constants, scale, store by split, read back.

    Every statistic comes from training rows; constant and all-null columns disappear.
    """
    from telemetra.plans.pipelines import prepare_table
    c = fx.cells(spark, d).withColumn("cell_3_m", F.when(F.col("f4") > 0.07, None).otherwise(F.col("cell_3_m")))
    c = c.withColumn("dead", F.lit(None).cast("double"))
    table, manifest = prepare_table(c.select(*_KEYS, "split", "label", *_SPARSE, "t3512", "dead"), [*_KEYS, "split", "label"])
    kept = manifest["features"]
    return table.select(*_KEYS, "split", "label", *[(F.round(k, 6) + 0.0).alias(k) for k in kept])

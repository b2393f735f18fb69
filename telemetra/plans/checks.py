"""Data quality report."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.operators.ordering import join_null_safe
from telemetra.operators import checks
from telemetra.operators.features import CLOCK_SUFFIXES, numeric_features
from telemetra.plans.registry import query
from telemetra.plans.splits import _DEAL_SQL, dealt
from telemetra.session import materialize
from telemetra.sources import fixtures as fx

_P = "round((f1 + 30 * label) / (f1 + 50), 6)"
_ROW = {
    "finite_values": "f1 is not null and f2 is not null and not isnan(f1) and not isinf(f1)",
    "binary_label": "label in (0, 1)",
    "probability_range": f"{_P} between 0 and 1",
    "timestamp_year": "year(ts) = 2024",
    "block_id_present": "block is not null and block >= 0",
}


@query("data_quality_report", f"""with {_DEAL_SQL}, bl as (select block, epoch_us(max(ts)) - epoch_us(min(ts)) as span from evb group by block),
sc as (select event_type, count(distinct split) as k from evb join deal using (block) group by event_type),
sr as (select split, avg(label) as rate from evb join deal using (block) group by split)
{' union all '.join(f"select '{k}' as check, count(*) as rows_checked, count(*) filter (not ({v})) as violations from evb" for k, v in _ROW.items())}
union all select 'both_classes', count(*), cast(case when sum(label) = 0 or sum(label) = count(*) then 1 else 0 end as bigint) from evb
union all select 'block_span', count(*), count(*) filter (span > {fx.EV_BLOCK_MICROS}) from bl
union all select 'block_in_one_split', count(*), count(*) - count(distinct block) from deal
union all select 'scenario_in_every_split', count(*), count(*) filter (k < 3) from sc
union all select 'class_rate_spread', count(*), cast(case when max(rate) - min(rate) >= 0.20 then 1 else 0 end as bigint) from sr
union all select 'no_clock_feature', count(*), cast(0 as bigint) from evb""")
def data_quality_report(spark, d):
    e = fx.ev_blocks(spark, d)
    a = dealt(spark, d)
    rows = checks.row_checks(e, {
        "finite_values": checks.finite(F.col("f1")) & F.col("f2").isNotNull(),
        "binary_label": F.col("label").isin(0, 1),
        "probability_range": fx.score_expr().between(0, 1),
        "timestamp_year": F.year("ts") == 2024,
        "block_id_present": F.col("block") >= 0,
    })
    # one small table per (block, type) answers the remaining checks
    per = materialize(e.groupBy("block", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"), F.min("ts").alias("a"), F.max("ts").alias("b")))
    one = F.count(F.lit(1))
    blocks = per.groupBy("block").agg((F.unix_micros(F.max("b")) - F.unix_micros(F.min("a"))).alias("span"))
    dealt_rows = join_null_safe(per, a.select("block", "split"), ["block"])
    scen = dealt_rows.groupBy("event_type").agg(F.count_distinct("split").alias("k"))
    rates = dealt_rows.groupBy("split").agg((F.sum("y") / F.sum("n")).alias("rate"))
    clocks = [c for c in numeric_features(e.schema) if c.endswith(CLOCK_SUFFIXES)]
    parts = [
        checks.one_check("both_classes", F.sum("n"), F.when(
            (F.sum("y") == 0) | (F.sum("y") == F.sum("n")), 1).otherwise(0), per),
        checks.one_check("block_span", one, F.count(F.when(F.col("span") > fx.EV_BLOCK_MICROS, 1)), blocks),
        checks.one_check("block_in_one_split", one, one - F.count_distinct("block"), a),
        checks.one_check("scenario_in_every_split", one, F.count(F.when(F.col("k") < 3, 1)), scen),
        checks.one_check("class_rate_spread", one, F.when(F.max("rate") - F.min("rate") >= 0.20, 1).otherwise(0), rates),
        checks.one_check("no_clock_feature", F.sum("n"), F.lit(len(clocks)), per),
    ]
    out = rows
    for p in parts:
        out = out.unionByName(p)
    return out

"""Feature tables: ordered selections and consolidation of sparse column families."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.functions.numeric import quoted, widest

# Names the published feature tables use.
TABLE_FEATURES = """
ul_retx dl_retx ul_tx dl_tx ul_bitrate dl_bitrate ul_mcs dl_mcs ul_path_loss cell_id epre
turbo_decoder_avg initial_ta ul_err ul_n_layer ul_phr ul_rank dl_err cqi p_ue pusch_snr ri
turbo_decoder_max turbo_decoder_min tac bearer_0_session_id bearer_1_session_id
bearer_0_dl_total_bytes bearer_0_ul_total_bytes bearer_0_qos_flow_id bearer_0_sst
bearer_1_dl_total_bytes bearer_1_ul_total_bytes bearer_1_qos_flow_id bearer_1_sst t3512
ue_aggregate_max_bitrate_dl ue_aggregate_max_bitrate_ul
""".split()
TABLE_ALIASES = {
    "bearer_0_session_id": "bearer_0_pdu_session_id",
    "bearer_1_session_id": "bearer_1_pdu_session_id",
}
IDENTIFIER_COLUMNS = """
_time imeisv 5g_tmsi amf_ue_id rnti ran_id ran_plmn tac tac_plmn registered
bearer_0_ip bearer_0_ipv6 bearer_1_ip bearer_1_ipv6
""".split()
CLOCK_SUFFIXES = (".realtime", ".timestamp")
LABEL_COLUMNS = ["timestamp", "attack_active", "attack_phase", "attack_phase_all"]
ATTACKER_COLUMNS = ["Attacker.event", "Attacker.old_value", "Attacker.new_value"]


def cell_families(columns: Sequence[str]) -> dict[str, list[str]]:
    """``cell_<n>_<metric>`` columns by metric.  Looks at names only, never at data."""
    out: dict[str, list[str]] = {}
    for c in columns:
        parts = c.split("_", 2)
        if len(parts) == 3 and parts[0] == "cell":
            out.setdefault(parts[2], []).append(c)
    return dict(sorted(out.items()))


def consolidate(df: DataFrame, families: dict[str, list[str]] | None = None) -> DataFrame:
    """Row-wise maximum of each family replaces its members in one projection."""
    families = cell_families(df.columns) if families is None else families
    gone = {c for cols in families.values() for c in cols} | set(families)
    kept = [F.col(quoted(c)) for c in df.columns if c not in gone]
    return df.select(*kept, *[widest([F.col(quoted(c)) for c in cols]).alias(m)
                              for m, cols in families.items()])


def select_features(df: DataFrame, names: Sequence[str], aliases: dict[str, str] | None = None,
                    keep: Sequence[str] = (), bitrate: str = "cell") -> DataFrame:
    """Consolidate the cell families and select features in report order.

    ``bitrate='device'`` takes the device-level column for the metrics that
    exist on both levels; it is resolved before consolidation replaces them.
    """
    families = cell_families(df.columns)
    if bitrate == "device":
        both = [m for m in families if m in df.columns]
        df = df.drop(*[c for m in both for c in families.pop(m)])
    flat = consolidate(df, families)
    aliases = aliases or {}
    raw = {n: aliases.get(n, n) for n in names}
    missing = [n for n, r in raw.items() if r not in flat.columns]
    if missing:
        raise KeyError(f"features not in the data: {missing}")
    return flat.select(*keep, *[F.col(quoted(r)).alias(n) for n, r in raw.items()])


def retx_feature_set(df: DataFrame, drop: Sequence[str] = IDENTIFIER_COLUMNS) -> DataFrame:
    """Alternative feature table: only retransmission counters are consolidated."""
    df = df.drop(*[c for c in drop if c in df.columns])
    families = {}
    for kind in ("ul_retx", "dl_retx"):
        cols = [c for c in df.columns if c.startswith("cell_") and kind in c]
        if cols:
            families[f"{kind}_max"] = cols
    out = consolidate(df, families)
    return out.drop(*[c for c in out.columns if c.endswith("_apn")])


def numeric_features(schema: T.StructType, exclude: Sequence[str] = (),
                     with_attacker: bool = False, drop_prefix: str | None = None) -> list[str]:
    """Numeric behaviour columns: no labels, no clocks, no attacker fields."""
    skip = {*LABEL_COLUMNS, "scenario", "block", *exclude}
    if not with_attacker:
        skip |= set(ATTACKER_COLUMNS)
    return [f.name for f in schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in skip
            and not f.name.endswith(CLOCK_SUFFIXES)
            and not (drop_prefix and f.name.startswith(drop_prefix))]

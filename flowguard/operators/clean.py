"""Cleaning and mapping of flow tables. The fixed order is: null out, drop sparse columns, drop rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.functions.columns import dash_to_null, finite, is_normal, numbers_of
from flowguard.functions.schema import BOT_NAMES, BOT_STATES, CIC_NAMES, CONTEXT, MAPPED, VOLUME
from flowguard.operators.profile import missing_share, quantiles


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def lower_headers(df: DataFrame) -> DataFrame:
    """Lower-case names; ValueError if two become the same."""
    names = [c.lower() for c in df.columns]
    if clash := {c for c in names if names.count(c) > 1}:
        raise ValueError(f"names clash in lower case: {', '.join(sorted(clash))}")
    return df.toDF(*names)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename what is there."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def translate_state(df: DataFrame, column: str = "state", states: dict[str, str] = BOT_STATES) -> DataFrame:
    """One dialect's states in the other's words; unknown ones stay."""
    return df.replace(states, subset=[column])


def coerce(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers where there are numbers, else null; absent columns are skipped."""
    return df.withColumns(numbers_of(df, columns))


def dash_to_null_all(df: DataFrame) -> DataFrame:
    return df.withColumns({c: dash_to_null(F.col(c)) for c, kind in df.dtypes if kind == "string"})


def inf_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def drop_context(df: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*CONTEXT, *more)


def drop_sparse_columns(df: DataFrame, limit: float = 0.30) -> DataFrame:
    """Drop columns whose share of nulls is above the limit; one row of shares comes to the driver."""
    sparse = [r["feature"] for r in missing_share(df).collect() if r["share"] is not None and r["share"] > limit]
    return df.drop(*sparse)


def drop_null_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.fill(0, [c for c in columns if c in df.columns])


def dedupe_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def ghost_columns(df: DataFrame, constants: dict[str, object], overwrite: bool = True) -> DataFrame:
    """Columns that a dialect lacks, as constants; those that exist stay unless overwritten."""
    return df.withColumns({c: F.lit(v) for c, v in constants.items() if overwrite or c not in df.columns})


def select_contract(df: DataFrame, columns: list[str] = MAPPED) -> DataFrame:
    return df.select(*columns)


def cast_types(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


def log1p_volume(df: DataFrame, columns: list[str] = VOLUME) -> DataFrame:
    return df.withColumns({c: F.log1p(F.col(c).cast("double")) for c in columns})


def clip_upper(df: DataFrame, columns: list[str] = VOLUME, q: float = 0.95, exact: bool = True) -> DataFrame:
    """Cap columns at a quantile. exact interpolates between neighbours (see profile.quantiles); the other way is a sketch
    that gives a value of the column in one pass."""
    if exact:
        limits = quantiles(df, columns, q)
    else:
        limits = df.agg(*[F.approx_percentile(F.col(c), q, 10_000).alias(c) for c in columns]).first().asDict()
    return df.withColumns({c: F.when(F.col(c) > F.lit(limits[c]), F.lit(limits[c])).otherwise(F.col(c)) for c in columns})


def label_of(df: DataFrame, column: str, mode: str) -> DataFrame:
    """label: 0 for normal traffic, else 1."""
    return df.withColumn("label", F.when(is_normal(F.col(column), mode), 0).otherwise(1))


def resolve_label(df: DataFrame) -> Column:
    """The label column that the table has, Label before label; without one all traffic is normal."""
    for name in ("Label", "label"):
        if name in df.columns:
            return F.col(name).cast("string")
    return F.lit("normal")


def union_domains(parts: dict[str, DataFrame]) -> DataFrame:
    """Dialects stacked by name, with their domain."""
    out = None
    for domain, part in parts.items():
        part = part.withColumn("domain", F.lit(domain))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def to_mapped(df: DataFrame, dialect: str) -> DataFrame:
    """A dialect's table in the contract's names and kinds: bot or cic (with snake-case names too), or ton. flow_key is kept."""
    if dialect == "bot":
        out = ghost_columns(rename(translate_state(df), BOT_NAMES), {"dns_qclass": 0, "dns_qtype": 0, "dns_rcode": 0})
    elif dialect == "cic":
        names = CIC_NAMES | {k.replace(" ", "_"): v for k, v in CIC_NAMES.items()}
        out = rename(lower_headers(label_of(strip_headers(df), "Label", "benign") if "label" not in df.columns else df), names)
        out = ghost_columns(out, {"src_ip_bytes": 0, "dst_ip_bytes": 0, "dns_qclass": 0, "dns_qtype": 0, "dns_rcode": 0, "proto": "other", "conn_state": "OTH"})
    else:
        out = coerce(df, [c for c in MAPPED if c not in ("conn_state", "proto", "label")])
    kinds = {c: "double" for c in MAPPED[:7]} | {c: "int" for c in ("dns_qclass", "dns_qtype", "dns_rcode", "label")}
    return select_contract(cast_types(out, kinds), ["flow_key", *MAPPED])

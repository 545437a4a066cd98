"""Feature building: the same column expressions serve tables and streams."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.functions.columns import numbers_of
from flowguard.functions.schema import FEATURES, NUMERIC, PROTOCOLS, STATES


#: More values than that are no categories.
MOST_CATEGORIES = 1000


def categories(df: DataFrame, column: str) -> list[str]:
    """Sorted values of a categorical column; protocols and states are few. A column of very many values is refused."""
    found = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_CATEGORIES + 1).collect())
    if len(found) > MOST_CATEGORIES:
        raise ValueError(f"{column} has more than {MOST_CATEGORIES} values")
    return found


def onehot(df: DataFrame, columns: list[str], drop_first: bool = False) -> DataFrame:
    """0/1 columns named column_value in place of each categorical column; a null is 0 everywhere."""
    out = df
    for c in columns:
        out = out.withColumns({f"{c}_{v}": F.when(F.col(c) == v, 1.0).otherwise(0.0) for v in categories(df, c)[int(drop_first) :]})
    return out.drop(*columns)


def align(df: DataFrame, names: list[str] = FEATURES, keep: tuple[str, ...] = ("flow_key",)) -> DataFrame:
    """The model's columns in its order: absent ones are 0, others go."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in names])


def fit_scaler(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(by, c_mean, c_std...) with the population's deviation: one row, or one for each value of `by`."""
    measures = [x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))]
    return df.groupBy(by).agg(*measures) if by else df.agg(*measures)


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(x - mean) / deviation; a constant column becomes 0. The scaler has a row for each domain at most."""
    out = df.join(F.broadcast(scaler), by) if by else df.crossJoin(F.broadcast(scaler))
    scaled = {c: F.when(F.col(f"{c}_std") > 0, (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).otherwise(F.col(c) * 0.0) for c in columns}
    return out.withColumns(scaled).drop(*[f"{c}_{x}" for c in columns for x in ("mean", "std")])


def assemble(df: DataFrame, columns: list[str] = FEATURES, to: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=to).transform(df)


def flow_features(df: DataFrame, use_categoricals: bool = True) -> dict[str, Column]:
    """The 28 features of a raw flow: numbers (dashes and anything else that isn't one as 0), and 0/1 for known protocols
    (any case) and states (any case). Without categoricals these are 0."""
    found = numbers_of(df, NUMERIC)
    out = {c: F.coalesce(found[c], F.lit(0.0)) if c in found else F.lit(0.0) for c in NUMERIC}
    for column, values, fold in (("proto", PROTOCOLS, F.lower), ("conn_state", STATES, F.upper)):
        for v in values:
            known = use_categoricals and column in df.columns
            out[f"{column}_{v}"] = F.when(fold(F.col(column)) == v, 1.0).otherwise(0.0) if known else F.lit(0.0)
    return out


def featurise(df: DataFrame, keep: tuple[str, ...] = ("flow_key",), use_categoricals: bool = True) -> DataFrame:
    made = flow_features(df, use_categoricals)
    return df.select(*keep, *[made[c].alias(c) for c in FEATURES])


def split_xy(df: DataFrame, label: str = "label", key: str = "flow_key") -> tuple[DataFrame, DataFrame]:
    return df.drop(label), df.select(key, label)


def conv_features(df: DataFrame, column: str, kernels: list[list[float]], to: str = "conv") -> DataFrame:
    """Width-3 convolutions over an array, negative values cut to 0, the larger of each two neighbours kept: one array for
    all kernels in turn. The kernels are fixed."""
    x = F.col(column)

    def pooled(k: list[float]) -> Column:
        at = lambda i: F.element_at(x, i).cast("double")
        conv = F.transform(F.sequence(F.lit(1), F.size(x) - 2), lambda i: F.greatest(F.lit(0.0), at(i) * k[0] + at(i + 1) * k[1] + at(i + 2) * k[2]))
        return F.transform(F.sequence(F.lit(1), F.floor(F.size(conv) / 2).cast("int")), lambda i: F.greatest(F.element_at(conv, 2 * i - 1), F.element_at(conv, 2 * i)))

    return df.withColumn(to, F.when(F.size(x) >= 4, F.concat(*map(pooled, kernels))))

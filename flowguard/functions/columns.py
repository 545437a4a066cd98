"""Column expressions: the only place where text becomes numbers, labels become classes and keys become random order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NORMAL = ("0", "0.0", "normal", "benign", "nan")
#: The case-sensitive list.
_NORMAL_EXACT = ("0", "0.0", "Normal", "benign", "nan")


def number(c: Column, kind: str = "string") -> Column:
    """A finite double, or null: text that isn't a plain number, infinities and NaN give null. kind is the column's type,
    as in DataFrame.dtypes: numbers are cast alone; of text that a cast takes, type suffixes and hexadecimal forms are refused."""
    if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        return c.cast("double")
    if kind in ("float", "double"):
        return finite(c.cast("double"))
    text = c.cast("string")
    return finite(F.when(~text.rlike("[dDfFxX]"), text.try_cast("double")))


def numbers_of(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """number() of those of the columns that a table has, by their types."""
    kinds = dict(df.dtypes)
    return {c: number(F.col(c), kinds[c]) for c in columns if c in kinds}


def finite(c: Column) -> Column:
    """Null for NaN and both infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def dash_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit("-"))


def is_normal(c: Column, mode: str = "trim_lower") -> Column:
    """Whether a label means normal traffic; null counts as normal. Modes: benign (exactly BENIGN), exact (a list with its
    case), lower, trim_lower (the list in any case, also between blanks)."""
    if mode == "benign":
        return F.coalesce(c == "BENIGN", F.lit(False))
    text = c.cast("string")
    text = {"exact": text, "lower": F.lower(text), "trim_lower": F.lower(F.trim(text))}[mode]
    return F.coalesce(text, F.lit("nan")).isin(*(_NORMAL_EXACT if mode == "exact" else _NORMAL))


def key_order(key: Column, seed: int) -> Column:
    """A pseudo-random place of a key, the same in any engine and under any partitioning."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def fraction(key: Column, seed: int) -> Column:
    """A pseudo-random number from 0 up to 1 of a key, from seven hex digits."""
    return F.conv(F.substring(key_order(key, seed), 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))


def attack_decision(p: Column, threshold: float = 0.5, inclusive: bool = True) -> Column:
    """1 from the threshold on (or above it only); null scores give 0."""
    return F.when(p >= threshold if inclusive else p > threshold, 1).otherwise(0)


def confidence(p: Column) -> Column:
    """Probability of the likelier class to two places, halves to even; 0.0 without a score."""
    return F.coalesce(F.bround(F.greatest(p, 1 - p), 2), F.lit(0.0))


def severity(c: Column) -> Column:
    return F.when(c > 0.95, "CRITICAL").otherwise("WARNING")


def badge(n: Column) -> Column:
    return F.when(n > 99, "99+").otherwise(n.cast("string"))


def percent(c: Column) -> Column:
    """One place, as text."""
    return F.format_string("%.1f", c * 100)

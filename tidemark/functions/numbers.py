"""Column arithmetic that is the same on every engine the results are compared with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(x: Column | str, digits: int = 2) -> Column:
    """Half away from zero on the scaled binary value."""
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c * float(10**digits)) / float(10**digits)


def pct_change(new: Column, old: Column, digits: int = 2) -> Column:
    """Change in per cent; null if the old value is zero or null."""
    return rnd(F.try_divide(new - old, old) * 100, digits)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def fixed(x: Column | str, digits: int) -> Column:
    """A number as text with so many digits; N/A for null, which a format alone would cut to its first letters."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c.cast("double"))).otherwise(F.lit("N/A"))


def grouped(x: Column | str, digits: int) -> Column:
    """A number as text with thousands set apart and so many digits; N/A for null."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.isNotNull(), F.format_string(f"%,.{digits}f", c.cast("double"))).otherwise(F.lit("N/A"))


def cell(df_types: dict[str, str], column: str) -> Column:
    """A table's cell: whole numbers as they are, others with two digits, thousands set apart; N/A for null."""
    return grouped(column, 2 if df_types[column] in ("double", "float") or df_types[column].startswith("decimal") else 0)


def signed(x: Column | str, suffix: str = "%") -> Column:
    """A change with its sign, two digits and a suffix; N/A for null."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.isNotNull(), F.concat(F.format_string("%+,.2f", c.cast("double")), F.lit(suffix))).otherwise(F.lit("N/A"))


def series_texts(values: str, unit: str = "") -> Column:
    """The numbers of a list as texts by one rule for all of them: no digits if all are whole, else two; nulls are N/A."""
    whole = F.forall(values, lambda v: v.isNull() | (v == F.floor(v)))
    show = lambda v, d: F.when(v.isNotNull(), F.concat(F.format_string(f"%,.{d}f", v.cast("double")), F.lit(unit))).otherwise(F.lit("N/A"))
    return F.transform(values, lambda v: F.when(whole, show(v, 0)).otherwise(show(v, 2)))

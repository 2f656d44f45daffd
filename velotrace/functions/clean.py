"""Casting and null hygiene."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """Text to double; text that is no number, and NaN, give null."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def no_nan(value: Column) -> Column:
    """NaN to null, so that comparisons with it are never true."""
    return F.when(~F.isnan(value), value)


def floor_div(micros: Column, width: int) -> Column:
    """Floor of micros / width in whole numbers, right for negative values too."""
    w = F.lit(int(width))
    return ((micros - F.pmod(micros, w)) / w).cast("long")

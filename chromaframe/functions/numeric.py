"""Pixel formats, rounding and small integer helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FORMAT_MAX


def normalise(v: Column, fmt: str) -> Column:
    """An integer sample over its format's largest value, so that the least signed value lies below -1; floats as they are."""
    return v.cast("double") / F.lit(float(FORMAT_MAX[fmt])) if fmt in FORMAT_MAX else v.cast("double")


def quantise(v: Column, fmt: str) -> Column:
    """A sample in the format: held in range, rounded half away from zero."""
    if fmt not in FORMAT_MAX:
        return v.cast("float")
    top = float(FORMAT_MAX[fmt])
    held = F.least(F.greatest(v, F.lit(-1.0 if fmt[0] == "i" else 0.0)), F.lit(1.0)) * F.lit(top)
    return F.when(held < 0, F.ceil(held - 0.5)).otherwise(F.floor(held + 0.5)).cast("long")


def next_power_of_two(v: Column) -> Column:
    return F.when(v <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(v - 1)))).cast("long")


def is_power_of_two(v: Column) -> Column:
    return (v > 0) & (F.bit_count(v) == 1)


def divide_round_up(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("long")


def next_multiple(a: Column, b: Column) -> Column:
    return divide_round_up(a, b) * b

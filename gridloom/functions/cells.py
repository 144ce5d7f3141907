"""Column expressions on cell values; all stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def nan() -> Column:
    return F.lit(float("nan"))


def finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) < INF)


def number(v: Column) -> Column:
    """The value unless it is NaN."""
    return F.when(~F.isnan(v), v)


def bit_equal(v: Column, fill: float) -> Column:
    """Equality that tells 0.0 from -0.0, and by which NaN equals NaN."""
    if fill == 0:
        return v.cast("string") == F.lit("-0.0" if math.copysign(1, fill) < 0 else "0.0")
    return v.eqNullSafe(F.lit(fill))


def count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0).cast("bigint"))

"""Shape-preserving two-pass transforms: statistics of each kept cell, then every cell by them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.cells import INF, nan, finite
from gridloom.model import DTYPES, TensorFrame, ValidationError, linear
from gridloom.operators.reductions import fold_column, group, kept

#: Kept cells up to which the statistics are broadcast; beyond, they are joined by a shuffle.
SMALL = 1_000_000
LISTED = 256


def _statistics(t: TensorFrame, method: str, axes: Sequence[int]) -> list[Column]:
    fold = lambda k: fold_column(t, k, axes).alias(f"_{k}")
    v = F.when(finite(t.value), t.value)
    return {
        "center": lambda: [fold("mean")],
        "zscore": lambda: [fold("mean"), fold("std")],
        "scale": lambda: [fold("std")],
        "minmax": lambda: [fold("min"), fold("max")],
        "l1": lambda: [fold("norm_l1")],
        "l2": lambda: [fold("norm_l2")],
        "log1p": lambda: [F.coalesce(F.min(v), F.lit(0.0)).alias("_floor")],
        "sqrt": lambda: [F.coalesce(F.min(v), F.lit(0.0)).alias("_floor")],
        "softmax": lambda: [F.coalesce(F.max(v), F.lit(0.0)).alias("_top")],
    }[method]()


def _meet(t: TensorFrame, cells: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        return cells.withColumn("_one", F.lit(1)).join(F.broadcast(stats.withColumn("_one", F.lit(1))), "_one").drop("_one")
    n = math.prod(t.meta.shape[int(k[1:])] for k in keys)
    return cells.join(F.broadcast(stats) if n <= SMALL else stats, keys)


def _formula(method: str, x: Column) -> tuple[Column, Column | None]:
    """(numerator, denominator or None)."""
    c = F.col
    return {
        "center": lambda: (x - c("_mean"), None),
        "zscore": lambda: (x - c("_mean"), c("_std")),
        "scale": lambda: (x, c("_std")),
        "minmax": lambda: (x - c("_min"), c("_max") - c("_min")),
        "l1": lambda: (x, c("_norm_l1")),
        "l2": lambda: (x, c("_norm_l2")),
        "log1p": lambda: (F.log1p(x - c("_floor")), None),
        "sqrt": lambda: (F.sqrt(x - c("_floor")), None),
        "softmax": lambda: (F.exp(x - c("_top")), c("_sum")),
    }[method]()


def _applied(t: TensorFrame, method: str, axes: Sequence[int]) -> DataFrame:
    """Coordinates, v (DOUBLE) and warned: whether the denominator of a finite cell was 0 or not finite."""
    if not DTYPES[t.meta.dtype].floating or t.meta.dtype == "f16":
        raise ValidationError("transform needs a dataset of f32 or f64")
    keys = kept(t, axes)
    cells = t.df.select(*t.meta.coord_names, t.value.alias("x"))
    d = _meet(t, cells, group(t, axes, *_statistics(t, method, axes)), keys)
    x = F.col("x")
    if method == "softmax":
        s = d.where(finite(x)).groupBy(*keys).agg(F.sum(F.exp(x - F.col("_top"))).alias("_sum"))
        if keys:  # a fibre without a finite cell has no sum; its cells pass through
            n = math.prod(t.meta.shape[int(k[1:])] for k in keys)
            d = d.join(F.broadcast(s) if n <= SMALL else s, keys, "left")
        else:
            d = _meet(t, d, s, keys)
    top, bottom = _formula(method, x)
    if bottom is None:
        bad, value = F.lit(False), top
    else:
        bad = (bottom == 0) | F.isnan(bottom) | (F.abs(bottom) == INF)
        value = F.when(bad, nan()).otherwise(F.try_divide(top, bottom))
    return d.select(*t.meta.coord_names, F.when(finite(x), value).otherwise(x).alias("v"), F.coalesce(finite(x) & bad, F.lit(False)).alias("warned"))


def transform(t: TensorFrame, method: str, axes: Sequence[int] = ()) -> TensorFrame:
    """The tensor after the transform, of the same type and shape."""
    out = _applied(t, method, axes)
    return TensorFrame(t.meta, out.select(*t.meta.coord_names, F.col("v").cast(DTYPES[t.meta.dtype].spark).alias("v")))


def warnings(t: TensorFrame, method: str, axes: Sequence[int] = ()) -> tuple[int, list[int]]:
    """How many cells had no usable denominator, and the least LISTED of their linear indices."""
    at = _applied(t, method, axes).where("warned").select(linear(t.meta.coord_names, t.meta.shape).alias("i"))
    return at.count(), [r["i"] for r in at.orderBy("i").limit(LISTED).collect()]

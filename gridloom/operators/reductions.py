"""Reductions over all cells or over some axes. NaN is skipped by min, max, arg_min and arg_max; ties go to the least index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.cells import INF, nan, bit_equal, count_where, finite, number
from gridloom.model import TensorFrame, ValidationError, linear


def kept(t: TensorFrame, axes: Sequence[int]) -> list[str]:
    """Coordinates that stay; none for a reduction of the whole tensor."""
    return [c for i, c in enumerate(t.meta.coord_names) if i not in axes] if axes else []


def group(t: TensorFrame, axes: Sequence[int], *aggregates: Column) -> DataFrame:
    """One hash aggregate with partial sums: the only shuffle is that of one row per task and kept cell."""
    keys = kept(t, axes)
    return t.df.groupBy(*keys).agg(*aggregates) if keys else t.df.agg(*aggregates)


def fiber_index(t: TensorFrame, axes: Sequence[int]) -> Column:
    """Row-major index within the reduced axes, or within the tensor."""
    axes = axes or range(t.meta.rank)
    return linear([f"c{i}" for i in axes], [t.meta.shape[i] for i in axes])


def fold_column(t: TensorFrame, kind: str, axes: Sequence[int], fill: float | None = None) -> Column:
    """The aggregate of an operation."""
    v = t.value
    if kind in ("arg_min", "arg_max"):
        at = fiber_index(t, axes)
        if kind == "arg_min":
            return F.min(F.when(~F.isnan(v), F.struct(v.alias("v"), at.alias("i"))))["i"]
        return -F.max(F.when(~F.isnan(v), F.struct(v.alias("v"), (-at).alias("i"))))["i"]
    if kind == "null_count":
        if t.meta.cf_decoded and fill is None:
            return count_where(F.isnan(v))
        fill = t.meta.fill() if fill is None else fill
        if fill is None:
            raise ValidationError(f"null_count needs a fill value: none in the query or in the attributes of {t.meta.name!r}")
        return count_where(bit_equal(v, fill))
    return {
        "sum": lambda: F.sum(v),
        "mean": lambda: F.avg(v),
        "min": lambda: F.coalesce(F.min(number(v)), nan()),
        "max": lambda: F.coalesce(F.max(number(v)), nan()),
        "count": lambda: F.count(F.lit(1)),
        "var": lambda: F.var_pop(v),
        "std": lambda: F.stddev_pop(v),
        "product": lambda: F.product(v),
        "norm_l1": lambda: F.sum(F.abs(v)),
        "norm_l2": lambda: F.sqrt(F.sum(v * v)),
        "nan_mean": lambda: F.coalesce(F.avg(number(v)), nan()),
        "nan_std": lambda: F.coalesce(F.stddev_pop(number(v)), nan()),
        "all_finite": lambda: F.bool_and(finite(v)),
        "any_nan": lambda: F.bool_or(F.isnan(v)),
        "any_inf": lambda: F.bool_or(F.abs(v) == INF),
        "nan_count": lambda: count_where(F.isnan(v)),
        "inf_count": lambda: count_where(F.abs(v) == INF),
    }[kind]()


def fold(t: TensorFrame, kind: str, axes: Sequence[int] = (), fill: float | None = None) -> DataFrame:
    """Kept coordinates and the result, named like the operation."""
    return group(t, axes, fold_column(t, kind, axes, fill).alias(kind))


def fold_many(t: TensorFrame, kinds: Sequence[str], axes: Sequence[int] = ()) -> DataFrame:
    """Several folds in one scan."""
    return group(t, axes, *(fold_column(t, k, axes).alias(k) for k in kinds))

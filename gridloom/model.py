"""The tensor model: element types, dataset metadata, and tensors as DataFrames of cells.

A tensor of rank n is a DataFrame with the columns c0 .. c{n-1} (BIGINT, from 0) and v. Linear indices are row-major.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RANK = 8


class ValidationError(ValueError):
    """A query, selection or dataset that isn't valid."""


@dataclass(frozen=True)
class DType:
    name: str
    tag: int
    size: int
    spark: str
    numpy: str

    @property
    def floating(self) -> bool:
        return self.name[0] == "f"


#: Element types with their tags in files (fixed values).
DTYPES = {
    d.name: d
    for d in (
        DType("f32", 1, 4, "float", "<f4"),
        DType("f64", 2, 8, "double", "<f8"),
        DType("i32", 3, 4, "int", "<i4"),
        DType("i64", 4, 8, "bigint", "<i8"),
        DType("u8", 5, 1, "smallint", "<u1"),
        DType("u16", 6, 2, "int", "<u2"),
        DType("i16", 7, 2, "smallint", "<i2"),
        DType("u32", 8, 4, "bigint", "<u4"),
        DType("f16", 9, 2, "float", "<f2"),
        DType("u64", 10, 8, "decimal(20,0)", "<u8"),
    )
}
BY_TAG = {d.tag: d for d in DTYPES.values()}
#: Attributes that name a fill value, in order of precedence (fixed values).
FILL_ATTRS = ("_FillValue", "missing_value", "fill_value")


@dataclass(frozen=True)
class TensorMeta:
    name: str
    dtype: str
    shape: tuple[int, ...]
    chunk_shape: tuple[int, ...] = ()
    dim_names: tuple[str, ...] = ()
    coords: Mapping[str, Sequence[str]] = field(default_factory=dict)
    attrs: Mapping[str, str] = field(default_factory=dict)
    #: Values were decoded from packed ones on import, so missing cells are NaN.
    cf_decoded: bool = False

    def __post_init__(self):
        if self.dtype not in DTYPES:
            raise ValidationError(f"unknown dtype {self.dtype!r}")
        if not 1 <= len(self.shape) <= MAX_RANK:
            raise ValidationError(f"rank must be 1 to {MAX_RANK}, not {len(self.shape)}")
        if any(n < 1 for n in self.shape):
            raise ValidationError("every extent must be at least 1")
        if not self.chunk_shape:
            object.__setattr__(self, "chunk_shape", self.shape)
        if len(self.chunk_shape) != len(self.shape) or any(n < 1 for n in self.chunk_shape):
            raise ValidationError("chunk_shape must have an extent of at least 1 for each axis")
        if self.dim_names and len(self.dim_names) != len(self.shape):
            raise ValidationError("dim_names must name every axis")

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def n_bytes(self) -> int:
        return self.size * DTYPES[self.dtype].size

    @property
    def coord_names(self) -> list[str]:
        return [f"c{i}" for i in range(self.rank)]

    def fill(self) -> float | None:
        """The fill value that the attributes name."""
        for k in FILL_ATTRS:
            if k in self.attrs:
                try:
                    return float(self.attrs[k])
                except ValueError as e:
                    raise ValidationError(f"attribute {k} isn't a number: {self.attrs[k]!r}") from e
        return None

    def labels(self, axis: int) -> list[str] | None:
        """Labels of an axis, by its name or its number."""
        for key in ([self.dim_names[axis]] if self.dim_names else []) + [str(axis)]:
            if key in self.coords:
                return list(self.coords[key])
        return None


def strides(shape: Sequence[int]) -> list[int]:
    """Row-major strides in cells."""
    out = [1] * len(shape)
    for i in range(len(shape) - 2, -1, -1):
        out[i] = out[i + 1] * shape[i + 1]
    return out


def linear(names: Sequence[str], shape: Sequence[int]) -> Column:
    """The row-major index of the coordinates ``names`` in ``shape``."""
    out = F.lit(0).cast("bigint")
    for c, s in zip(names, strides(shape), strict=True):
        out = out + F.col(c) * F.lit(s).cast("bigint")
    return out


@dataclass(frozen=True)
class TensorFrame:
    """Metadata and cells. Each cell of the shape is there once; ``check`` makes sure."""

    meta: TensorMeta
    df: DataFrame
    #: For sources that read chunks: the cells of the given chunks only.
    scan: Callable[[Sequence[tuple[int, ...]]], DataFrame] | None = None

    @property
    def value(self) -> Column:
        """The value for arithmetic: always DOUBLE, as results are."""
        return F.col("v").cast("double")

    def with_values(self, column: Column, dtype: str | None = None) -> TensorFrame:
        dtype = dtype or self.meta.dtype
        return TensorFrame(replace(self.meta, dtype=dtype), self.df.select(*self.meta.coord_names, column.cast(DTYPES[dtype].spark).alias("v")))

    def check(self) -> TensorFrame:
        """Raises unless there is exactly one value for each cell of the shape."""
        m = self.meta
        at = linear(m.coord_names, m.shape)
        inside = F.lit(True)
        for c, n in zip(m.coord_names, m.shape, strict=True):
            inside = inside & (F.col(c) >= 0) & (F.col(c) < n)
        # Distinctness without a distinct: count, sum and sum of squares of the indices would do for honest data, but a
        # count of distinct indices is exact.
        n, d, bad, nulls = self.df.agg(F.count(F.lit(1)), F.count_distinct(at), F.count_if(~inside), F.count_if(F.col("v").isNull())).first()
        if (n, d, bad, nulls) != (m.size, m.size, 0, 0):
            raise ValidationError(f"dataset {m.name!r} isn't dense: {n} cells, {d} distinct, {bad} outside of {list(m.shape)}, {nulls} null")
        return self

"""Packed values by CF conventions: stored * scale_factor + add_offset, missing values as NaN."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gridloom.model import DTYPES, TensorFrame


def _number(attrs, key: str) -> float | None:
    try:
        return float(attrs[key])
    except (KeyError, ValueError):
        return None


def decode(t: TensorFrame) -> TensorFrame:
    """Only for f32 and f64 with a scale or an offset; fill values are met within a millionth."""
    scale, offset = _number(t.meta.attrs, "scale_factor"), _number(t.meta.attrs, "add_offset")
    if t.meta.dtype not in ("f32", "f64") or scale is None and offset is None:
        return t
    fill = t.meta.fill()
    v = F.col("v").cast("double")
    value = v * F.lit(1.0 if scale is None else scale) + F.lit(0.0 if offset is None else offset)
    if fill is not None:
        value = F.when(F.abs(v - fill) <= max(abs(fill) * 1e-6, 1e-6), float("nan")).otherwise(value)
    out = lambda df: df.select(*t.meta.coord_names, value.cast(DTYPES[t.meta.dtype].spark).alias("v"))
    scan = t.scan
    return TensorFrame(replace(t.meta, cf_decoded=True), out(t.df), (lambda chunks: out(scan(chunks))) if scan else None)

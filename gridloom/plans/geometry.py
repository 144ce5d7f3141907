"""Selections and read plans: which cells a query wants and which chunks hold them. Plain Python on the driver."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import functions as F

from gridloom.model import DTYPES, TensorFrame, TensorMeta, ValidationError
from gridloom.plans.document import AxisSlice

#: Tokens of the touch policies (fixed values).
DENSE, STRIDED = "dense_half_open_unit_step", "strided_half_open"


@dataclass(frozen=True)
class Box:
    """A half-open box with a step on each axis."""

    start: tuple[int, ...]
    stop: tuple[int, ...]
    step: tuple[int, ...]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(-(-(e - s) // t) for s, e, t in zip(self.start, self.stop, self.step, strict=True))

    @property
    def strided(self) -> bool:
        return any(t != 1 for t in self.step)


@dataclass(frozen=True)
class ReadPlan:
    dataset: str
    box: Box
    chunks: tuple[tuple[int, ...], ...]
    policy: str
    bytes_logical: int

    def to_dict(self) -> dict:
        return {"touch_policy": self.policy, "global_start": list(self.box.start), "global_stop": list(self.box.stop), "step": list(self.box.step), "logical_shape": list(self.box.shape), "chunk_count": len(self.chunks), "chunks": [list(c) for c in self.chunks], "logical_bytes": self.bytes_logical}


def resolve_axes(meta: TensorMeta, axes: Sequence[int | str], partial: bool = True) -> tuple[int, ...]:
    """Axis numbers, sorted; names are looked up in dim_names. ``[]`` is the whole tensor; all axes together are an error."""
    out = []
    for a in axes:
        if isinstance(a, str):
            at = [i for i, d in enumerate(meta.dim_names) if d == a]
            if not meta.dim_names:
                raise ValidationError(f"axis {a!r}: dataset {meta.name!r} has no dimension names")
            if len(at) != 1:
                raise ValidationError(f"axis {a!r} is {'ambiguous' if at else 'unknown'}; dimensions: {', '.join(meta.dim_names)}")
            a = at[0]
        if a >= meta.rank:
            raise ValidationError(f"axis {a} is out of range for rank {meta.rank}")
        out.append(a)
    if len(set(out)) != len(out):
        raise ValidationError("an axis is named twice")
    if partial and len(out) == meta.rank:
        raise ValidationError("all axes are reduced; use [] for the whole tensor")
    return tuple(sorted(out))


def resolve_selection(meta: TensorMeta, selection: Sequence[AxisSlice] | None) -> Box:
    """The box of a selection; labels are exact, and a stop label is exclusive like a stop number."""
    if selection is None:
        return Box((0,) * meta.rank, meta.shape, (1,) * meta.rank)
    if len(selection) != meta.rank:
        raise ValidationError(f"selection has {len(selection)} slices for rank {meta.rank}")
    start, stop, step = [], [], []
    for axis, s in enumerate(selection):

        def number(label: str, axis: int = axis) -> int:
            labels = meta.labels(axis)
            if labels is None:
                raise ValidationError(f"axis {axis} has no labels")
            if label not in labels:
                raise ValidationError(f"axis {axis} has no label {label!r}")
            return labels.index(label)

        b = number(s.start_label) if s.start_label is not None else s.start or 0
        e = number(s.stop_label) if s.stop_label is not None else meta.shape[axis] if s.stop is None else s.stop
        if not (b < meta.shape[axis] and e <= meta.shape[axis] and b < e):
            raise ValidationError(f"axis {axis}: {b}:{e} isn't a range within 0:{meta.shape[axis]}")
        start.append(b)
        stop.append(e)
        step.append(s.step)
    return Box(tuple(start), tuple(stop), tuple(step))


def touched(n: int, chunk: int, start: int, stop: int, step: int) -> list[int]:
    """Numbers of the chunks of an axis that hold a place of start:stop:step."""
    if step <= chunk:
        return list(range(start // chunk, (start + (stop - 1 - start) // step * step) // chunk + 1))
    return sorted({i // chunk for i in range(start, stop, step)})


def read_plan(meta: TensorMeta, box: Box) -> ReadPlan:
    each = [touched(*x) for x in zip(meta.shape, meta.chunk_shape, box.start, box.stop, box.step, strict=True)]
    return ReadPlan(meta.name, box, tuple(itertools.product(*each)), STRIDED if box.strided else DENSE, math.prod(box.shape) * DTYPES[meta.dtype].size)


def select(t: TensorFrame, box: Box) -> TensorFrame:
    """The cells of a box, renumbered from 0; filters on coordinates reach the scan, and on chunk columns prune files."""
    m, df = t.meta, t.df
    if t.scan is not None and box != Box((0,) * m.rank, m.shape, (1,) * m.rank):
        df = t.scan(read_plan(m, box).chunks)
    cols = []
    for i, (n, chunk, b, e, s) in enumerate(zip(m.shape, m.chunk_shape, box.start, box.stop, box.step, strict=True)):
        c = F.col(f"c{i}")
        if (b, e) != (0, n):
            df = df.where((c >= b) & (c < e))
        if s != 1:
            df = df.where((c - b) % s == 0)
        if f"k{i}" in df.columns:
            ks = touched(n, chunk, b, e, s)
            if len(ks) < -(-n // chunk):
                k = F.col(f"k{i}")
                df = df.where(k.isin(ks) if len(ks) <= 256 and ks[-1] - ks[0] >= len(ks) else (k >= ks[0]) & (k <= ks[-1]))
        cols.append((F.floor((c - b) / s) if s != 1 else c - b if b else c).cast("bigint").alias(f"c{i}"))
    coords = {}
    for i in range(m.rank):
        if (labels := m.labels(i)) is not None:
            coords[m.dim_names[i] if m.dim_names else str(i)] = labels[box.start[i] : box.stop[i] : box.step[i]]
    shape = box.shape
    meta = TensorMeta(m.name, m.dtype, shape, tuple(min(a, b) for a, b in zip(m.chunk_shape, shape, strict=True)), m.dim_names, coords, m.attrs, m.cf_decoded)
    return TensorFrame(meta, df.select(*cols, "v"))

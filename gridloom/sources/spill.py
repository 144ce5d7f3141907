"""Dense exports of selections and transforms: raw little-endian values in row-major order, and derived containers.

Files are written only below allowed folders: that of the source file, the cache, and those the caller names.
"""

from __future__ import annotations

import os
import time
from dataclasses import replace
from pathlib import Path
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.model import DTYPES, TensorFrame, ValidationError, linear
from gridloom.sources.files import publish

if TYPE_CHECKING:
    from gridloom.engine import Planned
    from gridloom.plans.document import Write

#: Bytes of a part that a task makes.
PART_BYTES = 32 << 20


def cache_dir() -> Path:
    root = os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache")
    return Path(root) / "gridloom"


def allowed(path: str | None, source: str | None, roots: list[str] | None, suffix: str) -> Path:
    """The place to write: checked against the allowed folders after links are followed."""
    base = Path(source).resolve().parent if source and "://" not in source else None
    places = [p for p in (base, cache_dir().resolve(), *(Path(r).resolve() for r in roots or ())) if p]
    if path is None:
        return cache_dir().resolve() / f"{os.getpid()}-{time.time_ns()}{suffix}"
    given = Path(path)
    target = (given if given.is_absolute() else (base or Path.cwd()) / given).resolve()
    if not any(target.is_relative_to(p) for p in places):
        raise ValidationError(f"{target} isn't below an allowed folder: {', '.join(map(str, places))}")
    return target


def write_dense(t: TensorFrame, target: Path) -> int:
    """Writes all values in order; tasks make the parts, and the driver appends them one at a time."""
    m = t.meta
    kind = np.dtype(DTYPES[m.dtype].numpy)
    parts = max(1, -(-m.n_bytes // PART_BYTES))

    def run(batches):
        for b in batches:
            v = b.column(1)
            raw = np.array([int(x) for x in v.to_pylist()], kind) if m.dtype == "u64" else v.to_numpy().astype(kind)
            yield pa.RecordBatch.from_arrays([pa.array([raw.tobytes()], pa.binary())], ["body"])

    cells = t.df.select(linear(m.coord_names, m.shape).alias("i"), "v")
    ordered = (cells.repartitionByRange(parts, "i") if parts > 1 else cells.coalesce(1)).sortWithinPartitions("i")
    target.parent.mkdir(parents=True, exist_ok=True)
    draft = f"{target}.{os.getpid()}.{time.time_ns()}.draft"
    try:
        n = 0
        with open(draft, "wb") as f:
            for r in ordered.mapInArrow(run, "body binary").toLocalIterator():
                n += f.write(r["body"])
        if n != m.n_bytes:
            raise ValidationError(f"{n} bytes were made for {m.n_bytes}")
        publish(draft, str(target))
        return n
    finally:
        if os.path.exists(draft):
            os.unlink(draft)


def write(t: TensorFrame, path: str | None, source: str | None, roots: list[str] | None) -> dict:
    target = allowed(path, source, roots, ".bin")
    n = write_dense(t, target)
    return {"spill_path": str(target), "spill_bytes": n}


def sidecar(t: TensorFrame, p: Planned, hints: Write, source: str | None, roots: list[str] | None) -> dict:
    """Publishes the transformed selection as a container of one tile; labels are those of the selection."""
    from gridloom.sources.container import EXTENSION, Event, write_container

    method = p.doc.operation.method
    stamp = f".{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}" if hints.timestamp is not False else ""
    if hints.path is None and source is None:
        raise ValidationError("a sidecar needs a path or a source file to stand beside")
    default = f"{Path(source).stem}.{method}{stamp}{EXTENSION}" if source else None
    target = allowed(hints.path or default, source, roots, EXTENSION)
    name = f"{p.source.name}-{method}"
    meta = replace(t.meta, name=name, chunk_shape=t.meta.shape, attrs=dict(t.meta.attrs) | {"derived_from": p.source.name})
    target.parent.mkdir(parents=True, exist_ok=True)
    write_container(str(target), [TensorFrame(meta, t.df)], history=[Event("transform", source or p.source.name, parents=[p.source.name], params={"method": method, "axes": ",".join(map(str, p.axes))})])
    return {"sidecar_path": str(target), "sidecar_dataset": name}


def numbered(t: TensorFrame):
    """(i, v): values by linear index, for embedders that want a DataFrame."""
    return t.df.select(linear(t.meta.coord_names, t.meta.shape).alias("i"), F.col("v"))

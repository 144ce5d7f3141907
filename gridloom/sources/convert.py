"""Import of array files: sniffing, and copying into a container or a Parquet store.

HDF5 and NetCDF need the optional libraries h5py and netCDF4; Zarr needs none.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
from pyspark.sql import SparkSession

from gridloom.model import DTYPES, TensorFrame, TensorMeta, ValidationError
from gridloom.sources import cf, parquet_tensor, zarr3
from gridloom.sources.container import EXTENSION, MAGIC, Event, cell_schema, cells_of, grid, tile_shape, write_container
from gridloom.sources.files import is_dir, read_range

#: Endings of files by format, endings of compression that are looked through, and first bytes (fixed values).
ENDINGS = {"hdf5": (".h5", ".hdf5", ".hdf", ".he2", ".he5"), "netcdf": (".nc", ".netcdf", ".nc4", ".nc3", ".cdf", ".ncdf"), "container": (EXTENSION,)}
COMPRESSED = (".gz", ".zst", ".bz2", ".xz")
SIGNATURES = {"hdf5": (b"\x89HDF\r\n\x1a\n",), "netcdf": (b"CDF\x01", b"CDF\x02", b"CDF\x05"), "container": (MAGIC,)}
#: Element types of HDF5 and NetCDF arrays; int8 is widened so its sign stays.
KINDS = {"float16": "f16", "float32": "f32", "float64": "f64", "bool": "u8", "int8": "i16", "uint8": "u8", "int16": "i16", "uint16": "u16", "int32": "i32", "uint32": "u32", "int64": "i64", "uint64": "u64"}
PREFERRED = ("units", "long_name", "standard_name", "description", "title", "_FillValue", "missing_value", "scale_factor", "add_offset", "calendar")


def sniff(path: str) -> str:
    """zarr, hdf5, netcdf or container: by ending, then folder, then first bytes."""
    name = os.path.basename(path.rstrip("/")).lower()
    while name.endswith(COMPRESSED):
        name = name.rsplit(".", 1)[0]
    for kind, endings in ENDINGS.items():
        if name.endswith(endings):
            return kind
    if is_dir(path):
        if zarr3._json(f"{path}/zarr.json") is not None:
            return "zarr"
        raise ValidationError(f"{path} is a folder without zarr.json")
    head = read_range(path, 0, 8)
    for kind, marks in SIGNATURES.items():
        if any(head.startswith(m) for m in marks):
            return kind
    raise ValidationError(f"{path} has no known format")


def _attrs(raw: dict) -> dict[str, str]:
    """Well-known attributes first, 64 in all."""
    keys = [k for k in PREFERRED if k in raw] + [k for k in raw if k not in PREFERRED]
    out = {}
    for k in keys:
        v = raw[k]
        v = v.decode(errors="replace") if isinstance(v, bytes) else str(v.item() if isinstance(v, np.generic) else v)
        if v and len(v.encode()) <= 1024:
            out[k] = v
    return dict(list(out.items())[:64])


def _hdf5(path: str) -> Iterator[tuple[TensorMeta, str]]:
    try:
        import h5py
    except ImportError as e:
        raise ValidationError("HDF5 import needs h5py") from e
    found: list = []
    with h5py.File(path, "r") as f:
        f.visititems(lambda name, x: found.append((name, x.dtype.name, x.shape, x.chunks, dict(x.attrs))) if isinstance(x, h5py.Dataset) else None)
    for name, kind, shape, chunks, attrs in found:
        if kind in KINDS and shape and len(shape) <= 8 and all(shape):
            yield TensorMeta(name, KINDS[kind], tuple(shape), tuple(min(a, b) for a, b in zip(chunks or shape, shape, strict=True)), attrs=_attrs(attrs)), name


def _netcdf(path: str) -> Iterator[tuple[TensorMeta, str]]:
    try:
        import netCDF4
    except ImportError as e:
        raise ValidationError("NetCDF import needs netCDF4") from e
    with netCDF4.Dataset(path) as f:
        todo = [("", f)]
        while todo:
            prefix, g = todo.pop(0)
            for name, v in g.variables.items():
                kind = np.dtype(v.dtype).name if v.dtype is not str else "str"
                if kind in KINDS and v.shape and all(v.shape):
                    chunks = v.chunking()
                    chunks = v.shape if chunks in (None, "contiguous") else tuple(min(a, b) for a, b in zip(chunks, v.shape, strict=True))
                    coords = {d: [str(x) for x in g.variables[d][:]] for d in v.dimensions if d in g.variables and g.variables[d].ndim == 1 and len(g.variables[d]) <= 64}
                    yield TensorMeta(prefix + name, KINDS[kind], tuple(v.shape), chunks, tuple(v.dimensions), coords, _attrs({k: v.getncattr(k) for k in v.ncattrs()})), prefix + name
            todo += [(f"{prefix}{k}/", x) for k, x in g.groups.items()]


def _tiles(spark: SparkSession, path: str, kind: str, meta: TensorMeta, name: str) -> TensorFrame:
    """A tensor whose tasks read their tiles from the file; each opens it for itself."""
    places = grid(meta)

    def read(batches):
        if kind == "hdf5":
            import h5py

            source = h5py.File(path, "r")[name]
        else:
            import netCDF4

            file = netCDF4.Dataset(path)
            file.set_auto_maskandscale(False)
            source = file[name]
        for b in batches:
            for p in b.column(0).to_pylist():
                at = places[p]
                shape = tile_shape(meta, at)
                box = tuple(slice(i * c, i * c + n) for i, c, n in zip(at, meta.chunk_shape, shape, strict=True))
                yield cells_of(meta, at, np.ascontiguousarray(source[box]).astype(DTYPES[meta.dtype].numpy))

    table = spark.range(0, len(places), 1, min(len(places), 256))
    return cf.decode(TensorFrame(meta, table.mapInArrow(read, cell_schema(meta))))


def import_tensors(spark: SparkSession, path: str) -> list[TensorFrame]:
    """All numeric arrays of a file; others are left out."""
    kind = sniff(path)
    if kind == "zarr":
        return [zarr3.open_tensor(spark, path, n, node) for n, node in zarr3.arrays(path) if zarr3.meta_of(n, node)]
    if kind == "container":
        from gridloom.sources.container import open_tensor, read_summary

        s = read_summary(path)
        return [open_tensor(spark, path, d.name, s) for d in s.datasets]
    return [_tiles(spark, path, kind, m, n) for m, n in (_hdf5 if kind == "hdf5" else _netcdf)(path)]


def convert(spark: SparkSession, source: str, out: str) -> list[str]:
    """Into a container, or into a Parquet store if ``out`` ends with a slash or ".parquet"; returns the datasets' names."""
    tensors = import_tensors(spark, source)
    if not tensors:
        raise ValidationError(f"{source} has no numeric arrays")
    if out.endswith(("/", ".parquet")):
        for t in tensors:
            parquet_tensor.write(t, out.rstrip("/"))
    else:
        # The file format holds at most 64 labels an axis; longer axes stay without.
        fit = [TensorFrame(replace(t.meta, coords={k: v for k, v in t.meta.coords.items() if len(v) <= 64}), t.df, t.scan) for t in tensors]
        write_container(out, fit, history=[Event("convert", source, params={"format": sniff(source)})])
    return [t.meta.name for t in tensors]



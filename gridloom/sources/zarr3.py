"""Zarr v3 directory stores: reading numeric arrays in groups, and exporting a container."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import DTYPES, TensorFrame, TensorMeta, ValidationError
from gridloom.sources import cf
from gridloom.sources.container import cell_schema, cells_of, decode, read_summary, tile_shape
from gridloom.sources.files import open_fs, read_range

#: Element types of arrays, and the tensor types they become (fixed values). int8 is widened, so its sign stays.
READ = {"float16": "f16", "float32": "f32", "float64": "f64", "bool": "u8", "int8": "i16", "uint8": "u8", "uint16": "u16", "int16": "i16", "int32": "i32", "int64": "i64", "uint32": "u32", "uint64": "u64"}
WRITE = {"f16": "float16", "f32": "float32", "f64": "float64", "u8": "uint8", "u16": "uint16", "i16": "int16", "i32": "int32", "i64": "int64", "u32": "uint32", "u64": "uint64"}


def _json(path: str) -> dict | None:
    f, p = open_fs(path)
    if f.get_file_info(p).type != fs.FileType.File:
        return None
    with f.open_input_file(p) as source:
        return json.loads(source.read())


def arrays(store: str) -> Iterator[tuple[str, dict]]:
    """(name, zarr.json) of each array below a store; groups are parts of the name."""
    f, root = open_fs(store)
    todo = [""]
    while todo:
        name = todo.pop(0)
        node = _json(f"{store}/{name}/zarr.json" if name else f"{store}/zarr.json")
        if node is None:
            continue
        if node.get("zarr_format") != 3:
            raise ValidationError(f"{name or store}: only Zarr version 3 is supported")
        if node.get("node_type") == "array":
            yield name or os.path.basename(root.rstrip("/")), node
            continue
        below = f.get_file_info(fs.FileSelector(f"{root}/{name}" if name else root))
        todo += sorted((f"{name}/" if name else "") + x.base_name for x in below if x.type == fs.FileType.Directory)


def _fill(value, kind: np.dtype):
    return kind.type({"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}.get(value, value) if isinstance(value, str) else value or 0)


def _codecs(node: dict) -> tuple[str, bool]:
    """(byte order, whether zstd follows)."""
    order, zstd = "<", False
    for i, c in enumerate(node.get("codecs", [])):
        name, conf = c.get("name"), c.get("configuration") or {}
        if name == "bytes" and i == 0:
            order = ">" if conf.get("endian") == "big" else "<"
        elif name == "zstd" and not zstd:
            zstd = True
        else:
            raise ValidationError(f"codec {name!r} isn't supported")
    return order, zstd


def meta_of(name: str, node: dict) -> TensorMeta | None:
    """The tensor's metadata, or None for an element type that isn't numeric."""
    dtype = READ.get(node.get("data_type")) if isinstance(node.get("data_type"), str) else None
    if dtype is None or not node["shape"]:
        return None
    chunk = node["chunk_grid"]["configuration"]["chunk_shape"]
    attrs = {k: str(v) for k, v in (node.get("attributes") or {}).items() if isinstance(v, str | int | float) and not isinstance(v, bool)}
    dims = node.get("dimension_names") or ()
    return TensorMeta(name, dtype, tuple(node["shape"]), tuple(min(c, n) for c, n in zip(chunk, node["shape"], strict=True)), tuple(dims) if all(dims) else (), attrs=attrs)


def _chunk_path(node: dict, index: tuple[int, ...]) -> str:
    e = node.get("chunk_key_encoding") or {"name": "default"}
    sep = (e.get("configuration") or {}).get("separator", "/" if e["name"] == "default" else ".")
    return sep.join((["c"] if e["name"] == "default" else []) + [str(i) for i in index])


def open_tensor(spark: SparkSession, store: str, name: str, node: dict) -> TensorFrame:
    """An array as a tensor; a missing chunk has the fill value. Packed values are decoded by their attributes."""
    meta = meta_of(name, node)
    if meta is None:
        raise ValidationError(f"{name}: element type {node.get('data_type')} isn't supported")
    order, zstd = _codecs(node)
    full = tuple(node["chunk_grid"]["configuration"]["chunk_shape"])
    kind = np.dtype("u1" if node["data_type"] == "bool" else node["data_type"]).newbyteorder(order)
    array = _json(f"{store}/{name}/zarr.json") is not None
    folder = f"{store}/{name}" if array else store

    def cells(chunks) -> DataFrame:
        # Tile numbers are plain integers; a task for about 64 MB of them.
        each = max(1, (64 << 20) // max(1, math.prod(full) * kind.itemsize))
        grid = [-(-n // c) for n, c in zip(meta.shape, full, strict=True)]
        if chunks is None:
            n = math.prod(grid)
            table = spark.range(0, n, 1, -(-n // each)).withColumnRenamed("id", "p")
        else:
            places = [int(np.ravel_multi_index(c, grid)) for c in chunks]
            table = spark.createDataFrame([(p,) for p in places], "p long").repartition(-(-len(places) // each))

        def read(batches):
            f, root = open_fs(folder)
            for b in batches:
                for p in b.column(0).to_pylist():
                    index = tuple(map(int, np.unravel_index(p, grid)))
                    path = f"{root}/{_chunk_path(node, index)}"
                    if f.get_file_info(path).type != fs.FileType.File:
                        tile = np.full(full, _fill(node.get("fill_value"), kind.newbyteorder("=")))
                    else:
                        with f.open_input_file(path) as source:
                            raw = source.read()
                        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw) if zstd else raw
                        tile = np.frombuffer(raw, kind).reshape(full)
                    clipped = tile[tuple(slice(0, n) for n in tile_shape(meta, index))]
                    yield cells_of(meta, index, np.ascontiguousarray(clipped).astype(DTYPES[meta.dtype].numpy))

        return table.mapInArrow(read, cell_schema(meta))

    return cf.decode(TensorFrame(meta, cells(None), cells))


def open_catalog(spark: SparkSession, store: str):
    from gridloom.engine import Catalog

    return Catalog({name: partial(open_tensor, spark, store, name, node) for name, node in arrays(store) if meta_of(name, node)}, store)


def array_json(meta: TensorMeta, zstd: bool) -> dict:
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([{"name": "zstd", "configuration": {"level": 0, "checksum": False}}] if zstd else [])
    out = {"zarr_format": 3, "node_type": "array", "shape": list(meta.shape), "data_type": WRITE[meta.dtype], "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(meta.chunk_shape)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0.0 if meta.dtype[0] == "f" else 0, "codecs": codecs, "attributes": dict(meta.attrs)}
    return out | ({"dimension_names": list(meta.dim_names)} if meta.dim_names else {})


def export(spark: SparkSession, source: str, out: str) -> int:
    """A container as a Zarr store; returns the chunks written. Whole tiles keep their stored bytes, those at the edges are padded.

    Tasks write the chunks, so ``out`` must be a folder that executors share.
    """
    s = read_summary(source)
    f, root = open_fs(out)
    info = f.get_file_info(root)
    if info.type == fs.FileType.File or info.type == fs.FileType.Directory and f.get_file_info(fs.FileSelector(root)):
        raise ValidationError(f"{out} isn't empty")
    codecs = {i: {c.codec for c in s.chunks if c.dataset == i} for i in range(len(s.datasets))}
    if any(len(x) > 1 for x in codecs.values()):
        raise ValidationError("a dataset with several codecs can't be exported")
    groups = {""} | {"/".join(d.name.split("/")[:i]) for d in s.datasets for i in range(1, d.name.count("/") + 1)}

    def put(path: str, body: bytes) -> None:
        f.create_dir(os.path.dirname(path), recursive=True)
        with f.open_output_stream(path) as o:
            o.write(body)

    for g in groups:
        put(f"{root}/{g}/zarr.json" if g else f"{root}/zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {}}).encode())
    for i, d in enumerate(s.datasets):
        put(f"{root}/{d.name}/zarr.json", json.dumps(array_json(d, codecs[i] == {1})).encode())

    def write(batches):
        g, top = open_fs(out)
        for b in batches:
            for p in b.column(0).to_pylist():
                c = s.chunks[p]
                m = s.datasets[c.dataset]
                body = read_range(s.path, c.offset, c.stored)
                if tile_shape(m, c.index) != m.chunk_shape:
                    padded = np.zeros(m.chunk_shape, DTYPES[m.dtype].numpy)
                    padded[tuple(slice(0, n) for n in tile_shape(m, c.index))] = decode(m, c, body)
                    body = zstandard.compress(padded.tobytes(), 3) if c.codec else padded.tobytes()
                path = "/".join([top, m.name, "c", *map(str, c.index)])
                g.create_dir(os.path.dirname(path), recursive=True)
                with g.open_output_stream(path) as o:
                    o.write(body)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    if not s.chunks:
        return 0
    n = len(s.chunks)
    return spark.range(0, n, 1, min(n, 1024)).mapInArrow(write, "n long").agg(F.sum("n")).first()[0]


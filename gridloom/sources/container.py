"""The single-file tensor container, version 1: reading by chunk, writing, and metadata in its footer.

The driver reads the directory and the chunk index; tasks read and decode only the chunks that a selection touches.
"""

from __future__ import annotations

import json
import math
import os
import struct
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.model import BY_TAG, DTYPES, TensorFrame, TensorMeta, ValidationError
from gridloom.sources.files import publish, read_range, size_of

#: Fixed values of the format.
MAGIC, INDEX_MAGIC, FOOTER_MAGIC, VERSION = b"TETR", b"TIDX", b"THST", 1
SUPERBLOCK, INDEX_HEADER, ENTRY, TAIL, FLAG_FOOTER = 32, 32, 104, 16, 1
RAW, ZSTD = 0, 1
EXTENSION = ".tet"
#: Limits of the footer's metadata (fixed values).
MAX_INLINE, MAX_SPILLED, MAX_DATASETS, MAX_ATTRS, MAX_STRING, MAX_LABELS, MAX_HISTORY, MAX_PARENTS, MAX_PARAMS = 64 << 10, 16 << 20, 256, 64, 1024, 64, 4096, 16, 32
TOOL = "gridloom"


class ContainerError(ValidationError):
    """A damaged or unsupported container; ``check`` names the part."""

    def __init__(self, check: str, message: str):
        super().__init__(message)
        self.check = check


@dataclass(frozen=True)
class Chunk:
    dataset: int
    index: tuple[int, ...]
    offset: int
    raw: int
    stored: int
    codec: int


@dataclass
class Event:
    op: str
    source: str
    at: str = field(default_factory=lambda: str(int(time.time())))
    parents: list[str] = field(default_factory=list)
    params: dict[str, str] = field(default_factory=dict)

    def to_wire(self) -> dict:
        return {k: v for k, v in vars(self).items() if v or k in ("op", "source", "at")}


@dataclass
class Summary:
    path: str
    length: int
    flags: int
    datasets: list[TensorMeta]
    chunks: list[Chunk]
    budget_bps: int = 0
    budget_bytes: int = 0
    history: list[Event] = field(default_factory=list)
    file_metadata: dict = field(default_factory=dict)
    footer_start: int | None = None
    index: tuple[int, int] = (SUPERBLOCK, 0)

    @property
    def payload_end(self) -> int:
        return self.footer_start if self.footer_start is not None else self.length

    def find(self, name: str) -> int | None:
        return next((i for i, d in enumerate(self.datasets) if d.name == name), None)


def align8(n: int) -> int:
    return n + 7 & ~7


def tile_shape(meta: TensorMeta, index: Sequence[int]) -> tuple[int, ...]:
    """The shape of a tile; those at the edges are clipped."""
    return tuple(min(c, n - i * c) for n, c, i in zip(meta.shape, meta.chunk_shape, index, strict=True))


def grid(meta: TensorMeta) -> list[tuple[int, ...]]:
    """Tile numbers, the last axis fastest."""
    return list(np.ndindex(*(-(-n // c) for n, c in zip(meta.shape, meta.chunk_shape, strict=True))))


# ------------------------------------------------------------------------------------------------------- reading


def _directory(blob: bytes, count: int) -> list[TensorMeta]:
    out, at = [], 0
    for _ in range(count):
        if at + 16 > len(blob):
            raise ContainerError("dataset_directory", "dataset directory is cut off")
        n, tag, rank, _ = struct.unpack_from("<4I", blob, at)
        if tag not in BY_TAG or not 1 <= rank <= 8:
            raise ContainerError("dataset_directory", f"dataset has type tag {tag} and rank {rank}")
        head = align8(16 + n)
        if at + head + 16 * rank > len(blob):
            raise ContainerError("dataset_directory", "dataset record is cut off")
        try:
            name = blob[at + 16 : at + 16 + n].decode()
        except UnicodeDecodeError as e:
            raise ContainerError("dataset_directory", "dataset name isn't UTF-8") from e
        dims = struct.unpack_from(f"<{2 * rank}Q", blob, at + head)
        try:
            out.append(TensorMeta(name, BY_TAG[tag].name, dims[:rank], dims[rank:]))
        except ValidationError as e:
            raise ContainerError("dataset_directory", str(e)) from e
        at += head + 16 * rank
    if at != len(blob):
        raise ContainerError("dataset_directory", "dataset directory has bytes left over")
    if len({d.name for d in out}) != len(out):
        raise ContainerError("dataset_directory", "two datasets have one name")
    return out


def read_summary(path: str, footer: bool = True) -> Summary:
    """The directory, index and (unless not wanted) footer of a file, checked."""
    length = size_of(path)
    if length < SUPERBLOCK:
        raise ContainerError("superblock", "file is shorter than the superblock")
    magic, version, count, flags, index_at, index_len = struct.unpack("<4s3I2Q", read_range(path, 0, SUPERBLOCK))
    if magic != MAGIC or version != VERSION:
        raise ContainerError("superblock", f"magic {magic!r} and version {version} aren't supported")
    if flags & ~FLAG_FOOTER:
        raise ContainerError("superblock", f"unknown flags {flags:#x}")
    if index_at + index_len > length:
        raise ContainerError("chunk_index", "chunk index lies outside of the file")
    if count == 0:
        if (index_at, index_len) != (SUPERBLOCK, 0):
            raise ContainerError("superblock", "a file without datasets has an index")
        out = Summary(path, length, flags, [], [])
    else:
        if length < 40:
            raise ContainerError("dataset_directory", "file is shorter than its directory")
        blob_len = struct.unpack("<Q", read_range(path, 32, 8))[0]
        if 40 + blob_len > length or index_at != align8(40 + blob_len):
            raise ContainerError("dataset_directory", "directory and index don't fit")
        datasets = _directory(read_range(path, 40, blob_len), count)
        raw = read_range(path, index_at, index_len)
        if index_len < INDEX_HEADER:
            raise ContainerError("chunk_index", "chunk index is cut off")
        magic, version, entries, bps, _, budget = struct.unpack_from("<4sIQHHI", raw)
        if magic != INDEX_MAGIC or version != VERSION or index_len != INDEX_HEADER + entries * ENTRY:
            raise ContainerError("chunk_index", "chunk index header is wrong")
        rows = np.frombuffer(raw, np.dtype([("d", "<u8"), ("k", "<u8", 8), ("o", "<u8"), ("r", "<u8"), ("s", "<u8"), ("c", "<u4"), ("z", "<u4")]), offset=INDEX_HEADER)
        chunks = []
        for x in rows:
            d = int(x["d"])
            rank = datasets[d].rank if d < count else 8
            chunks.append(Chunk(d, tuple(map(int, x["k"][:rank])), int(x["o"]), int(x["r"]), int(x["s"]), int(x["c"])))
        out = Summary(path, length, flags, datasets, chunks, bps, budget, index=(index_at, index_len))
    if flags & FLAG_FOOTER and footer:
        _read_footer(out)
    return out


def _read_footer(s: Summary) -> None:
    try:
        n, version, magic = struct.unpack("<QI4s", read_range(s.path, s.length - TAIL, TAIL))
        if magic != FOOTER_MAGIC or version != VERSION or n + TAIL > s.length:
            raise ValueError("tail is wrong")
        start = s.length - TAIL - n
        body = json.loads(read_range(s.path, start, n))
        if not isinstance(body, dict):
            raise ValueError("it isn't an object")
        s.history = [Event(*x) if isinstance(x, list) else Event(**x) for x in body.get("history", [])]
        metadata = body.get("metadata") or {}
        if ref := body.get("metadata_ref"):
            metadata = json.loads(read_range(s.path, ref["offset"], ref["length"]))
            start = min(start, ref["offset"])
        s.file_metadata = metadata.get("file") or {}
        named = metadata.get("datasets") or {}
        for i, d in enumerate(s.datasets):
            if m := named.get(d.name):
                coords = {k: list(v["labels"]) for k, v in (m.get("coords") or {}).items()}
                attrs = dict(m.get("attrs") or {})
                s.datasets[i] = TensorMeta(d.name, d.dtype, d.shape, d.chunk_shape, tuple(m.get("dim_names") or ()), coords, attrs, cf_decoded=d.dtype in ("f32", "f64") and bool({"scale_factor", "add_offset"} & attrs.keys()))
        s.footer_start = start
    except (ValueError, KeyError, TypeError, struct.error, AttributeError) as e:
        raise ContainerError("footer", f"footer is malformed: {e}") from e


def decode(meta: TensorMeta, c: Chunk, stored: bytes) -> np.ndarray:
    """A tile from its stored bytes."""
    if len(stored) != c.stored:
        raise ContainerError("chunk_payloads", "chunk payload is cut off")
    if c.codec == RAW:
        raw = stored
    elif c.codec == ZSTD:
        try:
            raw = zstandard.ZstdDecompressor().decompress(stored, max_output_size=c.raw)
        except zstandard.ZstdError as e:
            raise ContainerError("chunk_decode", f"chunk {c.index} can't be decompressed: {e}") from e
    else:
        raise ContainerError("chunk_decode", f"unknown codec {c.codec}")
    shape = tile_shape(meta, c.index)
    if len(raw) != c.raw or c.raw != math.prod(shape) * DTYPES[meta.dtype].size:
        raise ContainerError("chunk_decode", f"chunk {c.index} has {len(raw)} bytes for shape {shape}")
    return np.frombuffer(raw, DTYPES[meta.dtype].numpy).reshape(shape)


def value_array(meta: TensorMeta, flat: np.ndarray) -> pa.Array:
    """Values in the Arrow type of the column."""
    d = DTYPES[meta.dtype]
    if meta.dtype == "u64":
        return pa.array([int(x) for x in flat], pa.decimal128(20, 0))
    kind = {"float": pa.float32(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16()}[d.spark]
    return pa.array(flat.astype(kind.to_pandas_dtype()), kind)


def cells_of(meta: TensorMeta, index: Sequence[int], tile: np.ndarray) -> pa.RecordBatch:
    """The cells of a tile, in row-major order."""
    places = np.indices(tile.shape, np.int64).reshape(meta.rank, -1)
    cols = [pa.array(p + i * c) for p, i, c in zip(places, index, meta.chunk_shape, strict=True)]
    return pa.RecordBatch.from_arrays([*cols, value_array(meta, tile.reshape(-1))], [*meta.coord_names, "v"])


def cell_schema(meta: TensorMeta) -> str:
    return ", ".join([*(f"{c} bigint" for c in meta.coord_names), f"v {DTYPES[meta.dtype].spark}"])


class _Part(InputPartition):
    def __init__(self, chunks: list[Chunk]):
        self.chunks = chunks


class _Reader(DataSourceReader):
    """One partition for about ``part_bytes`` of payload, in the order of the file, so reads are sequential."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.part = int(options.get("part_bytes", 64 << 20))
        s = read_summary(self.path)
        at = s.find(options["dataset"])
        if at is None:
            raise ValidationError(f"no dataset {options['dataset']!r}")
        self.meta = s.datasets[at]
        wanted = {tuple(x) for x in json.loads(options["chunks"])} if options.get("chunks") else None
        self.chunks = sorted((c for c in s.chunks if c.dataset == at and (wanted is None or c.index in wanted)), key=lambda c: c.offset)

    def partitions(self) -> list[InputPartition]:
        out: list[list[Chunk]] = []
        size = self.part
        for c in self.chunks:
            if size >= self.part:
                out.append([])
                size = 0
            out[-1].append(c)
            size += c.raw
        return [_Part(x) for x in out] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        for c in partition.chunks:
            yield cells_of(self.meta, c.index, decode(self.meta, c, read_range(self.path, c.offset, c.stored)))


class ContainerDataSource(DataSource):
    """``spark.read.format("tensor_container").option("path", ...).option("dataset", ...)``; option chunks: a JSON list of tile numbers."""

    @classmethod
    def name(cls) -> str:
        return "tensor_container"

    def schema(self) -> str:
        s = read_summary(self.options["path"])
        at = s.find(self.options["dataset"])
        if at is None:
            raise ValidationError(f"no dataset {self.options['dataset']!r}")
        return cell_schema(s.datasets[at])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def open_tensor(spark: SparkSession, path: str, name: str, summary: Summary | None = None) -> TensorFrame:
    """A dataset of a file; selections read only the tiles they touch."""
    s = summary or read_summary(path)
    at = s.find(name)
    if at is None:
        raise ValidationError(f"no dataset {name!r}; there are: {', '.join(d.name for d in s.datasets)}")
    spark.dataSource.register(ContainerDataSource)
    base = partial(lambda: spark.read.format("tensor_container").option("path", path).option("dataset", name))
    return TensorFrame(s.datasets[at], base().load(), lambda chunks: base().option("chunks", json.dumps(list(chunks))).load())


def open_catalog(spark: SparkSession, path: str):
    """All datasets of a file."""
    from gridloom.engine import Catalog

    s = read_summary(path)
    return Catalog({d.name: partial(open_tensor, spark, path, d.name, s) for d in s.datasets}, path, s.budget_bytes or None, s.budget_bps or None)


# ------------------------------------------------------------------------------------------------------- writing


def encode_tiles(t: TensorFrame, codec: int = RAW, level: int = 3) -> DataFrame:
    """(place, index, raw, body): a row for each tile of a tensor, encoded where its cells are."""
    m = t.meta
    grid_shape = [-(-n // c) for n, c in zip(m.shape, m.chunk_shape, strict=True)]
    ks = [F.floor(F.col(c) / n).cast("bigint").alias(f"k{i}") for i, (c, n) in enumerate(zip(m.coord_names, m.chunk_shape, strict=True))]

    def run(tab: pa.Table) -> pa.Table:
        index = [tab.column(f"k{i}")[0].as_py() for i in range(m.rank)]
        shape = tile_shape(m, index)
        if tab.num_rows != math.prod(shape):
            raise ValidationError(f"tile {index} of {m.name!r} has {tab.num_rows} cells for shape {shape}")
        out = np.zeros(shape, DTYPES[m.dtype].numpy)
        at = tuple(tab.column(c).to_numpy() - i * n for c, i, n in zip(m.coord_names, index, m.chunk_shape, strict=True))
        v = tab.column("v")
        out[at] = np.array([int(x) for x in v.to_pylist()], out.dtype) if m.dtype == "u64" else v.to_numpy().astype(out.dtype)
        raw = out.tobytes()
        body = zstandard.compress(raw, level) if codec == ZSTD else raw
        place = int(np.ravel_multi_index(index, grid_shape))
        return pa.table({"place": pa.array([place], pa.int64()), "index": pa.array([index], pa.list_(pa.int64())), "raw": pa.array([len(raw)], pa.int64()), "body": pa.array([body], pa.binary())})

    return t.df.select(*m.coord_names, "v", *ks).groupBy(*(f"k{i}" for i in range(m.rank))).applyInArrow(run, "place long, index array<long>, raw long, body binary")


def _check_strings(meta: TensorMeta) -> None:
    def good(x: str) -> None:
        if not x or len(x.encode()) > MAX_STRING:
            raise ValidationError(f"metadata strings have 1 to {MAX_STRING} bytes")

    if len(meta.attrs) > MAX_ATTRS:
        raise ValidationError(f"{meta.name!r} has more than {MAX_ATTRS} attributes")
    for x in (*meta.attrs, *meta.attrs.values(), *meta.dim_names, *meta.coords):
        good(x)
    for axis, labels in meta.coords.items():
        if len(labels) > MAX_LABELS:
            raise ValidationError(f"axis {axis!r} of {meta.name!r} has more than {MAX_LABELS} labels; the file format holds no more")
        for x in labels:
            good(x)


def _footer(metas: Sequence[TensorMeta], history: Sequence[Event], file_metadata: dict, at: int) -> bytes:
    named = {}
    for m in metas:
        d = {"attrs": dict(m.attrs), "dim_names": list(m.dim_names), "coords": {k: {"labels": list(v)} for k, v in m.coords.items()}}
        if d := {k: v for k, v in d.items() if v}:
            named[m.name] = d
    metadata = {k: v for k, v in (("file", file_metadata), ("datasets", named)) if v}
    body: dict = {"history": [e.to_wire() for e in history]}
    inline = json.dumps(body | {"metadata": metadata}).encode()
    spilled = b""
    if len(inline) > MAX_INLINE:
        spilled = json.dumps(metadata).encode()
        if len(spilled) > MAX_SPILLED:
            raise ValidationError("metadata is too large for the file format")
        inline = json.dumps(body | {"metadata_ref": {"offset": at, "length": len(spilled)}}).encode()
    return spilled + inline + struct.pack("<QI4s", len(inline), VERSION, FOOTER_MAGIC)


def _head(metas: Sequence[TensorMeta], n_chunks: int, flags: int, bps: int, budget: int) -> tuple[bytes, int]:
    """Superblock, directory and index header; and where the first payload goes."""
    blob = b""
    for m in metas:
        name = m.name.encode()
        record = struct.pack("<4I", len(name), DTYPES[m.dtype].tag, m.rank, 0) + name
        blob += record.ljust(align8(len(record)), b"\0") + struct.pack(f"<{2 * m.rank}Q", *m.shape, *m.chunk_shape)
    index_at = align8(40 + len(blob))
    index_len = INDEX_HEADER + n_chunks * ENTRY
    head = struct.pack("<4s3I2Q", MAGIC, VERSION, len(metas), flags, index_at, index_len) + struct.pack("<Q", len(blob)) + blob
    return head.ljust(index_at, b"\0") + struct.pack("<4sIQHHIQ", INDEX_MAGIC, VERSION, n_chunks, bps, 0, budget, 0), index_at + index_len


def write_empty(path: str) -> None:
    with open(path, "wb") as f:
        f.write(struct.pack("<4s3I2Q", MAGIC, VERSION, 0, 0, SUPERBLOCK, 0))


def write_container(path: str, tensors: Sequence[TensorFrame], codec: int = RAW, history: Sequence[Event] = (), file_metadata: dict | None = None, budget_bps: int = 0, budget_bytes: int = 0, keep: Summary | None = None) -> None:
    """Writes datasets into one file; with ``keep``, after those of another file, whose stored bytes stay as they are.

    Tiles are encoded by tasks; the driver appends them one after the other as they come in tile order, a partition at a
    time, so its memory holds a few tiles. The file appears under its name only when it is whole.
    """
    metas = [*(keep.datasets if keep else []), *(t.meta for t in tensors)]
    if not metas:
        return write_empty(path)
    if len({m.name for m in metas}) != len(metas):
        raise ValidationError("two datasets have one name")
    if len(metas) > MAX_DATASETS:
        raise ValidationError(f"a file holds at most {MAX_DATASETS} datasets")
    for m in metas:
        _check_strings(m)
    if len(history) > MAX_HISTORY or any(len(e.parents) > MAX_PARENTS or len(e.params) > MAX_PARAMS for e in history):
        raise ValidationError("history is too long for the file format")
    n = sum(len(grid(m)) for m in metas)
    info = {"tool": TOOL, "created_at": str(int(time.time()))} | (file_metadata or {})
    head, at = _head(metas, n, FLAG_FOOTER, budget_bps, budget_bytes)
    draft = f"{path}.{os.getpid()}.{time.time_ns()}.draft"
    entries = []

    def note(dataset: int, index: Sequence[int], raw: int, stored: int, codec: int) -> None:
        nonlocal at
        entries.append(struct.pack("<Q8Q3Q2I", dataset, *index, *(0,) * (8 - len(index)), at, raw, stored, codec, 0))
        at += stored

    try:
        with open(draft, "wb") as f:
            f.write(head)
            f.seek(at)
            for c in keep.chunks if keep else ():
                f.write(read_range(keep.path, c.offset, c.stored))
                note(c.dataset, c.index, c.raw, c.stored, c.codec)
            base = len(keep.datasets) if keep else 0
            for i, t in enumerate(tensors):
                tiles = encode_tiles(t, codec).repartitionByRange(max(1, -(-t.meta.n_bytes // (64 << 20))), "place").sortWithinPartitions("place")
                expected = 0
                for r in tiles.toLocalIterator(prefetchPartitions=True):
                    if r["place"] != expected:
                        raise ValidationError(f"tile {expected} of {t.meta.name!r} is missing")
                    expected += 1
                    f.write(r["body"])
                    note(base + i, r["index"], r["raw"], len(r["body"]), codec)
                if expected != len(grid(t.meta)):
                    raise ValidationError(f"tiles of {t.meta.name!r} are missing")
            f.write(_footer(metas, history, info, at))
            f.seek(len(head))
            f.write(b"".join(entries))
        publish(draft, path)
    finally:
        if os.path.exists(draft):
            os.unlink(draft)


def append(path: str, tensors: Sequence[TensorFrame], codec: int = RAW, history: Sequence[Event] = ()) -> None:
    """Adds datasets to a file, which is replaced as a whole; old payloads are copied byte by byte."""
    old = read_summary(path)
    write_container(path, tensors, codec, [*old.history, *history], old.file_metadata, old.budget_bps, old.budget_bytes, keep=old)


class Session:
    """Collects datasets and metadata, and commits them once."""

    def __init__(self, path: str, codec: int = RAW, append: bool = False):
        self.path, self.codec, self.append = path, codec, append
        self.tensors: list[TensorFrame] = []
        self.history: list[Event] = []
        self.done = False

    def add(self, t: TensorFrame, **changes) -> Session:
        from dataclasses import replace

        if any(x.meta.name == (changes.get("name") or t.meta.name) for x in self.tensors):
            raise ValidationError(f"dataset {t.meta.name!r} is there already")
        self.tensors.append(TensorFrame(replace(t.meta, **changes), t.df, t.scan))
        return self

    def note(self, op: str, source: str, **more) -> Session:
        self.history.append(Event(op, source, **more))
        return self

    def commit(self) -> None:
        if self.done:
            raise ValidationError("the session is committed already")
        self.done = True
        (append if self.append else write_container)(self.path, self.tensors, self.codec, history=self.history)

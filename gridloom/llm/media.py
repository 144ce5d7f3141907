"""Media columns: content-addressed payloads in tar shards, and rows that carry digest, shard, offset and length.

Every payload is stored losslessly as a PNG image, 64 pixels of three 8-bit samples wide, under the digest of its
payload. Each task writes tar shards into the shared folder and stores a digest once while it is among the last REMEMBERED
of the task; where a digest is stored more than once, one copy is elected and all rows refer to it. Shards are read back by range: first the
33 bytes of signature and header, which fill the metadata columns, then the stored form itself.

Shards of a lost task stay unreferenced, and a task that runs again writes new ones; the table of rows is fixed on
the shared folder before anything is read back.

Defined results: a null or empty text is one row of 192 spaces; equal texts have equal values, stored once or twice;
repeated rows give a row each; an empty table gives an empty result and no shard; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import lookup, materialize, scratch_path, table

ROW, WIDTH = 192, 64
#: Bytes from which on a task begins a new shard, and the effort of compression.
SHARD_BYTES, LEVEL = 64 << 20, 1
HEADER_BYTES = 33
#: Digests that a task remembers to have stored: some 200 bytes each.
REMEMBERED = 200_000
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (max(1, -(-len(raw) // ROW)) * ROW - len(raw))


def _part(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """The payload as the samples of an RGB image, row by row, unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    return _SIGNATURE + _part(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)) + _part(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _part(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, bits of a sample, colour type) from the first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", head[16:26])


def from_png(stored: bytes) -> bytes:
    """The samples of an image that ``to_png`` made."""
    _, height, bits, colour = png_header(stored[:HEADER_BYTES])
    if (bits, colour) != (8, 2):
        raise ValueError("only 8-bit RGB is stored here")
    at, body = 8, []
    while at < len(stored):
        n = struct.unpack(">I", stored[at : at + 4])[0]
        kind, data = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            body.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, ROW + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered rows are stored here")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, deviation and mean step of the samples, to four places, and how many values occur."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64)
    return f"{x.mean():.4f}:{x.std():.4f}:{np.abs(np.diff(x)).mean():.4f}:{int((np.bincount(x.astype(np.int64), minlength=256) > 0).sum())}"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ShardWriter:
    """Writes tar shards below ``root``; ``add`` returns (shard, offset of the content)."""

    def __init__(self, root: str):
        self.fs, self.path = filesystem(root)
        self.fs.create_dir(self.path, recursive=True)
        self.out, self.name, self.at = None, "", 0

    def add(self, name: str, content: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= SHARD_BYTES:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}")
        info = tarfile.TarInfo(name)
        info.size = len(content)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        start = self.at + len(head)
        pad = -len(content) % tarfile.BLOCKSIZE
        self.out.write(head)
        self.out.write(content)
        self.out.write(b"\0" * pad)
        self.at = start + len(content) + pad
        return self.name, start

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * (2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.out = None


STORED = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
READ = "digest string, shard string, offset long, length long, n_rows long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width long, height long, sample_bits int, feature string"

READ_NAMES = [x.split()[0] for x in READ.split(", ")]


def store(docs: DataFrame, root: str) -> DataFrame:
    """Writes the payloads of ``docs`` (doc_id, text) and returns a row for each: digest, shard, offset, length."""

    def write(batches):
        writer, known = ShardWriter(root), {}
        for b in batches:
            rows = []
            for t in b.column(1):
                n, payload = payload_of(t.as_py())
                digest = hashlib.sha256(payload).digest()
                if digest not in known:
                    media = to_png(payload)
                    known[digest] = (*writer.add(f"{digest.hex()}.png", media), len(media))
                place = known[digest] = known.pop(digest)  # the last used stays longest
                if len(known) > REMEMBERED:
                    del known[next(iter(known))]
                rows.append((n, digest.hex(), *place))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        writer.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(write, STORED)


class Shards:
    """Range reads from the shards below ``root``; one of them is open at a time."""

    def __init__(self, root: str):
        self.fs, self.path = filesystem(root)
        self.name, self.source = "", None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            self.close()
            self.name, self.source = shard, self.fs.open_input_file(f"{self.path}/{shard}")
        return self.source.read_at(length, offset)

    def close(self) -> None:
        if self.source is not None:
            self.source.close()
            self.name, self.source = "", None


def headers(media: DataFrame, root: str) -> DataFrame:
    """``media`` (digest, shard, offset, length, n_rows) with width, height and sample_bits, from range reads of the headers only."""

    def read(batches):
        shards = Shards(root)
        for b in batches:
            found = [png_header(shards.read(x, at, HEADER_BYTES))[:3] for x, at in zip(b.column("shard").to_pylist(), b.column("offset").to_pylist(), strict=True)]
            w, h, s = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w, pa.int64()), pa.array(h, pa.int64()), pa.array(s, pa.int32())], [*b.schema.names, "width", "height", "sample_bits"])
        shards.close()

    return media.mapInArrow(read, "digest string, shard string, offset long, length long, n_rows long, width long, height long, sample_bits int")


def read_back(media: DataFrame, root: str) -> DataFrame:
    """What the stored bytes of ``media`` (with header columns) give."""

    def read(batches):
        shards = Shards(root)
        for b in batches:
            rows = []
            for m in b.to_pylist():
                stored = shards.read(m["shard"], m["offset"], m["length"])
                payload = from_png(stored)
                rows.append((m["digest"], m["shard"], m["offset"], m["length"], m["n_rows"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), m["width"], m["height"], m["sample_bits"], feature_of(payload)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 14
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], READ_NAMES)
        shards.close()

    return media.mapInArrow(read, READ)


def media_columns(docs: DataFrame, root: str) -> DataFrame:
    """Stores the payloads below ``root``; one row per document with its place in the shards and its columns."""
    rows = materialize(store(docs, root), "media-rows")
    # One copy of each digest; ranges of a shard are read in order by one task.
    elected = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("m"), F.count(F.lit(1)).alias("n_rows"))
    media = elected.select("digest", "m.*", "n_rows").repartition(F.col("shard")).sortWithinPartitions("shard", "offset")
    columns = materialize(read_back(headers(media, root), root), "media-columns")
    return lookup(rows.drop("shard", "offset", "length"), columns, "digest", "n_rows").drop("n_rows")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_columns(table(spark, sf_dir, "documents"), scratch_path(spark, "media"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")

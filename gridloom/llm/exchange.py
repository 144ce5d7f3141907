"""Corpus-wide lookups by chunk, without shuffling any text.

Some operators need, at every place of every text, a fact about the whole corpus: how often an n-gram occurs, or
whether a string occurs twice. A join of all places would shuffle many times the corpus. Instead:

1. A map over the texts cuts them into chunks of about CHUNK_BYTES. Each chunk sends its distinct keys, sorted and
   packed, to buckets of the key space: a key leaves a chunk once, however often it occurs there.
2. Each bucket merges what its chunks sent and answers every chunk in the order of its keys, so answers carry no keys.
   A key of a third of all rows arrives once from each chunk, like any other.
3. The answers of a chunk are written as one file in the shared folder, under the digest of the chunk.
4. A second map over the same texts finds the file of each chunk by its digest and reads the answers.

Both maps read the same plan, so they see the same chunks; a chunk whose file is missing raises an error instead of
guessing. A task that runs again writes the same files. Memory is bounded by a chunk or by a bucket, and buckets grow in
number with the corpus.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import buffers, materialize, release, scratch_path, slices
from gridloom.llm.media import filesystem

CHUNK_BYTES = 8 << 20
#: Text bytes that a bucket stands for.
BUCKET_BYTES = 6 << 20
REQUEST = "bucket int, chunk string, body binary"


@dataclass
class Chunk:
    """Some rows of a batch: ids (None for null), offsets from 0, bytes, and the digest."""

    ids: list
    offsets: np.ndarray
    data: np.ndarray
    name: str


def chunks(batch: pa.RecordBatch, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The chunks of a batch with the columns doc_id and text."""
    offsets, data = buffers(batch.column(1))
    ids = batch.column(0).to_pylist()
    for i, j in slices(offsets, size):
        part = data[offsets[i] : offsets[j]]
        at = offsets[i : j + 1] - offsets[i]
        name = hashlib.sha256(part.tobytes() + at.tobytes() + repr(ids[i:j]).encode()).hexdigest()[:40]
        yield Chunk(ids[i:j], at, part, name)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; bytes of equal weight stand together."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)))
        body.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.compress(b"".join(head + body), 1)


def unpack(block: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(block)
    at, out = 1 + 10 * raw[0], []
    for k in range(raw[0]):
        kind, n = struct.unpack_from("<2sQ", raw, 1 + 10 * k)
        dtype = np.dtype("<" + kind.decode())
        size = n * dtype.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).ravel() if n else np.zeros(0, dtype))
        at += size
    return out


def deltas(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def undelta(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=np.uint64)


def narrow(x: np.ndarray) -> np.ndarray:
    """Non-negative integers in the least type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def n_buckets(docs: DataFrame) -> int:
    """Buckets for these texts, by their bytes (no cap)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4, -(-size // BUCKET_BYTES))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit key: equal parts of the key space, in order (fewer than 2**32 buckets)."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def runs(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of each bucket that sorted ``bucket`` holds; those without a key cost nothing."""
    if len(bucket):
        begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        yield from zip(bucket[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(bucket)], strict=True)


def split(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """``runs`` of sorted keys."""
    return runs(bucket_of(keys, buckets))


def request(docs: DataFrame, ask: Callable[[Chunk], Iterator[tuple[int, bytes]]], size: int = CHUNK_BYTES) -> DataFrame:
    """Rows (bucket, chunk, body): what ``ask`` yields for each chunk of ``docs`` (doc_id, text)."""

    def run(batches):
        for b in batches:
            for c in chunks(b, size):
                got = list(ask(c))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int32()), pa.array([c.name] * len(got), pa.string()), pa.array([x[1] for x in got], pa.binary())], ["bucket", "chunk", "body"])
        release()

    return docs.mapInArrow(run, REQUEST)


def reduce(requests: DataFrame, answer: Callable[[int, list[bytes]], tuple[list[bytes], np.ndarray]]) -> DataFrame:
    """Rows (bucket, chunk, body): the answers to each chunk, and a row without a chunk for the integers that ``answer`` sums up."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        bucket = t.column("bucket")[0].as_py()
        bodies, total = answer(bucket, t.column("body").to_pylist())
        names = t.column("chunk").to_pylist()
        return pa.table([pa.array([bucket] * (len(names) + 1), pa.int32()), pa.array([*names, None], pa.string()), pa.array([*bodies, pack(np.asarray(total, np.int64))], pa.binary())], ["bucket", "chunk", "body"])

    return requests.groupBy("bucket").applyInArrow(run, REQUEST)


class Answers:
    """The answers of a reduction, in files by chunk below ``root``; ``totals`` has the rows without a chunk."""

    def __init__(self, answers: DataFrame, name: str):
        self.root = scratch_path(answers.sparkSession, f"{name}-answers")
        root = self.root

        def write(batches):
            f, path = filesystem(root)
            f.create_dir(path, recursive=True)
            name, held = None, {}

            def close():
                if held:
                    with f.open_output_stream(f"{path}/{name}") as out:
                        for k in sorted(held):
                            out.write(struct.pack("<IQ", k, len(held[k])) + held[k])

            for b in batches:
                rest = []
                for k, chunk, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if chunk is None:
                        rest.append((k, body))
                        continue
                    if chunk != name:
                        close()
                        name, held = chunk, {}
                    held[k] = body
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rest], pa.int32()), pa.array([unpack(x[1])[0].tolist() for x in rest], pa.list_(pa.int64()))], ["bucket", "total"])
            close()

        dealt = answers.repartition(F.coalesce("chunk", F.col("bucket").cast("string"))).sortWithinPartitions("chunk", "bucket")
        self.totals = materialize(dealt.mapInArrow(write, "bucket int, total array<long>"), f"{name}-totals")

    def reader(self) -> Callable[[str], dict[int, list[np.ndarray]]]:
        """A function of a chunk's digest, for use in a task: its answers by bucket, unpacked; raises if there are none."""
        root = self.root

        def open_all():
            f, path = filesystem(root)

            def read(name: str) -> dict[int, list[np.ndarray]]:
                with f.open_input_file(f"{path}/{name}") as source:
                    raw = source.read()
                out, at = {}, 0
                while at < len(raw):
                    k, n = struct.unpack_from("<IQ", raw, at)
                    out[k] = unpack(raw[at + 12 : at + 12 + n])
                    at += 12 + n
                return out

            return read

        held: list = []

        def read_one(name: str):
            if not held:
                held.append(open_all())
            return held[0](name)

        return read_one

"""Helpers shared by the training-data operators: shared storage, table access and a columnar text kernel.

The text kernel works on the Arrow string buffers of a whole batch with NumPy, so words and shingles
are found and hashed without a Python loop over rows or characters.
"""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a fresh one in local mode."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows from which on a key is hot, at least, and the most hot keys there can be.
HOT_ROWS, HOT_KEYS = 1_000, 10_000


def lookup(rows: DataFrame, facts: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``facts``, which has one row for each ``key`` and in ``weight`` how many rows have it.

    Keys of a HOT_KEYS-th of all rows or more (and of HOT_ROWS) are joined by broadcast where their rows are, so that no
    task gets all rows of one key; there can't be more than HOT_KEYS of them. ``facts`` should be a written table.
    """
    most = facts.agg(F.max(weight).alias("top"), F.sum(weight).alias("all")).first()
    least = max(HOT_ROWS, -(-int(most["all"] or 0) // HOT_KEYS))
    if int(most["top"] or 0) < least:
        return rows.join(facts, key, how)
    hot = facts.where(F.col(weight) >= least)
    mark = free_name(rows, "_hot")
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias(mark))), key, "left")
    some = marked.where(F.col(mark).isNotNull()).drop(mark).join(F.broadcast(hot), key)
    return some.unionByName(marked.where(F.col(mark).isNull()).drop(mark).join(facts.where(F.col(weight) < least), key, how))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that ``materialize`` wrote in this shared folder; results that still read them end."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/gridloom")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(doc_id: str, n: int):
    """crc32 of the decimal doc_id, modulo ``n``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(n)


def release() -> None:
    """Gives freed memory back to the system at the end of a task: Python workers stay alive for the tasks to come."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# --------------------------------------------------------------------------- columnar text kernel

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = [np.uint64(x | 1) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]
#: Bytes of text that are hashed at once; bounds the kernel's working memory to about 60 times this.
SLICE_BYTES = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, b in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, raw = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word; offsets count from 0 of ``data``."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~_SPACE[data]
    begins, ends = offsets[:-1], offsets[1:]
    full = ends > begins
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[begins[full]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[ends[full] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    stops = np.flatnonzero(solid & ~after) + 1
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


#: Spans of more bytes than this are hashed one by one; and what of a block of eight bytes belongs to a span's last bytes.
LONG_SPAN = 512
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: blocks of eight bytes go through a chain of finalisers, long spans through BLAKE2b.

    No algebra of the bytes survives the finalisers, so texts made to collide under sums of powers don't collide here.
    """
    size = stops - starts
    h = size.astype(np.uint64) * _MIX[2]
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    blocks = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    todo, k = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(todo):
        left = size[todo] - k
        h[todo] = mix(h[todo] ^ (blocks[starts[todo] + k] & _KEEP[np.minimum(left, 8)])) + _MIX[3]
        todo, k = todo[left > 8], k + 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : stops[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h)


def ngram_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of ``n`` words in a row, and of all words of a row that has 1 to n - 1 words."""
    k = len(words) - n + 1
    if k > 0:
        whole = rows[:k] == rows[n - 1 :]
        h = np.zeros(k, np.uint64)
        for j in range(n):
            h = (h ^ words[j : j + k]) * _MIX[j % len(_MIX)]
            h ^= h >> np.uint64(29)
        h, at = mix(h[whole]), rows[:k][whole]
    else:
        h, at = np.zeros(0, np.uint64), np.zeros(0, rows.dtype)
    short, first, count = np.unique(rows, return_index=True, return_counts=True)
    few = count < n
    if few.any():
        extra = np.array([_fold(words[s : s + c]) for s, c in zip(first[few], count[few], strict=True)], np.uint64)
        h, at = np.concatenate([h, extra]), np.concatenate([at, short[few]])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, at


def _fold(words: np.ndarray) -> np.uint64:
    h = np.array([len(words)], np.uint64)
    for j in range(len(words)):
        h = (h ^ words[j : j + 1]) * _MIX[j % len(_MIX)]
        h ^= h >> np.uint64(29)
    return mix(h)[0]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

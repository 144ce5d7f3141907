"""Tensors as Parquet: one folder per dataset, chunk columns k0 .. as partitions on the leading axis, cells in row-major order.

The store is the engine's own format. Selections prune whole folders by k0 and row groups by the statistics of the
sorted coordinate columns; coordinates compress to almost nothing.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import TensorFrame, TensorMeta, ValidationError

META = "tensor.json"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p, _ = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def chunked(t: TensorFrame) -> DataFrame:
    """The cells with their chunk numbers."""
    return t.df.withColumns({f"k{i}": F.floor(F.col(f"c{i}") / n).cast("int") for i, n in enumerate(t.meta.chunk_shape)})


def write(t: TensorFrame, store: str, mode: str = "error") -> None:
    """Writes a dataset into a store; datasets of other names stay. Metadata comes last, so a failed write is no dataset."""
    spark = t.df.sparkSession
    if mode == "error" and t.meta.name in names(spark, store):
        raise ValidationError(f"dataset {t.meta.name!r} exists")
    ks = [f"k{i}" for i in range(t.meta.rank)]
    # Ranges in the order of chunks and cells; a large chunk may have several, so it isn't one task's work.
    order = [*ks, *t.meta.coord_names]
    cells = chunked(t).repartitionByRange(*order).sortWithinPartitions(*order)
    folder = f"{store}/{t.meta.name}"
    cells.write.mode("overwrite").partitionBy("k0").parquet(f"{folder}/cells")
    _write_text(spark, f"{folder}/{META}", json.dumps(asdict(t.meta)))


def names(spark: SparkSession, store: str) -> list[str]:
    """Names of the datasets in a store, groups separated by slashes."""
    fs, root, jvm = _fs(spark, store)
    if not fs.exists(root):
        return []
    base = fs.getFileStatus(root).getPath().toUri().getPath()
    todo, out = [root], []
    while todo:
        p = todo.pop()
        if fs.exists(jvm.org.apache.hadoop.fs.Path(p, META)):
            out.append(p.toUri().getPath()[len(base) :].strip("/"))
            continue
        todo += [s.getPath() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(out)


def read_meta(spark: SparkSession, store: str, name: str) -> TensorMeta:
    raw = json.loads(_read_text(spark, f"{store}/{name}/{META}"))
    return TensorMeta(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def read(spark: SparkSession, store: str, name: str) -> TensorFrame:
    if name not in names(spark, store):
        raise ValidationError(f"no dataset {name!r}")
    m = read_meta(spark, store, name)
    return TensorFrame(m, spark.read.parquet(f"{store}/{name}/cells"))

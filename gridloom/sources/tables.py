"""Relational tables as tensors: some columns are coordinates, one is the value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import DTYPES, TensorFrame, TensorMeta, ValidationError

KINDS = {"float": "f32", "double": "f64", "int": "i32", "bigint": "i64", "smallint": "i16", "tinyint": "i16"}


def dtype_of(df: DataFrame, column: str) -> str:
    kind = dict(df.dtypes)[column]
    if kind not in KINDS:
        raise ValidationError(f"a column of type {kind} can't be a tensor's value")
    return KINDS[kind]


def from_table(df: DataFrame, name: str, places: list[Column | str], value: str, shape: tuple[int, ...] | None = None, **meta) -> TensorFrame:
    """A tensor of a table with a row for each cell; the shape is that of the largest coordinates unless given."""
    cols = [(F.col(c) if isinstance(c, str) else c).cast("bigint").alias(f"c{i}") for i, c in enumerate(places)]
    dtype = meta.pop("dtype", None) or dtype_of(df, value)
    cells = df.select(*cols, F.col(value).cast(DTYPES[dtype].spark).alias("v"))
    if shape is None:
        top = cells.agg(*(F.max(f"c{i}") for i in range(len(cols)))).first()
        if top[0] is None:
            raise ValidationError(f"table of {name!r} is empty; a tensor has at least one cell")
        shape = tuple(int(x) + 1 for x in top)
    return TensorFrame(TensorMeta(name, dtype, shape, **meta), cells)


def from_arrays(df: DataFrame, name: str, key: str, array: str, width: int | None = None, rows: int | None = None) -> TensorFrame:
    """A rank-2 tensor of a table with an array in each row: c0 is the key, c1 the place in the array."""
    if width is None or rows is None:
        got = df.agg(F.max(F.size(array)), F.max(key)).first()
        if got[0] is None:
            raise ValidationError(f"table of {name!r} is empty; a tensor has at least one cell")
        width, rows = width or int(got[0]), rows or int(got[1]) + 1
    cells = df.select(F.col(key).cast("bigint").alias("c0"), F.posexplode(array).alias("p", "v")).select("c0", F.col("p").cast("bigint").alias("c1"), "v")
    return TensorFrame(TensorMeta(name, dtype_of(cells, "v"), (rows, width)), cells)


def virtual_datasets(spark: SparkSession, folder: str) -> dict[str, Callable[[], TensorFrame]]:
    """Tensors over the tables of a folder, made on demand."""
    read = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")

    def events(*dims: int) -> TensorFrame:
        df = read("events")
        n = df.count()
        at, inner = F.col("event_id"), 1
        coords: list[Column] = []
        for d in reversed(dims):
            coords.append(F.floor(at / inner) % d if inner > 1 else at % d)
            inner *= d
        coords.append(F.floor(at / inner) if inner > 1 else at)
        return from_table(df, "event_value", coords[::-1], "value", (n // inner, *dims))

    def grid() -> TensorFrame:
        """Sums of values by day and kind of event; both axes have labels."""
        df = read("events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "value")
        days = [r[0] for r in df.select("day").distinct().orderBy("day").collect()]
        kinds = [r[0] for r in df.select("event_type").distinct().orderBy("event_type").collect()]
        place = lambda c, xs: F.array_position(F.array(*map(F.lit, xs)), F.col(c)) - 1
        sums = df.groupBy("day", "event_type").agg(F.sum("value").alias("v"))
        return from_table(sums, "event_grid", [place("day", days), place("event_type", kinds)], "v", (len(days), len(kinds)), dim_names=("day", "event_type"), coords={"day": days, "event_type": kinds})

    def qc(*dims: int) -> TensorFrame:
        """Event values with NaN, infinities and a fill value put in by the number of the event."""
        df = read("events")
        e = F.col("event_id")
        v = F.when(e % 97 == 0, float("nan")).when(e % 101 == 0, float("inf")).when(e % 103 == 0, float("-inf")).when(e % 107 == 0, -9999.0).otherwise(F.col("value"))
        shape = events(*dims).meta.shape
        inner, places = 1, []
        for d in reversed(shape):
            places.append((F.floor(e / inner) if inner > 1 else e) % d)
            inner *= d
        return from_table(df.withColumn("_v", v), "event_qc", places[::-1], "_v", shape, dtype="f64", attrs={"_FillValue": "-9999.0"})

    return {
        "emb": lambda: from_arrays(read("embeddings"), "emb", "vec_id", "embedding"),
        "order_price": lambda: from_table(read("orders"), "order_price", ["o_orderkey"], "o_totalprice"),
        "retail": lambda: from_table(read("part"), "retail", ["p_partkey"], "p_retailprice"),
        "acct": lambda: from_table(read("customer"), "acct", ["c_custkey"], "c_acctbal"),
        "event_value": lambda: events(),
        "event_matrix": lambda: events(100),
        "event_cube": lambda: events(20, 20),
        "event_qc": lambda: qc(),
        "event_qc_matrix": lambda: qc(100),
        "event_grid": grid,
    }

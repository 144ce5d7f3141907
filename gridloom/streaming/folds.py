"""Folds over cells that keep arriving: the same mergeable accumulators, as a streaming aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gridloom.model import DTYPES, TensorFrame, TensorMeta, ValidationError
from gridloom.operators.reductions import fold_many

#: Operations whose state is a few numbers for each kept cell.
MERGEABLE = ("sum", "mean", "min", "max", "count", "var", "std", "norm_l1", "norm_l2", "nan_mean", "nan_std", "all_finite", "any_nan", "any_inf", "nan_count", "inf_count", "arg_min", "arg_max")


def cell_stream(spark: SparkSession, meta: TensorMeta, folder: str) -> TensorFrame:
    """Cells of a tensor from Parquet files as they appear in a folder."""
    schema = ", ".join([*(f"{c} bigint" for c in meta.coord_names), f"v {DTYPES[meta.dtype].spark}"])
    return TensorFrame(meta, spark.readStream.schema(schema).parquet(folder))


def running(t: TensorFrame, kinds: Sequence[str], axes: Sequence[int] = ()) -> DataFrame:
    """The streaming aggregate; each cell must arrive once."""
    if bad := [k for k in kinds if k not in MERGEABLE]:
        raise ValidationError(f"not mergeable: {', '.join(bad)}")
    return fold_many(t, kinds, axes)


def start(t: TensorFrame, kinds: Sequence[str], axes: Sequence[int], name: str, checkpoint: str) -> StreamingQuery:
    """Keeps a table ``name`` of the folds up to date."""
    return running(t, kinds, axes).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()

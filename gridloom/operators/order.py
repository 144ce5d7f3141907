"""Exact medians, quantiles and histograms, over the values that aren't NaN."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.cells import nan, number
from gridloom.model import TensorFrame
from gridloom.operators.reductions import group, kept

#: Cells up to which a quantile of the whole tensor is one aggregate; beyond, it is found by narrowing.
ONE_PASS = 4_000_000
#: Intervals of a narrowing pass, and the cells that are left for the last.
INTERVALS, LAST = 4096, 200_000


def quantile(t: TensorFrame, q: float, axes: Sequence[int] = (), name: str = "quantile") -> DataFrame:
    """Linear interpolation at q * (n - 1). A fibre that is all NaN gives NaN."""
    if kept(t, axes) or t.meta.size <= ONE_PASS:
        return group(t, axes, F.coalesce(F.percentile(number(t.value), F.lit(q)), nan()).alias(name))
    return narrowed(t, q, name)


def narrowed(t: TensorFrame, q: float, name: str) -> DataFrame:
    """The same for tensors of any size: counts by interval tell where a rank lies, and the next pass looks only there.

    The aggregate of a pass has INTERVALS rows, so memory doesn't grow with the tensor; an aggregate of all values would.
    """
    spark = t.df.sparkSession
    v = t.df.select(t.value.alias("v")).where("not isnan(v)")
    low, high, n = v.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n:
        return spark.range(1).select(nan().alias(name))
    place = q * (n - 1)
    found = [_ranked(v, low, high, int(k), n) for k in dict.fromkeys((math.floor(place), math.ceil(place)))]
    out = found[0] if found[0] == found[-1] else found[0] + (found[-1] - found[0]) * (place - math.floor(place))
    return spark.range(1).select(F.lit(float(out)).alias(name))


def _ranked(v: DataFrame, low: float, high: float, k: int, n: int) -> float:
    """The value of rank k (from 0) among the n values from low to high."""
    while low < high:
        if n <= LAST:
            return v.where((F.col("v") >= low) & (F.col("v") <= high)).orderBy("v").offset(k).limit(1).first()[0]
        inside = v.where((F.col("v") >= low) & (F.col("v") <= high))
        if math.isinf(low) or math.isinf(high):
            where = F.when(F.col("v") == -math.inf, 0).when(F.col("v") == math.inf, 2).otherwise(1)
        else:
            where = F.least(F.lit(INTERVALS - 1), F.floor((F.col("v") / 2 - low / 2) / (high / 2 - low / 2) * INTERVALS))
        rows = inside.groupBy(where.alias("i")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).orderBy("i").collect()
        for r in rows:
            if k < r["n"]:
                low, high, n = r["lo"], r["hi"], r["n"]
                break
            k -= r["n"]
    return low


def histogram(t: TensorFrame, bins: int, axes: Sequence[int] = (), low: float | None = None, high: float | None = None) -> DataFrame:
    """Kept coordinates, bin, lo, hi (edges of the bin) and n; empty bins too.

    The range is given or that of the data (of each kept cell); values outside count in the end bins; a range of width 0
    puts all in bin 0; infinite values count in the end bins of the range of the finite ones.
    """
    keys = kept(t, axes)
    v = number(t.value)
    cells = t.df.select(*keys, v.alias("v")).where("v is not null")
    if low is None:
        inner = F.when(F.abs("v") < math.inf, F.col("v"))
        ends = (F.coalesce(F.min(inner), F.lit(0.0)).alias("_lo"), F.coalesce(F.max(inner), F.lit(0.0)).alias("_hi"))
        span = cells.groupBy(*keys).agg(*ends) if keys else cells.agg(*ends)
    else:
        span = (t.df.select(*keys).distinct() if keys else t.df.sparkSession.range(1).drop("id")).withColumns({"_lo": F.lit(float(low)), "_hi": F.lit(float(high))})
    span = span.withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins)
    place = F.when(F.col("_w") > 0, F.least(F.lit(float(bins - 1)), F.greatest(F.lit(0.0), F.floor((F.col("v") - F.col("_lo")) / F.col("_w")).cast("double")))).otherwise(0.0)
    infinite = F.when(F.col("v") == math.inf, F.when(F.col("_w") > 0, bins - 1).otherwise(0)).when(F.col("v") == -math.inf, 0)
    if keys:
        placed = cells.join(span, keys)
    elif low is None:
        placed = cells.withColumn("_one", F.lit(1)).join(F.broadcast(span.withColumn("_one", F.lit(1))), "_one").drop("_one")
    else:
        placed = cells.withColumns({"_lo": F.lit(float(low)), "_hi": F.lit(float(high)), "_w": F.lit((high - low) / bins)})
    counts = placed.withColumn("bin", F.coalesce(infinite, place).cast("int")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    every = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = every.join(counts, [*keys, "bin"], "left")
    lo = F.col("_lo") + F.col("bin") * F.col("_w")
    hi = F.when(F.col("bin") == bins - 1, F.col("_hi")).otherwise(F.col("_lo") + (F.col("bin") + 1) * F.col("_w"))
    return out.select(*keys, "bin", lo.alias("lo"), hi.alias("hi"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))

"""Population covariance and Pearson correlation between the variables of a rank-2 tensor."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.cells import finite
from gridloom.model import TensorFrame, ValidationError

MOST_VARIABLES = 1024


def covariance(t: TensorFrame, axis: int) -> DataFrame:
    """(j, k, value) for all pairs of variables; ``axis`` holds the observations. Any non-finite value is an error.

    Cells are gathered into one row per observation (one shuffle), and each task adds up the product of its centred rows;
    a join of cells with cells would make variables squared rows for each observation.
    """
    if t.meta.rank != 2:
        raise ValidationError("covariance and correlation need rank 2")
    n_obs, n_var = t.meta.shape[axis], t.meta.shape[1 - axis]
    if n_var > MOST_VARIABLES:
        raise ValidationError(f"{n_var} variables exceed {MOST_VARIABLES}")
    obs, var = f"c{axis}", f"c{1 - axis}"
    v = t.value
    checked = F.when(finite(v), v).otherwise(F.raise_error(F.lit("covariance and correlation need finite values")).cast("double"))
    cells = t.df.select(F.col(obs).alias("o"), F.col(var).alias("k"), checked.alias("v"))
    rows = cells.groupBy("o").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("row"))

    def products(batches):
        # Chan's merge of (n, mean, sum of products) over batches keeps the centring stable.
        n, mean, total = 0, np.zeros(n_var), np.zeros((n_var, n_var))
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, n_var)
            m = x.mean(0)
            d = x - m
            shift = m - mean
            total += d.T @ d + np.outer(shift, shift) * (n * len(x) / (n + len(x)))
            mean += shift * (len(x) / (n + len(x)))
            n += len(x)
        if n:
            j, k = np.triu_indices(n_var)
            yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(k), pa.array(total[j, k]), pa.array(mean[j]), pa.array(mean[k]), pa.array(np.full(len(j), n))], ["j", "k", "s", "mj", "mk", "n"])

    parts = rows.select("row").mapInArrow(products, "j long, k long, s double, mj double, mk double, n long")
    # sum over tasks of s + n * (mj - Mj) * (mk - Mk), with the means of all: two terms that don't cancel badly.
    whole = parts.groupBy("j", "k").agg(F.collect_list(F.struct("s", "mj", "mk", "n")).alias("p"))
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda a, x: a + f(x))
    means = whole.withColumns({"Mj": total(lambda x: x["mj"] * x["n"]) / n_obs, "Mk": total(lambda x: x["mk"] * x["n"]) / n_obs})
    value = total(lambda x: x["s"] + x["n"] * (x["mj"] - F.col("Mj")) * (x["mk"] - F.col("Mk"))) / n_obs
    upper = means.select("j", "k", value.alias("value"))
    return upper.unionByName(upper.where("j < k").select(F.col("k").alias("j"), F.col("j").alias("k"), "value"))


def correlation(t: TensorFrame, axis: int) -> DataFrame:
    """As covariance, divided by the deviations: 1 on the diagonal, 0 beside it where a deviation is 0."""
    cov = covariance(t, axis)
    var = cov.where("j = k").select(F.col("j").alias("_i"), F.sqrt("value").alias("_s"))
    # As many rows as variables, 1024 at most.
    out = cov.join(F.broadcast(var.toDF("j", "_sj")), "j").join(F.broadcast(var.toDF("k", "_sk")), "k")
    scale = F.col("_sj") * F.col("_sk")
    return out.select("j", "k", F.when(F.col("j") == F.col("k"), 1.0).when(scale > 0, F.col("value") / scale).otherwise(0.0).alias("value"))

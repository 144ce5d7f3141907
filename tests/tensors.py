"""Tensors of nested lists, for tests."""


def tensor(spark, values, name="a", dtype="f64", chunk=(), **meta):
    """A tensor of a nested list."""
    import numpy as np

    from gridloom.model import DTYPES, TensorFrame, TensorMeta

    x = np.array(values, dtype=object)
    rows = [(*map(int, at), None if v is None else v) for at, v in np.ndenumerate(x)]
    m = TensorMeta(name, dtype, x.shape, chunk, **meta)
    import decimal

    cast = (lambda v: decimal.Decimal(int(v))) if dtype == "u64" else (float if dtype[0] == "f" else int)
    schema = ", ".join([*(f"{c} bigint" for c in m.coord_names), f"v {DTYPES[dtype].spark}"])
    return TensorFrame(m, spark.createDataFrame([(*r[:-1], cast(r[-1])) for r in rows], schema))

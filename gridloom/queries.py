"""Queries over the standard tables as virtual tensors, each with its SQL."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import engine
from gridloom.model import TensorFrame, TensorMeta
from gridloom.operators import reductions
from gridloom.plans.document import parse_query_toml
from gridloom.sources import parquet_tensor, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Cells of the virtual tensors, in SQL.
CELLS = {
    "emb": "SELECT vec_id AS c0, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS c1, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
    "order_price": "SELECT o_orderkey AS c0, o_totalprice AS v FROM orders",
    "retail": "SELECT p_partkey AS c0, p_retailprice AS v FROM part",
    "acct": "SELECT c_custkey AS c0, c_acctbal AS v FROM customer",
    "event_value": "SELECT event_id AS c0, value AS v FROM events",
    "event_cube": "SELECT event_id // 400 AS c0, (event_id // 20) % 20 AS c1, event_id % 20 AS c2, value AS v FROM events",
    "event_grid": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, sum(value) AS v FROM events GROUP BY ALL",
}
_QC = "CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE WHEN event_id % 101 = 0 THEN 'inf'::DOUBLE WHEN event_id % 103 = 0 THEN '-inf'::DOUBLE WHEN event_id % 107 = 0 THEN -9999.0 ELSE value END"
CELLS["event_qc"] = f"SELECT event_id AS c0, {_QC} AS v FROM events"
CELLS["event_qc_matrix"] = f"SELECT event_id // 100 AS c0, event_id % 100 AS c1, {_QC} AS v FROM events"

#: Aggregates in SQL, over v; {i} is the index of an arg operation.
FOLD_SQL = {
    "sum": "sum(v)",
    "mean": "avg(v)",
    "min": "min(v) FILTER (NOT isnan(v))",
    "max": "max(v) FILTER (NOT isnan(v))",
    "count": "count(*)",
    "var": "var_pop(v)",
    "std": "stddev_pop(v)",
    "product": "product(v)",
    "norm_l1": "sum(abs(v))",
    "norm_l2": "sqrt(sum(v * v))",
    "nan_mean": "avg(v) FILTER (NOT isnan(v))",
    "nan_std": "stddev_pop(v) FILTER (NOT isnan(v))",
    "all_finite": "bool_and(isfinite(v))",
    "any_nan": "bool_or(isnan(v))",
    "any_inf": "bool_or(isinf(v))",
    "nan_count": "CAST(count(*) FILTER (isnan(v)) AS BIGINT)",
    "inf_count": "CAST(count(*) FILTER (isinf(v)) AS BIGINT)",
    "null_count": "CAST(count(*) FILTER (v = -9999.0) AS BIGINT)",
    "arg_min": "arg_min({i}, {{'v': v, 'i': {i}}}) FILTER (NOT isnan(v))",
    "arg_max": "arg_max({i}, {{'v': v, 'i': -({i})}}) FILTER (NOT isnan(v))",
    "median": "median(v)",
    "quantile": "quantile_cont(v, 0.95)",
}
EXACT = ("count", "all_finite", "any_nan", "any_inf", "nan_count", "inf_count", "null_count", "arg_min", "arg_max")


def rounded(c: Column, places: int = 6) -> Column:
    return F.round(c.cast("double"), places)


def catalog(spark: SparkSession, folder: str) -> engine.Catalog:
    return engine.Catalog(tables.virtual_datasets(spark, folder))


def asked(spark: SparkSession, folder: str, document: dict) -> DataFrame:
    from gridloom.plans.document import parse_query_value

    return engine.query(parse_query_value(document), catalog(spark, folder))


def _register(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _fold(name: str, dataset: str, kind: str, axes: list[int], rank: int = 2, index: str = "0", **more) -> None:
    value = {"quantile": {"q": 0.95, "axis": axes}}.get(kind, axes)
    keys = [f"c{i}" for i in range(rank) if i not in axes] if axes else []

    def query(spark: SparkSession, folder: str) -> DataFrame:
        df = asked(spark, folder, {"dataset": dataset, kind: value} | more)
        return df if kind in EXACT else df.withColumn(kind, rounded(F.col(kind)))

    e = FOLD_SQL[kind].format(i=index)
    e = e if kind in EXACT else f"round({e}, 6)"
    _register(name, query, f"WITH cells AS ({CELLS[dataset]}) SELECT {', '.join([*keys, f'{e} AS {kind}'])} FROM cells" + (f" GROUP BY {', '.join(keys)}" if keys else ""))


for _kind in ("sum", "mean", "count", "var", "std", "norm_l1", "norm_l2", "median", "quantile", "min", "max"):
    _label = "quantile_95" if _kind == "quantile" else _kind
    _fold(f"{_label}_scalar", "emb", _kind, [])
    _fold(f"{_label}_axis0", "emb", _kind, [0])
    _fold(f"{_label}_axis1", "emb", _kind, [1])
for _kind in ("nan_count", "inf_count", "null_count", "any_nan", "any_inf", "all_finite", "nan_mean", "nan_std", "min", "max"):
    _fold(f"{_kind}_qc_scalar" if _kind in ("min", "max") else f"{_kind}_scalar", "event_qc", _kind, [], rank=1)
    if _kind not in ("nan_mean", "nan_std"):  # infinities meet in some rows, and their sums differ by engine
        _fold(f"{_kind}_qc_axis1" if _kind in ("min", "max") else f"{_kind}_axis1", "event_qc_matrix", _kind, [1])
for _kind in ("arg_min", "arg_max"):
    _fold(f"{_kind}_scalar", "emb", _kind, [], index="c0 * 64 + c1")
    _fold(f"{_kind}_axis0", "emb", _kind, [0], index="c0")
    _fold(f"{_kind}_orders", "order_price", _kind, [], rank=1, index="c0")
_fold("median_retail", "retail", "median", [], rank=1)
_fold("quantile_95_retail", "retail", "quantile", [], rank=1)
_fold("norm_l1_acct", "acct", "norm_l1", [], rank=1)
_fold("rank3_partial_sum", "event_cube", "sum", [0, 2], rank=3)
_fold("rank3_arg_max", "event_cube", "arg_max", [0, 2], rank=3, index="c0 * 20 + c2")


def _product(spark: SparkSession, folder: str) -> DataFrame:
    """Products of 64 values are tiny, so their logarithm and sign are compared."""
    df = asked(spark, folder, {"dataset": "emb", "product": 1})
    return df.select("c0", rounded(F.ln(F.abs("product"))).alias("product_ln"), (F.col("product") < 0).alias("negative"))


_register("product_axis1", _product, f"WITH cells AS ({CELLS['emb']}), p AS (SELECT c0, product(v) AS x FROM cells GROUP BY c0) SELECT c0, round(ln(abs(x)), 6) AS product_ln, x < 0 AS negative FROM p")

# ---- histograms

_BIN = "CAST(least(greatest(floor((v - lo) / ((hi - lo) / {n})), 0), {n} - 1) AS INTEGER)"


def _histogram(name: str, dataset: str, op: dict, sql: str) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        df = asked(spark, folder, {"dataset": dataset, "histogram": op})
        return df.withColumns({"lo": rounded(F.col("lo")), "hi": rounded(F.col("hi"))})

    _register(name, query, sql)


def _histogram_sql(cells: str, n: int, ends: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    on = f"USING ({keys}, bin)" if keys else "USING (bin)"
    spans = f"SELECT {k}{ends} FROM cells" + (f" GROUP BY {keys}" if keys else "")
    meet = f"cells JOIN spans USING ({keys})" if keys else "cells, spans"
    return (
        f"WITH cells AS ({cells}), spans AS ({spans}), counts AS (SELECT {k}{_BIN.format(n=n)} AS bin, count(*) AS n FROM {meet} GROUP BY ALL), "
        f"bins AS (SELECT {k}lo, hi, CAST(unnest(range({n})) AS INTEGER) AS bin FROM spans) "
        f"SELECT {k}bin, round(lo + bin * ((hi - lo) / {n}), 6) AS lo, round(CASE WHEN bin = {n - 1} THEN hi ELSE lo + (bin + 1) * ((hi - lo) / {n}) END, 6) AS hi, CAST(coalesce(n, 0) AS BIGINT) AS n FROM bins LEFT JOIN counts {on}"
    )


_histogram("histogram_10", "retail", {"bins": 10}, _histogram_sql(CELLS["retail"], 10, "min(v) AS lo, max(v) AS hi"))
_histogram("histogram_range_clamped", "retail", {"bins": 8, "min": 950.0, "max": 1500.0}, _histogram_sql(CELLS["retail"], 8, "950.0::DOUBLE AS lo, 1500.0::DOUBLE AS hi").replace("AS hi FROM cells)", "AS hi)"))
_histogram("histogram_axis0", "emb", {"bins": 5, "axis": 0}, _histogram_sql(CELLS["emb"], 5, "min(v) AS lo, max(v) AS hi", "c1"))

# ---- matrices


def _matrix(kind: str) -> Query:
    return lambda spark, folder: asked(spark, folder, {"dataset": "emb", kind: 0}).withColumn("value", rounded(F.col("value")))


_PAIRS = f"WITH cells AS ({CELLS['emb']}), cov AS (SELECT a.c1 AS j, b.c1 AS k, covar_pop(a.v, b.v) AS c FROM cells a JOIN cells b USING (c0) GROUP BY ALL)"
_register("covariance_axis0", _matrix("covariance"), f"{_PAIRS} SELECT j, k, round(c, 6) AS value FROM cov")
_register("correlation_axis0", _matrix("correlation"), f"{_PAIRS}, sd AS (SELECT j AS i, sqrt(c) AS s FROM cov WHERE j = k) SELECT j, k, round(CASE WHEN j = k THEN 1.0 WHEN x.s * y.s > 0 THEN c / (x.s * y.s) ELSE 0.0 END, 6) AS value FROM cov JOIN sd x ON x.i = j JOIN sd y ON y.i = k")

# ---- transforms

#: Statistics and formulas in SQL; OVER () is replaced for axes.
TRANSFORM_SQL = {
    "center": "v - avg(v) OVER w",
    "zscore": "(v - avg(v) OVER w) / stddev_pop(v) OVER w",
    "scale": "v / stddev_pop(v) OVER w",
    "minmax": "(v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w)",
    "l1": "v / sum(abs(v)) OVER w",
    "l2": "v / sqrt(sum(v * v) OVER w)",
    "log1p": "ln(1 + (v - min(v) OVER w))",
    "sqrt": "sqrt(v - min(v) OVER w)",
    "softmax": "x / sum(x) OVER w",
}


def _transform(name: str, method: str, axes: list[int]) -> None:
    by = ", ".join(f"c{i}" for i in (0, 1) if i not in axes) if axes else ""
    w = f"WINDOW w AS ({f'PARTITION BY {by}' if by else ''})"
    cells = f"WITH cells AS ({CELLS['emb']})"
    source = "cells"
    if method == "softmax":
        cells += f", tops AS (SELECT *, exp(v - max(v) OVER w) AS x FROM cells {w})"
        source = "tops"

    def query(spark: SparkSession, folder: str) -> DataFrame:
        df = asked(spark, folder, {"dataset": "emb", "transform": {"method": method, "axis": axes}})
        return df.withColumn("v", rounded(F.col("v")))

    _register(name, query, f"{cells} SELECT c0, c1, round(CAST(CAST({TRANSFORM_SQL[method]} AS FLOAT) AS DOUBLE), 6) AS v FROM {source} {w}")


for _method in TRANSFORM_SQL:
    _transform(f"transform_{_method}", _method, [])
_transform("transform_zscore_axis0", "zscore", [0])
_transform("transform_minmax_axis0", "minmax", [0])
_transform("transform_softmax_axis1", "softmax", [1])

# ---- selections, names, documents


def _cells(name: str, document: dict, sql: str) -> None:
    _register(name, lambda spark, folder: asked(spark, folder, document), sql)


_cells("slice_dense", {"dataset": "emb", "selection": [{"start": 10, "stop": 40}, {"start": 4, "stop": 12}]}, f"WITH cells AS ({CELLS['emb']}) SELECT c0 - 10 AS c0, c1 - 4 AS c1, CAST(v AS FLOAT) AS v FROM cells WHERE c0 >= 10 AND c0 < 40 AND c1 >= 4 AND c1 < 12")
_cells("slice_strided", {"dataset": "emb", "selection": [{"start": 5, "step": 7}, {"step": 16}]}, f"WITH cells AS ({CELLS['emb']}) SELECT (c0 - 5) // 7 AS c0, c1 // 16 AS c1, CAST(v AS FLOAT) AS v FROM cells WHERE c0 >= 5 AND (c0 - 5) % 7 = 0 AND c1 % 16 = 0")
_fold("strided_sum_axis0", "emb", "sum", [0], selection=[{"step": 3}, {}])
SQL["strided_sum_axis0"] = f"WITH cells AS ({CELLS['emb']}) SELECT c1, round(sum(v), 6) AS sum FROM cells WHERE c0 % 3 = 0 GROUP BY c1"


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    c = catalog(spark, folder)
    days = c.get("event_grid").meta.labels(0)
    document = {"dataset": "event_grid", "selection": [{"start_label": days[2], "stop_label": days[9]}, {}], "mean": "day"}
    from gridloom.plans.document import parse_query_value

    return engine.query(parse_query_value(document), c).select("c1", rounded(F.col("mean")).alias("mean"))


_GRID = f"WITH cells AS ({CELLS['event_grid']}), kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS c1 FROM (SELECT DISTINCT event_type FROM events)), days AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS c0 FROM (SELECT DISTINCT day FROM cells))"
_register("slice_labels", _labels, f"{_GRID} SELECT c1, round(avg(v), 6) AS mean FROM cells JOIN kinds USING (event_type) JOIN days USING (day) WHERE c0 >= 2 AND c0 < 9 GROUP BY c1")


def _named(spark: SparkSession, folder: str) -> DataFrame:
    c = catalog(spark, folder)
    df = engine.query('{"dataset": "event_grid", "mean": "day"}', c)
    kinds = c.get("event_grid").meta.labels(1)
    return df.select(F.element_at(F.array(*map(F.lit, kinds)), (F.col("c1") + 1).cast("int")).alias("event_type"), rounded(F.col("mean")).alias("mean"))


_register("named_axis_mean", _named, f"WITH cells AS ({CELLS['event_grid']}) SELECT event_type, round(avg(v), 6) AS mean FROM cells GROUP BY event_type")


def _preview(spark: SparkSession, folder: str) -> DataFrame:
    values, _ = engine.preview(catalog(spark, folder).get("emb"), 64)  # the first 64 cells are the feature
    return spark.createDataFrame([(i // 64, i % 64, v) for i, v in enumerate(values)], "c0 long, c1 long, v float")


_register("preview_64", _preview, f"WITH cells AS ({CELLS['emb']}) SELECT c0, c1, CAST(v AS FLOAT) AS v FROM cells WHERE c0 * 64 + c1 < 64")
_register("json_query", lambda spark, folder: engine.query('{"dataset": "retail", "max": []}', catalog(spark, folder)), f"WITH cells AS ({CELLS['retail']}) SELECT max(v) AS max FROM cells")
_TOML = 'dataset = "order_price"\nselection = [{start = 100, stop = 9100, step = 3}]\nmean = []\n'
_register("toml_query", lambda spark, folder: _small_toml(spark, folder), None)


def _small_toml(spark: SparkSession, folder: str) -> DataFrame:
    c = catalog(spark, folder)
    n = c.get("order_price").meta.shape[0]
    doc = parse_query_toml(_TOML.replace("9100", str(min(9100, n))))
    return engine.query(doc, c).select(rounded(F.col("mean")).alias("mean"))


SQL["toml_query"] = f"WITH cells AS ({CELLS['order_price']}) SELECT round(avg(v), 6) AS mean FROM cells WHERE c0 >= 100 AND c0 < 9100 AND (c0 - 100) % 3 = 0"

# ---- stores and tools


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder on any filesystem that driver and executors share; Spark makes it when it writes."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/gridloom-{name}-{uuid.uuid4().hex}"


def _work(spark: SparkSession, name: str) -> str:
    """The same as a path, for formats that are single files: the shared folder has to be mounted."""
    path = re.sub("^file:(//)?", "", _scratch(spark, name))
    if not path.startswith("/"):
        raise RuntimeError(f"{path} isn't a mounted folder, and single-file stores are written to one")
    os.makedirs(path)
    return path


def _store(spark: SparkSession, folder: str) -> DataFrame:
    """Through the Parquet store: written in chunks, and read by a selection that prunes folders."""
    store = _scratch(spark, "store")
    t = catalog(spark, folder).get("emb")
    parquet_tensor.write(TensorFrame(replace(t.meta, chunk_shape=(100, 64)), t.df), store)
    return engine.query('{"dataset": "emb", "selection": [{"start": 120, "stop": 180}, {}], "sum": 0}', engine.Catalog({"emb": parquet_tensor.read(spark, store, "emb")})).select("c1", rounded(F.col("sum")).alias("sum"))


_register("parquet_store_sum", _store, f"WITH cells AS ({CELLS['emb']}) SELECT c1, round(sum(v), 6) AS sum FROM cells WHERE c0 >= 120 AND c0 < 180 GROUP BY c1")


def _through_container(spark: SparkSession, folder: str) -> str:
    from gridloom.sources import container

    path = f"{_work(spark, 'container')}/emb{container.EXTENSION}"
    t = catalog(spark, folder).get("emb")
    container.write_container(path, [TensorFrame(replace(t.meta, chunk_shape=(64, 48), dim_names=("vector", "place")), t.df)], container.ZSTD)
    return path


def _container(spark: SparkSession, folder: str) -> DataFrame:
    from gridloom.sources import container

    t = container.open_tensor(spark, _through_container(spark, folder), "emb")
    return reductions.fold(t, "mean", [0]).select("c1", rounded(F.col("mean")).alias("mean"))


_MEAN = f"WITH cells AS ({CELLS['emb']}) SELECT c1, round(avg(v), 6) AS mean FROM cells GROUP BY c1"
_register("container_roundtrip", _container, _MEAN)


def _zarr(spark: SparkSession, folder: str) -> DataFrame:
    from gridloom.sources import zarr3

    path = _through_container(spark, folder)
    out = f"{os.path.dirname(path)}/emb.zarr"
    zarr3.export(spark, path, out)
    t = zarr3.open_catalog(spark, out).get("emb")
    return reductions.fold(t, "mean", [0]).select("c1", rounded(F.col("mean")).alias("mean"))


_register("zarr_roundtrip", _zarr, _MEAN)


def _verify(spark: SparkSession, folder: str) -> DataFrame:
    from gridloom.tools import verify

    r = verify.verify(_through_container(spark, folder), deep=True, spark=spark)
    return spark.createDataFrame([(f.check, f.severity, f.ok) for f in r.findings], "`check` string, severity string, ok boolean")


_CHECKS = ", ".join(f"('{c}')" for c in ("superblock", "dataset_directory", "chunk_index", "chunk_payloads", "chunk_dataset_ids", "dataset_tensor_bytes", "payload_offsets", "payload_order", "chunk_decode", "dataset_count", "footer", "footer_metadata"))
_register("verify_report", _verify, f"SELECT \"check\", 'info' AS severity, true AS ok FROM (VALUES {_CHECKS}) AS t(\"check\")")

#: Steps within and beyond a chunk of ten rows.
_STEPS = (1, 3, 25)


def _read_plan(spark: SparkSession, folder: str) -> DataFrame:
    """How many chunks of ten rows the driver's plan would open, from row 12 on."""
    from gridloom.plans.document import AxisSlice
    from gridloom.plans.geometry import read_plan, resolve_selection

    m = replace(catalog(spark, folder).get("emb").meta, chunk_shape=(10, 64))
    rows = []
    for step in _STEPS:
        p = read_plan(m, resolve_selection(m, [AxisSlice(12, None, step), AxisSlice()]))
        rows.append((step, len(p.chunks), p.box.shape[0], p.box.shape[1], p.bytes_logical))
    return spark.createDataFrame(rows, "step int, chunks long, n_rows long, n_columns long, n_bytes long")


_register(
    "read_plan",
    _read_plan,
    f"WITH cells AS ({CELLS['emb']}) SELECT step, count(DISTINCT c0 // 10) AS chunks, count(DISTINCT c0) AS n_rows, count(DISTINCT c1) AS n_columns, 4 * count(*) AS n_bytes "
    f"FROM cells, (VALUES {', '.join(f'({x})' for x in _STEPS)}) AS s(step) WHERE c0 >= 12 AND (c0 - 12) % step = 0 GROUP BY step",
)


def _cf(spark: SparkSession, folder: str) -> DataFrame:
    """Packed values: stored * 0.5 + 10, and -9999 as missing."""
    from gridloom.sources import cf

    t = catalog(spark, folder).get("event_qc")
    d = cf.decode(TensorFrame(replace(t.meta, attrs={"scale_factor": "0.5", "add_offset": "10", "_FillValue": "-9999"}), t.df)).df
    v = F.col("v")
    infinite = F.abs(v) == float("inf")
    return d.agg(F.count_if(F.isnan(v)).alias("missing"), F.count_if(infinite).alias("infinite"), rounded(F.sum(F.when(~F.isnan(v) & ~infinite, v))).alias("total"))


_register("cf_decode", _cf, f"WITH cells AS ({CELLS['event_qc']}) SELECT count(*) FILTER (isnan(v) OR v = -9999) AS missing, count(*) FILTER (isinf(v)) AS infinite, round(sum(v * 0.5 + 10) FILTER (isfinite(v) AND v <> -9999), 6) AS total FROM cells")


def _nan_cube(kind: str) -> Query:
    """A partial fold that skips NaN: every 97th cell is one."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        t = catalog(spark, folder).get("event_cube")
        v = F.when((F.col("c0") * 400 + F.col("c1") * 20 + F.col("c2")) % 97 == 0, float("nan")).otherwise(F.col("v"))
        return reductions.fold(TensorFrame(t.meta, t.df.select("c0", "c1", "c2", v.alias("v"))), kind, [0, 2]).select("c1", rounded(F.col(kind)).alias(kind))

    return query


for _kind, _sql in (("nan_mean", "avg"), ("nan_std", "stddev_pop")):
    _register(f"{_kind}_axes02", _nan_cube(_kind), f"WITH cells AS ({CELLS['event_cube']}) SELECT c1, round({_sql}(v) FILTER ((c0 * 400 + c1 * 20 + c2) % 97 <> 0), 6) AS {_kind} FROM cells GROUP BY c1")


def _product_scalar(spark: SparkSession, folder: str) -> DataFrame:
    """The product of the first forty prices, which is about 1e120, by its logarithm."""
    df = asked(spark, folder, {"dataset": "retail", "selection": [{"stop": 40}], "product": []})
    return df.select(rounded(F.ln("product")).alias("ln_product"))


_register("product_scalar", _product_scalar, f"WITH cells AS ({CELLS['retail']}) SELECT round(ln(product(v)), 6) AS ln_product FROM cells WHERE c0 - (SELECT min(c0) FROM cells) < 40")


def _dense_cells(spark: SparkSession, path: str, n: int, kind: str) -> DataFrame:
    """(i, v) of a raw export, each task reading its own range of the file."""

    def run(batches):
        for b in batches:
            i = b.column(0).to_numpy()
            v = np.fromfile(path, kind, len(i), offset=int(i[0]) * np.dtype(kind).itemsize) if len(i) else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v.astype("<f8"))], ["i", "v"])

    return spark.range(n).mapInArrow(run, "i long, v double")


def _spill(spark: SparkSession, folder: str) -> DataFrame:
    """Every second vector from the tenth on, exported as raw values and read back."""
    from gridloom.plans.document import parse_query_value

    work, c = _work(spark, "spill"), catalog(spark, folder)
    doc = parse_query_value({"dataset": "emb", "selection": [{"start": 10, "step": 2}, {}], "spill": f"{work}/out.bin"})
    e = engine.execute_query_document(doc, c, preview_limit=0, spill_roots=[work])["execution"]
    cells = _dense_cells(spark, e["spill_path"], e["spill_bytes"] // 4, "<f4")
    return cells.groupBy((F.col("i") % 64).alias("c1")).agg(rounded(F.sum("v")).alias("sum"), F.count("*").alias("n"))


_register("spill_export", _spill, f"WITH cells AS ({CELLS['emb']}) SELECT c1, round(sum(v), 6) AS sum, count(*) AS n FROM cells WHERE c0 >= 10 AND c0 % 2 = 0 GROUP BY c1")


def _sidecar(spark: SparkSession, folder: str) -> DataFrame:
    """A transform published as a container of its own, and read from there."""
    from gridloom.plans.document import parse_query_value
    from gridloom.sources import container

    work = _work(spark, "sidecar")
    doc = parse_query_value({"dataset": "acct", "transform": {"method": "center"}, "write": {"target": "sidecar", "path": f"{work}/center{container.EXTENSION}", "timestamp": False}})
    e = engine.execute_query_document(doc, catalog(spark, folder), preview_limit=0, spill_roots=[work])["execution"]
    return container.open_tensor(spark, e["sidecar_path"], e["sidecar_dataset"]).df.select("c0", rounded(F.col("v"), 4).alias("v"))


_register("sidecar_center", _sidecar, f"WITH cells AS ({CELLS['acct']}) SELECT c0 - (SELECT min(c0) FROM cells) AS c0, round(v - (SELECT avg(v) FROM cells), 4) AS v FROM cells")


def _append(spark: SparkSession, folder: str) -> DataFrame:
    """A second dataset appended to a container; both are read from the new file."""
    from gridloom.sources import container

    path = _through_container(spark, folder)
    container.append(path, [catalog(spark, folder).get("retail")], container.RAW)
    each = [reductions.fold(container.open_tensor(spark, path, n), "sum", []).select(F.lit(n).alias("dataset"), rounded(F.col("sum"), 4).alias("sum")) for n in ("emb", "retail")]
    return each[0].unionByName(each[1])


_register("container_append", _append, f"SELECT 'emb' AS dataset, round(sum(v), 4) AS sum FROM ({CELLS['emb']}) UNION ALL SELECT 'retail', round(sum(v), 4) FROM ({CELLS['retail']})")


def _repair(spark: SparkSession, folder: str) -> DataFrame:
    """A container whose footer is broken, repaired, verified and read."""
    from gridloom.sources import container
    from gridloom.tools import verify

    path = _through_container(spark, folder)
    at = container.read_summary(path).payload_end
    with open(path, "r+b") as f:
        f.seek(at)
        f.write(b"????")
    verify.repair(path, verify.plan_repairs(path))
    sound = verify.verify(path, deep=True, spark=spark).ok
    t = container.open_tensor(spark, path, "emb")
    return reductions.fold(t, "mean", [0]).select("c1", rounded(F.col("mean")).alias("mean"), F.lit(sound).alias("sound"))


_register("container_repair", _repair, f"WITH cells AS ({CELLS['emb']}) SELECT c1, round(avg(v), 6) AS mean, true AS sound FROM cells GROUP BY c1")


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming fold, run to the end of what is there."""
    from gridloom.streaming import folds

    work = _scratch(spark, "stream")
    t = catalog(spark, folder).get("emb")
    t.df.write.parquet(f"{work}/cells")
    name = f"gridloom_stream_{uuid.uuid4().hex}"
    q = folds.start(folds.cell_stream(spark, t.meta, f"{work}/cells"), ["mean"], [0], name, f"{work}/checkpoint")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).select("c1", rounded(F.col("mean")).alias("mean"))


_register("streaming_mean_axis0", _stream, _MEAN)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""From a query document to a plan, a result DataFrame, and a response."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.model import DTYPES, TensorFrame, TensorMeta, ValidationError, linear
from gridloom.operators import matrix, order, reductions
from gridloom.operators import transform as transforms
from gridloom.plans.document import FOLDS, QueryDocument, parse_query_json, parse_query_text, parse_query_toml
from gridloom.plans.geometry import Box, ReadPlan, read_plan, resolve_axes, resolve_selection, select

#: Keys of results in a response, where they differ from the operation's (fixed values).
SCALAR_KEYS = {"arg_min": "operation_argmin_index", "arg_max": "operation_argmax_index"}
REDUCED_KEYS = {"arg_min": "operation_reduced_argmin", "arg_max": "operation_reduced_argmax"}
DEFAULT_BUDGET = 256 << 20


class Catalog:
    """Datasets by exact name, opened on demand."""

    def __init__(self, datasets: Mapping[str, Callable[[], TensorFrame] | TensorFrame], path: str | None = None, budget_bytes: int | None = None, budget_bps: int | None = None):
        self._datasets, self.path, self.budget_bytes, self.budget_bps = dict(datasets), path, budget_bytes, budget_bps
        self._open: dict[str, TensorFrame] = {}

    def names(self) -> list[str]:
        return sorted(self._datasets)

    def get(self, name: str) -> TensorFrame | None:
        if name not in self._open:
            made = self._datasets.get(name)
            if made is None:
                return None
            self._open[name] = made if isinstance(made, TensorFrame) else made()
        return self._open[name]


@dataclass(frozen=True)
class Planned:
    """A resolved query: the selected tensor, its plan, and the operation's axes."""

    doc: QueryDocument
    source: TensorMeta
    box: Box
    plan: ReadPlan
    selected: TensorFrame
    axes: tuple[int, ...]

    @property
    def out_shape(self) -> tuple[int, ...]:
        return tuple(n for i, n in enumerate(self.selected.meta.shape) if i not in self.axes) if self.axes else ()


def parse(text: str | QueryDocument, path: str | None = None) -> QueryDocument:
    return text if isinstance(text, QueryDocument) else parse_query_text(text, path)


def plan(doc: QueryDocument, catalog: Catalog) -> Planned | None:
    """Resolves names, labels and geometry; None if the catalog lacks the dataset. Nothing runs on the cluster."""
    t = catalog.get(doc.dataset)
    if t is None:
        return None
    box = resolve_selection(t.meta, doc.selection)
    op = doc.operation
    axes = resolve_axes(t.meta, op.axes, partial=op.kind not in matrix_kinds) if op else ()
    return Planned(doc, t.meta, box, read_plan(t.meta, box), select(t, box), axes)


matrix_kinds = ("covariance", "correlation")


def result(p: Planned) -> DataFrame:
    """The lazy result: kept coordinates and values, or the selected cells if the query has no operation."""
    op, t, axes = p.doc.operation, p.selected, p.axes
    if op is None:
        return t.df.select(*t.meta.coord_names, "v")
    if op.kind == "median":
        return order.quantile(t, 0.5, axes, "median")
    if op.kind == "quantile":
        return order.quantile(t, op.q, axes)
    if op.kind == "histogram":
        return order.histogram(t, op.bins, axes, op.low, op.high)
    if op.kind == "covariance":
        return matrix.covariance(t, axes[0])
    if op.kind == "correlation":
        return matrix.correlation(t, axes[0])
    if op.kind == "transform":
        return transforms.transform(t, op.method, axes).df
    assert op.kind in FOLDS
    return reductions.fold(t, op.kind, axes, op.fill)


def query(text: str | QueryDocument, catalog: Catalog) -> DataFrame:
    """The result of a query as a DataFrame; an unknown dataset is an error here."""
    doc = parse(text)
    p = plan(doc, catalog)
    if p is None:
        raise ValidationError(f"no dataset {doc.dataset!r}; there are: {', '.join(catalog.names())}")
    return result(p)


def execute_query_json(text: str, catalog: Catalog | None = None, **options) -> dict:
    return execute_query_document(parse_query_json(text), catalog, **options)


def execute_query_toml(text: str, catalog: Catalog | None = None, **options) -> dict:
    return execute_query_document(parse_query_toml(text), catalog, **options)


def plan_read_for_document(doc: QueryDocument, catalog: Catalog) -> ReadPlan | None:
    p = plan(doc, catalog)
    return p.plan if p else None


def to_numpy(t: TensorFrame) -> np.ndarray:
    """The dense array of a tensor, on the driver."""
    m = t.meta
    at = t.df.select(linear(m.coord_names, m.shape).alias("i"), "v").toPandas()
    kind = np.dtype(DTYPES[m.dtype].numpy)
    out = np.zeros(m.size, kind)
    values = np.array([int(x) for x in at["v"]], kind) if m.dtype == "u64" else at["v"].to_numpy().astype(kind)
    out[at["i"].to_numpy()] = values
    return out.reshape(m.shape)


def materialize_query(text: str | QueryDocument, catalog: Catalog) -> np.ndarray:
    """The dense selection of a query, or the transformed one; not capped by a preview."""
    doc = parse(text)
    p = plan(doc, catalog)
    if p is None:
        raise ValidationError(f"no dataset {doc.dataset!r}")
    t = p.selected
    if doc.operation:
        if doc.operation.kind != "transform":
            raise ValidationError("only a selection or a transform can be materialized")
        t = transforms.transform(t, doc.operation.method, p.axes)
    return to_numpy(t)


def host_available_ram() -> int | None:
    try:
        with open("/proc/meminfo") as f:
            for line in f:
                if line.startswith("MemAvailable:"):
                    return int(line.split()[1]) << 10
    except OSError:
        pass
    return None


def budget(doc: QueryDocument, catalog: Catalog) -> int:
    """Bytes: of the query, else of the file, else a share of RAM by query or file, else the default."""
    e, ram = doc.execution, host_available_ram()
    if e and e.memory_budget_bytes is not None:
        return e.memory_budget_bytes
    if catalog.budget_bytes:
        return catalog.budget_bytes
    for bps in (e.memory_budget_percent_bps if e else None, catalog.budget_bps):
        if bps and ram:
            return ram * bps // 10_000
    return DEFAULT_BUDGET


def strategy(p: Planned, most: int) -> str:
    """The label of how the selection relates to the budget; Spark itself decides where data lie."""
    op, over = p.doc.operation, p.plan.bytes_logical > most
    if p.doc.spill:
        return "user_spill"
    if op is None:
        return "in_memory"
    if op.kind == "transform":
        target = p.doc.write.target if p.doc.write else "switch"
        return {"ram": "transform_ram", "spill": "transform_spill", "sidecar": "transform_sidecar"}.get(target, "transform_spill" if over else "transform_ram")
    if op.kind in ("median", "quantile", "histogram", *matrix_kinds):
        return "temp_spill_materialize" if over else "in_memory_materialize"
    return "streaming_fold"


def _plain(x: Any) -> Any:
    """JSON has no NaN or infinity: they become null."""
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return int(x) if isinstance(x, np.integer) else x


def _scalars(p: Planned) -> dict:
    """What an operation adds to the response's execution block; runs it."""
    op, axes = p.doc.operation, p.axes
    df = result(p)
    out: dict[str, Any] = {}
    keys = reductions.kept(p.selected, axes)
    if op.kind in matrix_kinds:
        rows = df.orderBy("j", "k").collect()
        return {f"operation_{op.kind}": [_plain(r["value"]) for r in rows], f"operation_{op.kind}_order": p.selected.meta.shape[1 - axes[0]]}
    if op.kind == "transform":
        count, listed = transforms.warnings(p.selected, op.method, axes)
        out = {"transform_method": op.method}
        return out | ({"transform_div_by_zero_count": count, "transform_div_by_zero_indices": listed} if count else {})
    if axes:
        out["operation_reduced_shape"] = list(p.out_shape)
    if op.kind == "histogram":
        rows = df.orderBy(*keys, "bin").collect()
        counts = [float(r["n"]) for r in rows]
        if axes:
            return out | {"operation_reduced_histogram_counts": counts}
        return {"operation_element_count": p.selected.meta.size, "operation_histogram_counts": counts, "operation_histogram_edges": [rows[0]["lo"], *(r["hi"] for r in rows)]}
    name = op.kind
    if not axes:
        value = df.first()[name]
        key = SCALAR_KEYS.get(name, f"operation_{name}")
        if name == "count":
            return {"operation_element_count": int(value)}
        value = float(value) if name in ("nan_count", "inf_count", "null_count") else value
        return {"operation_element_count": p.selected.meta.size, key: _plain(value)}
    values = [r[name] for r in df.orderBy(*keys).collect()]
    if name in ("count", "nan_count", "inf_count", "null_count"):
        values = [float(v) for v in values]
    return out | {REDUCED_KEYS.get(name, f"operation_reduced_{name}"): [_plain(v) for v in values]}


def preview(t: TensorFrame, n: int) -> tuple[list, bool]:
    """The first ``n`` values in row-major order, and whether there are more."""
    m = t.meta
    at = linear(m.coord_names, m.shape)
    rows = t.df.select(at.alias("i"), "v").where(F.col("i") < n).orderBy("i").collect()
    values = [int(r["v"]) if m.dtype == "u64" else r["v"] for r in rows]
    return [_plain(v) for v in values], m.size > n


def execute_query_document(doc: QueryDocument, catalog: Catalog | None = None, preview_limit: int | None = None, spill_roots: list[str] | None = None) -> dict:
    """The response envelope. Without a catalog the plan is only echoed; without a preview limit nothing runs."""
    from gridloom.sources import spill

    op = doc.operation
    out: dict[str, Any] = {"status": "planned", "accepted": True, "layout_version": doc.layout_version, "dataset": doc.dataset, "selection_axes": None if doc.selection is None else len(doc.selection), "operation": {op.kind: op.to_wire()} if op else None, "message": "query accepted; no file consulted", "file": None, "catalog": None, "read_plan": None, "execution": None}
    if catalog is None:
        return out
    out["file"] = catalog.path
    p = plan(doc, catalog)
    if p is None:
        return out | {"message": f"dataset {doc.dataset!r} not found", "catalog": {"matched": False, "available_datasets": catalog.names()}}
    m = p.source
    sizes = {f"dataset_{k}_bytes": m.n_bytes if m.dtype == k else None for k in ("f32", "f64", "i32", "i64", "u8", "u16", "i16")}
    out |= {"message": "read plan ready", "read_plan": p.plan.to_dict(), "catalog": {"matched": True, "dataset_index": catalog.names().index(m.name) if m.name in catalog.names() else None, "dtype": m.dtype, "shape": list(m.shape), "chunk_shape": list(m.chunk_shape), "chunk_index_rows": math.prod(-(-n // c) for n, c in zip(m.shape, m.chunk_shape, strict=True)), **sizes}}
    if preview_limit is None:
        return out
    if preview_limit == 0 and op is None and doc.spill is None:
        raise ValidationError("a preview limit of 0 without an operation or spill has nothing to execute")
    most = budget(doc, catalog)
    over = p.plan.bytes_logical > most
    if op is None and doc.spill is None and over:
        raise ValidationError(f"the selection of {p.plan.bytes_logical} bytes exceeds the budget of {most}; raise it, add an operation, or spill")
    device = doc.execution.device if doc.execution else None
    e: dict[str, Any] = {"memory_strategy": strategy(p, most), "memory_budget_bytes": most, "host_available_ram_bytes": host_available_ram(), "logical_selection_bytes": p.plan.bytes_logical, "io_regime": "unknown", "device_requested": device, "device_used": "cpu", "device_fallback_reason": "gpu_feature_disabled" if device not in (None, "cpu") else None}
    shown = p.selected
    if op is not None and op.kind == "transform":
        shown = transforms.transform(p.selected, op.method, p.axes)
        target = doc.write.target if doc.write else "switch"
        if target == "ram" and over:
            raise ValidationError(f"the selection of {p.plan.bytes_logical} bytes exceeds the budget of {most}; use another write target")
        if target == "spill" or target == "switch" and over:
            e |= spill.write(shown, doc.write.path if doc.write else None, catalog.path, spill_roots)
        elif target == "sidecar":
            e |= spill.sidecar(shown, p, doc.write, catalog.path, spill_roots)
    elif doc.spill is not None:
        e |= spill.write(p.selected, doc.spill, catalog.path, spill_roots)
    if preview_limit:
        values, cut = preview(shown, preview_limit)
        e |= {f"{m.dtype}_preview": values, f"{m.dtype}_preview_truncated": cut}
    if op is not None:
        e |= _scalars(p)
    return out | {"message": "query executed", "execution": {k: v for k, v in e.items() if v is not None}}

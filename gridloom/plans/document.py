"""Query documents: flat JSON or TOML, parsed, checked and written back."""

from __future__ import annotations

import json
import math
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from gridloom.model import ValidationError

FOLDS = ("sum", "mean", "min", "max", "count", "var", "std", "product", "norm_l1", "norm_l2", "nan_mean", "nan_std", "all_finite", "any_nan", "any_inf", "nan_count", "inf_count", "null_count", "arg_min", "arg_max", "median")
MATRICES = ("covariance", "correlation")
OPERATIONS = (*FOLDS, "quantile", "histogram", *MATRICES, "transform")
METHODS = ("center", "zscore", "scale", "minmax", "l1", "l2", "log1p", "sqrt", "softmax")
TARGETS = ("switch", "spill", "sidecar", "ram")
FIELDS = ("layout_version", "dataset", "selection", "spill", "write", "execution")
#: Limits of a document (fixed values).
MAX_BYTES, MAX_DEPTH, MAX_NAME, MAX_LABEL, MAX_AXES, MAX_BINS = 1 << 20, 64, 1024, 32, 8, 4096
_AXIS = re.compile(r"\d+|[A-Za-z_][A-Za-z0-9_-]*")
_DEVICE = re.compile(r"cpu|auto|metal|(cuda|rocm)(:(\d+|multi))?")


@dataclass(frozen=True)
class AxisSlice:
    start: int | None = None
    stop: int | None = None
    step: int = 1
    start_label: str | None = None
    stop_label: str | None = None

    def to_wire(self) -> dict:
        out = {k: getattr(self, k) for k in ("start", "stop", "start_label", "stop_label") if getattr(self, k) is not None}
        return out | ({"step": self.step} if self.step != 1 else {})


@dataclass(frozen=True)
class Operation:
    """``axes``: numbers or names; parameters by the kind of operation."""

    kind: str
    axes: tuple[int | str, ...] = ()
    q: float | None = None
    bins: int | None = None
    low: float | None = None
    high: float | None = None
    fill: float | None = None
    method: str | None = None

    def to_wire(self) -> Any:
        axis = list(self.axes) if len(self.axes) != 1 else self.axes[0]
        if self.kind == "null_count" and self.fill is not None:
            return {"fill": "nan" if math.isnan(self.fill) else self.fill, "axis": axis}
        if self.kind == "quantile":
            return {"q": self.q} | ({"axis": axis} if self.axes else {})
        if self.kind == "histogram":
            return {"bins": self.bins} | ({"axis": axis} if self.axes else {}) | ({"min": self.low, "max": self.high} if self.low is not None else {})
        if self.kind == "transform":
            return {"method": self.method} | ({"axis": axis} if self.axes else {})
        return axis


@dataclass(frozen=True)
class Write:
    target: str = "switch"
    path: str | None = None
    timestamp: bool | None = None

    def to_wire(self) -> Any:
        more = {k: getattr(self, k) for k in ("path", "timestamp") if getattr(self, k) is not None}
        return {"target": self.target} | more if more else self.target


@dataclass(frozen=True)
class Execution:
    memory_budget_bytes: int | None = None
    memory_budget_percent_bps: int | None = None
    fold_parallel: bool | None = None
    device: str | None = None

    def to_wire(self) -> dict:
        return {k: v for k, v in vars(self).items() if v is not None}


@dataclass(frozen=True)
class QueryDocument:
    dataset: str
    selection: tuple[AxisSlice, ...] | None = None
    operation: Operation | None = None
    spill: str | None = None
    write: Write | None = None
    execution: Execution | None = None
    layout_version: int | None = None
    #: How the document came in.
    source: str = field(default="json", compare=False)

    def to_wire(self) -> dict:
        """The canonical flat form; names of axes stay names."""
        out: dict[str, Any] = {"dataset": self.dataset}
        if self.layout_version is not None:
            out["layout_version"] = self.layout_version
        if self.selection is not None:
            out["selection"] = [s.to_wire() for s in self.selection]
        if self.operation:
            out[self.operation.kind] = self.operation.to_wire()
        for k in ("spill", "write", "execution"):
            x = getattr(self, k)
            if x is not None:
                out[k] = x if isinstance(x, str) else x.to_wire()
        return out

    def to_json(self) -> str:
        return json.dumps(self.to_wire())


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValidationError(message)


def _keys(value: Any, where: str, allowed: tuple[str, ...]) -> dict:
    _need(isinstance(value, dict), f"`{where}` must be an object")
    for k in value:
        _need(k in allowed, f"unknown field `{where}.{k}`")
    return value


def _int(value: Any, where: str, least: int = 0, most: int = (1 << 64) - 1) -> int:
    _need(isinstance(value, int) and not isinstance(value, bool) and least <= value <= most, f"`{where}` must be an integer from {least} to {most}")
    return value


def _number(value: Any, where: str, finite: bool = True) -> float:
    _need(isinstance(value, int | float) and not isinstance(value, bool), f"`{where}` must be a number")
    try:
        value = float(value)
    except OverflowError:
        raise ValidationError(f"`{where}` is out of range") from None
    _need(not finite or math.isfinite(value), f"`{where}` must be finite")
    return value


def _text(value: Any, where: str, most: int = MAX_NAME) -> str:
    _need(isinstance(value, str) and value != "", f"`{where}` must be a non-empty string")
    _need(len(value.encode("utf-8", "surrogatepass")) <= most, f"`{where}` exceeds {most} bytes")
    return value


def _axis(value: Any, where: str) -> int | str:
    if isinstance(value, str):
        _text(value, where, MAX_LABEL)
        _need(_AXIS.fullmatch(value) is not None, f"`{where}`: bad axis {value!r}")
        return int(value) if value.isdigit() else value
    return _int(value, where, 0, (1 << 32) - 1)


def _axes(value: Any, where: str) -> tuple[int | str, ...]:
    if isinstance(value, dict):
        _keys(value, where, ("axis", "axes"))
        value = value.get("axis", value.get("axes", []))
    items = value if isinstance(value, list) else [value]
    _need(len(items) <= MAX_AXES, f"`{where}` names more than {MAX_AXES} axes")
    return tuple(_axis(x, where) for x in items)


def _axes_of(value: dict, where: str) -> tuple[int | str, ...]:
    return _axes(value["axis"] if "axis" in value else value.get("axes", []), where)


def _operation(kind: str, value: Any) -> Operation:
    if kind == "quantile":
        o = _keys(value, kind, ("q", "axis", "axes"))
        q = _number(o.get("q"), "quantile.q")
        _need(0 <= q <= 1, "`quantile.q` must be from 0 to 1")
        return Operation(kind, _axes_of(o, kind), q=q)
    if kind == "histogram":
        o = _keys(value, kind, ("bins", "axis", "axes", "min", "max"))
        low, high = (None if o.get(k) is None else _number(o[k], f"histogram.{k}") for k in ("min", "max"))
        _need((low is None) == (high is None), "`histogram` needs both or neither of `min` and `max`")
        _need(low is None or low < high, "`histogram.min` must be less than `histogram.max`")
        return Operation(kind, _axes_of(o, kind), bins=_int(o.get("bins"), "histogram.bins", 1, MAX_BINS), low=low, high=high)
    if kind == "transform":
        o = _keys(value, kind, ("method", "axis", "axes"))
        _need(o.get("method") in METHODS, f"`transform.method` must be one of {', '.join(METHODS)}")
        return Operation(kind, _axes_of(o, kind), method=o["method"])
    if kind == "null_count" and isinstance(value, dict):
        o = _keys(value, kind, ("fill", "axis", "axes"))
        fill = o.get("fill")
        if isinstance(fill, str):
            _need(fill.lower() == "nan", "`null_count.fill` must be a number or \"nan\"")
            fill = math.nan
        return Operation(kind, _axes_of(o, kind), fill=None if fill is None else _number(fill, "null_count.fill", finite=False))
    axes = _axes(value, kind)
    _need(kind not in MATRICES or len(axes) == 1, f"`{kind}` needs exactly one axis, that of the observations")
    return Operation(kind, axes)


def _slice(value: Any) -> AxisSlice:
    o = _keys(value, "selection", ("start", "stop", "step", "start_label", "stop_label"))
    number = {k: None if o.get(k) is None else _int(o[k], f"selection.{k}") for k in ("start", "stop")}
    label = {k: None if o.get(k) is None else _text(o[k], f"selection.{k}") for k in ("start_label", "stop_label")}
    for end in ("start", "stop"):
        _need(number[end] is None or label[f"{end}_label"] is None, f"a slice has `{end}` or `{end}_label`, not both")
    return AxisSlice(**number, **label, step=1 if o.get("step") is None else _int(o["step"], "selection.step", 1))


def _write(value: Any) -> Write:
    if isinstance(value, str):
        value = {"target": value}
    o = _keys(value, "write", ("target", "path", "timestamp"))
    target = o.get("target", "switch")
    _need(target in TARGETS, f"unknown write target {target!r} (expected one of {', '.join(TARGETS)})")
    _need("timestamp" not in o or isinstance(o["timestamp"], bool), "`write.timestamp` must be a boolean")
    return Write(target, _text(o["path"], "write.path") if "path" in o else None, o.get("timestamp"))


def _execution(value: Any) -> Execution:
    o = _keys(value, "execution", ("memory_budget_bytes", "memory_budget_percent", "memory_budget_percent_bps", "fold_parallel", "device"))
    _need(not {"memory_budget_percent", "memory_budget_percent_bps"} <= o.keys(), "use `execution.memory_budget_percent` or `execution.memory_budget_percent_bps`, not both")
    bps = None
    if "memory_budget_percent_bps" in o:
        bps = _int(o["memory_budget_percent_bps"], "execution.memory_budget_percent_bps", 1, 10_000)
    elif "memory_budget_percent" in o:
        percent = _number(o["memory_budget_percent"], "execution.memory_budget_percent")
        bps = round(percent * 100)
        _need(0 < percent <= 100 and bps >= 1, "`execution.memory_budget_percent` must be above 0 and at most 100")
    _need("fold_parallel" not in o or isinstance(o["fold_parallel"], bool), "`execution.fold_parallel` must be a boolean")
    device = o.get("device")
    if "device" in o:
        _need(isinstance(device, str) and _DEVICE.fullmatch(device.strip().lower()) is not None, f"unknown device {device!r}")
        device = device.strip().lower()
    return Execution(_int(o["memory_budget_bytes"], "execution.memory_budget_bytes") if "memory_budget_bytes" in o else None, bps, o.get("fold_parallel"), device)


def _depth(value: Any) -> int:
    todo, most = [(value, 1)], 0
    while todo:
        x, d = todo.pop()
        most = max(most, d)
        if most > MAX_DEPTH:
            break
        todo += [(y, d + 1) for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())]
    return most


def parse_query_value(value: Any, source: str = "json") -> QueryDocument:
    """A checked document from a tree of plain values."""
    _need(isinstance(value, dict), "a query document must be an object")
    _need(_depth(value) <= MAX_DEPTH, f"the document is nested deeper than {MAX_DEPTH}")
    _need("operation" not in value, 'nested `operation` is not supported; use a top-level key such as `"mean": 0`')
    _need("output" not in value, 'nested `output` is not supported; use a top-level `"spill": "path"`')
    for k in value:
        _need(k in FIELDS or k in OPERATIONS, f"unknown field `{k}`")
    kinds = [k for k in OPERATIONS if k in value]
    _need(len(kinds) <= 1, "a query document has at most one operation")
    selection = value.get("selection")
    if selection is not None:
        _need(isinstance(selection, list) and len(selection) <= MAX_AXES, f"`selection` must be a list of at most {MAX_AXES} slices")
        selection = tuple(map(_slice, selection))
    doc = QueryDocument(
        _text(value.get("dataset"), "dataset"),
        selection,
        _operation(kinds[0], value[kinds[0]]) if kinds else None,
        _text(value["spill"], "spill") if "spill" in value else None,
        _write(value["write"]) if "write" in value else None,
        _execution(value["execution"]) if "execution" in value else None,
        _int(value["layout_version"], "layout_version", 0, (1 << 32) - 1) if "layout_version" in value else None,
        source,
    )
    return validate(doc)


def validate(doc: QueryDocument) -> QueryDocument:
    """Rules between the parts of a document."""
    w = doc.write
    if w:
        _need(doc.operation is not None and doc.operation.kind == "transform", "`write` needs a `transform`")
        _need(doc.spill is None, "`write` and `spill` can't be combined; use a `write` target")
        _need(w.path is None or w.target in ("spill", "sidecar"), "`write.path` needs the target spill or sidecar")
        _need(w.timestamp is None or w.target == "sidecar", "`write.timestamp` needs the target sidecar")
    return doc


def parse_query_json(text: str) -> QueryDocument:
    _need(len(text.encode("utf-8", "surrogatepass")) <= MAX_BYTES, f"the document exceeds {MAX_BYTES} bytes")
    try:
        value = json.loads(text)
    except (ValueError, RecursionError) as e:
        raise ValidationError(f"not JSON: {e}") from e
    return parse_query_value(value)


def parse_query_toml(text: str) -> QueryDocument:
    _need(len(text.encode("utf-8", "surrogatepass")) <= MAX_BYTES, f"the document exceeds {MAX_BYTES} bytes")
    try:
        value = tomllib.loads(text)
    except (ValueError, RecursionError) as e:
        raise ValidationError(f"not TOML: {e}") from e
    return parse_query_value(value, "toml")


def parse_query_text(text: str, path: str | Path | None = None) -> QueryDocument:
    """By the file's ending, else JSON if the text begins with a brace, else TOML."""
    ending = Path(path).suffix.lower() if path else ""
    if ending == ".json" or ending != ".toml" and text.lstrip().startswith("{"):
        return parse_query_json(text)
    return parse_query_toml(text)

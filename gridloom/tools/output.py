"""Responses as text: full, json, stats (JSON), plan, quiet (a line for scripts) and table."""

from __future__ import annotations

import json

FORMATS = ("full", "json", "stats", "plan", "quiet", "table")
#: Preview values by format, unless the caller says otherwise.
PREVIEW = {"full": 64, "json": 64}


def _values(response: dict) -> dict:
    e = response.get("execution") or {}
    return {k.removeprefix("operation_"): v for k, v in e.items() if k.startswith(("operation_", "transform_"))}


def _short(x) -> str:
    if isinstance(x, float):
        return f"{x:.8g}"
    if isinstance(x, list):
        return "[" + ", ".join(map(_short, x[:8])) + (f", ... {len(x)}]" if len(x) > 8 else "]")
    return str(x)


def render(response: dict, form: str = "full") -> str:
    if form == "json":
        return json.dumps(response)
    if form == "full":
        return json.dumps({k: v for k, v in response.items() if v is not None}, indent=2)
    if form == "plan":
        return json.dumps({"dataset": response["dataset"], "catalog": response["catalog"], "read_plan": response["read_plan"]}, indent=2)
    values = _values(response)
    if form == "quiet":
        return " ".join([f"status={response['status']}", f"dataset={response['dataset']}", *(f"{k}={_short(v)}" for k, v in values.items())])
    if form == "stats":
        e = response.get("execution") or {}
        kept = ("memory_strategy", "memory_budget_bytes", "logical_selection_bytes", "device_used", "spill_path", "sidecar_path")
        kind = next(iter(response.get("operation") or {}), None)
        out = {"status": response["status"], "message": response["message"], "dataset": response["dataset"], "operation": kind, "values": values, "execution": {k: e[k] for k in kept if k in e}}
        return json.dumps(out, indent=2)
    if form == "table":
        width = max([len(k) for k in values] or [0])
        return "\n".join(f"{k.ljust(width)} | {_short(v)}" for k, v in values.items()) or response["message"]
    raise ValueError(f"unknown format {form!r}; one of {', '.join(FORMATS)}")


def miss_hint(response: dict) -> str | None:
    """What to say when the catalog lacks the dataset."""
    c = response.get("catalog") or {}
    return f"datasets: {', '.join(c['available_datasets'])}" if c.get("matched") is False else None

"""Summaries of a container as text, JSON and DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.sources.container import Summary, read_summary


def as_dict(s: Summary, chunk_limit: int = 0) -> dict:
    rows = s.chunks[:chunk_limit] if chunk_limit else s.chunks
    return {
        "path": s.path,
        "file_len": s.length,
        "layout_version": 1,
        "flags": s.flags,
        "execution": {"memory_budget_percent_bps": s.budget_bps, "memory_budget_bytes": s.budget_bytes},
        "datasets": [{"name": d.name, "dtype": d.dtype, "shape": list(d.shape), "chunk_shape": list(d.chunk_shape), "dim_names": list(d.dim_names), "coords": {k: list(v) for k, v in d.coords.items()}, "attrs": dict(d.attrs)} for d in s.datasets],
        "chunks": [{"dataset": s.datasets[c.dataset].name, "index": list(c.index), "payload_offset": c.offset, "raw_byte_len": c.raw, "stored_byte_len": c.stored, "codec": c.codec} for c in rows],
        "history": [e.to_wire() for e in s.history],
        "metadata": s.file_metadata,
    }


def chunks_frame(spark: SparkSession, s: Summary) -> DataFrame:
    rows = [(s.datasets[c.dataset].name, list(c.index), c.offset, c.raw, c.stored, c.codec) for c in s.chunks]
    return spark.createDataFrame(rows, "dataset string, chunk_index array<bigint>, payload_offset bigint, raw_byte_len bigint, stored_byte_len bigint, codec int")


def datasets_frame(spark: SparkSession, s: Summary) -> DataFrame:
    rows = [(i, d.name, d.dtype, list(d.shape), list(d.chunk_shape), list(d.dim_names), dict(d.attrs)) for i, d in enumerate(s.datasets)]
    return spark.createDataFrame(rows, "dataset_id int, name string, dtype string, shape array<bigint>, chunk_shape array<bigint>, dim_names array<string>, attrs map<string,string>")


def history_frame(spark: SparkSession, s: Summary) -> DataFrame:
    rows = [(e.op, e.source, e.at, e.parents, e.params) for e in s.history]
    return spark.createDataFrame(rows, "op string, source string, at string, parents array<string>, params map<string,string>")


def text(path: str, sections: set[str] | None = None, dataset: str | None = None, grep: str | None = None, limit: int = 32, metadata: bool = False) -> str:
    """Sections: layout, execution, datasets, chunks, history; the table of datasets unless others are asked for."""
    s = read_summary(path)
    sections = sections or {"datasets"}
    keep = [d for d in s.datasets if (not dataset or dataset.lower() in d.name.lower()) and (not grep or grep.lower() in f"{d.name} {d.dtype}".lower())]
    out = []
    if "layout" in sections:
        out += [f"layout 1, {s.length} bytes, {len(s.datasets)} datasets, {len(s.chunks)} chunks, footer {'yes' if s.footer_start is not None else 'no'}"]
    if "execution" in sections:
        out += [f"memory budget: {s.budget_bytes or 'default'} bytes, {s.budget_bps or 'default'} basis points"]
    if "datasets" in sections:
        for d in keep:
            out.append(f"{d.name}  {d.dtype}  shape {list(d.shape)}  chunks {list(d.chunk_shape)}  {d.n_bytes} bytes")
            if metadata:
                out += [f"  dims: {', '.join(d.dim_names)}"] if d.dim_names else []
                out += [f"  {k}: {', '.join(list(v)[:8])}{' ...' if len(v) > 8 else ''}" for k, v in d.coords.items()]
                out += [f"  @{k} = {v}" for k, v in d.attrs.items()]
    if "chunks" in sections:
        names = {d.name for d in keep}
        rows = [c for c in s.chunks if s.datasets[c.dataset].name in names]
        out += [f"{s.datasets[c.dataset].name}{list(c.index)}  at {c.offset}  raw {c.raw}  stored {c.stored}  codec {c.codec}" for c in (rows[:limit] if limit else rows)]
        out += [f"... {len(rows) - limit} more"] if limit and len(rows) > limit else []
    if "history" in sections:
        out += [f"{e.at}  {e.op}  {e.source}" for e in s.history]
    return "\n".join(out)


def quiet(path: str) -> str:
    s = read_summary(path)
    return f"datasets={len(s.datasets)} chunks={len(s.chunks)} bytes={s.length}"

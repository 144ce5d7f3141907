"""Health checks of a container, what to do about findings, and the one repair that is safe."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession

from gridloom.model import DTYPES
from gridloom.sources.container import FLAG_FOOTER, ContainerError, Summary, decode, read_summary, tile_shape
from gridloom.sources.files import read_range, size_of

#: Checks in their order, and the chunks that are decoded unless all are wanted (fixed values).
CHECKS = ("superblock", "dataset_directory", "chunk_index", "chunk_payloads", "chunk_dataset_ids", "dataset_tensor_bytes", "payload_offsets", "payload_order", "chunk_decode", "dataset_count", "footer", "footer_metadata")
QUICK_CHUNKS = 128
#: Code and advice by check.
ADVICE = {
    "superblock": ("invalid_layout", "create the file again from its source"),
    "dataset_directory": ("invalid_layout", "create the file again from its source"),
    "chunk_index": ("invalid_layout", "create the file again from its source"),
    "chunk_payloads": ("payload_out_of_bounds", "restore the file from a copy"),
    "chunk_dataset_ids": ("bad_dataset_id", "write the file again; its index contradicts itself"),
    "dataset_tensor_bytes": ("dataset_size_mismatch", "write the dataset again"),
    "payload_offsets": ("payload_overlap", "write the file again; payloads overlap"),
    "payload_order": ("payload_order", "no action needed; reads are less sequential"),
    "chunk_decode": ("chunk_decode_failed", "restore the file from a copy"),
    "footer": ("footer_invalid", "strip the footer: repair with --apply footer_invalid"),
    "footer_metadata": ("footer_metadata", "write the metadata again; it names datasets that aren't there"),
}


@dataclass
class Finding:
    check: str
    severity: str = "info"
    ok: bool = True
    detail: str | None = None


@dataclass
class Report:
    path: str
    file_len: int
    findings: list[Finding] = field(default_factory=list)
    summary: dict | None = None

    @property
    def ok(self) -> bool:
        return not any(f.severity == "error" for f in self.findings)

    @property
    def recommendations(self) -> list[dict]:
        """One for each code, of errors and warnings."""
        out: dict[str, dict] = {}
        for f in self.findings:
            if f.severity != "info" and f.check in ADVICE:
                code, fix = ADVICE[f.check]
                out.setdefault(code, {"code": code, "message": f.detail, "fix": fix})
        s = self.summary
        if s and s["chunks_decoded"] < s["chunks"] and self.ok:
            out["run_deep_verify"] = {"code": "run_deep_verify", "message": f"{s['chunks_decoded']} of {s['chunks']} chunks decoded", "fix": "verify with --deep to decode every chunk"}
        return list(out.values())

    def add(self, check: str, problems: list[str], severity: str = "error", good: str | None = None) -> None:
        if problems:
            self.findings.append(Finding(check, severity, severity != "error", "; ".join(problems[:8])))
        else:
            self.findings.append(Finding(check, detail=good))

    def to_dict(self) -> dict:
        return {"ok": self.ok, "path": self.path, "file_len": self.file_len, "findings": [vars(f) for f in self.findings], "recommendations": self.recommendations, "summary": self.summary}


def _decoded(s: Summary, places: list[int], spark: SparkSession | None) -> list[str]:
    """Problems of decoding chunks; with a session, tasks decode."""

    def one(p: int) -> str | None:
        c = s.chunks[p]
        try:
            decode(s.datasets[c.dataset], c, read_range(s.path, c.offset, c.stored))
        except (ContainerError, OSError) as e:
            return f"{s.datasets[c.dataset].name} {list(c.index)}: {e}"
        return None

    if spark is None or len(places) <= QUICK_CHUNKS:
        return [x for x in map(one, places) if x]

    def run(batches):
        for b in batches:
            bad = [x for x in (one(p) for p in b.column(0).to_pylist()) if x]
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["bad"])

    return [r["bad"] for r in spark.range(0, len(places), 1, min(len(places) // 32 + 1, 4096)).mapInArrow(run, "bad string").limit(8).collect()]


def verify(path: str, deep: bool = False, spark: SparkSession | None = None) -> Report:
    r = Report(path, size_of(path))
    try:
        s = read_summary(path, footer=False)
    except ContainerError as e:
        for c in CHECKS[: CHECKS.index(e.check)] if e.check in CHECKS else ():
            r.add(c, [])
        r.add(e.check, [str(e)])
        return r
    for c in ("superblock", "dataset_directory", "chunk_index"):
        r.add(c, [])
    footer_error = None
    if s.flags & FLAG_FOOTER:
        try:
            s = read_summary(path)
        except ContainerError as e:
            footer_error = str(e)
    known = [c for c in s.chunks if c.dataset < len(s.datasets)]
    data_start = sum(s.index)
    r.add("chunk_payloads", [f"chunk {list(c.index)} ends at {c.offset + c.stored}" for c in s.chunks if c.offset + c.stored > s.payload_end or c.offset < data_start])
    r.add("chunk_dataset_ids", [f"dataset {c.dataset}" for c in s.chunks if c.dataset >= len(s.datasets)])
    sizes = []
    for i, d in enumerate(s.datasets):
        mine = [c for c in known if c.dataset == i]
        total = sum(c.raw for c in mine)
        if total != d.size * DTYPES[d.dtype].size or len({c.index for c in mine}) != len(mine):
            sizes.append(f"{d.name}: {total} bytes in {len(mine)} chunks, {d.n_bytes} expected")
        for c in mine:
            if any(k * n >= e for k, n, e in zip(c.index, d.chunk_shape, d.shape, strict=True)):
                sizes.append(f"{d.name}: chunk {list(c.index)} lies outside")
            elif c.raw != DTYPES[d.dtype].size * _prod(tile_shape(d, c.index)):
                sizes.append(f"{d.name}: chunk {list(c.index)} has {c.raw} bytes")
    r.add("dataset_tensor_bytes", sizes)
    spans = sorted((c.offset, c.offset + c.stored) for c in s.chunks)
    r.add("payload_offsets", [f"payloads at {a[0]} and {b[0]} overlap" for a, b in zip(spans, spans[1:], strict=False) if b[0] < a[1]])
    offsets = [c.offset for c in s.chunks]
    r.add("payload_order", [] if offsets == sorted(offsets) else ["payloads aren't in the order of the index"], "warning")
    sound = [i for i, c in enumerate(s.chunks) if c.dataset < len(s.datasets) and c.offset + c.stored <= s.length]
    places = sound if deep else sound[:QUICK_CHUNKS]
    r.add("chunk_decode", _decoded(s, places, spark), good=f"{len(places)} of {len(s.chunks)} chunks decoded")
    r.add("dataset_count", [], good=str(len(s.datasets)))
    r.add("footer", [footer_error] if footer_error else [], good="present" if s.flags & FLAG_FOOTER else "none")
    if not footer_error:
        wrong = [f"{d.name}: labels of axis {k!r}" for d in s.datasets for k, v in d.coords.items() if not any(d.labels(i) == list(v) and len(v) <= d.shape[i] for i in range(d.rank))]
        r.add("footer_metadata", wrong, "warning")
    r.summary = {"datasets": len(s.datasets), "chunks": len(s.chunks), "chunks_decoded": len(places), "payload_bytes": sum(c.stored for c in s.chunks)}
    return r


def _prod(xs) -> int:
    out = 1
    for x in xs:
        out *= x
    return out


def plan_repairs(path: str) -> list[str]:
    """Codes of the findings that can be repaired in place."""
    return [x["code"] for x in verify(path).recommendations if x["code"] == "footer_invalid"]


def repair(path: str, codes: list[str], dry_run: bool = False) -> dict:
    """Strips a malformed footer: the file is cut after its payloads and the flag cleared. Nothing else is touched."""
    open_ = plan_repairs(path)
    bad = [c for c in codes if c not in open_]
    if bad:
        raise ContainerError("footer", f"nothing to repair for: {', '.join(bad)}; open: {', '.join(open_) or 'none'}")
    s = read_summary(path, footer=False)
    end = max([sum(s.index), *(c.offset + c.stored for c in s.chunks)])
    actions = [f"truncate from {s.length} to {end} bytes", "clear the footer flag"] if codes else []
    if codes and not dry_run:
        with open(path, "r+b") as f:
            f.truncate(end)
            f.seek(12)
            f.write((s.flags & ~FLAG_FOOTER).to_bytes(4, "little"))
            f.flush()
            os.fsync(f.fileno())
    return {"path": path, "dry_run": dry_run, "planned": open_, "applied": [] if dry_run else list(codes), "actions": actions, "ok": verify(path).ok if codes and not dry_run else None}

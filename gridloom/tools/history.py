"""The history of queries: JSON lines in the cache folder, newest last."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from gridloom.plans.document import QueryDocument
from gridloom.sources.spill import cache_dir

DEFAULT_MOST, MOST = 50, 10_000


def path() -> Path:
    return Path(os.environ.get("GRIDLOOM_HISTORY_FILE") or cache_dir() / "query_history.jsonl")


def most() -> int:
    try:
        return max(1, min(MOST, int(os.environ.get("GRIDLOOM_HISTORY_MAX", DEFAULT_MOST))))
    except ValueError:
        return DEFAULT_MOST


def load() -> list[dict]:
    out = []
    if path().exists():
        for line in path().read_text().splitlines():
            try:
                out.append(json.loads(line))
            except ValueError:
                continue
    return out


def record(doc: QueryDocument, file: str | None, mode: str) -> None:
    """Adds a query; one that equals the last counts again instead."""
    if os.environ.get("GRIDLOOM_NO_HISTORY"):
        return
    rows = load()
    new = {"query": doc.to_wire(), "file": file, "mode": mode}
    if rows and all(rows[-1].get(k) == v for k, v in new.items()):
        rows[-1]["count"] = rows[-1].get("count", 1) + 1
        rows[-1]["at"] = int(time.time())
    else:
        rows.append(new | {"at": int(time.time()), "count": 1})
    path().parent.mkdir(parents=True, exist_ok=True)
    draft = path().with_suffix(f".{os.getpid()}.draft")
    draft.write_text("".join(json.dumps(r) + "\n" for r in rows[-most() :]))
    os.replace(draft, path())


def listed(dataset: str | None = None, file: str | None = None, mode: str | None = None, grep: str | None = None, everything: bool = False) -> list[dict]:
    """Newest first, filtered; 20 unless all are wanted."""
    rows = [r for r in reversed(load()) if (not dataset or r["query"].get("dataset") == dataset) and (not file or file in (r.get("file") or "")) and (not mode or r.get("mode") == mode) and (not grep or grep.lower() in json.dumps(r).lower())]
    return rows if everything else rows[:20]


def pick(n: int, **filters) -> dict:
    rows = listed(everything=True, **filters)
    if not 1 <= n <= len(rows):
        raise IndexError(f"no saved query {n}; there are {len(rows)}")
    return rows[n - 1]


def clear() -> None:
    path().unlink(missing_ok=True)

"""Command line: info, verify, repair, query, history, convert and export."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from gridloom import engine
from gridloom.model import ValidationError
from gridloom.plans.document import Execution, parse_query_text, parse_query_value
from gridloom.tools import history, info, output


def session() -> SparkSession:
    spark = SparkSession.builder.appName("gridloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def catalog_of(spark: SparkSession, path: str) -> engine.Catalog:
    """A container, a Zarr store, a Parquet tensor store, or a folder of tables."""
    from gridloom.sources import container, parquet_tensor, tables, zarr3

    if os.path.isdir(path):
        if os.path.exists(f"{path}/zarr.json"):
            return zarr3.open_catalog(spark, path)
        if names := parquet_tensor.names(spark, path):
            return engine.Catalog({n: (lambda n=n: parquet_tensor.read(spark, path, n)) for n in names}, path)
        return engine.Catalog(tables.virtual_datasets(spark, path), path)
    return container.open_catalog(spark, path)


def query_text(arg: str | None) -> tuple[str, str | None]:
    if arg is None or arg == "-":
        return sys.stdin.read(), None
    if os.path.exists(arg):
        with open(arg) as f:
            return f.read(), arg
    return arg, None


def run_query(doc, a) -> int:
    spark = session() if a.file else None
    form = "quiet" if a.quiet else a.format
    if a.device:
        e = doc.execution or Execution()
        doc = type(doc)(**{**vars(doc), "execution": Execution(e.memory_budget_bytes, e.memory_budget_percent_bps, e.fold_parallel, a.device)})
    limit = (output.PREVIEW.get(form, 0) if a.preview is None else a.preview) if a.execute else None
    if a.execute and limit == 0 and doc.operation is None and doc.spill is None:
        limit = 64
    response = engine.execute_query_document(doc, catalog_of(spark, a.file) if a.file else None, limit, a.spill_allow)
    print(output.render(response, form))
    if hint := output.miss_hint(response):
        print(hint, file=sys.stderr)
    history.record(doc, a.file, "execute" if a.execute else "plan")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("gridloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("info")
    c.add_argument("path")
    for flag in ("json", "all", "layout", "execution", "datasets", "chunks", "history", "metadata"):
        c.add_argument(f"--{flag}", action="store_true")
    c.add_argument("-q", "--quiet", action="store_true")
    c.add_argument("-n", "--limit", type=int, default=32)
    c.add_argument("--dataset")
    c.add_argument("--grep")
    c = sub.add_parser("verify")
    c.add_argument("path")
    for flag in ("deep", "repair", "json"):
        c.add_argument(f"--{flag}", action="store_true")
    c.add_argument("-q", "--quiet", action="store_true")
    c = sub.add_parser("repair")
    c.add_argument("path")
    c.add_argument("--apply", action="append", default=[])
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--json", action="store_true")

    def query_flags(c: argparse.ArgumentParser) -> None:
        c.add_argument("-t", "--file")
        c.add_argument("-x", "--execute", action="store_true")
        c.add_argument("--format", choices=output.FORMATS, default="full")
        c.add_argument("-q", "--quiet", action="store_true")
        c.add_argument("--preview", "--preview-f32", type=int)
        c.add_argument("--device")
        c.add_argument("--spill-allow", action="append")

    c = sub.add_parser("query", aliases=["q"])
    c.add_argument("query", nargs="?")
    query_flags(c)
    c = sub.add_parser("history", aliases=["hist", "qhist"])
    c.add_argument("action", nargs="?", choices=("list", "run"), default="list")
    c.add_argument("n", nargs="?", type=int)
    for flag in ("clear", "all", "json", "plan"):
        c.add_argument(f"--{flag}", action="store_true")
    for flag in ("dataset", "mode", "grep"):
        c.add_argument(f"--{flag}")
    query_flags(c)
    c = sub.add_parser("convert")
    c.add_argument("source")
    c.add_argument("out")
    c.add_argument("--jobs", type=int, default=0, help="tasks at once; 0: as Spark has them")
    c = sub.add_parser("export")
    c.add_argument("source")
    c.add_argument("out")
    a = p.parse_args(argv)
    try:
        return COMMANDS[a.command](a)
    except (ValidationError, OSError, IndexError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _info(a) -> int:
    if a.quiet:
        print(info.quiet(a.path))
    elif a.json:
        print(json.dumps(info.as_dict(info.read_summary(a.path)), indent=2))
    else:
        names = {"layout", "execution", "datasets", "chunks", "history"}
        print(info.text(a.path, names if a.all else {n for n in names if getattr(a, n)} or None, a.dataset, a.grep, a.limit, a.metadata or a.all))
    return 0


def _verify(a) -> int:
    from gridloom.tools import verify

    r = verify.verify(a.path, a.deep, session() if a.deep else None)
    if a.repair and (codes := verify.plan_repairs(a.path)):
        verify.repair(a.path, codes)
        r = verify.verify(a.path, a.deep)
    if a.json:
        print(json.dumps(r.to_dict(), indent=2))
    elif a.quiet:
        print(f"status={'ok' if r.ok else 'failed'}")
    else:
        for f in r.findings:
            print(f"{'ok  ' if f.severity == 'info' else f.severity} {f.check}{': ' + f.detail if f.detail else ''}")
        for x in r.recommendations:
            print(f"{x['code']}: {x['fix']}")
    return 0 if r.ok else 1


def _repair(a) -> int:
    from gridloom.tools import verify

    out = verify.repair(a.path, a.apply, a.dry_run)
    print(json.dumps(out, indent=2) if a.json else "\n".join([f"planned: {', '.join(out['planned']) or 'nothing'}", *out["actions"]]))
    return 0


def _query(a) -> int:
    return run_query(parse_query_text(*query_text(a.query)), a)


def _history(a) -> int:
    filters = {"dataset": a.dataset, "mode": a.mode, "grep": a.grep, "file": a.file if a.action == "list" else None}
    if a.clear:
        history.clear()
    elif a.action == "run":
        row = history.pick(a.n or 1, **filters)
        a.file = a.file or row.get("file")
        a.execute = (a.execute or row.get("mode") == "execute") and not a.plan
        return run_query(parse_query_value(row["query"]), a)
    else:
        rows = history.listed(everything=a.all, **filters)
        print(json.dumps(rows, indent=2) if a.json else "\n".join(f"{i + 1}  {r['mode']}  {r.get('file') or '-'}  {json.dumps(r['query'])}" for i, r in enumerate(rows)))
    return 0


def _convert(a) -> int:
    from gridloom.sources import convert

    names = convert.convert(session(), a.source, a.out)
    print(f"{len(names)} datasets: {', '.join(names)}")
    return 0


def _export(a) -> int:
    from gridloom.sources import zarr3

    n = zarr3.export(session(), a.source, a.out)
    print(f"{n} chunks", file=sys.stderr)
    return 0


COMMANDS = {"info": _info, "verify": _verify, "repair": _repair, "query": _query, "q": _query, "history": _history, "hist": _history, "qhist": _history, "convert": _convert, "export": _export}

if __name__ == "__main__":
    sys.exit(main())

"""Secret scans with corpus-wide ownership frequency.

A scan finds credential-like spans in whole texts: assignments, access keys, long hexadecimal runs, and further long
tokens of mixed characters as candidates. The secret part of each is hashed, and hashes are counted over the corpus by
distinct repositories (documents) and distinct owners (sources). What EXAMPLE_OWNERS owners or more have, or
EXAMPLE_REPOSITORIES repositories or more even of one owner, is a widely copied example; what fewer have and looks random
is live. Candidates beyond the base kinds become spans only if they are live; base spans always stay, with their verdict.

Only hashes and counts are shuffled, never texts, and a hash that a third of all rows hold is counted by partial sums.

Defined results: a null or empty text has no spans; a null source is an owner of its own, and so is that of a table without
the column source; repeated rows and repeated doc_ids give a row each and count as one repository by doc_id, null
doc_ids together as another one; an empty table gives an empty result; further columns are ignored by the scan and
passed through by the pipeline stage.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import buffers, lookup, materialize, release, slices, table

KINDS = ("assign", "access", "hex", "token")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_TOKEN = 6, 20, 24, 20
#: Owners, and repositories, from which on a value is a widely copied example, and the bits a character of a value that looks random.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, LIVE_BITS = 3, 50, 2.5
#: Parts of placeholder values (fixed values).
PLACEHOLDERS = ("example", "changeme", "placeholder", "xxxx", "your", "dummy", "sample", "123456", "abcdef", "test")

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True

SCAN = "uid long, doc_id long, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind:int,start:long,end:long,value:string,random:boolean>>"


def runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(row, start, end) of each maximal run of true bytes within a row, of ``least`` bytes or more."""
    if not len(mask):
        return []
    before = np.concatenate([[False], mask[:-1]])
    after = np.concatenate([mask[1:], [False]])
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    rows = np.searchsorted(offsets, starts, "right") - 1
    return list(zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True))


def bits(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    low = value.lower()
    return bits(value) >= LIVE_BITS and any(c.isdigit() for c in value) and not any(p in low for p in PLACEHOLDERS)


def find(text: str, hexes: list[tuple[int, int]], tokens: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int, int, str]]]:
    """Base spans and further candidates, each (kind, start, end, value); ``hexes`` and ``tokens`` are runs in code points."""
    base = []
    if ":" in text or "=" in text:
        base += [(0, m.start(), m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    if "AKIA" in text:
        base += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    base += [(2, s, e, text[s:e]) for s, e in hexes]
    base.sort(key=lambda x: (x[1], x[0]))
    more = []
    for s, e in tokens:
        v = text[s:e]
        if any(b[1] < e and s < b[2] for b in base) or not (any(c.isdigit() for c in v) and any(c.isalpha() for c in v)):
            continue
        more.append((3, s, e, v))
    return base, more


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, *_ in spans)


def _scan(batches):
    for b in batches:
        offsets, data = buffers(b.column("_text"))
        n = b.num_rows
        hexes: dict[int, list] = {}
        tokens: dict[int, list] = {}
        for i, j in slices(offsets):
            part = data[offsets[i] : offsets[j]]
            at = offsets[i : j + 1] - offsets[i]
            lead = None
            for mask, least, into in ((_HEX, MIN_HEX, hexes), (_TOKEN, MIN_TOKEN, tokens)):
                for row, s, e in runs(mask[part], at, least):
                    if lead is None:
                        lead = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                    into.setdefault(i + row, []).append((int(lead[s] - lead[at[row]]), int(lead[e] - lead[at[row]])))
        rows = []
        for r in range(n):
            text = b.column("_text")[r].as_py() or ""
            base, more = find(text, hexes.get(r, []), tokens.get(r, []))
            kinds = [x[0] for x in base]
            found = [{"kind": k, "start": s, "end": e, "value": hashlib.sha256(v.encode()).hexdigest()[:32], "random": looks_random(v)} for k, s, e, v in sorted(base + more, key=lambda x: (x[1], x[0]))]
            rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), found))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        item = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("random", pa.bool_())])
        yield pa.RecordBatch.from_arrays(
            [b.column("_uid"), b.column("_doc"), b.column("_owner"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(item))],
            ["uid", "doc_id", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
        )


def owner_of(source: Column | None) -> Column:
    """Who owns a repository; a null source and a missing column are one owner."""
    return F.lit("\0") if source is None else F.coalesce(source.cast("string"), F.lit("\0"))


def verdicts(each: DataFrame) -> DataFrame:
    """(value, owners, repositories, n, example) of the candidates ``each`` (value, owner, doc_id): counts by partial sums, never a list of a value's rows."""
    repository = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    owned = each.groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count_distinct(repository).alias("repositories"), F.count(F.lit(1)).alias("n"))
    return materialize(owned.withColumn("example", (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)), "secret-owners")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: base counts and digest, and every candidate with its verdict and span."""
    source = F.col("source") if "source" in docs.columns else None
    # Rows are told apart by their place in the input, so a task that runs again gives the same rows.
    found = docs.select(F.monotonically_increasing_id().alias("_uid"), F.col("doc_id").cast("long").alias("_doc"), owner_of(source).alias("_owner"), F.col("text").alias("_text")).mapInArrow(_scan, SCAN)
    found = materialize(found, "secrets")
    each = found.where(F.size("found") > 0).select("uid", "doc_id", "owner", F.explode("found").alias("f")).select("uid", "doc_id", "owner", "f.*")
    judged = lookup(each, verdicts(each), "value", "n").withColumn("verdict", F.when(F.col("example"), "example").when(F.col("random"), "live").otherwise("unclear"))
    kept = judged.where((F.col("kind") < 3) | (F.col("verdict") == "live"))
    spans = kept.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "verdict", "owners", "repositories"))).alias("all"))
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform("all", lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
    count = lambda v: F.coalesce(F.size(F.filter("all", lambda x: x["verdict"] == v)), F.lit(0)).cast("long")
    most = F.coalesce(F.array_max(F.transform("all", lambda x: x["repositories"])), F.lit(0)).cast("long")
    return found.join(spans, "uid", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(text, F.lit("")).alias("spans"), count("live").alias("n_live"), count("example").alias("n_example"), most.alias("most_repositories"), F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,verdict:string,owners:bigint,repositories:bigint>>")).alias("all"))


#: What a redacted span becomes.
MASK = "[secret]"


def redact(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` with each union of overlapping spans replaced by MASK."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s, e in sorted(spans):
        if s < at:
            out, at = out, max(at, e)
            continue
        out += [text[at:s], MASK]
        at = e
    return "".join([*out, text[at:]])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the spans of live credentials masked; widely copied examples and all other text stay.

    Verdicts are counts over hashes; the hashes of live credentials are joined back to the few texts that have
    candidates, so texts without any pass by without a shuffle.
    """
    item = "array<struct<kind:int,start:long,end:long,value:string,random:boolean>>"
    names = docs.columns
    place = {n: f"c{i}" for i, n in enumerate(names)}
    flat = docs.toDF(*place.values())
    text, doc = place["text"], place["doc_id"]
    own = owner_of(F.col(place["source"]) if "source" in place else None)

    def candidates(batches):
        for b in batches:
            column = lambda name: b.column(b.schema.get_field_index(name))
            got = next(_scan([pa.RecordBatch.from_arrays([column("_uid"), column("_doc"), column("_owner"), column(text)], ["_uid", "_doc", "_owner", "_text"])]))
            yield pa.RecordBatch.from_arrays([*b.columns, got.column("found")], [*b.schema.names, "_found"])
        release()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema.fields) + f", _uid long, _doc long, _owner string, _found {item}"
    numbered = flat.select("*", F.monotonically_increasing_id().alias("_uid"), F.col(doc).cast("long").alias("_doc"), own.alias("_owner"))
    whole = materialize(numbered.mapInArrow(candidates, schema), "secrets-stage")
    each = whole.where(F.size("_found") > 0).select("_uid", F.col("_doc").alias("doc_id"), F.col("_owner").alias("owner"), F.explode("_found").alias("f")).select("_uid", "doc_id", "owner", "f.*")
    live = lookup(each, verdicts(each), "value", "n").where(F.col("random") & ~F.col("example")).groupBy("_uid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_live"))

    def masked(batches):
        at = [place[n] for n in names].index(text)
        for b in batches:
            spans = b.column(b.num_columns - 1).to_pylist()
            texts = [redact(t.as_py(), [(x["start"], x["end"]) for x in s or ()]) for t, s in zip(b.column(at), spans, strict=True)]
            cols = [c if i != at else pa.array(texts, pa.string()) for i, c in enumerate(b.columns[: len(names)])]
            yield pa.RecordBatch.from_arrays(cols, list(place.values()))
        release()

    some = whole.where(F.size("_found") > 0).join(live, "_uid", "left").select(*place.values(), "_live").mapInArrow(masked, flat.schema)
    if "n_chars" in place:  # a length of the text, so it follows the text
        some = some.withColumn(place["n_chars"], F.when(F.col(text).isNull(), F.col(place["n_chars"])).otherwise(F.char_length(text)).cast(flat.schema[place["n_chars"]].dataType))
    return whole.where(F.size("_found") == 0).select(*place.values()).unionByName(some).toDF(*names)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example", "most_repositories")

"""Removal of repeated 200-byte strings by sorted suffixes over the corpus.

A byte goes if a 200-byte string (a window) that covers it also starts anywhere else. All suffixes of a corpus, 200 bytes
each, are 200 times the corpus, so suffixes are sorted at anchors only, which stand for all windows around them, exactly:

1. Each window has an anchor, the least-hashed 101-byte string in it. Equal windows have equal anchors at equal offsets, so
   a window whose anchor occurs once can't repeat. Neighbouring windows share an anchor: a stretch of some fifty windows.
   A first lookup by chunk (see ``exchange``) counts anchors; stretches with a unique one are done.
2. The suffixes at the other anchors, with the bytes of their stretch, are range-partitioned by splitters sampled from what
   is sent: their leading 8 bytes, then a hash of the anchor. A chunk sends equal ones once.
3. Each bucket sorts its suffixes by multikey quicksort, and the bytes before the anchors likewise, reversed. Neighbours in
   both orders tell how many bytes suffixes share after and before the anchor, and so which windows of two stretches are
   equal: by comparison of bytes, not of hashes. Least and greatest keys of neighbouring buckets are compared across
   their boundary, so no suffix can have an equal one on the other side.

An anchor with more than HOT_RECORDS different stretches (the border of a passage that a third of all documents hold) would be too
much for one bucket. Its windows are sent one by one, each by its own leading 8 bytes and a hash of all 200, and dealt by
that key.

Defined results: null and empty texts have no bytes and no removals (the digest of no bytes); texts under 200 bytes keep
all; repeated rows are repeats of each other; matches never cross texts; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import _TABLE, mix, powers, slices, span_hashes, table
from gridloom.llm.exchange import Answers, Chunk, chunks, deltas, n_buckets, narrow, pack, reduce, request, runs, split, undelta, unpack

LENGTH, ANCHOR = 200, 101
#: k-mers among which a window's anchor is chosen, and the most bytes of a stretch on either side of its anchor.
CHOICES = LENGTH - ANCHOR + 1
SIDE = LENGTH - ANCHOR
#: What the first lookup says of an anchor: unique, again, again with very many different stretches.
UNIQUE, AGAIN, HOT = 0, 1, 2
HOT_RECORDS = 20_000
#: Chunks from which splitters are sampled, about, the most keys of each, and the most ranges (a range beyond is dealt by hash).
SAMPLE_CHUNKS, SAMPLE_KEYS, MOST_RANGES = 64, 512, 1 << 15
_LOW = np.uint64(0xFFFFFFFF)


@dataclass
class Stretches:
    """Runs of windows with one anchor: first and last window, place and hash of the anchor, and a hash of all their bytes."""

    lo: np.ndarray
    hi: np.ndarray
    place: np.ndarray
    anchor: np.ndarray
    span: np.ndarray


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each ``w`` neighbours, from minima before and after the borders of blocks."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=total[1:])
    return total, down


def stretches(at: np.ndarray, data: np.ndarray) -> Stretches:
    n = len(data)
    size = np.diff(at)
    whole = size >= LENGTH
    if n < LENGTH or not whole.any():
        none = np.zeros(0, np.int64)
        return Stretches(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    total, down = prefix(data)
    grams = mix((total[ANCHOR:] - total[:-ANCHOR]) * down[: n - ANCHOR + 1])
    # The upper half decides, the place breaks ties to the left.
    least = sliding_min((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), CHOICES)
    inside = np.zeros(n - LENGTH + 2, np.int8)
    inside[at[:-1][whole]] += 1
    np.add.at(inside, at[1:][whole] - LENGTH + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[:-1]))
    place = (least[window] & _LOW).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(window)) - 1
    lo, hi, p = window[begin], window[end], place[begin]
    span = (total[hi + LENGTH] - total[lo]) * down[lo] + mix(((p - lo) * 1024 + (hi - lo)).astype(np.uint64))
    return Stretches(lo, hi, p, grams[p], mix(span ^ np.uint64(0xC3A5C85C97CB3127)))


def by_slices(c: Chunk, f) -> list:
    """``f(offsets, bytes)`` of the slices of a chunk, with the place of each in the chunk."""
    return [(int(c.offsets[i]), f(c.offsets[i : j + 1] - c.offsets[i], c.data[c.offsets[i] : c.offsets[j]])) for i, j in slices(c.offsets)]


def of_chunk(c: Chunk) -> Stretches:
    parts = by_slices(c, stretches)
    moved = ("lo", "hi", "place")
    return Stretches(*(np.concatenate([getattr(s, k) + (base if k in moved else 0) for base, s in parts]) if parts else np.zeros(0, np.int64 if k in moved else np.uint64) for k in (*moved, "anchor", "span")))


def distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, count, inverse) of the distinct pairs, in order."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(new) - 1
    inverse = np.empty(len(a), np.int64)
    inverse[order] = group
    return a[new], b[new], np.bincount(group, minlength=int(new.sum())), inverse


def _ask_anchors(buckets: int):
    def ask(c: Chunk):
        s = of_chunk(c)
        a, _, n, _ = distinct(s.anchor, s.span)
        own, first = np.unique(a, return_index=True)
        if len(own):
            times, different = np.add.reduceat(n, first), np.diff(np.append(first, len(a)))
            for k, i, j in split(own, buckets):
                yield k, pack(deltas(own[i:j]), narrow(times[i:j]), narrow(different[i:j]))

    return ask


def _answer_anchors(bucket: int, bodies: list[bytes]):
    parts = [unpack(b) for b in bodies]
    own, at = np.unique(np.concatenate([undelta(p[0]) for p in parts]), return_inverse=True)
    times, different = (np.bincount(at, np.concatenate([p[i] for p in parts]).astype(np.float64), len(own)) for i in (1, 2))
    code = np.where(times < 2, UNIQUE, np.where(different > HOT_RECORDS, HOT, AGAIN)).astype(np.uint8)[at]
    return [pack(x) for x in np.split(code, np.cumsum([len(p[0]) for p in parts])[:-1])], np.array([(code != UNIQUE).sum(), len(code)])


def codes(read, c: Chunk, s: Stretches) -> np.ndarray:
    """What the first lookup says of each stretch."""
    if not len(s.lo):
        return np.zeros(0, np.uint8)
    got = read(c.name)
    return np.concatenate([got[k][0] for k in sorted(got)])[np.unique(s.anchor, return_inverse=True)[1]]


def expand(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All places from each ``lo`` to its ``hi``."""
    n = hi - lo + 1
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(n) else np.zeros(0, np.int64)


def leads(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as a number, in the order of strings."""
    out = np.zeros(len(places), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | data[places + k].astype(np.uint64)
    return out


def rows_at(data: np.ndarray, places: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The ``size`` bytes at each place as rows of ``width`` bytes, with zeros after them."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, width)[places]
    out[np.arange(width) >= size[:, None]] = 0
    return out


@dataclass
class Sent:
    """What a chunk sends, in the order of sending.

    Records are distinct stretches with anchors that occur again: ``record`` of each stretch of ``cold``, and of each record a
    stretch (``first``), how often it stands in the chunk, and its key. Windows are those with hot anchors: ``window``
    of each of ``places``, and of each window its key and how often it stands in the chunk.
    """

    cold: np.ndarray
    record: np.ndarray
    first: np.ndarray
    n: np.ndarray
    lead: np.ndarray
    digest: np.ndarray
    places: np.ndarray
    window: np.ndarray
    window_lead: np.ndarray
    window_digest: np.ndarray
    times: np.ndarray


def sent(c: Chunk, s: Stretches, code: np.ndarray) -> Sent:
    cold = np.flatnonzero(code == AGAIN)
    lo, size = s.lo[cold], s.hi[cold] + LENGTH - s.lo[cold]
    lead, digest = leads(c.data, s.place[cold]), s.anchor[cold]
    # Equal records stand together in this order; they are told apart by their bytes.
    order = np.lexsort((span_hashes(c.data, lo, lo + size), s.place[cold] - lo, digest, lead))
    new = np.ones(len(order), bool)
    for i in range(0, len(order) - 1, 1 << 14):
        mine = order[i : i + (1 << 14) + 1]
        bytes_ = rows_at(c.data, lo[mine], size[mine], LENGTH + SIDE)
        same = (bytes_[1:] == bytes_[:-1]).all(1) & (size[mine][1:] == size[mine][:-1]) & ((s.place[cold] - lo)[mine][1:] == (s.place[cold] - lo)[mine][:-1])
        new[i + 1 : i + len(mine)] = ~same
    group = np.cumsum(new) - 1
    record = np.empty(len(order), np.int64)
    record[order] = group
    first = cold[order[new]]
    hot = code == HOT
    places = expand(s.lo[hot], s.hi[hot])
    wl, wd, times, window = distinct(leads(c.data, places), span_hashes(c.data, places, places + LENGTH))
    return Sent(cold, record, first, np.bincount(group, minlength=len(first)), leads(c.data, s.place[first]), s.anchor[first], places, window, wl, wd, times)


@dataclass
class Ranges:
    """Splitters of keys (leading bytes, hash); each range is dealt into ``parts`` buckets by hash."""

    lead: np.ndarray
    digest: np.ndarray
    parts: int = 1

    def bucket(self, lead: np.ndarray, digest: np.ndarray) -> np.ndarray:
        """The bucket of each of sorted keys."""
        i, j = np.searchsorted(lead, self.lead, "left"), np.searchsorted(lead, self.lead, "right")
        edges = [a + int(np.searchsorted(digest[a:b], d)) if b > a else int(a) for a, b, d in zip(i.tolist(), j.tolist(), self.digest, strict=True)]
        at = np.searchsorted(np.array(edges, np.int64), np.arange(len(lead)), "right")
        return at * self.parts + (mix(digest) % np.uint64(self.parts)).astype(np.int64)


def _ask_suffixes(read, by: Ranges):
    def ask(c: Chunk):
        s = of_chunk(c)
        x = sent(c, s, codes(read, c, s))
        mine, other = by.bucket(x.lead, x.digest), by.bucket(x.window_lead, x.window_digest)
        records, windows = _dealt(mine), _dealt(other)
        for k in sorted({*records, *windows}):
            i, w = records.get(k, _NONE), windows.get(k, _NONE)
            f = x.first[i]
            raw = c.data[expand(s.lo[f], s.hi[f] + LENGTH - 1)]
            yield k, pack((s.place[f] - s.lo[f]).astype(np.uint8), (s.hi[f] - s.place[f] + SIDE).astype(np.uint8), narrow(x.n[i]), raw, deltas(x.window_lead[w]), x.window_digest[w], narrow(x.times[w]))

    return ask


_NONE = np.zeros(0, np.int64)


def _dealt(bucket: np.ndarray) -> dict[int, np.ndarray]:
    """The places of each bucket's keys."""
    order = np.argsort(bucket, kind="stable")
    return {k: order[i:j] for k, i, j in runs(bucket[order])}


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of words by multikey quicksort, and how many words each row shares with the one before.

    Rows that are equal so far are a part; all parts of a depth are sorted by their next word at once, and parts of one row
    are done.
    """
    n, depth = words.shape
    order, shared, part, open_ = np.arange(n), np.full(n, depth), np.zeros(n, np.int64), np.arange(n)
    if n:
        shared[0] = 0
    for k in range(depth):
        if not len(open_):
            break
        word = words[order[open_], k]
        by = np.lexsort((word, part[open_]))
        order[open_], word = order[open_[by]], word[by]
        fresh = np.ones(len(open_), bool)
        fresh[1:] = part[open_][1:] != part[open_][:-1]
        new = fresh.copy()
        new[1:] |= word[1:] != word[:-1]
        shared[open_[new & ~fresh]] = k
        part[open_] = np.cumsum(new)
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone]
    return order, shared


def shared_bytes(words: np.ndarray, order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """How many bytes each row shares with the one before it in ``order``, from the words that they share."""
    out = shared * 8
    part = np.flatnonzero((shared < words.shape[1]) & (np.arange(len(order)) > 0))
    x = words[order[part], shared[part]] ^ words[order[part - 1], shared[part]]
    for k in range(1, 8):
        out[part] += x >> np.uint64(64 - 8 * k) == 0
    return out


def _words(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def repeated_windows(left: np.ndarray, right: np.ndarray, n: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """A row for each record, and at column d whether its window with d bytes before the anchor occurs twice or more.

    left and right: bytes on either side of the anchor; n: times; raw: the bytes of all records one after the other.
    """
    size = left + ANCHOR + right
    anchor_at = np.cumsum(size) - size + left
    after = _words(rows_at(raw, anchor_at, ANCHOR + right, LENGTH))
    before = rows_at(np.concatenate([np.zeros(SIDE, np.uint8), raw]), anchor_at, np.full(len(left), SIDE), SIDE)[:, ::-1]
    before = np.pad(np.where(np.arange(SIDE) < left[:, None], before, 0), ((0, 0), (0, -SIDE % 8)))
    (order_a, words_a), (order_b, words_b) = multikey_order(after), multikey_order(before := _words(before))
    same_a, same_b = shared_bytes(after, order_a, words_a), shared_bytes(before, order_b, words_b)
    out = np.zeros((len(left), CHOICES), bool)
    class_a, class_b = np.empty(len(left), np.int64), np.empty(len(left), np.int64)
    for d in range(CHOICES):
        # Windows are equal if their anchors are, the d bytes before and the others after.
        class_a[order_a], class_b[order_b] = np.cumsum(same_a < LENGTH - d), np.cumsum(same_b < d)
        mine = np.flatnonzero((right >= SIDE - d) & (left >= d))
        _, at = np.unique(class_a[mine] * (len(left) + 1) + class_b[mine], return_inverse=True)
        out[mine, d] = (np.bincount(at, n[mine].astype(np.float64)) > 1)[at] if len(mine) else False
    return out


def _merged(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, times, bytes) of the distinct records of all chunks, and the distinct record of each sent one."""
    seen: dict[bytes, int] = {}
    at, times, keep, lefts, rights = [], [], [], [], []
    for p in parts:
        left, right = p[0].astype(np.int64), p[1].astype(np.int64)
        ends = np.cumsum(left + ANCHOR + right)
        raw = p[3].tobytes()
        for a, b, x, y, k in zip((ends - left - ANCHOR - right).tolist(), ends.tolist(), left.tolist(), right.tolist(), p[2].tolist(), strict=True):
            body = raw[a:b]
            key = body + bytes((x,))
            i = seen.setdefault(key, len(seen))
            at.append(i)
            if i == len(times):
                times.append(0)
                keep.append(body)
                lefts.append(x)
                rights.append(y)
            times[i] += k
    return np.array(lefts, np.int64), np.array(rights, np.int64), np.array(times, np.int64), np.frombuffer(b"".join(keep), np.uint8), np.array(at, np.int64)


def _ordered(x: np.uint64) -> int:
    """An unsigned number as a signed one, in the same order."""
    return int(x) - (1 << 63)


def _answer_suffixes(bucket: int, bodies: list[bytes]):
    """For each chunk the flags of its records' windows, by record and d, and those of its single windows; totals: the least and the greatest key."""
    parts = [unpack(b) for b in bodies]
    left, right, times, raw, at = _merged(parts)
    flags = repeated_windows(left, right, times, raw) if len(left) else np.zeros((0, CHOICES), bool)
    d = np.arange(CHOICES)
    real = (d >= SIDE - right[:, None]) & (d <= left[:, None])
    lead, digest = np.concatenate([undelta(p[4]) for p in parts]), np.concatenate([p[5] for p in parts])
    _, _, _, key = distinct(lead, digest)
    again = (np.bincount(key, np.concatenate([p[6] for p in parts]).astype(np.float64)) > 1)[key] if len(key) else np.zeros(0, bool)
    out = []
    for mine, single in zip(np.split(at, np.cumsum([len(p[0]) for p in parts])[:-1]), np.split(again, np.cumsum([len(p[4]) for p in parts])[:-1]), strict=True):
        x = flags[mine][real[mine]]
        out.append(pack(np.packbits(x), np.array([len(x)], np.uint64), np.packbits(single), np.array([len(single)], np.uint64)))
    if len(left):
        lead = np.append(lead, leads(raw, np.cumsum(left + ANCHOR + right) - ANCHOR - right))
    return out, np.array([_ordered(lead.min()), _ordered(lead.max())])


def check_boundaries(totals: DataFrame, parts: int) -> None:
    """Raises if a range holds a leading string that lies before one of the range before it: equal suffixes could be apart."""
    ranges = totals.groupBy(F.floor(F.col("bucket") / parts).alias("r")).agg(F.min(F.element_at("total", 1)).alias("least"), F.max(F.element_at("total", 2)).alias("greatest"))
    # A row for each range.
    if not ranges.withColumn("before", F.lag("greatest").over(Window.orderBy("r"))).where("before > least").isEmpty():
        raise RuntimeError("suffixes aren't in the order of their ranges")


def splitters(docs: DataFrame, read, buckets: int) -> Ranges:
    """Ranges of about equal size, from a sample of the keys that chunks send: at most SAMPLE_KEYS of about SAMPLE_CHUNKS chunks, chosen by their digest."""
    every = max(1, -(-buckets // SAMPLE_CHUNKS))  # a bucket stands for about as many bytes as a chunk

    def run(batches):
        for b in batches:
            for c in chunks(b):
                if int(c.name[:8], 16) % every == 0:
                    s = of_chunk(c)
                    x = sent(c, s, codes(read, c, s))
                    lead, digest = np.append(x.lead, x.window_lead), np.append(x.digest, x.window_digest)
                    some = np.unique(np.linspace(0, max(0, len(lead) - 1), min(len(lead), SAMPLE_KEYS)).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([pack(lead[some], digest[some])], pa.binary())], ["body"])

    parts = [unpack(r["body"]) for r in docs.mapInArrow(run, "body binary").collect()] or [[np.zeros(0, np.uint64)] * 2]
    lead, digest, _, _ = distinct(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
    ranges = min(buckets, MOST_RANGES, max(1, len(lead)))
    at = np.linspace(0, len(lead), ranges + 1)[1:-1].astype(int)
    return Ranges(lead[at], digest[at], -(-buckets // ranges))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def repeated_places(c: Chunk, s: Stretches, code: np.ndarray, read, by: Ranges) -> np.ndarray:
    """Where repeated windows of a chunk begin."""
    if not (code != UNIQUE).any():
        return np.zeros(0, np.int64)
    x = sent(c, s, code)
    got = read(c.name)
    flags = [np.concatenate([np.unpackbits(got[k][i], count=int(got[k][i + 1][0])) for k in sorted(got)]).astype(bool) for i in (0, 2)]
    # Answers come by bucket; what each record and window was answered lies behind those of the buckets before.
    size = (s.hi - s.lo + 1)[x.first]
    dealt = np.argsort(by.bucket(x.lead, x.digest), kind="stable")
    start = np.empty(len(size), np.int64)
    start[dealt] = np.cumsum(size[dealt]) - size[dealt]
    lo, hi = s.lo[x.cold], s.hi[x.cold]
    places = expand(lo, hi)
    hit = places[flags[0][np.repeat(start[x.record] + hi, hi - lo + 1) - places]]
    single = np.empty(len(x.times), bool)
    single[np.argsort(by.bucket(x.window_lead, x.window_digest), kind="stable")] = flags[1]
    return np.concatenate([hit, x.places[single[x.window]]])


def dedup(docs: DataFrame, with_kept: bool = True) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): bytes, removed bytes, removed runs, and the digest and bytes that are left."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    buckets = n_buckets(docs)
    known = Answers(reduce(request(docs, _ask_anchors(buckets)), _answer_anchors), "anchors").reader()
    by = splitters(docs, known, buckets)
    answers = Answers(reduce(request(docs, _ask_suffixes(known, by)), _answer_suffixes), "suffixes")
    check_boundaries(answers.totals, by.parts)
    sorted_ = answers.reader()

    def run(batches):
        for b in batches:
            for c in chunks(b):
                s = of_chunk(c)
                cover = np.zeros(len(c.data) + 1, np.int32)
                hit = repeated_places(c, s, codes(known, c, s), sorted_, by)
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + LENGTH, -1)
                gone = np.cumsum(cover[:-1]) > 0
                before = np.concatenate([[False], gone[:-1]])
                full = c.offsets[1:] > c.offsets[:-1]
                before[c.offsets[:-1][full]] = False
                n_gone = np.concatenate([[0], np.cumsum(gone)])[c.offsets]
                n_runs = np.concatenate([[0], np.cumsum(gone & ~before)])[c.offsets]
                left = [c.data[i:j][~gone[i:j]].tobytes() for i, j in zip(c.offsets[:-1], c.offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.ids, pa.int64()), pa.array(np.diff(c.offsets)), pa.array(np.diff(n_gone)), pa.array(np.diff(n_runs)), pa.array([hashlib.sha256(x).hexdigest() for x in left]), pa.array(left if with_kept else [None] * len(left), pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return docs.mapInArrow(run, RESULT)


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), with_kept=False).drop("kept")

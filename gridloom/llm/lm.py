"""Language-model scoring by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of the trigram, the bigram and the unigram and a uniform share.
The weights depend on how often the context was seen (buckets by powers of two: of the two tokens before, or of the one
before where the two were never seen) and are learned by expectation-maximisation on held-out counts: each of the folds
DELETED is deleted from the counts and predicted from the rest. The final model counts all training documents again.

Counts cover every training token. Chunks of texts send each distinct unigram and bigram once, with its counts, to
buckets of the key space, and get back its corpus counts, so no row is ever made for a token of a document. A second
lookup of the same kind counts trigrams; a trigram with a bigram that occurs once in all texts occurs once itself, so
its counts are known without asking. EM runs on a fixed grid of (context bucket, quantised estimates), whose size doesn't
depend on the corpus.

Defined results: null and empty texts consist of one end token; a null doc_id is a training document; repeated rows
count and are scored each; the first token's trigram is its bigram; with no training document at all the base is 0 by its
formula and the model is uniform; an empty table gives an empty result; further columns are ignored. Tokens are known by
64-bit hashes.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import mix, slices, span_hashes, table, word_spans
from gridloom.llm.exchange import Answers, Chunk, chunks, deltas, n_buckets, narrow, pack, reduce, request, split, undelta, unpack

FOLDS, HELD_OUT, DELETED = 7, 2, (3, 5)
#: Octaves of context frequency; one set of buckets for contexts of two tokens, one for those of one.
OCTAVES = 25
#: Steps of the grid in an octave, its places (0 for an estimate of 0), and rounds of EM.
STEPS, PLACES, ROUNDS = 2, 64, 60
#: Weights of trigram, bigram, unigram and uniform share before learning, and the least share of each.
START, LEAST = (0.4, 0.3, 0.2, 0.1), 1e-6
_END, _BEGIN = np.uint64(0x5E0FD0C5E0FD0C11), np.uint64(0xB0517B0517B05173)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Tokens:
    """Of a chunk: hashes of tokens, bigrams and trigrams (each by its last token), where rows begin, and the fold of each token (-1 for a null doc_id); a row ends with an end token."""

    token: np.ndarray
    pair: np.ndarray
    triple: np.ndarray
    first: np.ndarray
    fold: np.ndarray


def fold_of(doc_id: int | None) -> int:
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def _then(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(token))


def _shifted(x: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """The value of the token before, and ``start`` at the begin of a row."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first] = start
    return out


def tokens(c: Chunk) -> Tokens:
    found, places = [], []
    for i, j in slices(c.offsets):
        part = _LOWER[c.data[c.offsets[i] : c.offsets[j]]]
        s, e, rows = word_spans(c.offsets[i : j + 1] - c.offsets[i], part)
        found.append(span_hashes(part, s, e))
        places.append(rows + i)
    n = len(c.ids)
    words = np.concatenate(found) if found else np.zeros(0, np.uint64)
    rows = np.concatenate(places) if places else np.zeros(0, np.int64)
    size = np.bincount(rows, minlength=n) + 1
    first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    token = np.full(int(size.sum()), _END, np.uint64)
    token[np.arange(len(words)) + rows] = words
    pair = _then(_shifted(token, first, _BEGIN), token)
    return Tokens(token, pair, _then(_shifted(pair, first, _BEGIN), token), first, np.repeat(np.array([fold_of(x) for x in c.ids], np.int8), size))


@dataclass
class Own:
    """Distinct keys of a chunk, the place of each token's key among them, and their counts: held out, training, and by deleted fold."""

    keys: np.ndarray
    at: np.ndarray
    held: np.ndarray
    train: np.ndarray
    deleted: list[np.ndarray]


def own_keys(keys: np.ndarray, fold: np.ndarray) -> Own:
    own, at = np.unique(keys, return_inverse=True)
    count = lambda mask: np.bincount(at[mask], minlength=len(own))
    return Own(own, at, count(fold == HELD_OUT), count(fold != HELD_OUT), [count(fold == f) for f in DELETED])


def _bodies(o: Own, buckets: int):
    for b, i, j in split(o.keys, buckets):
        yield b, pack(deltas(o.keys[i:j]), narrow(o.held[i:j]), narrow(o.train[i:j]), *(narrow(d[i:j]) for d in o.deleted))


def _ask(buckets: int):
    def ask(c: Chunk):
        t = tokens(c)
        for kind, keys in enumerate((t.token, t.pair)):
            yield from ((2 * b + kind, body) for b, body in _bodies(own_keys(keys, t.fold), buckets))

    return ask


def _answer(bucket: int, bodies: list[bytes]):
    """Corpus counts of each asked key: training, whether it occurs twice or more in all texts, and by deleted fold where the chunk has it there; totals: the kind of key, then distinct and counted training keys, all and without each deleted fold."""
    parts = [unpack(b) for b in bodies]
    own, at = np.unique(np.concatenate([undelta(p[0]) for p in parts]), return_inverse=True)
    held, train, *deleted = (np.bincount(at, np.concatenate([p[k] for p in parts]).astype(np.float64), len(own)).astype(np.int64) for k in range(1, 3 + len(DELETED)))
    ends = np.cumsum([len(p[0]) for p in parts])
    out = [pack(narrow(train[x]), (held[x] + train[x] > 1).astype(np.uint8), *(narrow(d[x[p[3 + k] > 0]]) for k, d in enumerate(deleted))) for p, x in zip(parts, np.split(at, ends[:-1]), strict=True)]
    totals = [y for d in (0, *deleted) for y in ((train > d).sum(), (train - d).sum())]
    return out, np.array([bucket % 2, *totals])


@dataclass
class Counts:
    """Of one n-gram length at each token: training count, whether the n-gram occurs twice or more, and counts by deleted fold (right where the token is in that fold)."""

    train: np.ndarray
    again: np.ndarray
    deleted: list[np.ndarray]


def _looked_up(o: Own, got: list[list[np.ndarray]]) -> Counts:
    train, again = (np.concatenate([x[i] for x in got]) for i in (0, 1))
    train = train.astype(np.int64 if train.dtype.itemsize == 8 else train.dtype)[o.at]  # small types spare memory
    deleted = []
    for k, mine in enumerate(o.deleted):
        found = np.concatenate([x[2 + k] for x in got])
        d = np.zeros(len(o.keys), np.int64 if found.dtype.itemsize == 8 else np.int32 if found.dtype.itemsize < 4 else np.int64)
        d[mine > 0] = found
        deleted.append(d[o.at])
    return Counts(train, (again > 0)[o.at], deleted)


def _short_counts(read, c: Chunk, t: Tokens) -> list[Counts]:
    """Of the unigrams and bigrams of a chunk."""
    got = read(c.name)
    return [_looked_up(own_keys(keys, t.fold), [got[k] for k in sorted(got) if k % 2 == kind]) for kind, keys in enumerate((t.token, t.pair))]


def _open(t: Tokens, pairs: Counts) -> np.ndarray:
    """Where a trigram may occur again: both its bigrams do."""
    out = pairs.again & _shifted(pairs.again, t.first, False)
    out[t.first] = False
    return out


def _ask_triples(read, buckets: int):
    def ask(c: Chunk):
        t = tokens(c)
        go = _open(t, _short_counts(read, c, t)[1])
        return _bodies(own_keys(t.triple[go], t.fold[go]), buckets)

    return ask


def _triples(read, c: Chunk, t: Tokens, pairs: Counts) -> Counts:
    """Of the trigrams of a chunk; a row's first token has its bigram's counts."""
    once = t.fold != HELD_OUT
    out = Counts(once.astype(np.int64), pairs.again, [(t.fold == f).astype(np.int64) for f in DELETED])
    go = _open(t, pairs)
    if go.any():
        got = read(c.name)
        asked = _looked_up(own_keys(t.triple[go], t.fold[go]), [got[k] for k in sorted(got)])
        out.train[go] = asked.train
        for mine, found in zip(out.deleted, asked.deleted, strict=True):
            mine[go] = found
    out.train[t.first] = pairs.train[t.first]
    for mine, found in zip(out.deleted, pairs.deleted, strict=True):
        mine[t.first] = found[t.first]
    return out


def _ratio(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    return np.where(np.asarray(b) > 0, a / np.maximum(b, 1), 0.0)


def octave(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(count + 1.0)).astype(np.int64), OCTAVES - 1)


def estimates(t: Tokens, uni: np.ndarray, bi: np.ndarray, tri: np.ndarray, total: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The context bucket of each token, and its maximum-likelihood estimates by trigram, bigram and unigram from these counts.

    The begin of a row was seen as often as the end, which is the last token of every chunk; deleted counts of ends must
    be taken off before.
    """
    texts = uni[-1] if len(uni) else 0
    one, two = _shifted(uni, t.first, texts), _shifted(bi, t.first, texts)
    return np.where(two > 0, OCTAVES + octave(two), octave(one)), [_ratio(tri, two), _ratio(bi, one), _ratio(uni, total)]


def grid(p: np.ndarray) -> np.ndarray:
    """The grid place of an estimate: 0 for 0, else one more than its octaves below 1 in steps, up to the last place."""
    return np.where(p > 0, 1 + np.clip(np.round(-STEPS * np.log2(np.maximum(p, 1e-300))), 0, PLACES - 2), 0).astype(np.int64)


def value(place: np.ndarray) -> np.ndarray:
    return np.where(place > 0, 2.0 ** ((1.0 - place) / STEPS), 0.0)


def learn_weights(rows: list[tuple[int, int, int, int, int, int]], uniform: list[float], rounds: int = ROUNDS) -> np.ndarray:
    """Weights (trigram, bigram, unigram, uniform) of each context bucket by EM; rows: (deleted fold's number, bucket, grid places of the three estimates, count)."""
    out = np.tile(np.array(START), (2 * OCTAVES, 1))
    if not rows:
        return out
    x = np.array(rows, np.int64)
    p = np.stack([*(value(x[:, i]) for i in (2, 3, 4)), np.array(uniform)[x[:, 0]]], 1)
    for b in np.unique(x[:, 1]):
        mine = x[:, 1] == b
        w, q, n = out[b].copy(), p[mine], x[mine, 5].astype(np.float64)
        for _ in range(rounds):
            share = w * q
            w = np.maximum((share / share.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum(), LEAST)
            w /= w.sum()
        out[b] = w
    return out


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): the contract's columns."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    buckets = n_buckets(docs)
    short = Answers(reduce(request(docs, _ask(buckets)), _answer), "lm")
    read = short.reader()
    sums = short.totals.where(F.element_at("total", 1) == 0).agg(*(F.coalesce(F.sum(F.element_at("total", i)), F.lit(0)) for i in range(2, 4 + 2 * len(DELETED)))).first()
    (distinct, total), *rest = ((int(sums[i]), int(sums[i + 1])) for i in range(0, len(sums), 2))
    read_triples = Answers(reduce(request(docs, _ask_triples(read, buckets)), _answer), "lm-triples").reader()

    def predict(batches):
        for b in batches:
            for c in chunks(b):
                t = tokens(c)
                if not np.isin(t.fold, DELETED).any():
                    continue
                uni, bi = _short_counts(read, c, t)
                tri = _triples(read_triples, c, t, bi)
                keys = []
                for k, f in enumerate(DELETED):
                    mine = t.fold == f
                    if mine.any():
                        # The deleted counts are right within the fold, so its rows are looked at by themselves.
                        first = np.searchsorted(np.flatnonzero(mine), t.first[mine[t.first]])
                        own = Tokens(t.token[mine], t.pair[mine], t.triple[mine], first, t.fold[mine])
                        bucket, p = estimates(own, *(x.train[mine] - x.deleted[k][mine] for x in (uni, bi, tri)), rest[k][1])
                        key = k * 2 * OCTAVES + bucket
                        for x in p:
                            key = key * PLACES + grid(x)
                        keys.append(key)
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    # Cells of a fixed grid, whatever the corpus: estimates of a bucket lie in few of its places.
    cells = docs.mapInArrow(predict, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    place = lambda key, i: key // PLACES**i % PLACES
    rows = [(*divmod(r["key"] // PLACES**3, 2 * OCTAVES), place(r["key"], 2), place(r["key"], 1), place(r["key"], 0), r["n"]) for r in cells]
    weights = learn_weights(rows, [1 / (v + 1) for v, _ in rest])

    def run(batches):
        for b in batches:
            for c in chunks(b):
                t = tokens(c)
                uni, bi = _short_counts(read, c, t)
                bucket, p = estimates(t, uni.train, bi.train, _triples(read_triples, c, t, bi).train, total)
                w = weights[bucket]
                chance = sum(w[:, k] * x for k, x in enumerate(p)) + w[:, 3] / (distinct + 1)
                base = np.log10((uni.train + 1) / (total + distinct + 1))
                at = t.first
                n = np.diff(np.append(at, len(t.token)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.ids, pa.int64()), pa.array(t.fold[at] == HELD_OUT), pa.array(n), pa.array(np.add.reduceat((uni.train > 0).astype(np.int64), at)), pa.array(np.full(len(n), total)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(chance), at))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return docs.mapInArrow(run, RESULT)


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))

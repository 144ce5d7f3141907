"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding undoes disguises: lower case, accents, look-alike letters of other scripts, full-width forms, zero-width
characters, and digits or signs that stand for letters. A term is a whole word or a word stem, and weighs the log-odds
with which it marks toxic texts. Hits inside an exception phrase don't count. The sum of the weights by 100 words is
turned into a score by a logistic curve.

Weights and curve are learned from labels: a seed lexicon is joined by words and stems that labelled texts show to be
toxic. Learning takes at most SAMPLE labelled rows, those of least hash; the term counts over them are made in parallel
and only terms with enough evidence reach the driver, all of them: LEAST_TEXTS groups of texts each.

Defined results: null and empty texts have no hits and get the score of a clean text; a null doc_id counts as not held
out for reporting and never carries a label; labels that are null are skipped, several labels of a doc_id each count;
with no labels at all the seed lexicon and its curve apply; an empty table gives an empty result; repeated rows are
scored each. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import crc_mod, free_name, materialize, release, table

HELD_OUT_OF, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Bound of the labelled rows that are learned from.
SAMPLE = 40_000
#: Terms whose counts a task holds before it hands them on.
HELD_TERMS = 150_000
#: Fewest different groups of texts with a learned term, its least share of toxic texts, and the lengths of stems.
LEAST_TEXTS, LEAST_SHARE, STEMS = 5, 0.8, (4, 5, 6, 7, 8, 9)
#: Seed terms (fixed values), and the weight that they have unless labels speak against it.
SEED = ("idiot", "moron", "stupid", "scum", "trash", "worthless", "pathetic", "loser", "clown", "disgusting", "imbecile", "vermin", "filth", "degenerate")
SEED_WEIGHT = 3.0
#: Phrases in which a term is meant otherwise (fixed values).
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "trash bag", "trash collection", "class clown", "sore loser")
#: The curve before any labels: bias, and factors of log(1 + weight by 100 words) and of a hit.
CURVE = (-3.0, 1.0, 2.0)

#: Letters of other scripts and the Latin letter that each looks like (fixed values).
_LOOKALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ь": "b", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "г": "r", "п": "n", "и": "u",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}
#: Digits and signs that stand for letters; l, i and 1 are one letter to the fold.
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "l": "i", "!": "i", "|": "i"}


def _fold_table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for code in [*range(0x80, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)).lower() if not unicodedata.combining(c))
        out[code] = "".join(_LOOKALIKE.get(c, c) for c in plain)
    for code in [*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF]:
        out[code] = None
    for c, to in _STANDS_FOR.items():
        out[ord(c)] = to
    return {k: v if v is None else "".join(_STANDS_FOR.get(c, c) for c in v) for k, v in out.items()}


_FOLD = _fold_table()
#: Signs stand for letters only before a letter or digit: "moron!" ends with a sign, "!diot" starts with a letter.
_SIGNS = "@$!|"


def fold(text: str) -> str:
    low = text.lower()
    if any(s in low for s in _SIGNS):
        chars = list(low)
        for i, c in enumerate(chars):
            if c in _SIGNS and not (i + 1 < len(chars) and chars[i + 1].isalnum()):
                chars[i] = " "
        low = "".join(chars)
    return low.translate(_FOLD)


@dataclass
class Model:
    """words and stems: folded term to weight; curve: of the score."""

    words: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = CURVE

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        terms: dict[str, tuple[float | None, float | None, bool]] = {}
        for t, w in self.words.items():
            terms[t] = (w, None, False)
        for t, w in self.stems.items():
            terms[t] = (terms.get(t, (None,))[0], w, False)
        for t in map(fold, self.exceptions):
            terms[t] = (*terms.get(t, (None, None))[:2], True)
        for t, x in terms.items():
            a.add_word(t, (len(t), *x))
        if terms:
            a.make_automaton()
        return a


def features(a: ahocorasick.Automaton, text: str | None) -> tuple[float, float]:
    """(log(1 + weight by 100 words), 1 if there is a hit)."""
    if not text or not len(a):
        return 0.0, 0.0
    t = fold(text)
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, word, stem, spare) in a.iter(t):
        start = end - n + 1
        if start and t[start - 1].isalpha():
            continue
        closed = end + 1 == len(t) or not t[end + 1].isalpha()
        if spare and closed:
            spared.append((start, end))
        w = max(stem if stem is not None else 0.0, word if word is not None and closed else 0.0)
        if w > best.get(start, 0.0):
            best[start] = w
    for s, e in spared:
        for start in [x for x in best if s <= x <= e]:
            del best[start]
    if not best:
        return 0.0, 0.0
    return math.log1p(100 * sum(best.values()) / max(1, len(text.split()))), 1.0


def terms_of(text: str) -> tuple[set[str], set[str], int]:
    """Words, stems and the group of a text: near copies mostly fall into one of 64 groups, by the least hash of a word."""
    words = {w for w in "".join(c if c.isalpha() else " " for c in fold(text)).split() if len(w) >= 3}
    stems = {w[:n] for w in words for n in STEMS if len(w) >= n}
    return words, stems, min((zlib.crc32(w.encode()) for w in words), default=0) * 2654435761 % (1 << 32) >> 26


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Learns a model from the rows of ``labels`` (doc_id, toxic) outside of the held-out fold."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", HELD_OUT_OF) != HELD_OUT)).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    rows = rows.orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(SAMPLE)
    # SAMPLE rows of two numbers: a bounded broadcast.
    known = docs.select(F.col(id_column).alias("_key"), F.col(text_column).alias("_text")).join(F.broadcast(rows), F.col("_key") == F.col("_id")).select("_text", "_toxic")
    known = materialize(known.where("_text is not null"), "toxic-labelled")

    def count(batches):
        seen: dict[tuple[bool, str], list[int]] = defaultdict(lambda: [0, 0, 0])
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words, stems, group = terms_of(text)
                for stem, terms in ((False, words), (True, stems)):
                    for t in terms:
                        x = seen[stem, t]
                        x[toxic > 0] += 1
                        if toxic > 0:
                            x[2] |= 1 << group
                if len(seen) >= HELD_TERMS:
                    yield counted(seen)
                    seen.clear()
        yield counted(seen)
        seen.clear()
        release()

    def counted(seen):
        keys = list(seen)
        part = np.array([seen[k] for k in keys], np.uint64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.string()), *(pa.array(part[:, i].view(np.int64) if i == 2 else part[:, i].astype(np.int64)) for i in range(3))], ["stem", "term", "clean", "toxic", "groups"])

    sizes = known.groupBy((F.col("_toxic") > 0).alias("t")).count().collect()
    toxic_texts = sum(r["count"] for r in sizes if r["t"])
    clean_texts = sum(r["count"] for r in sizes if not r["t"])
    words = {fold(w): SEED_WEIGHT for w in SEED}
    stems: dict[str, float] = {}
    if not toxic_texts or not clean_texts:
        return Model(words)
    counts = known.mapInArrow(count, "stem boolean, term string, clean long, toxic long, groups long").groupBy("stem", "term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_count(F.bit_or("groups")).alias("groups"))
    weight = F.log((F.col("toxic") + 0.5) / (toxic_texts + 1.0)) - F.log((F.col("clean") + 0.5) / (clean_texts + 1.0))
    good = (F.col("groups") >= LEAST_TEXTS) & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("clean"))) & (weight > 0)
    against = F.col("term").isin(list(words)) & ~F.col("stem") & (F.col("clean") > F.col("toxic"))
    # Terms with the evidence of LEAST_TEXTS groups of at most SAMPLE texts: a bounded list, sorted here for reruns to agree.
    for r in sorted(counts.withColumn("weight", weight).where(good | against).collect(), key=lambda r: (r["term"], r["stem"])):
        if r["clean"] > r["toxic"]:
            words.pop(r["term"], None)
        else:
            (stems if r["stem"] else words)[r["term"]] = r["weight"]
    model = Model(words, stems)

    def measure(batches):
        a = model.automaton()
        for b in batches:
            x = [features(a, t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in x], pa.float64()), pa.array([f[1] for f in x], pa.float64()), b.column(1).cast(pa.int32())], ["x", "hit", "toxic"])
        release()

    # At most SAMPLE rows of three numbers, and grouped further.
    got = known.mapInArrow(measure, "x double, hit double, toxic int").groupBy(F.round("x", 2).alias("x"), "hit", (F.col("toxic") > 0).alias("y")).count().orderBy("x", "hit", "y").collect()
    return Model(words, stems, curve=fit([(r["x"], r["hit"], r["y"], r["count"]) for r in got]))


def fit(rows: list[tuple[float, float, bool, int]]) -> tuple[float, float, float]:
    """Logistic regression with a ridge, by Newton's method."""
    x = np.array([[1.0, r[0], r[1]] for r in rows])
    y, n = np.array([float(r[2]) for r in rows]), np.array([float(r[3]) for r in rows])
    beta, ridge = np.array(CURVE), np.diag([1e-3, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge, x.T @ (n * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, beta))


def score(docs: DataFrame, model: Model, text_column: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the toxicity of each whole text, from 0 to 1."""
    at = docs.columns.index(text_column)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        a, (b0, b1, b2) = model.automaton(), model.curve
        for b in batches:
            out = []
            for t in b.column(at):
                x, hit = features(a, t.as_py())
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, b0 + b1 * x + b2 * hit)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, name])
        release()

    return docs.mapInArrow(run, schema)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str, name: str = "score") -> DataFrame:
    return score(docs, learn(docs, table(spark, sf_dir, "labels")), name=name)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    name = free_name(docs, "_toxicity")
    return toxicity(spark, docs, sf_dir, name).where(F.col(name) < THRESHOLD).drop(name)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = toxicity(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
    held = F.coalesce(crc_mod("doc_id", HELD_OUT_OF) == HELD_OUT, F.lit(False))
    return d.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Quality rules and mixing."""

import random

import numpy as np
import pytest
from helpers import base_quality, empty_frame, odd_frame, plain_mix, targets, words, write_folder

from gridloom.llm import mixing, quality

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def em(patterns, rounds):
    """The label model in NumPy."""
    v, n = np.array([p[0] for p in patterns]), np.array([p[1] for p in patterns], float)
    prior, acc = quality.PRIOR, np.full(v.shape[1], quality.ACCURACY)
    for _ in range(rounds + 1):
        good = np.log(prior) + (np.where(v == 1, np.log(acc), 0) + np.where(v == -1, np.log(1 - acc), 0)).sum(1)
        bad = np.log(1 - prior) + (np.where(v == -1, np.log(acc), 0) + np.where(v == 1, np.log(1 - acc), 0)).sum(1)
        p = 1 / (1 + np.exp(bad - good))
        last = p
        hits = (n[:, None] * np.where(v == 1, p[:, None], np.where(v == -1, 1 - p[:, None], 0))).sum(0)
        cast = (n[:, None] * (v != 0)).sum(0)
        acc = np.clip((hits + quality.WEIGHT * quality.ACCURACY) / (cast + quality.WEIGHT), quality.LEAST, quality.MOST)
        prior = np.clip(((n * p).sum() + quality.WEIGHT * quality.PRIOR) / (n.sum() + quality.WEIGHT), 1 - quality.MOST, quality.MOST)
    return last


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_base_columns(request, which):
    df = request.getfixturevalue(which)
    got = sorted(repr((r["doc_id"], *(r[c] for c in COLUMNS))) for r in quality.quality(df).collect())
    assert got == sorted(repr((r["doc_id"], *base_quality(r["text"]))) for r in df.collect())


def test_label_model(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(600):
        y = 1 if rng.random() < 0.7 else -1
        rows.append(([0 if rng.random() < 0.3 else y if rng.random() < a else -y for a in (0.9, 0.8, 0.7, 0.55)],))
    got = {tuple(r["votes"]): r["p"] for r in quality.label_model(spark.createDataFrame(rows, "votes array<int>"), 4).collect()}
    patterns = {}
    for (v,) in rows:
        patterns[tuple(v)] = patterns.get(tuple(v), 0) + 1
    keys = sorted(patterns)
    want = em([(k, patterns[k]) for k in keys], quality.ROUNDS)
    assert [got[k] for k in keys] == pytest.approx(list(want), abs=1e-9)


def test_quality_edges(spark):
    assert quality.quality(empty_frame(spark)).count() == 0
    clash = quality.quality(odd_frame(spark, clash=True))
    assert clash.count() == odd_frame(spark).count()
    assert all(not r["kept"] for r in clash.collect() if r["base_failed"])


def test_quality_is_native(spark, docs):
    plan = quality.quality(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_mixing(request, which):
    df = request.getfixturevalue(which)
    rows = mixing.mix(df).collect()
    texts = df.select("doc_id", "source", "text").collect()
    assert sorted(repr((r["doc_id"], r["source"], r["size"])) for r in rows) == sorted(repr((r["doc_id"], r["source"], len(words(r["text"])))) for r in texts)
    sizes, taken, most = {}, {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        k = r["source"]
        sizes[k] = sizes.get(k, 0) + r["size"]
        taken[k] = taken.get(k, 0) + r["taken"]
        most[k] = max(most.get(k, 0), r["size"])
    want = targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
    # the sum of taken words ends within the larger of two documents at the cut
    assert all(abs(taken[k] - want[k]) <= most[k] for k in sizes)
    plain = [(r["doc_id"], r["text"], r["source"]) for r in texts]
    assert sorted(repr((r["doc_id"], r["size"], r["copies"])) for r in rows) == sorted(repr((d, len(words(t)), c)) for (d, t, _), c in zip(plain, plain_mix(plain), strict=True))
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_pareto_inclusion(spark):
    """Over many draws, documents are included about as often as their expectation says, shorter ones half as often."""
    rows = [(i, " ".join(["w"] * (20 if i % 2 else 160)), None, "ab"[i % 7 == 0]) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = [r for r in mixing.mix(df).collect() if r["source"] == "a"]
    e = {s: sum(r["copies"] for r in got if r["size"] == s) / sum(1 for r in got if r["size"] == s) for s in (20, 160)}
    assert e[20] == pytest.approx(e[160] / 2, rel=0.15)


def test_mixing_edges(spark, tmp_path):
    assert mixing.mix(empty_frame(spark)).count() == 0
    clash = odd_frame(spark, clash=True)
    out = mixing.stage(spark, clash, "")
    assert out.columns == clash.columns
    copies = sum(r["copies"] for r in mixing.mix(clash).collect())
    assert out.count() == copies and {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in clash.collect()}
    assert mixing.stage(spark, empty_frame(spark), "").count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string")
    assert [r["taken"] for r in mixing.mix(nothing).collect()] == [0, 0]


def test_queries_run(spark, tmp_path):
    folder = write_folder(spark, tmp_path, odd_frame(spark))
    assert mixing.op2_mixing(spark, folder).columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert quality.op1_quality(spark, folder).count() == odd_frame(spark).count()


def test_mixing_is_native(spark, docs):
    for df in (mixing.mix(docs), mixing.shares(mixing.decide(docs)[0]), mixing.stage(spark, docs, "")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


@pytest.mark.parametrize("ids", ["null", "third null"])
def test_mixing_of_ties(spark, ids):
    """Rows without an id of their own are drawn one by one: every source comes within a document of its target."""
    name = {"null": lambda i: None, "third null": lambda i: None if i % 3 == 0 else i % 50}[ids]
    rows = [(name(i), " ".join(["w"] * 100), "abc"[i % 3 if i % 2 else 0]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    want, got = targets({s: 100 * sum(r[2] == s for r in rows) for s in "abc"}), dict.fromkeys("abc", 0)
    for r in mixing.mix(df).collect():
        got[r["source"]] += r["taken"]
    assert all(abs(got[s] - want[s]) <= 100 for s in "abc")
    staged = mixing.stage(spark, df, "")
    assert {s: 100 * staged.where(f"source = '{s}'").count() for s in "abc"} == got
    assert sorted(plain_mix([r for r in rows])) == sorted(r["copies"] for r in mixing.mix(df).collect())

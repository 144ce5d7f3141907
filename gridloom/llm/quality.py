"""Quality rules by weak supervision, in DataFrame operations only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation estimates the accuracy of
each rule and the share of good documents from the votes alone, and a document is kept on its posterior probability of
being good. Documents with equal votes are alike to the model, so EM runs over the vote patterns with their counts
(3**rules of them at most, whatever the input's size) as one expression of higher-order functions.

Defined results: a null or empty text has no words and fails the base; a rule abstains where it has nothing to judge;
repeated rows count each; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, materialize, table

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Rounds of EM, the posterior that keeps a document, and the first share of good documents and accuracy of a rule, with their weight in documents.
ROUNDS, KEEP, PRIOR, ACCURACY, WEIGHT = 25, 0.5, 0.5, 0.8, 10.0
#: Bounds of an accuracy: a rule is never worse than chance, so good and bad can't swap; and never certain.
LEAST, MOST = 0.5, 0.995
#: Frequent short words of the corpus' languages (fixed values).
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "der", "die", "das", "und", "den", "von", "de", "la", "le", "les", "des", "et", "en", "un", "el", "que", "los", "las", "por", "y"]
RULES = ("length", "symbols", "repeats", "duplicate_lines", "capitals", "digits", "stop_words", "sentences")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def base_columns(text: str = "text") -> Column:
    """A struct of the base statistics of a text, and of what else the rules look at."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))

    def repeats(w: Column) -> Column:
        n = F.size(w)
        # 64-bit hashes of the 3-word windows with their places, sorted: equal windows are neighbours.
        windows = F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

        def covered(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)))
            starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
            # A window covers three words, less those that the one before it has covered.
            return F.aggregate(starts, F.struct(F.lit(-3).alias("p"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("p"), (a["n"] + F.least(F.lit(3), i - a["p"])).alias("n")))["n"]

        return let(F.sort_array(windows), covered)

    def of(w: Column) -> Column:
        return let(
            lines,
            lambda x: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                F.when(F.size(w) < 3, 0).otherwise(repeats(w)).cast("long").alias("n_repeat_words"),
                F.size(x).cast("long").alias("n_lines"),
                F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
                F.regexp_count(t, F.lit(r"[0-9]")).cast("long").alias("n_digits"),
                F.size(F.filter(w, lambda y: F.lower(F.rtrim(y, F.lit(".,"))).isin(STOP_WORDS))).cast("long").alias("n_stops"),
                F.regexp_count(t, F.lit(r"[.,;:?!]+(?=[\x20\x09-\x0D]|\z)")).cast("long").alias("n_stopped"),
            ),
        )

    return let(words, of)


def votes() -> list[Column]:
    """A vote per rule, in the order of RULES."""
    n, c = F.col("n_words"), F.col("word_chars")

    def vote(bad: Column, good: Column | None = None) -> Column:
        v = F.when(n == 0, 0).when(bad, -1)
        return (v if good is None else v.when(good, 1)).otherwise(0)

    # The absence of a fault is no sign of quality: most rules vote bad or abstain.
    return [
        vote(n < MIN_WORDS),
        vote(10 * F.col("n_symbols") > n),
        vote(100 * F.col("n_repeat_words") > 40 * n),
        vote(10 * F.col("n_dup_lines") > 5 * F.col("n_lines")),
        vote(10 * F.col("n_upper") > 3 * c),
        vote(10 * F.col("n_digits") > 2 * c),
        vote((100 * F.col("n_stops") < 2 * n) & (n >= 30), 100 * F.col("n_stops") >= 6 * n),
        vote((100 * F.col("n_stopped") < 5 * n) & (n >= 30) | (10 * F.col("n_stopped") > 6 * n), (100 * F.col("n_stopped") >= 8 * n) & (10 * F.col("n_stopped") <= 4 * n)),
    ]


def posterior(patterns: Column, n_rules: int, rounds: int = ROUNDS) -> Column:
    """Learns from an array of (votes, n) and returns an array of (votes, p): the posterior of each pattern."""

    def chance(st: Column, v: Column) -> Column:
        def side(right: int) -> Column:
            return F.aggregate(F.zip_with(v, st["acc"], lambda x, a: F.when(x == right, F.log(a)).when(x == -right, F.log(1 - a)).otherwise(0.0)), F.log(st["prior"] if right == 1 else 1 - st["prior"]), lambda s, x: s + x)

        return 1 / (1 + F.exp(side(-1) - side(1)))

    def scored(st: Column) -> Column:
        return F.transform(patterns, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), chance(st, p["votes"]).alias("p")))

    def total(q: Column, f) -> Column:
        return F.aggregate(q, F.lit(0.0), lambda s, p: s + f(p))

    def learn(q: Column) -> Column:
        def accuracy(j: Column) -> Column:
            hits = total(q, lambda p: p["n"] * F.when(F.get(p["votes"], j) == 1, p["p"]).when(F.get(p["votes"], j) == -1, 1 - p["p"]).otherwise(0.0))
            cast = total(q, lambda p: F.when(F.get(p["votes"], j) != 0, p["n"]).otherwise(0.0))
            return F.least(F.lit(MOST), F.greatest(F.lit(LEAST), (hits + WEIGHT * ACCURACY) / (cast + WEIGHT)))

        prior = (total(q, lambda p: p["n"] * p["p"]) + WEIGHT * PRIOR) / (total(q, lambda p: p["n"]) + WEIGHT)
        return F.struct(F.least(F.lit(MOST), F.greatest(F.lit(1 - MOST), prior)).alias("prior"), F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), accuracy).alias("acc"))

    start = F.struct(F.lit(PRIOR).alias("prior"), F.array_repeat(F.lit(ACCURACY), n_rules).alias("acc"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda st, _: let(scored(st), learn))
    return let(end, scored)


def label_model(voted: DataFrame, n_rules: int, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, p): the posterior of each vote pattern of ``voted``, which has an array column ``votes``; at most 3**n_rules rows."""
    counts = voted.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = counts.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("pairs"))
    return pairs.select(F.explode(posterior(F.col("pairs"), n_rules, rounds)).alias("x")).select("x.votes", F.col("x.p").alias("p"))


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: the base statistics, base_failed, the votes, the posterior and kept."""
    base = docs.select("doc_id", base_columns().alias("s")).select("doc_id", "s.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    voted = materialize(base.withColumn("base_failed", failed).withColumn("votes", F.array(*[v.cast("int") for v in votes()])), "quality")
    model = label_model(voted, len(RULES))
    # At most 3**8 patterns of eight small integers: a bounded broadcast.
    out = voted.join(F.broadcast(model), "votes", "left")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p") >= KEEP))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p", 6).alias("posterior"))

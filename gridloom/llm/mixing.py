"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source is to supply a target number of words. Every document gets the expected number of copies
``e = share of its tier's target / size of its tier``: ``floor(e)`` copies are certain, and one more is drawn with
inclusion probability ``e - floor(e)`` by Pareto order sampling: documents are ranked by random odds divided by
inclusion odds, and the first ones are taken until the words left to the source are used up. Tiers give documents of
one source unequal expectations in proportion to their importance.

The rank is a total order over a source, yet no task ever holds a source: the rank axis is cut into a fixed number of
intervals, words are summed by (source, interval), and only the one interval that holds the cut is ranked row by row.

Defined results: a null source is one source, last in order; a null or empty text has size 0 and is never taken;
repeated and null doc_ids are rows of their own: rows of one source, doc_id and size are told apart by the number of the
row among them (``numbered``), which goes into the rank, so they are drawn one by one; ties of rank fall to the smaller
doc_id, size and number; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, materialize, table

#: Weights of the sources in code-point order, repeating; their common share of all words; and the most copies.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Importance of documents with fewer words than this, against 1 for longer ones.
TIERS = ((20, 0.25), (50, 0.5), (100, 0.75))
#: Rows up to which a table by source is broadcast.
BROADCAST_ROWS = 100_000
#: Intervals of the rank axis: the ranked interval holds about 1 / INTERVALS of a source.
INTERVALS, SEED = 1 << 14, "mix-1"


def water_fill(df: DataFrame, group: list[str], total: Column, weight: str, cap: str, order: list[Column]) -> DataFrame:
    """Adds ``target``: ``total`` of each group shared by ``weight``, stopping at ``cap``, the excess reshared until none is above.

    The fixed point of the resharing is min(cap, level * weight); rows are taken by cap / weight, and the level is the
    first that no further cap is below. The rows are per-source aggregates, never documents.
    """
    key = group or [F.lit(0)]
    up = Window.partitionBy(*key).orderBy(F.col("_ratio"), *order)
    prior = up.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*key)
    d = df.withColumn("_ratio", F.when(F.col(weight) > 0, F.col(cap) / F.col(weight)).otherwise(0.0))
    d = d.withColumns({"_capped": F.coalesce(F.sum(cap).over(prior), F.lit(0.0)), "_spent": F.coalesce(F.sum(weight).over(prior), F.lit(0.0)), "_all": F.sum(weight).over(every), "_total": total})
    d = d.withColumn("_level", F.when(F.col("_all") > F.col("_spent"), (F.col("_total") - F.col("_capped")) / (F.col("_all") - F.col("_spent"))))
    d = d.withColumn("_final", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct(F.col("_ratio"), F.col("_level")))).over(every))
    target = F.when(F.col("_final").isNull(), F.col(cap)).otherwise(F.least(F.col(cap), F.col("_final._level") * F.col(weight)))
    return d.withColumn("target", target).drop("_ratio", "_capped", "_spent", "_all", "_total", "_level", "_final")


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys only: 48 bits of their MD5."""
    text = F.concat_ws("|", F.lit(SEED), *keys)
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 48)


def sizes(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tier_of(size: Column) -> Column:
    return F.coalesce(*(F.when(size < words, importance) for words, importance in TIERS), F.lit(1.0))


def by_source(df: DataFrame) -> DataFrame:
    """A written table of some rows for each source, for a join: by broadcast while it is small, else by shuffle, in which AQE splits hot sources."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def numbered(sized: DataFrame) -> DataFrame:
    """``sized`` (uid, doc_id, source, size) with ``num``, the number of each row among those equal in source, doc_id and size, from 0.

    Rows are numbered within each partition that they were read from, and the counts of the partitions before are added, so
    no task sorts all rows of one key.
    """
    key = ["source", "doc_id", "size"]
    if sized.where("size > 0").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return sized.withColumn("num", F.lit(0).cast("long"))
    rows = sized.withColumn("part", F.shiftright("uid", 33))
    rows = rows.withColumn("within", F.row_number().over(Window.partitionBy(*key, "part").orderBy("uid")) - 1)
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in (*key, "part")]
    return rows.alias("r").join(parts.alias("p"), reduce(lambda a, b: a & b, same)).select("r.uid", "r.doc_id", "r.source", "r.size", (F.col("r.within") + F.col("p.before")).cast("long").alias("num"))


def shares(sized: DataFrame) -> DataFrame:
    """A row for each source and tier of ``sized`` (doc_id, source, size): source_size, target of the source, certain copies and inclusion probability."""
    tiers = sized.groupBy("source", tier_of(F.col("size")).alias("tier")).agg(F.sum("size").cast("double").alias("tier_size"))
    # The windows below run over a row per source or tier, never over documents.
    sources = tiers.groupBy("source").agg(F.sum("tier_size").alias("source_size"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = reduce(lambda c, k: c.when(F.col("_place") % len(WEIGHTS) == k, WEIGHTS[k]), range(1, len(WEIGHTS)), F.when(F.col("_place") % len(WEIGHTS) == 0, WEIGHTS[0]))
    sources = sources.withColumn("_place", place).withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    everything = SHARE * F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    sources = water_fill(sources, [], everything, "weight", "cap", [F.col("_place")]).select("source", "source_size", F.col("target").alias("source_target"))
    plan = tiers.alias("t").join(sources.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select("t.source", "tier", "tier_size", "source_size", "source_target")
    plan = plan.withColumns({"tier_weight": F.col("tier") * F.col("tier_size"), "tier_cap": MOST * F.col("tier_size")})
    plan = water_fill(plan, ["source"], F.col("source_target"), "tier_weight", "tier_cap", [F.col("tier")])
    copies = F.when(F.col("tier_size") > 0, F.least(F.col("target") / F.col("tier_size"), F.lit(MOST))).otherwise(0.0)
    plan = plan.select("source", "tier", F.col("source_size").cast("long").alias("source_size"), F.col("source_target").alias("target"), F.floor(copies).alias("whole"), (copies - F.floor(copies)).alias("pi"), "tier_size")
    # The largest inclusion odds of a source scale its ranks, so that the ranks of its main tier spread evenly.
    odds = F.when((F.col("pi") > 0) & (F.col("pi") < 1), F.col("pi") / (1 - F.col("pi")))
    return plan.withColumn("scale", F.coalesce(F.max(odds).over(Window.partitionBy("source")), F.lit(1.0)))


def rank_of(doc_id: str, size: Column, num: Column, pi: Column) -> Column:
    """Random odds by inclusion odds; null for what can't be drawn."""
    u = uniform(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), size.cast("string"), num.cast("string"))
    return F.when((pi > 0) & (size > 0), (u / (1 - u)) / (pi / (1 - pi)))


def cuts(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, last, first): the last (rank, doc_id, size, num) in the rank order of a source that is drawn; a source with nothing to draw or to leave has no row."""
    left = plan.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("tier_size"))).alias("open"))
    d = with_plan(sized, plan, "source", F.col("size")).select("doc_id", "source", "size", "num", rank_of("doc_id", F.col("size"), F.col("num"), F.col("pi")).alias("rank"), "scale").where("rank is not null")
    # x / (1 + x) maps ranks to (0, 1) in their order; equal steps of it are the intervals.
    x = F.col("rank") * F.col("scale")
    d = d.withColumn("interval", F.floor(x / (1 + x) * INTERVALS).cast("int")).drop("scale")
    sums = d.groupBy("source", "interval").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("interval").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # INTERVALS rows per source at most; one of them holds the cut.
    cut = sums.withColumn("before", before).alias("a").join(left.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "interval", "words", "before", "open")
    cut = materialize(cut.where((F.col("before") <= F.col("open")) & (F.col("open") < F.col("before") + F.col("words"))), "mix-intervals")
    edge = d.alias("d").join(by_source(cut).alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.interval") == F.col("c.interval"))).select("d.source", "doc_id", "size", "num", "rank", "before", "open")
    run = Window.partitionBy("source").orderBy("rank", "doc_id", "size", "num").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = F.col("before") + F.sum("size").over(run)
    # A document is in while the middle of its words lies under what is open: the sum ends at the nearest place.
    drawn = edge.withColumn("in", done - F.col("size") / 2 <= F.col("open"))
    key = F.struct("rank", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "size", "num")
    # If none of the interval is drawn, the cut lies just under it.
    return drawn.groupBy("source").agg(F.max(F.when(F.col("in"), key)).alias("last"), F.min(key).alias("first")).select("source", "last", "first")


def with_plan(docs: DataFrame, plan: DataFrame, source: str, size: Column) -> DataFrame:
    """``docs`` with the plan's columns of each row's source and tier."""
    p = plan.toDF(*("_p_" + c for c in plan.columns))
    out = docs.join(by_source(p), F.col(source).eqNullSafe(F.col("_p_source")) & (tier_of(size) == F.col("_p_tier")))
    return out.withColumnsRenamed({"_p_" + c: c for c in plan.columns if c not in ("source", "tier")}).drop("_p_source", "_p_tier")


def copies_of(docs: DataFrame, plan: DataFrame, edges: DataFrame, doc_id: str, source: str, size: str, num: str) -> DataFrame:
    """``docs`` with source_size, target and copies: certain copies, and one more up to the cut of its source."""
    d = with_plan(docs, plan, source, F.col(size)).drop("tier_size", "scale")
    e = edges.toDF("_e_source", "_e_last", "_e_first")
    d = d.join(by_source(e), F.col(source).eqNullSafe(F.col("_e_source")), "left")
    rank = rank_of(doc_id, F.col(size), F.col(num), F.col("pi"))
    key = F.struct(rank.alias("rank"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col(size).alias("size"), F.col(num).alias("num"))
    extra = F.when(rank.isNull(), 0).when(F.col("_e_source").isNull(), 1).when(F.col("_e_last").isNotNull(), (key <= F.col("_e_last")).cast("int")).otherwise((key < F.col("_e_first")).cast("int"))
    return d.withColumn("copies", F.when(F.col(size) > 0, (F.col("whole") + extra).cast("long")).otherwise(F.lit(0).cast("long"))).drop("whole", "pi", "_e_source", "_e_last", "_e_first")


def decide(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", uid: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(numbered sizes of the documents, shares, cuts), all in the shared folder."""
    uid = F.monotonically_increasing_id() if uid is None else uid
    sized = materialize(docs.select(uid.alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), sizes(text).alias("size")), "mix-sizes")
    sized = materialize(numbered(sized), "mix-numbers")
    plan = materialize(shares(sized), "mix-shares")
    return sized, plan, materialize(cuts(sized, plan), "mix-cuts")


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target of its source, copies and words taken."""
    sized, plan, edges = decide(docs)
    return copies_of(sized.drop("uid"), plan, edges, "doc_id", "source", "size", "num").drop("num").withColumn("taken", F.col("copies") * F.col("size"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken.

    The decision is a map over documents, so no text is shuffled, unless there are rows equal in source, doc_id and size:
    then the rows are written with an id, by which they meet their numbers.
    """
    names = docs.columns
    flat = docs.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, source, text = (f"c{names.index(n)}" for n in ("doc_id", "source", "text"))
    sized, plan, edges = decide(flat, doc_id, source, text)
    rows = flat.withColumn("_num", F.lit(0).cast("long"))
    if not sized.where("num > 0").isEmpty():
        whole = materialize(flat.withColumn("_uid", F.monotonically_increasing_id()), "mix-rows")
        sized, plan, edges = decide(whole, doc_id, source, text, F.col("_uid"))
        later = sized.where("num > 0").select(F.col("uid").alias("_uid"), "num")
        rows = whole.join(later, "_uid", "left").select(*flat.columns, F.coalesce("num", F.lit(0)).cast("long").alias("_num"))
    taken = copies_of(rows.withColumn("_size", sizes(text)), plan, edges, doc_id, source, "_size", "_num")
    many = taken.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return many.select(*flat.columns).toDF(*names)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")

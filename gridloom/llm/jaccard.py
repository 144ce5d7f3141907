"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Texts are sets of 5-word shingles; two texts are linked if the Jaccard similarity of their sets is 0.8 or more. Number
and size of bands are chosen for a target recall at that similarity. The plan:

1. A map over texts makes, for each, a digest of its set and one hash a band.
2. Texts with equal sets form a class (of copies); from here on a class is one row, whatever its size.
3. Classes are shuffled by band hash, which gives candidate links as stars: each class points to the least class of its
   bucket. Connected components of the stars are candidate clusters; they only deal out the work.
4. Clusters are dealt out as pairs of blocks of about BLOCK classes, which bounds a task's memory for any size of cluster. A
   class goes to a pair of blocks only if it met a class of the other block in a band. Within a pair of blocks, the
   classes that met in a band are compared by their full shingle sets, each pair once however many bands it met in. A
   class gets a row with its count of links, and one that names the least class that it is joined to: no row for a pair.
5. Connected components of those stars are the groups; where a cluster is one pair of blocks, they are so at once.

Shingles are 64-bit hashes. A text with fewer than five words has all of them as its one shingle.

Defined results: null and empty texts have no shingles, form no links, and are groups of their own; repeated rows and
doc_ids count as copies; a null doc_id is a document like others, after all numbers; an empty table gives an empty
result; further columns are ignored by the join, and passed through by the pipeline stage. Rows are known by doc_id and a
64-bit hash of the text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import SHINGLE_WORDS, SIMILARITY, buffers, lookup, materialize, mix, ngram_hashes, release, signed, slices, span_hashes, table, word_spans

RECALL, MOST_HASHES = 0.9999, 128
#: Classes in a block of a cluster: two blocks' shingle sets are in memory at once.
BLOCK = 512
#: Rows of (doc_id, hash) up to which a list of documents is broadcast to the texts; beyond, texts are shuffled to it.
BROADCAST_ROWS = 1_000_000


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds a pair of this similarity with the target recall within ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        if similarity**rows < 1e-9:
            break
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall")
    return best


def shingle_sets(column: pa.Array, n: int = SHINGLE_WORDS):
    """Yields (first row, hashes, starts) of slices of the column: row ``first + i`` has hashes[starts[i]:starts[i + 1]], sorted and distinct."""
    offsets, data = buffers(column)
    for i, j in slices(offsets):
        part = data[offsets[i] : offsets[j]]
        at = offsets[i : j + 1] - offsets[i]
        s, e, rows = word_spans(at, part)
        h, rows = ngram_hashes(span_hashes(part, s, e), rows, n)
        order = np.lexsort((h, rows))
        h, rows = h[order], rows[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        h, rows = h[new], rows[new]
        yield i, h, np.searchsorted(rows, np.arange(j - i + 1))


_SECOND = np.uint64(0x5BF03635DEADBEEF)


def _seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    return r.integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1), r.integers(1, 1 << 63, k, dtype=np.uint64)


#: What stands for a null doc_id: after all numbers.
LAST = (1 << 63) - 1


def doc_key(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))


def signatures(docs: DataFrame, bands: int, rows: int, n: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, hash of the text, size, digest and band hashes of its set) of each text of ``docs`` (doc_id, text)."""

    def run(batches):
        a, b = _seeds(bands * rows)
        for batch in batches:
            k = batch.num_rows
            size, digest, sign = np.zeros(k, np.int64), np.zeros((k, 2), np.uint64), np.zeros((k, bands), np.uint64)
            for i, h, at in shingle_sets(batch.column(2), n):
                count = np.diff(at)
                size[i : i + len(count)] = count
                some = np.flatnonzero(count)
                if not len(some):
                    continue
                first = at[:-1][some]
                digest[i + some, 0] = np.add.reduceat(h, first)
                digest[i + some, 1] = np.add.reduceat(mix(h ^ _SECOND), first)
                for band in range(bands):
                    key = np.full(len(some), band, np.uint64)
                    for r in range(band * rows, (band + 1) * rows):
                        x = h * a[r] + b[r]
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x ^ (x >> np.uint64(31)), first))
                    sign[i + some, band] = key
            lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * bands), pa.array(signed(sign.ravel())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array([digest[i].tobytes() for i in range(k)], pa.binary()), lists], ["doc_id", "hash", "size", "digest", "bands"])
        release()

    return docs.select(doc_key("doc_id").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").mapInArrow(run, "doc_id long, hash long, size long, digest binary, bands array<long>")


def digest_of(h: np.ndarray) -> bytes:
    """The digest that ``signatures`` gives to a set."""
    return np.array([h.sum(dtype=np.uint64), mix(h ^ _SECOND).sum(dtype=np.uint64)], np.uint64).tobytes()


def components(links: DataFrame, name: str, rounds: int = 40) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): the least node of its connected component.

    Alternating large-star and small-star steps: every step is an aggregation by node, and each is written to the shared
    folder. A node's least neighbour is a partial minimum; the links of a node with very many neighbours meet it by
    ``lookup``, so no task gets them all.
    """

    def nearest(e: DataFrame) -> DataFrame:
        return materialize(e.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), f"{name}-least")

    e = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = nearest(both)
        # A node with a lesser neighbour that has no other one: if all are such, links are stars around least nodes.
        if least.where("m < a and n > 1").isEmpty():
            break
        # Repeated links do no harm between the steps: there are no more than links before.
        least = least.select("a", F.least("a", "m").alias("m"), "n")
        large = materialize(lookup(both.where("b > a"), least, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"), f"{name}-large")
        small = lookup(large, nearest(large), "a", "n").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e = materialize(small, name)
    else:
        raise RuntimeError("components didn't settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def met_in_band(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows of band hashes agree in a band."""
    out = np.zeros((len(left), len(right)), bool)
    for k in range(left.shape[1]):
        out |= left[:, k][:, None] == right[:, k][None, :]
    return out


def _compare(left: list[np.ndarray], right: list[np.ndarray], met: np.ndarray, similarity: float) -> np.ndarray:
    """Which of left and right that met are linked, by exact intersections of their sets.

    Few pairs are intersected one by one. Many are one product of matrices: shingles that only one set has can't be shared,
    so only the others become columns; columns are taken in runs, which bounds the dense matrices.
    """
    size_l, size_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    shared = np.zeros((len(left), len(right)), np.float32)
    pairs = np.argwhere(met)
    if len(pairs) <= 4 * (len(left) + len(right)):
        for i, j in pairs.tolist():
            shared[i, j] = len(np.intersect1d(left[i], right[j], assume_unique=True))
    else:
        hl, hr = np.concatenate(left), np.concatenate(right)
        rl, rr = np.repeat(np.arange(len(left)), size_l), np.repeat(np.arange(len(right)), size_r)
        both = np.intersect1d(hl, hr)
        for x in np.array_split(both, max(1, len(both) // 4096)) if len(both) else ():
            cols = []
            for h, r, k in ((hl, rl, len(left)), (hr, rr, len(right))):
                at = np.searchsorted(x, h)
                at[at == len(x)] = 0
                hit = x[at] == h
                m = np.zeros((k, len(x)), np.float32)
                m[r[hit], at[hit]] = 1
                cols.append(m)
            shared += cols[0] @ cols[1].T
    union = size_l[:, None] + size_r[None, :] - shared
    return met & (shared >= similarity * union - 1e-6 * union)


def _stars(linked: np.ndarray, left: list[bytes], right: list[bytes]) -> list[tuple[bytes, bytes]]:
    """(node, least node) of the components of a block pair's link matrix, for nodes that aren't the least of theirs; a node may be on both sides."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        a, b = root(left[i]), root(right[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, top) for x in parent if (top := root(x)) != x]


def verify(members: DataFrame, similarity: float = SIMILARITY, n: int = SHINGLE_WORDS) -> DataFrame:
    """Compares the classes of each pair of blocks that met in a band; members: cluster, i, j (blocks), side, node, weight, bands, text.

    Returns (node, other, links): a row for each class with its number of links, where other is null, and a row for each
    class that links join to a lesser one within the pair of blocks, with the least such class as other, where links is 0.
    """

    def run(batches):
        held: dict[tuple, tuple] = {}
        key = None

        def done():
            left, right = ([x for (side, _), x in held.items() if side == s] for s in (0, 1))
            same = key[1] == key[2]
            if not left or not (same or right):
                return
            right = left if same else right
            met = met_in_band(*(np.array([x[3] for x in side], np.int64) for side in (left, right)))
            if same:
                np.fill_diagonal(met, False)
            linked = _compare([x[2] for x in left], [x[2] for x in right], met, similarity)
            wl, wr = np.array([x[1] for x in left]), np.array([x[1] for x in right])
            rows = [(left[i][0], None, int(c)) for i, c in enumerate(linked @ wr) if c]
            if not same:
                rows += [(right[i][0], None, int(c)) for i, c in enumerate(wl @ linked) if c]
            rows += [(node, least, 0) for node, least in _stars(linked, [x[0] for x in left], [x[0] for x in right])]
            if rows:
                nodes, others, counts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(others, pa.binary()), pa.array(counts, pa.int64())], ["node", "other", "links"])

        for b in batches:
            sets = {}
            for i, h, at in shingle_sets(b.column("text"), n):
                for r in range(len(at) - 1):
                    sets[i + r] = h[at[r] : at[r + 1]].copy()
            c = [b.column(x).to_pylist() for x in ("cluster", "i", "j", "side", "node", "weight", "bands")]
            for r, (cluster, i, j, side, node, weight, bands) in enumerate(zip(*c, strict=True)):
                if (cluster, i, j) != key:
                    if held:
                        yield from done()
                    held, key = {}, (cluster, i, j)
                if digest_of(sets[r]) == node:  # else another text with the same doc_id and hash
                    held[side, node] = (node, weight, sets[r], bands)
        if held:
            yield from done()
        held.clear()
        release()

    return members.mapInArrow(run, "node binary, other binary, links long")


def listed(keys: DataFrame) -> DataFrame:
    """A written list of documents, for a join with texts: by broadcast up to BROADCAST_ROWS rows."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def deal(placed: DataFrame) -> DataFrame:
    """(cluster, i, j, side, node) of the pairs of blocks that each class goes to, i <= j; ``placed`` has node, root, blocks, block and bands."""
    one = placed.where("blocks = 1").select("node", "root", "block", F.col("block").alias("o"))
    # In a cluster of many blocks, a class meets its own block and those that share a band's bucket with it.
    inside = placed.where("blocks > 1").select("node", "root", "block", F.posexplode("bands").alias("band", "hash"))
    there = inside.select("root", "band", "hash", F.col("block").alias("o")).distinct()
    many = inside.join(there, ["root", "band", "hash"]).select("node", "root", "block", "o").distinct()
    return one.unionByName(many).select(F.col("root").alias("cluster"), F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), (F.col("block") > F.col("o")).cast("int").alias("side"), "node")


def known_classes(docs: DataFrame, similarity: float, n: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of the texts, and the classes: node, first and hash (of its least document), root of its group, weight, links, least (doc_id of the group) and leader (whether it is the group's first class)."""
    bands, rows = choose_bands(similarity)
    sig = materialize(signatures(docs, bands, rows, n), "shingles")
    # A class is known by the digest of its set; its text is fetched from its first document.
    classes = sig.where("size > 0").groupBy(F.col("digest").alias("node")).agg(F.min(F.struct("doc_id", "hash")).alias("f"), F.count(F.lit(1)).alias("weight"), F.first("bands").alias("bands"))
    classes = materialize(classes.select("node", F.col("f.doc_id").alias("first"), "f.hash", "weight", "bands"), "copies")
    each = classes.select("node", F.posexplode("bands").alias("band", "key"))
    least = each.groupBy("band", "key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("band", "key", "low")
    stars = each.join(least, ["band", "key"]).where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    clusters = components(stars, "candidate-stars")
    sizes = materialize(clusters.groupBy("root").agg(F.count(F.lit(1)).alias("k")), "cluster-sizes")
    # A class falls into a block by its hash; blocks are half full on average.
    placed = lookup(clusters, sizes, "root", "k").withColumn("blocks", F.ceil(F.col("k") / (BLOCK // 2)).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = materialize(placed.join(classes, "node"), "placed-classes")
    mine = listed(materialize(placed.select("first", "hash").distinct(), "class-documents"))
    # Equal rows are one text; copies among rows without an id are folded by partial aggregates.
    texts = docs.select(doc_key("doc_id").alias("first"), F.xxhash64("text").alias("hash"), "text").join(mine, ["first", "hash"], "left_semi")
    texts = texts.groupBy("first", "hash").agg(F.min("text").alias("text"))
    whole = deal(placed).join(placed.select("node", "first", "hash", "weight", "bands").join(texts, ["first", "hash"]).drop("first", "hash"), "node")
    found = materialize(verify(whole.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j"), similarity, n), "verified")
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), "verified-links")
    known = classes.drop("bands").join(groups, "node", "left").join(links, "node", "left").select("node", "first", "hash", F.coalesce("root", "node").alias("root"), "weight", F.coalesce("links", F.lit(0)).alias("links"))
    known = materialize(known, "class-groups")
    heads = known.groupBy("root").agg(F.min(F.struct("first", "hash", "node")).alias("head"), F.count(F.lit(1)).alias("in_group"))
    out = lookup(known, materialize(heads, "group-heads"), "root", "in_group")
    return sig, materialize(out.select("node", "first", "hash", "root", "weight", "links", F.col("head.first").alias("least"), (F.col("head.node") == F.col("node")).alias("leader")), "classes")


def join(docs: DataFrame, similarity: float = SIMILARITY, n: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its group of linked texts), copy_id (least doc_id with its very set), n_copies, n_links."""
    sig, known = known_classes(docs, similarity, n)
    named = lambda c: F.when(F.col(c) < LAST, F.col(c)).alias(c)
    rows = sig.select(named("doc_id"), "size", F.col("digest").alias("node"))
    some = lookup(rows.where("size > 0"), known, "node", "weight").select("doc_id", named("least").alias("class_id"), named("first").alias("copy_id"), F.col("weight").alias("n_copies"), (F.col("weight") - 1 + F.col("links")).cast("long").alias("n_links"))
    return some.unionByName(rows.where("size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: its least doc_id (a null one only if there is no other), and one row of it.

    The other rows are listed by doc_id and hash of the text, and the texts meet that list; where rows are equal in both, one
    of them is left, by partial aggregates. Texts without shingles stay, once for each repeated id and text; all of
    those without an id stay.
    """
    names = docs.columns
    flat = docs.toDF(*(f"c{i}" for i in range(len(names))))
    doc, text = (f"c{names.index(x)}" for x in ("doc_id", "text"))
    sig, known = known_classes(docs.select("doc_id", "text"), SIMILARITY, SHINGLE_WORDS)
    leaders = known.where("leader").select(F.col("first").alias("doc_id"), "hash")
    others = materialize(sig.where("size > 0").join(leaders, ["doc_id", "hash"], "left_anti").select(F.col("doc_id").alias("_first"), F.col("hash").alias("_hash")).distinct(), "near-duplicates")
    same = sig.where(f"size > 0 or doc_id < {LAST}").groupBy(F.col("doc_id").alias("_first"), F.col("hash").alias("_hash")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    same = materialize(same.join(others, ["_first", "_hash"], "left_anti").select("_first", "_hash"), "equal-rows")
    rows = flat.withColumns({"_key": doc_key(doc), "_text": F.xxhash64(text)})
    on = (F.col("_key") == F.col("_first")) & (F.col("_text") == F.col("_hash"))
    kept = rows.join(listed(others), on, "left_anti")
    if not same.isEmpty():
        kept = kept.join(listed(same), on, "left_anti").unionByName(kept.join(listed(same), on, "left_semi").dropDuplicates(["_key", "_text"]))
    return kept.select(*flat.columns).toDF(*names)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))

"""SentencePiece encoding and decoding as a relational lattice.

A text is cut into segments wherever no piece of the vocabulary can span two neighbouring characters (by the pair and
the triples around it): no segmentation can cross such a place. Each distinct segment of the corpus is encoded once:

1. Substrings of bounded length are exploded and equi-joined to the piece table; the matches are the edges of the
   segment's lattice.
2. Edges are grouped by segment and folded by a higher-order aggregate: for a unigram model by Viterbi's best path, for a
   byte-pair model by its merges, best rank first and leftmost among equals. (The best path of a byte-pair model's
   ranks isn't its encoding, so that fold follows the merges over the same lattice.)

Characters outside of the vocabulary fall back to byte pieces. Texts then look up their segments by chunk (see
``exchange``) and are decoded again; a text that decodes to another one raises an error.

The vocabulary file is a parameter; it is read on the driver, and its tables (a fixed size) go to the tasks.

Defined results: null and empty texts have no pieces; the sign U+2581 is a space to the model, so a text with it decodes to
spaces; segments of more than LONG characters take the same
merges or path in a plain loop instead of the fold; repeated rows are
encoded each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import exchange
from gridloom.llm.common import buffers, materialize, release, slices, span_hashes, table
from gridloom.llm.exchange import Answers, Chunk, n_buckets, narrow, pack, unpack
from gridloom.llm.quality import let

MODEL = os.environ.get("GRIDLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
#: Longest segment for the fold, and the bits of an id and of a cost in an edge (key * 2**48 + cost * 2**20 + id).
LONG, ID_BITS, COST_BITS = 64, 20, 28
#: Characters of a beginning that bounds the length of pieces.
REACH = 3
UNIGRAM, BPE = 1, 2


#: Size of the table of triples of characters in pieces; two triples in one place only join what could be cut.
TRIPLE_BITS = 22


def _triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - TRIPLE_BITS)


@dataclass
class Vocabulary:
    """pieces: (text with plain spaces, score) by id, None for control pieces; byte_ids: id of each byte piece."""

    pieces: list[tuple[str, float] | None]
    byte_ids: list[int]
    kind: int = BPE
    unknown: int = 0

    def __post_init__(self):
        self.longest = max((len(p[0]) for p in self.pieces if p), default=1)
        inner = sorted({c for p in self.pieces if p and len(p[0]) > 1 for c in p[0]})
        code = {c: i + 1 for i, c in enumerate(inner)}
        self.codes = np.zeros(0x110000, np.uint16)
        self.codes[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.pairs = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        self.triples = np.zeros(1 << TRIPLE_BITS, bool)
        longer = [[code[c] for c in p[0]] for p in self.pieces if p and len(p[0]) > 1]
        for p in longer:
            if len(p) == 2:
                self.pairs[p[0], p[1]] = True
        flat = np.array([x for p in longer for x in zip(p, p[1:], p[2:], strict=False)], np.uint32).reshape(-1, 3)
        self.triples[_triple(*flat.T)] = True
        self.places = {x: k for k, x in enumerate(sorted({p[1] for p in self.pieces if p}, reverse=True))}
        if len(self.pieces) >= 1 << ID_BITS or self.kind == UNIGRAM and not all(0 <= -p[1] < 1 << 8 for p in self.pieces if p):
            raise ValueError("the vocabulary is too large, or its scores are out of range")
        raw = [p[0].encode() if p else b"" for p in self.pieces]
        for byte, i in enumerate(self.byte_ids):
            raw[i] = bytes([byte])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece as sp

        m = sp.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        plain = lambda i: not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))
        pieces = [(m.id_to_piece(i).replace(SPACE, " "), m.get_score(i)) if plain(i) else None for i in range(n)]
        bytes_ = {m.id_to_piece(i): i for i in range(n) if m.is_byte(i)}
        if len(bytes_) != 256:
            raise ValueError("a vocabulary with byte fallback is needed")
        return cls(pieces, [bytes_[f"<0x{b:02X}>"] for b in range(256)], kind_of(path), m.unk_id())

    def cost(self, score: float) -> int:
        """What a piece costs, as an integer: its place by score for merges, the score in units of 2**-20 for paths."""
        return self.places[score] if self.kind == BPE else round(-score * (1 << 20))

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, entry): the fixed piece table; an entry is cost * 2**20 + id."""
        rows = [(p[0], (self.cost(p[1]) << ID_BITS) + i) for i, p in enumerate(self.pieces) if p]
        return spark.createDataFrame(pa.table({"piece": [r[0] for r in rows], "entry": pa.array([r[1] for r in rows], pa.int64())}))


    def reach(self, spark: SparkSession) -> DataFrame:
        """(head, most): the longest piece for each beginning of REACH characters; shorter pieces need no row."""
        most: dict[str, int] = {}
        for p in self.pieces:
            if p and len(p[0]) >= REACH:
                most[p[0][:REACH]] = max(most.get(p[0][:REACH], 0), len(p[0]))
        return spark.createDataFrame(pa.table({"head": list(most), "most": pa.array(list(most.values()), pa.int32())}), "head string, most int")


def kind_of(path: str) -> int:
    """UNIGRAM or BPE, from the model's trainer settings."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.add_dummy_prefix:
        raise ValueError("only models with the identity normaliser and a leading space are supported")
    if m.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and byte-pair models are supported")
    return m.trainer_spec.model_type


@dataclass
class Segments:
    """Bytes (with a space before each text that isn't empty), segment starts, ends and rows, hashes, and where rows begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray
    at: np.ndarray


def segments(at: np.ndarray, data: np.ndarray, v: Vocabulary) -> Segments:
    text = data.tobytes().decode()
    if SPACE in text:
        texts = [data[i:j].tobytes().decode().replace(SPACE, " ").encode() for i, j in zip(at[:-1], at[1:], strict=True)]
        data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    full = at[1:] > at[:-1]
    data = np.insert(data, at[:-1][full], 32)
    at = at + np.concatenate([[0], np.cumsum(full)])
    if not len(data):
        none = np.zeros(0, np.int64)
        return Segments(data, none, none, none, none.astype(np.uint64), at)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    size = np.ones(len(points), np.uint8)
    for most in (0x7F, 0x7FF, 0xFFFF):
        size += points > most
    place = np.cumsum(size, dtype=np.int64) - size
    # A piece that spans two neighbours is their pair, or holds a triple of them with the character before or after.
    code = v.codes[points]
    joined = v.pairs[code[:-1], code[1:]]
    if len(code) > 2:
        wide = code.astype(np.uint32)
        triple = v.triples[_triple(wide[:-2], wide[1:-1], wide[2:])]
        joined[1:] |= triple
        joined[:-1] |= triple
    joined &= (code[:-1] > 0) & (code[1:] > 0)
    apart = np.ones(len(points), bool)
    apart[1:] = ~joined
    apart[np.searchsorted(place, at[:-1][full])] = True
    starts = place[np.flatnonzero(apart)]
    ends = np.append(starts[1:], len(data))
    rows = np.searchsorted(at, starts, "right") - 1
    return Segments(data, starts.astype(np.int32), ends.astype(np.int32), rows.astype(np.int32), span_hashes(data, starts, ends), at)


#: Text bytes that are cut into segments at once; their arrays take about 100 times that. Texts are never cut here.
CUT_BYTES = 1 << 18


def of_chunk(c: Chunk, v: Vocabulary) -> Iterator[tuple[int, Segments]]:
    return ((i, segments(c.offsets[i : j + 1] - c.offsets[i], c.data[c.offsets[i] : c.offsets[j]], v)) for i, j in slices(c.offsets, CUT_BYTES))


def _ask(v: Vocabulary, buckets: int):
    def ask(c: Chunk):
        # Of each slice only the distinct segments are held: their hashes, sizes and bytes.
        hashes, sizes, words = [], [], []
        for _, s in of_chunk(c, v):
            own, first = np.unique(s.hashes, return_index=True)
            size = s.ends[first] - s.starts[first]
            hashes.append(own)
            sizes.append(size)
            words.append(s.data[_gather(s.starts[first].astype(np.int64), size.astype(np.int64))])
        own, first = np.unique(np.concatenate(hashes), return_index=True) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        if not len(own):
            return
        size, raw = np.concatenate(sizes).astype(np.int64), np.concatenate(words)
        del hashes, sizes, words
        begin, size = (np.cumsum(size) - size)[first], size[first]
        for b, i, j in exchange.split(own, buckets):
            yield b, pack(narrow(size[i:j]), raw[_gather(begin[i:j], size[i:j])])

    return ask


def _words(body: bytes) -> list[bytes]:
    size, raw = unpack(body)
    data, ends = raw.tobytes(), np.cumsum(size.astype(np.int64))
    return [data[e - n : e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]


def lattice(words: DataFrame, v: Vocabulary) -> DataFrame:
    """(word, edges, singles): the pieces of several and of one character in each word of at most LONG characters, packed, with key = start * 256 + length.

    Starts and lengths are exploded as integers, so substrings are cut inside generated code. Every character of a word
    is a row of its lattice, with or without a piece, so no word is lost and none has to be joined back.
    """
    spark = words.sparkSession
    # The first three characters bound the length of a piece, so hopeless substrings are never cut.
    reach = v.reach(spark).select(F.xxhash64("head").alias("g"), "most")
    each = words.select("word", F.char_length("word").alias("n"))
    each = each.select("word", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
    each = each.withColumn("g", F.xxhash64(F.substring(F.col("word"), F.col("s") + 1, F.lit(REACH)))).join(F.broadcast(reach), "g", "left")
    each = each.select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.coalesce("most", F.lit(REACH - 1)), F.col("n") - F.col("s")))).alias("k"))
    each = each.select("word", (F.col("s") * 256 + F.col("k")).cast("bigint").alias("key"), F.substring(F.col("word"), F.col("s") + 1, F.col("k")).alias("piece"))
    # The piece table is a fixed vocabulary file, so the broadcast doesn't grow; words stay where they are. Joining by
    # the hash and then comparing pieces is the equi-join with a key of one machine word.
    pieces = v.table(spark).select(F.xxhash64("piece").alias("h"), F.col("piece").alias("p"), "entry")
    found = each.withColumn("h", F.xxhash64("piece")).join(F.broadcast(pieces), "h", "left").where("piece = p or key % 256 = 1")
    packed = F.shiftleft("key", ID_BITS + COST_BITS) + F.when(F.col("piece") == F.col("p"), F.col("entry"))
    return found.groupBy("word").agg(F.collect_list(F.when(F.col("key") % 256 > 1, packed)).alias("edges"), F.collect_list(F.when(F.col("key") % 256 == 1, packed)).alias("singles"))


def _cost(entry: Column) -> Column:
    return F.shiftright(entry, ID_BITS).bitwiseAND(F.lit((1 << COST_BITS) - 1))


def _id(entry: Column) -> Column:
    return entry.bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int")


def _edge(edges: Column, start: Column, end: Column) -> Column:
    """The packed edge of a span, or null."""
    return F.try_element_at(edges, start * 256 + (end - start))


def merge_fold(n: Column, edges: Column) -> Column:
    """Borders of the pieces after all merges of a byte-pair model, least cost first and leftmost among equals; ``edges`` is a map by key."""

    def step(b: Column, _: Column) -> Column:
        # Cost and place as one number: its minimum is the merge to make, and null where no two neighbours join.
        best = F.array_min(F.transform(F.slice(b, 1, F.size(b) - 2), lambda s, j: F.shiftleft(_cost(_edge(edges, s, F.get(b, j + 2))), 12) + j))
        return let(best, lambda x: F.when(x.isNull(), b).otherwise(let(x.bitwiseAND(F.lit(4095)) + 1, lambda gone: F.filter(b, lambda _, i: i != gone))))

    whole = F.sequence(F.lit(0), n)
    return F.when(n < 2, whole).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), whole, lambda b, i: F.when(F.size(b) < 3, b).otherwise(step(b, i))))


#: Cost of a character that has no piece, above that of any path of pieces.
UNKNOWN = 1 << 40


def viterbi_fold(n: Column, edges: Column, singles: Column, longest: int) -> Column:
    """Borders of the path of least total cost."""

    def step(paths: Column, end: Column) -> Column:
        def through(start: Column) -> Column:
            alone = F.when(end - start == 1, F.coalesce(_cost(_edge(singles, start, end)), F.lit(UNKNOWN)))
            cost = F.coalesce(_cost(_edge(edges, start, end)), alone)
            return F.struct((F.get(paths, start)["cost"] + cost).alias("cost"), F.concat(F.get(paths, start)["path"], F.array(end)).alias("path"))

        ways = F.filter(F.transform(F.sequence(F.greatest(F.lit(0), end - longest), end - 1), through), lambda x: x["cost"].isNotNull())
        return F.concat(paths, F.array(F.array_min(ways)))

    start = F.array(F.struct(F.lit(0).cast("bigint").alias("cost"), F.array(F.lit(0)).alias("path")))
    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda p: F.element_at(p, -1)["path"])


def fold(lattices: DataFrame, v: Vocabulary) -> DataFrame:
    """(word, ids) from (word, edges, singles)."""
    n = F.char_length("word")

    def by_key(name: str) -> Column:
        packed = F.coalesce(name, F.array().cast("array<bigint>"))
        return F.map_from_arrays(F.transform(packed, lambda e: F.shiftright(e, ID_BITS + COST_BITS).cast("int")), packed)

    borders = (lambda m, one: merge_fold(n, m)) if v.kind == BPE else (lambda m, one: viterbi_fold(n, m, one, v.longest))
    byte_ids = F.array(*map(F.lit, v.byte_ids))

    def bytes_of(start: Column, end: Column) -> Column:
        digits = F.hex(F.encode(F.substring(F.col("word"), start + 1, end - start), "UTF-8"))
        return F.transform(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1), lambda i: F.get(byte_ids, F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int")))

    def ids(m: Column, one: Column, b: Column) -> Column:
        def piece(start: Column, j: Column) -> Column:
            end = F.get(b, j + 1)
            found = F.when(end - start == 1, _edge(one, start, end)).otherwise(_edge(m, start, end))
            return let(found, lambda e: F.when(e.isNotNull(), F.array(_id(e))).otherwise(bytes_of(start, end)))

        return F.flatten(F.transform(F.slice(b, 1, F.size(b) - 1), piece))

    return lattices.select("word", let(by_key("edges"), lambda m: let(by_key("singles"), lambda one: let(borders(m, one), lambda b: ids(m, one, b)))).alias("ids"))


def path_long(text: str, v: Vocabulary, rank: dict[str, tuple[int, int]]) -> list[int]:
    """The path of least total cost for a long segment of a unigram model."""
    cost, back = [0] + [-1] * len(text), [0] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        ways = []
        for start in range(max(0, end - v.longest), end):
            e = rank.get(text[start:end])
            if e or end - start == 1:
                ways.append((cost[start] + (e[0] if e else UNKNOWN), start))
        cost[end], back[end] = min(ways)
    borders = [len(text)]
    while borders[-1]:
        borders.append(back[borders[-1]])
    out = []
    for s, e in zip(borders[:0:-1], borders[-2::-1], strict=True):
        found = rank.get(text[s:e])
        out += [found[1]] if found else [v.byte_ids[x] for x in text[s:e].encode()]
    return out


def merge_long(text: str, v: Vocabulary, rank: dict[str, tuple[int, int]]) -> list[int]:
    """The merges of a byte-pair model for a long segment, by a queue."""
    left, right, end = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1)), list(range(1, len(text) + 1))
    queue: list = []

    def offer(i: int) -> None:
        if i >= 0 and (j := right[i]) < len(text):
            e = rank.get(text[i : end[j]]) if end[j] - i <= v.longest else None
            if e:
                heapq.heappush(queue, (e[0], i, j, end[j]))

    for i in range(len(text)):
        offer(i)
    gone = bytearray(len(text))
    while queue:
        _, i, j, e = heapq.heappop(queue)
        if gone[i] or j >= len(text) or gone[j] or right[i] != j or end[j] != e:
            continue
        gone[j] = 1
        end[i], right[i] = e, right[j]
        if right[j] < len(text):
            left[right[j]] = i
        offer(left[i])
        offer(i)
    out = []
    for i in range(len(text)):
        if not gone[i]:
            found = rank.get(text[i : end[i]])
            out += [found[1]] if found else [v.byte_ids[x] for x in text[i : end[i]].encode()]
    return out


def encode_words(words: DataFrame, v: Vocabulary) -> DataFrame:
    """(word, ids) of distinct words; ids is null for words of more than LONG characters, which ``_packed`` fills in."""
    done = fold(lattice(words.where(F.char_length("word") <= LONG), v), v)
    return done.unionByName(words.where(F.char_length("word") > LONG).select("word", F.lit(None).cast("array<int>").alias("ids")))


def _packed(encoded: DataFrame, v: Vocabulary, buckets: int) -> DataFrame:
    """(bucket, body): encodings by bucket, each body with sorted hashes, counts of ids, and ids."""

    def run(batches):
        rank = {p[0]: (v.cost(p[1]), i) for i, p in enumerate(v.pieces) if p}
        long = merge_long if v.kind == BPE else path_long
        for b in batches:
            words, ids = b.column(0), b.column(1)
            if ids.null_count:
                ids = pa.array([long(w, v, rank) if x is None else x for w, x in zip(words.to_pylist(), ids.to_pylist(), strict=True)], pa.list_(pa.int32()))
            at, data = buffers(words)
            hashes = span_hashes(np.ascontiguousarray(data[at[0] : at[-1]]), at[:-1] - at[0], at[1:] - at[0]) if len(words) else np.zeros(0, np.uint64)
            size = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            begin = np.cumsum(size) - size
            order = np.argsort(hashes)
            rows = []
            for k, i, j in exchange.split(hashes[order], buckets):
                mine = order[i:j]
                rows.append((k, pack(exchange.deltas(hashes[mine]), narrow(size[mine]), narrow(flat[_gather(begin[mine], size[mine])]))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "body"])
        release()

    return encoded.mapInArrow(run, "bucket int, body binary")


def encode(docs: DataFrame, v: Vocabulary | None = None) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): doc_id, ids of its pieces, and the text decoded from them."""
    spark = docs.sparkSession
    v = v or Vocabulary.load(MODEL)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    buckets = n_buckets(docs)
    # Read twice, for the words and for the answers; packed, it is about a fifth of the texts.
    asked = materialize(exchange.request(docs, _ask(v, buckets), PIECE_CHUNK), "segment-requests")

    def distinct(t: pa.Table) -> pa.Table:
        own = {w for body in t.column("body").to_pylist() for w in _words(body)}
        return pa.table([pa.array([w.decode() for w in own], pa.string())], ["word"])

    words = materialize(asked.groupBy("bucket").applyInArrow(distinct, "word string"), "segments")
    # A word's lattice is some twenty rows, so tasks are dealt few words and sort them without spilling.
    tasks = max(1, -(-words.count() // WORDS_OF_TASK))
    encoded = materialize(_packed(encode_words(words.repartition(tasks, "word"), v), v, buckets), "encoded-segments")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [unpack(b) for b in right.column("body").to_pylist()]
        keys = np.concatenate([exchange.undelta(p[0]) for p in parts])
        size = np.concatenate([p[1].astype(np.int64) for p in parts])
        ids = np.concatenate([p[2].astype(np.int64) for p in parts])
        begin = np.cumsum(size) - size
        order = np.argsort(keys)
        bodies = []
        for body in left.column("body").to_pylist():
            n, raw = unpack(body)
            ends = np.cumsum(n.astype(np.int64))
            at = order[np.searchsorted(keys[order], span_hashes(raw, ends - n, ends))]
            bodies.append(pack(narrow(size[at]), narrow(ids[_gather(begin[at], size[at])])))
        return pa.table([left.column("bucket"), left.column("chunk"), pa.array(bodies, pa.binary())], ["bucket", "chunk", "body"])

    read = Answers(asked.groupBy("bucket").cogroup(encoded.groupBy("bucket")).applyInArrow(answer, exchange.REQUEST), "pieces").reader()

    def run(batches):
        for b in batches:
            for c in exchange.chunks(b, PIECE_CHUNK):
                parts = []
                for i, s in of_chunk(c, v):
                    own, at = np.unique(s.hashes, return_inverse=True)
                    parts.append((i, s.rows, s.at, own, at.astype(np.int32)))
                known = np.unique(np.concatenate([p[3] for p in parts])) if parts else np.zeros(0, np.uint64)
                got = [x for _, x in sorted(read(c.name).items())] if len(known) else []
                size = np.concatenate([x[0].astype(np.int64) for x in got]) if got else np.zeros(0, np.int64)
                ids = np.concatenate([x[1].astype(np.int32) for x in got]) if got else np.zeros(0, np.int32)
                begin = np.cumsum(size) - size
                for first, row_of, row_at, own, at in parts:
                    mine = np.searchsorted(known, own)[at]
                    out = ids[_gather(begin[mine], size[mine])]
                    rows = len(row_at) - 1
                    count = np.bincount(row_of, size[mine], rows).astype(np.int64)
                    ends = np.concatenate([[0], np.cumsum(count)])
                    raw_size = (v.raw_at[1:] - v.raw_at[:-1])[out]
                    raw = v.raw[_gather(v.raw_at[out], raw_size)]
                    raw_ends = np.concatenate([[0], np.cumsum(raw_size)])[ends]
                    # The space that was put before a text is taken off again.
                    texts = [raw[i + 1 : j].tobytes().decode() for i, j in zip(raw_ends[:-1], raw_ends[1:], strict=True)]
                    at_text = c.offsets[first : first + rows + 1]
                    for i, text in enumerate(texts):
                        if text.encode() != (want := c.data[at_text[i] : at_text[i + 1]].tobytes()) and text != want.decode().replace(SPACE, " "):
                            raise ValueError(f"document {c.ids[first + i]} decodes to another text: two of its segments have one hash")
                    yield pa.RecordBatch.from_arrays([pa.array(c.ids[first : first + rows], pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out)), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])
        release()

    return docs.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


#: Text bytes of a chunk: larger ones repeat fewer segments, and take about 20 times their size of memory.
PIECE_CHUNK = 4 << 20
#: Distinct segments of a task that folds lattices.
WORDS_OF_TASK = 25_000


def _gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... begin + size - 1 of each pair."""
    if not len(size):
        return np.zeros(0, np.int64)
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_pieces, ids_hash, decoded_sha256): the 64-bit hash of the ids and the digest of the text decoded from them."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs.select("doc_id", "text")).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))

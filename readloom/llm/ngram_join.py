"""Grouped prefix join of documents by the Jaccard coefficient of their word shingles.

Exact: two documents link when 100 |A & B| >= 75 |A | B| for their sets of 5-word shingles (A-Z lower-cased; fewer words
make one shingle). What is asked for is the class of each document, its component of links.

1. Documents of equal sets are one class, whatever their number.
2. Shingles are ordered, rare ones first, by counts of all documents in a table of ``SKETCH_BITS`` bits' size (hashed, so
   an upper bound; the order may be any for right results). Linked sets share one of their first n - ceil(3n/4) + 1
   shingles. Classes with equal prefixes and sizes are one group, and a group posts its prefix once for each task.
3. Postings are sorted by shingle. A shared shingle speaks for a pair of groups only if what remains of both ordered sets
   from there on could link them, as it could from the first one that linked sets share. Postings without such a partner
   in their list go; lists too long to be held at once keep all. A group of three classes or more has a list of its own.
4. Each group is paired with the first of its lists, and each class with the first of its group; what links is joined into
   components. In rounds, the classes of each list that still holds several components meet a newly drawn one of them, till
   a round joins few. Then the pairs of components that a list holds are formed, filtered by size and place, and expanded
   to their classes in the list, the smaller component first, each class against the bounds of the other component. The
   join with the classes of the larger one, in shares of ``SHARE``, looks at a parity sketch of ``SKETCH_WORDS`` words
   too, so that a pair it tells apart never becomes a row. Pairs within a component need no look, so a group of thousands
   of near copies costs a check each, not each pair, and no link between components is missed.
5. Pairs are verified in two steps. Each class has a parity bitmap of twice as many bits as shingles: two sets differ in as
   many shingles at least as their bitmaps in bits, which tells most pairs apart without their sets. For the rest, a
   class's set goes once to each of its partners, in shares of ``SHARE`` for classes with many.

Defined results: null, empty and blank texts have no shingles and stand alone; repeated rows get equal classes;
component_id is the least id of the component's documents, null ids aside (null if there is no other). Extra columns are
ignored, and pass through ``apply``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import checkpointed, free_shuffles, remove, scratch_path, slices, table, unused
from readloom.llm.components import components

WORDS = 5
THRESHOLD = 75
SKETCH_BITS = 20
BLOCK_BITS = 14
SHARE = 1_000
SKETCH_WORDS = 8
MAX_ROUNDS = 8
ROUND_GAIN = 100
LIST_ROWS = 1 << 16
SHORT_LIST = 24
PIECE_BYTES = 1 << 20

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class Shingles:
    """The shingle sets of texts as sorted 64-bit hashes.

    A word's hash is a polynomial of its bytes (each by a fixed random number), taken for all words of a piece of text from
    one running sum; a shingle's is a mixed polynomial of its words' hashes.
    """

    def __init__(self, words: int = WORDS):
        self.words = words
        rng = np.random.default_rng(11)
        self.of_byte = rng.integers(0, 2**64, 256, np.uint64)
        self.space = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
        self._powers(PIECE_BYTES)

    def _powers(self, n: int) -> None:
        base = 0x5851F42D4C957F2D
        grow = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(b))]), dtype=np.uint64)
        with np.errstate(over="ignore"):
            self.up, self.down = grow(base), grow(pow(base, -1, 2**64))

    def _word_hashes(self, data: bytes) -> np.ndarray:
        n = len(data)
        if n >= len(self.up):  # a word longer than a piece
            self._powers(n)
        raw = np.frombuffer(data, np.uint8)
        blank = np.ones(n + 2, bool)
        blank[1:-1] = self.space[raw]
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.of_byte[raw] * self.down[:n], out=sums[1:])
        found = (sums[ends] - sums[starts]) * self.up[starts]
        return (found ^ (found >> np.uint64(32))) * _MIX

    def __call__(self, text: str | None) -> np.ndarray:
        data, parts, at = (text or "").encode().lower(), [], 0
        with np.errstate(over="ignore"):
            while at < len(data):
                end = len(data)
                if end - at > PIECE_BYTES:  # between words
                    cut = max(data.rfind(s, at, at + PIECE_BYTES) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                    found = [x for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := data.find(s, at + PIECE_BYTES)) >= 0]
                    end = cut + 1 if cut >= at else min(found, default=end - 1) + 1
                parts.append(self._word_hashes(data[at:end]))
                at = end
            own = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            n = len(own)
            if not n:
                return own
            size = min(n, self.words)
            found = own[: n - size + 1] + np.uint64(size)
            for k in range(1, size):
                found = found * _FACTOR + own[k : n - size + 1 + k]
            found = (found ^ (found >> np.uint64(30))) * _MIX
        found = np.sort(found ^ (found >> np.uint64(27)))
        return found[np.concatenate([[True], found[1:] != found[:-1]])]


def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    return n - -(-threshold * n // 100) + 1


def linked(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= threshold * (len(a) + len(b) - common)


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingles(words), np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in slices(batches):
            places = [shingles(text) >> np.uint64(64 - SKETCH_BITS) for text in batch.column(0).to_pylist()]
            counts += np.bincount(np.concatenate(places).astype(np.int64), minlength=len(counts))
        blocks = counts.reshape(-1, 1 << BLOCK_BITS)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[i].tobytes() for i in used], pa.binary())], ["block", "counts"])

    return run


def _summed(group: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(b, np.int64) for b in group.column("counts").to_pylist()], axis=0)
    ranks = np.minimum(255, 8 * np.log2(1 + total)).astype(np.uint8)
    return pa.table({"block": group.column("block")[:1].cast(pa.int32()), "ranks": pa.array([ranks.tobytes()], pa.binary())})


def _ranks(texts: DataFrame, words: int) -> np.ndarray:
    """One byte of frequency for each place of the table: 2^SKETCH_BITS bytes, whatever the input."""
    found = texts.mapInArrow(_sketch(words), "block int, counts binary").groupBy("block").applyInArrow(_summed, "block int, ranks binary").collect()
    out = np.zeros((1 << SKETCH_BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.uint8)
    for row in found:
        out[row.block] = np.frombuffer(row.ranks, np.uint8)
    return out.ravel()


def bitmap(own: np.ndarray) -> bytes:
    """Parity by place: of 2^k bits, twice the shingles and ``SKETCH_WORDS`` words or more, each is flipped by those whose low k bits name it."""
    k = (max(64 * SKETCH_WORDS, 2 * len(own)) - 1).bit_length()
    flips = np.bincount((own & np.uint64((1 << k) - 1)).astype(np.int64), minlength=1 << k)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """In how many bits two bitmaps differ; the longer one is folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    return int(np.bitwise_count(folded(x, len(y)) ^ folded(y, len(x))).sum())


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """A bitmap by fewer places, of ``words`` words at most."""
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


_SKETCHES = ", ".join(f"s{i} long" for i in range(SKETCH_WORDS))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set_key, s0, ...) of (set_key, bits)."""
    for batch in slices(batches, 4096):
        found = np.stack([folded(np.frombuffer(x, np.int64), SKETCH_WORDS) for x in batch.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in found.T)], ["set_key", *(x.split()[0] for x in _SKETCHES.split(", "))])


_LISTS = "shingle long, group long, left int, hub long, hub_left int"
_SETS = "doc_id long, n int, set_key binary, group long, text_key binary, prefix array<long>, bits binary"


def _sets(words: int, threshold: int, ranks):
    types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
    names = [x.split()[0] for x in _SETS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, rank, posted, told = Shingles(words), ranks.value, set(), set()
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = shingles(text)
                n, text_key = len(own), hashlib.md5((text or "").encode()).digest()
                if not n:
                    rows.append((doc_id, 0, None, None, text_key, None, None))
                    continue
                order = np.argsort(rank[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                prefix = own[order[: prefix_length(n, threshold)]].view(np.int64)
                name, key = hashlib.md5(prefix.tobytes() + n.to_bytes(8, "little")).digest(), hashlib.md5(own.tobytes()).digest()
                new, first = name not in posted, key not in told
                posted.add(name)
                told.add(key)
                rows.append((doc_id, n, key, int.from_bytes(name[:8], "little", signed=True), text_key, prefix if new else None, bitmap(own) if first else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

    return run


def most_partner(n: np.ndarray, left: np.ndarray, threshold: int) -> np.ndarray:
    """The size of the largest set that one of n shingles could link with, if they first share that with ``left`` from it on."""
    return (100 + threshold) * left // threshold - n


def with_partner(starts: np.ndarray, sizes: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which rows of the lists have a partner there: each is small enough for the other."""
    keep, where = np.zeros(len(n), bool), np.repeat(np.arange(len(starts)), sizes)
    short = sizes <= SHORT_LIST
    for d in range(1, int(sizes[short].max(initial=1))):
        ok = (where[d:] == where[:-d]) & (n[d:] <= most[:-d]) & (n[:-d] <= most[d:])
        keep[d:] |= ok
        keep[:-d] |= ok
    for i in np.flatnonzero(~short).tolist():
        own = slice(int(starts[i]), int(starts[i] + sizes[i]))
        order = np.argsort(n[own])
        reach = np.maximum.accumulate(most[own][order])  # of the sets up to a size, itself perhaps among them
        upto = np.searchsorted(n[own][order], most[own], "right")
        keep[own] = (upto > 0) & (reach[np.maximum(upto, 1) - 1] >= n[own])
    return keep


def _shared_postings(threshold: int, list_rows: int = LIST_ROWS):
    """(shingle, group, left, hub, hub_left) of postings with a partner; the input (shingle, group, left, n) is sorted by shingle and group."""
    names = [x.split()[0] for x in _LISTS.split(", ")]

    def told(rows: list[np.ndarray], prune: bool, hub: tuple | None = None) -> Iterator[pa.RecordBatch]:
        s, g, left, n = rows
        if not len(s):
            return
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(s)]]))
        if prune:
            keep = with_partner(starts, sizes, n, most_partner(n.astype(np.int64), left.astype(np.int64), threshold))
            s, g, left = s[keep], g[keep], left[keep]
            if not len(s):
                return
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(s)]]))
        hubs = np.repeat(g[starts], sizes) if hub is None else np.full(len(g), hub[0], np.int64)
        hubs_left = np.repeat(left[starts], sizes) if hub is None else np.full(len(g), hub[1], np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s, g, left, hubs, hubs_left)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long = None, None  # rows of a list that may go on; (shingle, its last group, hub, hub_left) of one told as it comes
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(4)]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            s, g = rows[:2]
            fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (g[1:] != g[:-1])])
            if long and s[0] == long[0]:
                fresh &= (s != long[0]) | (g != long[1])
            rows = [x[fresh] for x in rows]
            if long:
                end = int(np.searchsorted(rows[0], long[0], "right"))
                yield from told([x[:end] for x in rows], False, long[2:])
                if end:
                    long = (long[0], int(rows[1][end - 1]), *long[2:])
                rows = [x[end:] for x in rows]
            if not len(rows[0]):
                held = None
                continue
            long = None
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from told([x[:cut] for x in rows], True)
            held = [x[cut:] for x in rows]
            if len(held[0]) > list_rows:
                long = (int(held[0][0]), int(held[1][-1]), int(held[1][0]), int(held[2][0]))
                yield from told(held, False)
                held = None
        if held is not None:
            yield from told(held, True)

    return run


def _wanted(words: int, bits, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, done = Shingles(words), bits.value, set()
        for batch in slices(batches):
            keys, sets = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if doc_id is not None:
                    place = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42) >> shift
                    if not int(held[place >> 6]) >> (place & 63) & 1:
                        continue
                own = shingles(text)
                raw = own.tobytes()
                key = hashlib.md5(raw).digest()
                if len(own) and key not in done:
                    done.add(key)
                    keys.append(key)
                    sets.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["set_key", "members"])

    return run


def _verified(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub = None, None
        for batch in slices(batches):
            left, right = [], []
            for a, share, b, members in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b is None:
                    now, hub = (a, share), np.frombuffer(members, np.uint64)
                elif now == (a, share) and linked(hub, np.frombuffer(members, np.uint64), threshold):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["u", "v"])

    return run


def _alike(threshold: int):
    """The pairs whose bitmaps don't rule out that they link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            n, m, x, y = (batch.column(name).to_pylist() for name in ("n", "m", "x", "y"))
            keep = [(100 + threshold) * least_difference(p, q) <= (100 - threshold) * (i + j) for i, j, p, q in zip(n, m, x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(documents: DataFrame, kinds: DataFrame, pairs: DataFrame, words: int, threshold: int) -> tuple[DataFrame, list[str]]:
    """The pairs (a, b) of classes that link, checked on their bitmaps and full sets; and the scratch tables to remove afterwards."""
    spark = documents.sparkSession
    pairs_at, at = scratch_path(spark, "shingle-pairs"), scratch_path(spark, "shingle-sets")
    one = kinds.select(F.col("set_key").alias("a"), "n", F.col("bits").alias("x"))
    two = kinds.select(F.col("set_key").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    pairs.join(one, "a").join(two, "b").mapInArrow(_alike(threshold), "a binary, b binary").write.option("compression", "zstd").parquet(pairs_at)
    pairs = spark.read.schema("a binary, b binary").parquet(pairs_at)
    free_shuffles(spark)
    # sets are made again from one document of each class asked for; a filter by id says which
    asked = pairs.select(F.col("a").alias("set_key")).union(pairs.select("b")).distinct().join(kinds.select("set_key", "rep"), "set_key").where("rep is not null")
    asked = asked.select(F.xxhash64("rep").alias("h"))
    bits = min(27, max(16, (10 * asked.count()).bit_length()))
    place = F.shiftrightunsigned("h", 64 - bits)
    words_set = asked.select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    found = words_set.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # 2^bits places at most
    filled = np.zeros(1 << (bits - 6), np.int64)
    filled[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
    made = documents.select("doc_id", "text").mapInArrow(_wanted(words, spark.sparkContext.broadcast(filled.view(np.uint64)), 64 - bits), "set_key binary, members binary")
    made.write.parquet(at)  # hashes don't compress
    sets = spark.read.schema("set_key binary, members binary").parquet(at).dropDuplicates(["set_key"])
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    dealt = pairs.join(degree, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int")).drop("shares")
    hubs = degree.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("a", "share", F.lit(None).cast("binary").alias("b"), F.col("a").alias("set_key"))
    rows = dealt.select("a", "share", "b", F.col("b").alias("set_key")).unionByName(hubs).join(sets, "set_key").drop("set_key")
    rows = rows.repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    return rows.select("a", "share", "b", "members").mapInArrow(_verified(threshold), "u binary, v binary"), [pairs_at, at]


def _joined(spark: SparkSession, edges: DataFrame, scratch: list[str]) -> DataFrame:
    """``components`` of edges; what they were made from goes."""
    found = components(edges)
    for path in scratch:
        remove(spark, path)
    free_shuffles(spark)
    return found


def classes(documents: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, text_key, set_key, root): root is the class of the component, null for documents without shingles."""
    spark = documents.sparkSession
    texts = documents.select("text")
    ranks = spark.sparkContext.broadcast(_ranks(texts, words))
    at, lists_at, kinds_at, rows_at = (scratch_path(spark, f"shingle-{x}") for x in ("prefixes", "lists", "classes", "rows"))
    documents.select("doc_id", "text").mapInArrow(_sets(words, threshold, ranks), _SETS).write.option("compression", "zstd").parquet(at)
    held = spark.read.schema(_SETS).parquet(at)
    members = checkpointed(held.select("doc_id", "n", "set_key", "text_key"))
    posted = held.where("prefix is not null").select(F.posexplode("prefix").alias("nth", "shingle"), "group", "n")
    posted = posted.select("shingle", "group", (F.col("n") - F.col("nth")).alias("left"), "n")  # this shingle and those after it
    posted = posted.repartition("shingle").sortWithinPartitions("shingle", "group")
    posted.mapInArrow(_shared_postings(threshold), _LISTS).write.option("compression", "zstd").parquet(lists_at)
    del posted
    free_shuffles(spark)
    # classes of one group meet in a list of its own: the prefix they share may be in no other list, or only in a late place
    grouped = held.where("n > 0").select("set_key", "n", "group").distinct().groupBy("group").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    grouped = checkpointed(grouped)
    several = grouped.where("classes > 2")  # two are paired below
    several.select(F.col("group").alias("shingle"), "group", F.col("n").alias("left"), F.col("group").alias("hub"), F.col("n").alias("hub_left")).write.mode("append").option("compression", "zstd").parquet(lists_at)
    lists = spark.read.schema(_LISTS).parquet(lists_at)
    # what follows is about the classes that may have a link
    met = lists.select("group").distinct().union(grouped.select("group")).distinct()
    held.where("n > 0").join(met, "group", "left_semi").groupBy("set_key", "n", "group").agg(F.min("doc_id").alias("rep"), F.max("bits").alias("bits")).write.parquet(kinds_at)
    kinds = spark.read.schema("set_key binary, n int, group long, rep long, bits binary").parquet(kinds_at)
    remove(spark, at)
    free_shuffles(spark)

    first = kinds.groupBy("group").agg(F.min("set_key").alias("first"), F.min("n").alias("n"))
    in_groups = kinds.select("set_key", "group").join(first.drop("n"), "group").where("first != set_key").select(F.col("first").alias("a"), F.col("set_key").alias("b"))
    # of the shingles that a group shares with a hub, the one that leaves most speaks for all
    to_hubs = lists.where("group != hub").groupBy("group", "hub").agg(F.max(F.least("left", "hub_left")).alias("rest"))
    hub = first.select(F.col("group").alias("hub"), F.col("first").alias("a"), F.col("n").alias("m"))
    to_hubs = to_hubs.join(hub, "hub").join(first.withColumnRenamed("first", "b"), "group").where(_reachable("rest", "n", "m", threshold)).select("a", "b")
    of = checkpointed(kinds.select("set_key", F.col("set_key").alias("root")))
    of, _ = _contracted(spark, of, *_links(documents, kinds, in_groups.unionByName(to_hubs), words, threshold))

    lists.select("shingle", "group", "left").join(kinds.select("group", "set_key", "n"), "group").drop("group").write.option("compression", "zstd").parquet(rows_at)
    remove(spark, lists_at)
    open_lists = _open_lists(spark.read.schema("shingle long, left int, set_key binary, n int").parquet(rows_at), of)
    for turn in range(MAX_ROUNDS):
        # the classes of other components than that of the one drawn from the list meet it
        draw = F.xxhash64("set_key", "shingle", F.lit(turn))
        hubs = open_lists.groupBy("shingle").agg(F.min_by(F.struct("set_key", "part", "n", "left"), draw).alias("h"))
        hubs = hubs.select("shingle", F.col("h.set_key").alias("x"), F.col("h.part").alias("p"), F.col("h.n").alias("m"), F.col("h.left").alias("l"))
        pairs = open_lists.join(hubs, "shingle").where((F.col("part") != F.col("p")) & _reachable(F.least("left", "l"), "n", "m", threshold))
        pairs = pairs.select(F.least("x", "set_key").alias("a"), F.greatest("x", "set_key").alias("b")).distinct()
        parts = open_lists.select("part").distinct().count()
        if not parts:
            break
        of, gained = _contracted(spark, of, *_links(documents, kinds, pairs, words, threshold))
        open_lists = _open_lists(open_lists.drop("part"), of)
        del pairs, hubs
        free_shuffles(spark)
        if gained * ROUND_GAIN < parts:
            break
    pairs = _left_pairs(open_lists, kinds, threshold)
    final, _ = _contracted(spark, of, *_links(documents, kinds, pairs, words, threshold))
    for path in (kinds_at, rows_at):
        remove(spark, path)
    found = members.join(final, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "text_key", "set_key", "root")


def _contracted(spark: SparkSession, of: DataFrame, links: DataFrame, scratch: list[str]) -> tuple[DataFrame, int]:
    """``of`` (set_key, root) with the components that links join made one, and how many roots that cost."""
    joined = links.join(of.select(F.col("set_key").alias("u"), F.col("root").alias("p")), "u").join(of.select(F.col("set_key").alias("v"), F.col("root").alias("q")), "v")
    last = _joined(spark, joined.select(F.col("p").alias("u"), F.col("q").alias("v")), scratch)
    return checkpointed(of.join(last.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("set_key", F.coalesce("top", "root").alias("root"))), last.count()


def _left_pairs(open_lists: DataFrame, kinds: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of the classes of different components that meet in a list and that sizes, places and sketches leave."""
    sketches = kinds.join(open_lists.select("set_key").distinct(), "set_key", "left_semi").select("set_key", "bits").mapInArrow(_sketches, f"set_key binary, {_SKETCHES}")
    rows = checkpointed(open_lists.join(sketches, "set_key"))
    parts = checkpointed(rows.groupBy("shingle", "part").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("left").alias("rest")))
    like = lambda least, most, least2, most2: (100 * F.col(most) >= threshold * F.col(least2)) & (100 * F.col(most2) >= threshold * F.col(least))
    other = parts.select("shingle", F.col("part").alias("other"), *(F.col(c).alias(f"{c}2") for c in ("size", "least", "most", "rest")))
    met = parts.join(other, "shingle").where((F.struct("size", "part") < F.struct(F.col("size2").alias("size"), F.col("other").alias("part"))) & like("least", "most", "least2", "most2") & _reachable(F.least("rest", "rest2"), "least", "least2", threshold))
    met = met.select("shingle", "part", "other", "size2", "least2", "most2", "rest2")
    side = lambda x: rows.select("shingle", "part", F.col("set_key").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "left", *(f"s{i}" for i in range(SKETCH_WORDS)))))
    met = met.join(side("x"), ["shingle", "part"]).where(like("x_n", "x_n", "least2", "most2") & _reachable(F.least("x_left", "rest2"), "x_n", "least2", threshold)).drop("part")
    # the classes of a large component are dealt into shares; one that meets them goes to each
    shares = lambda size: F.ceil(F.col(size) / SHARE).cast("int")
    met = met.withColumn("share", F.explode(F.sequence(F.lit(0), shares("size2") - 1)))
    large = side("y").join(parts.select("shingle", "part", "size"), ["shingle", "part"]).withColumn("share", F.pmod(F.xxhash64("y"), shares("size")).cast("int")).withColumnRenamed("part", "other").drop("size")
    apart = reduce(add, (F.bit_count(F.col(f"x_s{i}").bitwiseXOR(F.col(f"y_s{i}"))) for i in range(SKETCH_WORDS)))
    alike = (100 + threshold) * apart <= (100 - threshold) * (F.col("x_n") + F.col("y_n"))
    pairs = met.join(large, ["shingle", "other", "share"]).where(_reachable(F.least("x_left", "y_left"), "x_n", "y_n", threshold) & alike)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _open_lists(rows: DataFrame, of: DataFrame) -> DataFrame:
    """(shingle, set_key, n, left, part) of the lists that hold several components. The others stay as they are from then on, and leave."""
    held = rows.join(of.select("set_key", F.xxhash64("root").alias("part")), "set_key")
    mixed = held.groupBy("shingle").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi").select("shingle")
    return checkpointed(held.join(mixed, "shingle"))


def _reachable(rest, n: str, m: str, threshold: int):
    """Sets of n and m shingles could link if the first one they share and the ``rest`` after it were all in common."""
    return (100 + threshold) * F.lit(rest if not isinstance(rest, str) else F.col(rest)) >= threshold * (F.col(n) + F.col(m))


def with_components(documents: DataFrame, **how: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document."""
    found = checkpointed(classes(documents, **how))
    least = found.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return found.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def apply(documents: DataFrame, **how: int) -> DataFrame:
    """One document of each component: that with the least id, and of equal ids that with the least digest of its text; a
    repeated row stays once. Documents without shingles are linked with none and all stay."""
    found = checkpointed(classes(documents, **how)).where("root is not null")
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("least"))
    own, text, nth = (unused(documents, x) for x in ("id", "text_key", "nth"))
    chosen = least.select(F.coalesce(F.col("least.doc_id").cast("string"), F.lit("-")).alias(own), F.col("least.text_key").alias(text))
    keyed = documents.withColumns({own: F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text: F.unhex(F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))})
    once = Window.partitionBy(own, text).orderBy(F.lit(0))
    kept = keyed.join(chosen, [own, text], "left_semi").withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1)
    blank = documents.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*documents.columns).unionByName(blank)


def join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_components(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < {WORDS} THEN array_to_string(ws, ' ') ELSE array_to_string(list_slice(ws, i, i + {WORDS - 1}), ' ') END AS g
  FROM w, unnest(range(1, CAST(greatest(len(ws) - {WORDS - 2}, 2) AS BIGINT))) AS t(i) WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= {THRESHOLD} * (p.n + q.n - common)
), ways AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN ways b ON r.y = b.x
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(y) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id, n
"""

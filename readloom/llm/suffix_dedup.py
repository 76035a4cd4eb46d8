"""Suffix-array deduplication: bytes under strings of ``LENGTH`` bytes that start more than once in the corpus.

Suffixes are sorted where they can matter. Every window of LENGTH bytes has a minimizer, the q-gram of least hash in it,
at the same place in equal windows; so the windows of a document fall into runs with one minimizer each, and equal windows
always meet under the key of their minimizer. A run's context is the bytes its windows cover.

1. Count keys and context digests. Keys seen once are done with: their windows start once.
2. A context whose digest is seen twice is repeated whole. A run is cut into blocks by distance from the minimizer; the
   bytes that all windows of a block share, its core, must be seen in two contexts for any of them to be repeated. The
   windows of such blocks are sorted with those of their key by bucket-pointer refinement: buckets of equal q-grams are
   refined by the bucket identifiers at a later offset, and the refined identifiers are used again for the next, doubled
   depth, up to LENGTH; buckets of one suffix are final and sort no more. Windows left in a bucket of two or more are
   repeated.
3. Keys with over ``HOT_BYTES`` of contexts never meet in one task: there each window is counted by its 128-bit digest, by
   a combining aggregate. So what is sorted at once has a bound in bytes, ``BLOCK_BYTES`` and one such key's.
4. Repeated windows give spans by text; overlapping spans merge; the text is cut.

Documents are held by digest of their text, so equal ones, whatever their ids, share their spans. Two bit filters of
bounded size (``MAX_FILTER_BITS``) keep unrepeated keys from shuffling; what they let pass by chance is dropped by a join.

Defined results: null text is empty and loses nothing, as do texts shorter than LENGTH; a repeated row is a copy, so both
lose all their windows; null ids are kept; extra columns pass through ``apply`` and are ignored elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import free_shuffles, remove, scratch_path, slices, table

LENGTH = 400
GRAM = 64
HOT_BYTES = 6 << 20
CORE_SHARE = 6
MAX_FILTER_BITS = 27
BLOCK_BYTES = 1 << 16  # of contexts, sorted at once: what the sort makes of them stays in a core's own cache
MAX_BROADCAST_KEYS = 1_000_000
DICTIONARY_TEXTS = 200
DICTIONARY_BYTES = 100_000
PACK_LEVEL = 3
CHUNK = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


class _Minimizers:
    """The runs of windows that share a minimizer."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.span = length, gram, length - gram + 1
        rng = np.random.default_rng(7)
        self.of_byte = rng.integers(0, 2**64, 256, np.uint64)
        base = 0x5851F42D4C957F2D
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK + length, np.uint64(base))]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK + length, np.uint64(pow(base, -1, 2**64)))]), dtype=np.uint64)

    def runs(self, data: bytes) -> Iterator[tuple[int, int, int, int]]:
        """(key, first window, last window, minimizer) for all windows of ``data``; a run is never longer than the span."""
        if len(data) < self.length:
            return
        for at in range(0, len(data) - self.length + 1, CHUNK - self.length + 1):
            part = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - at), at)
            keys, first, last, places = self._chunk(part)
            yield from zip(keys.tolist(), (first + at).tolist(), (last + at).tolist(), (places + at).tolist(), strict=True)
            if at + len(part) == len(data):
                return

    def _chunk(self, part: np.ndarray) -> tuple[np.ndarray, ...]:
        n, q, w = len(part), self.gram, self.span
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.of_byte[part] * self.down[:n], out=sums[1:])
            hashes = (sums[q:] - sums[:-q]) * self.up[: n - q + 1]
            hashes ^= hashes >> np.uint64(31)
            hashes *= _MIX
            hashes ^= hashes >> np.uint64(29)
        m = len(hashes)
        # the least hash, leftmost among equals: its high bits, then the place
        ranked = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(m, dtype=np.uint64)
        padded = np.full(-(-m // w) * w, ~np.uint64(0))
        padded[:m] = ranked
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = m - w + 1
        places = np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & np.uint64(0xFFFFFF)
        first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        last = np.concatenate([first[1:] - 1, [windows - 1]])
        places = places[first].astype(np.int64)
        return hashes[places].view(np.int64), first, last, places


def _cores(length: int, block: int, data: bytes, first: int, last: int, place: int) -> list[tuple[int, int, int]]:
    """(hash of the core, first window, last window) of the blocks of a run.

    Blocks are counted from the minimizer, so equal windows lie in equal blocks; the core is what all windows of a block,
    here or elsewhere, have in common. A core seen in no other context rules its windows out.
    """
    out = []
    while first <= last:
        far = (place - first) // block
        end = min(last, place - far * block)
        low = place - far * block
        out.append((xxhash.xxh3_64_intdigest(data[low : low - block + 1 + length], seed=far) - (1 << 63), first, end))
        first = end + 1
    return out


def _windows(length: int, first: int, last: int) -> slice:
    return slice(first, last + length)


def _counts(length: int, gram: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Minimizers(length, gram)
        for batch in slices(batches):
            keys, digests, cores = [], [], []
            for text in batch.column(0).to_pylist():
                data = (text or "").encode()
                for key, first, last, place in find.runs(data):
                    keys.append(key)
                    digests.append(xxhash.xxh3_128_digest(data[_windows(length, first, last)]))
                    cores.append([c for c, _, _ in _cores(length, block, data, first, last, place)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(digests, pa.binary()), pa.array(cores, pa.list_(pa.int64()))], ["key", "digest", "cores"])

    return run


def _bit_filter(keys: DataFrame, column: str = "key", spread: int = 10) -> tuple[np.ndarray, int]:
    """Bits by the high part of a key: 2^MAX_FILTER_BITS at most, gathered as 64-bit words; of other keys one in ``spread`` passes, or fewer."""
    n = keys.count()
    bits = min(MAX_FILTER_BITS, max(16, (spread * n).bit_length()))
    place = F.shiftrightunsigned(column, 64 - bits)
    words = keys.select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
    return out.view(np.uint64), bits


def _passes(held: tuple[np.ndarray, int], keys: np.ndarray) -> np.ndarray:
    words, bits = held
    place = keys.view(np.uint64) >> np.uint64(64 - bits)
    return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def text_key(data: bytes) -> bytes:
    return hashlib.md5(data).digest()


_PLACES = "digest binary, text_key binary, first long, last long"
_CONTEXTS = "key long, digest binary, a long, context binary"


def _packing_words(texts: DataFrame) -> bytes:
    """A dictionary for packing contexts, from a few texts; it has no bearing on results."""
    sample = [t.encode() for (t,) in texts.where("text is not null").select(F.substring("text", 1, 20_000)).limit(DICTIONARY_TEXTS).collect()]
    pieces = [t[i : i + 600] for t in sample for i in range(0, len(t), 600)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too few
        return b""


def _dictionary(words: bytes) -> zstandard.ZstdCompressionDict:
    found = zstandard.ZstdCompressionDict(words)
    if words:  # prepared once, not for each context
        found.precompute_compress(level=PACK_LEVEL)
    return found


def _found(length: int, gram: int, block: int, filtered, words: bytes | None):
    """The places of contexts whose keys pass the filter; or, given ``words``, the contexts, packed, once for each task."""
    types = [pa.binary(), pa.binary(), pa.int64(), pa.int64()] if words is None else [pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in (_PLACES if words is None else _CONTEXTS).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held, shown, texts = _Minimizers(length, gram), filtered.value, set(), set()
        pack = zstandard.ZstdCompressor(level=PACK_LEVEL, dict_data=_dictionary(words)).compress if words is not None else None
        for batch in slices(batches, 64):
            rows = []
            for text in batch.column(0).to_pylist():
                data = (text or "").encode()
                runs = list(find.runs(data))
                if not runs:
                    continue
                own = text_key(data)
                if own in texts:  # an equal text of this task has told the same
                    continue
                texts.add(own)
                if pack is None:
                    for i in np.flatnonzero(_passes(held, np.array([r[0] for r in runs], np.int64))).tolist():
                        key, first, last, _ = runs[i]
                        rows.append((xxhash.xxh3_128_digest(data[_windows(length, first, last)]), own, first, last))
                    continue
                cores = [(r, c) for r in runs for c in _cores(length, block, data, *r[1:])]
                before = None
                for i in np.flatnonzero(_passes(held, np.array([c[0] for _, c in cores], np.int64))).tolist():
                    run_, (_, first, last) = cores[i]
                    digest = before if before and before[0] is run_ else (run_, xxhash.xxh3_128_digest(data[_windows(length, run_[1], run_[2])]))
                    before = digest
                    if (name := (digest[1], first - run_[1])) not in shown:
                        shown.add(name)
                        rows.append((run_[0], digest[1], first - run_[1], pack(data[_windows(length, first, last)])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

    return run


def _grouped(values: np.ndarray) -> np.ndarray:
    """An order of ``values`` in which equal ones stand together.

    Mixed values are sorted with their places in the low bits, which is several times faster than an indirect sort; the few
    runs whose high bits agree by chance are then put in order by the whole values.
    """
    low = np.uint64(max(1, int(len(values) - 1).bit_length()))
    mask = (np.uint64(1) << low) - np.uint64(1)
    packed = values >> np.uint64(32)  # in place from here on
    packed ^= values
    packed *= _MIX
    packed ^= packed >> np.uint64(29)
    packed &= ~mask
    packed |= np.arange(len(values), dtype=np.uint64)
    packed.sort()
    order = (packed & mask).view(np.int64)
    packed >>= low
    alike = packed[1:] == packed[:-1]
    if (alike & (values[order[1:]] != values[order[:-1]])).any():
        run = np.concatenate([[0], np.cumsum(~alike)])
        mixed_runs = np.isin(run, run[1:][alike & (values[order[1:]] != values[order[:-1]])])
        rows = np.flatnonzero(mixed_runs)
        order[rows] = order[rows][np.lexsort((values[order[rows]], run[rows]))]
    return order


def repeated_starts(text: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Places in ``text`` where a string of ``length`` bytes starts that starts elsewhere too, by bucket-pointer refinement.

    ``ends``: for each place, the end of the stretch that holds it, which no string crosses.
    """
    n, depth = len(text), min(8, length)
    if n < depth:
        return np.zeros(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for k in range(depth):
        grams[: n - k] = (grams[: n - k] << np.uint64(8)) | text[k:]
    with np.errstate(over="ignore"):
        while 2 * depth <= min(GRAM, length, n):  # q-grams of up to GRAM bytes, hashed to 64 bits
            longer = grams.copy()
            longer[: n - depth] = (grams[: n - depth] ^ (grams[: n - depth] >> np.uint64(29))) * _MIX + (grams[depth:] ^ (grams[depth:] >> np.uint64(32))) * _MIX2
            grams, depth = longer, 2 * depth
    return refined(grams, depth, ends, length)[0]


def refined(grams: np.ndarray, depth: int, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, buckets) of the strings of ``length`` symbols that start more than once; equal strings have one bucket.

    ``grams``: for each place, the ``depth`` symbols that start there, as 64 bits.
    """
    n = len(grams)
    left = ends - np.arange(n)
    at = np.flatnonzero(left >= depth)
    grams = grams[at]
    bucket = np.arange(n, dtype=np.int64)  # a place on its own has an identifier of its own
    next_id = n

    def refine(at: np.ndarray, order_by: np.ndarray) -> np.ndarray:
        """Gives equal values one identifier, different ones others; returns the places that share theirs."""
        nonlocal next_id
        if not len(at):
            return at
        order = _grouped(order_by)
        ranked = order_by[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1], [True]])
        shared = ~(new[1:] & new[:-1])
        placed = at[order]
        bucket[placed] = next_id + np.cumsum(new[:-1]) - 1  # those alone in a bucket as well: later offsets point to them
        next_id += len(at)
        keep = np.zeros(n, bool)
        keep[placed[shared]] = True
        return np.flatnonzero(keep)

    at = refine(at, grams)
    while depth < length and len(at):
        # the string at a place: the bucket of its first bytes, then the bucket at a later offset
        step = min(depth, length - depth)
        at = at[left[at] >= depth + step]
        pairs = bucket[at].astype(np.uint64) << np.uint64(32) | bucket[at + step].astype(np.uint64)
        if next_id + len(at) >= 1 << 32:  # identifiers fit 32 bits
            _, bucket = np.unique(bucket, return_inverse=True)
            next_id = n
            pairs = bucket[at].astype(np.uint64) << np.uint64(32) | bucket[at + step].astype(np.uint64)
        at = refine(at, pairs)
        depth += step
    return at, bucket[at]


def _spans_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + length).tolist(), strict=True))


def _refined(length: int, words: bytes):
    types = [pa.binary(), pa.int64(), pa.int64()]

    def solve(held: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
        sizes = np.array([len(c) for _, _, c in held])
        text = np.frombuffer(b"".join(c for _, _, c in held), np.uint8)
        ends = np.repeat(np.cumsum(sizes), sizes)
        found = repeated_starts(text, ends, length)
        begin = np.cumsum(sizes) - sizes
        bounds = np.searchsorted(found, np.concatenate([begin, [len(text)]]))
        rows = [(d, o + a, o + b) for i, (d, o, _) in enumerate(held) if bounds[i] < bounds[i + 1] for a, b in _spans_of(found[bounds[i] : bounds[i + 1]] - begin[i], length)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), types, strict=True)], ["digest", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, before = [], 0, None
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(words)).decompress
        for batch in batches:
            for key, digest, offset, context in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != before and size >= BLOCK_BYTES:
                    yield solve(held)
                    held, size = [], 0
                before = key
                held.append((digest, offset, unpack(context)))
                size += len(held[-1][2])
        if held:
            yield solve(held)

    return run


def _window_digests(length: int, words: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(words)).decompress
        for batch in slices(batches, 16):
            rows = [(d, o + i, xxhash.xxh3_128_digest(c[i : i + length])) for d, o, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), map(unpack, batch.column(2).to_pylist()), strict=True) for i in range(len(c) - length + 1)]
            types = [pa.binary(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], ["digest", "a", "window"])

    return run


def repeated_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(text_key, spans array<struct<a, b>>) of the texts with repeated strings; spans overlap or not, in any order. What it
    reads is a table in the shared folder; those made on the way are removed."""
    spark, block = documents.sparkSession, max(1, length // CORE_SHARE)
    texts = documents.select("text")
    seen = texts.mapInArrow(_counts(length, gram, block), "key long, digest binary, cores array<long>").groupBy("key", "digest", "cores").agg(F.count(F.lit(1)).alias("n"))
    keys_at, seen_at, found_at, extra_at = (scratch_path(spark, f"suffix-{x}") for x in ("keys", "digests", "contexts", "spans"))
    seen.write.parquet(seen_at)
    seen = spark.read.parquet(seen_at)
    free_shuffles(spark)
    seen.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").write.parquet(keys_at)
    per_key = spark.read.parquet(keys_at)
    share = spark.sparkContext.broadcast
    cores_at = scratch_path(spark, "suffix-cores")
    cores = seen.select("key", F.explode("cores").alias("core")).groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).where("n > 1")
    cores.write.parquet(cores_at)
    cores = spark.read.schema("core long, n long, key long").parquet(cores_at)
    several, bits = _bit_filter(cores, "core")
    free_shuffles(spark)
    words = _packing_words(texts)
    # contexts go from the scan into one shuffle
    shown = texts.mapInArrow(_found(length, gram, block, _Shared(share(several), bits), words), _CONTEXTS)
    # blocks of repeated cores are what meets under a key; one key for each hot_bytes of them at most
    hot_keys = cores.groupBy("key").agg((F.sum("n") * (block - 1 + length)).alias("bytes")).where(F.col("bytes") > hot_bytes).select("key")
    n_hot = hot_keys.count()
    hot_keys = F.broadcast(hot_keys) if n_hot <= MAX_BROADCAST_KEYS else hot_keys
    cool = shown.join(hot_keys, "key", "left_anti") if n_hot else shown
    cool = cool.repartition("key").sortWithinPartitions("key", "digest", "a")
    spans = cool.mapInArrow(_once(_refined(length, words)), "digest binary, a long, b long")
    if n_hot:
        hot = shown.join(hot_keys, "key", "left_semi").select("digest", "a", "context").dropDuplicates(["digest", "a"])
        windows = hot.mapInArrow(_window_digests(length, words), "digest binary, a long, window binary")
        twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
        spans = spans.unionByName(windows.join(twice, "window").select("digest", "a", (F.col("a") + length).alias("b")))
    spans.write.parquet(extra_at)
    spans = spark.read.parquet(extra_at)
    del shown, cool
    free_shuffles(spark)

    repeated, bits = _bit_filter(per_key)
    texts.mapInArrow(_found(length, gram, block, _Shared(share(repeated), bits), None), _PLACES).write.option("compression", "zstd").parquet(found_at)
    found = spark.read.parquet(found_at)
    places = found.select("digest", "text_key", "first", "last").distinct()
    whole = seen.where("n > 1").select("digest").join(places, "digest").select("text_key", F.col("first").alias("a"), (F.col("last") + length).alias("b"))
    part = spans.join(places, "digest").select("text_key", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    spans_at = scratch_path(spark, "suffix-repeated")
    whole.unionByName(part).groupBy("text_key").agg(F.collect_set(F.struct("a", "b")).alias("spans")).write.option("compression", "zstd").parquet(spans_at)
    for path in (keys_at, seen_at, cores_at, extra_at, found_at):
        remove(spark, path)
    free_shuffles(spark)
    return spark.read.schema("text_key binary, spans array<struct<a: long, b: long>>").parquet(spans_at)


class _Shared:
    """A broadcast bit filter."""

    def __init__(self, words, bits: int):
        self.words, self.bits = words, bits

    @property
    def value(self) -> tuple[np.ndarray, int]:
        return self.words.value, self.bits


def _once(solve):
    """``solve`` over contexts sorted by key and digest, without repetitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def distinct():
            before = None
            for batch in batches:
                keep = []
                for i, piece in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    if piece != before:
                        keep.append(i)
                    before = piece
                yield batch.take(pa.array(keep, pa.int64()))

        yield from solve(distinct())

    return run


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The spans as maximal runs; such as touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(data)]
    return b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def _with_spans(documents: DataFrame, **how: int) -> DataFrame:
    keyed = documents.withColumn("text_key", F.unhex(F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))))
    return keyed.join(repeated_spans(documents, **how), "text_key", "left").drop("text_key")


_DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 4 + [pa.string()]
    for batch in slices(batches):
        rows = []
        for doc_id, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data, runs = (text or "").encode(), merged(spans)
            rows.append((doc_id, len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(data, runs)).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], [x.split()[0] for x in _DIGESTS.split(", ")])


def digests(documents: DataFrame, **how: int) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _with_spans(documents.select("doc_id", "text"), **how).select("doc_id", "text", "spans").mapInArrow(_digests, _DIGESTS)


def _cut(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                if text and spans:
                    data = text.encode()
                    text = kept_bytes(data, [(a, b) for a, b in merged(spans) if not min_words or len(data[a:b].split()) >= min_words]).decode(errors="ignore")
                texts.append(text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).drop_columns(["__spans"])

    return run


def apply(documents: DataFrame, min_words: int = 0, **how: int) -> DataFrame:
    """``documents`` without the repeated bytes; what is left of a cut character goes as well; n_chars follows the text.

    With ``min_words`` only maximal runs of as many words go, cut ones at their ends included.
    """
    spans = _with_spans(documents.withColumnRenamed("spans", "__own") if "spans" in documents.columns else documents, **how)
    spans = spans.withColumnRenamed("spans", "__spans").withColumnRenamed("__own", "spans")
    cut = spans.mapInArrow(_cut(min_words), spans.drop("__spans").schema)
    if "n_chars" in documents.columns:
        cut = cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long")))
    return cut.select(*documents.columns)


def suffix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))

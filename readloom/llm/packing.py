"""Sum-of-squares packing of tokenised documents into sequences.

A document's ids (and id 0 after them) are cut into pieces of at most ``CAPACITY`` tokens only if they are longer. Pieces
are packed by the sum-of-squares rule: with N(g) open sequences that have g tokens left, each piece goes where the sum of
N(g)^2 becomes smallest; a sequence is opened only for a piece that fits in no open one. Pieces come in falling length,
which the rule, being on-line, leaves free; on the test tables this meets the bound ceil(tokens / capacity) to within one
sequence for each shard.

At scale nothing but counts decides: pieces are ranked within their length, dealt to shards by rank, so that each shard
gets the same mix of lengths, and each shard is packed from its at most ``CAPACITY`` counts in one task. What the shard
finds goes back to the pieces by (length, rank), a key that no two pieces share. So equal documents, however many, spread
over all shards, and a shard's work has a bound (``SHARD_PIECES``).

Defined results: a null or empty text is one piece, the id 0; repeated rows are packed each; a null id is kept.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import Remembered, checkpointed, slices, table

CAPACITY = 2048
SHARD_PIECES = 20_000
CACHE_WORDS = 200_000  # and as many again of the older generation: some 80 MB a worker at most
MAX_TASKS = 10_000
END_ID = b"\0\0\0\0"

#: The word pattern of the tokenizer file: a fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|[^\sA-Za-z0-9À-ÖØ-öø-ɏªºµ²³¹¼½¾]+"
#: Texts of these characters alone take the short way below; tests hold it against the library for each of them.
_PLAIN = re.compile("[\t\n\r -~¡-©«-±´¶-¸»¿-ÖØ-öø-ıĴ-ňŊ-ž]*")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter for each byte in byte-level models: itself if it prints, else the next of those from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


@functools.cache
def encoder(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian 32-bit numbers, equal to the library's; one for each process, so that its cache serves all tasks of a worker."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    merge, letters = tokenizer.model.tokenize, _byte_letters()

    def of_word(word: str) -> bytes:
        """The library's model on one word, in the letters that stand for its bytes; those of printing ASCII are itself."""
        ids = array("I", [t.id for t in merge(word if word.isascii() else "".join(map(letters.__getitem__, word.encode())))])
        return ids.tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()

    words, find = Remembered(of_word, CACHE_WORDS), re.compile(WORDS).findall

    def encode(text: str) -> bytes:
        if _PLAIN.fullmatch(text) and "<|" not in text and unicodedata.is_normalized("NFC", text):
            return b"".join(map(words.__getitem__, find(text.lower())))
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return encode


_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


def _cut(path: str, capacity: int, with_ids: bool):
    schema = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]
    schema += [("ids", pa.binary())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + END_ID
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(own), part, seen[n], own)[: len(schema)])
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), schema, strict=True)], [n for n, _ in schema])

    return run


def pieces(documents: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents; (part, nth) numbers those of a length within their task."""
    cut = _cut(tokenizer_path or default_tokenizer(), capacity, with_ids)
    return documents.select("doc_id", "text").mapInArrow(cut, _PIECES + ", ids binary" * with_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each piece, in order: its sequence, its place there; and the number of sequences."""
    n_open = np.zeros(capacity + 1, np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        # an open sequence of gap g becomes one of gap g - s: the sum changes by 2 - 2 N(g) + 2 N(g - s), or by
        # 1 - 2 N(s) if the piece fills it
        change = 2 - 2 * n_open[s:] + 2 * n_open[: capacity + 1 - s]
        change[0] = 1 - 2 * n_open[s]
        change[n_open[s:] == 0] = 4 * len(lengths) + 4
        gap = s + int(change.argmin())
        if n_open[gap]:
            own = by_gap[gap].pop()
            n_open[gap] -= 1
        else:
            own, gap, n = n, capacity, n + 1
        where[i], offset[i] = own, capacity - gap
        if gap > s:
            by_gap[gap - s].append(own)
            n_open[gap - s] += 1
    return where, offset, n


def _pack_shard(capacity: int):
    def run(counts: pd.DataFrame) -> pd.DataFrame:
        counts = counts.sort_values("length", ascending=False)
        lengths = np.repeat(counts["length"].to_numpy(), counts["n"].to_numpy())
        nth = np.concatenate([np.arange(n) for n in counts["n"]])
        where, offset, _ = sum_of_squares(lengths, capacity)
        return pd.DataFrame({"shard": counts["shard"].iloc[0], "length": lengths, "slot": nth, "own": where, "offset": offset})

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``cut`` (see ``pieces``, read from stable storage) with sequence_id and offset."""
    per_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_part.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "part", "first")
    totals = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n"))  # as many rows as there are lengths
    shards = max(1, -(-(totals.where(F.col("length") < capacity).agg(F.sum("n")).first()[0] or 0) // shard_pieces))
    ranked = cut.join(firsts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("nth")).drop("first", "part", "nth")
    # rank r of a length goes to shard r mod shards, shifted by the length, as slot r div shards
    shard_of = F.pmod(F.col("rank") + F.col("length"), F.lit(shards)).cast("int")
    ranked = ranked.withColumn("shard", shard_of).withColumn("slot", F.floor(F.col("rank") / shards))
    counts = totals.where(F.col("length") < capacity).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    lead = F.pmod(F.col("shard") - F.col("length"), F.lit(shards))
    counts = counts.withColumn("n", F.greatest(F.lit(0), F.ceil((F.col("n") - lead) / shards)).cast("int")).where("n > 0")
    # a number of partitions of one's own, else adaptive execution takes these small rows for one task's work
    packed = counts.repartition(min(shards, MAX_TASKS), "shard").groupBy("shard").applyInPandas(_pack_shard(capacity), "shard int, length int, slot long, own long, offset long")
    packed = packed.withColumn("sequence_id", F.col("own") * shards + F.col("shard")).drop("own")
    partial = ranked.where(F.col("length") < capacity).join(packed, ["shard", "length", "slot"])
    whole = ranked.where(F.col("length") == capacity).select("*", F.lit(0).cast("long").alias("offset"), (-1 - F.col("rank")).alias("sequence_id"))
    return partial.unionByName(whole).drop("shard", "slot", "rank")


def apply(documents: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = pack(checkpointed(pieces(documents, tokenizer_path, capacity)), capacity)
    return found.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"))

"""Fragment extraction: slice, cut at the first adapter, keep what is long enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.sequence import trim_at_adapters

MIN_LENGTH = 20


def head(reads: DataFrame, n: int) -> DataFrame:
    """The first n reads, in order of file, if told, and place."""
    return reads.orderBy(*[c for c in ("file", "ordinal") if c in reads.columns]).limit(n)


def sliced(reads: DataFrame, start: int, end: int = -1) -> DataFrame:
    """Sequence and quality from ``start`` to ``end`` (0-based, -1: the read's end)."""
    cut = lambda c: F.substring(c, F.lit(start + 1), F.length(c) - start if end < 0 else F.lit(end - start))
    return reads.withColumns({c: cut(F.col(c)) for c in ("seq", "qual") if c in reads.columns})


def trimmed(reads: DataFrame, adapters: list[str]) -> DataFrame:
    found = reads.withColumn("_at", trim_at_adapters("seq", adapters))
    return found.withColumns({c: F.substring(F.col(c), F.lit(1), F.col("_at")) for c in ("seq", "qual") if c in reads.columns}).drop("_at")


def extract(reads: DataFrame, start: int, end: int = -1, adapters: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The fragments of at least ``MIN_LENGTH`` bases, in order; ``limit`` counts fragments, not reads."""
    found = sliced(reads, start, end)
    found = (trimmed(found, adapters) if adapters else found).where(F.length("seq") >= MIN_LENGTH)
    return found if limit is None else found.orderBy("ordinal").limit(limit)


def as_fastq(fragments: DataFrame) -> DataFrame:
    """One column, the record as text."""
    return fragments.select("ordinal", F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit("_RPF\n"), "seq", F.lit("\n+\n"), "qual").alias("record"))


def as_fasta(fragments: DataFrame) -> DataFrame:
    return fragments.select("ordinal", F.concat(F.lit(">"), F.col("read_id").cast("string"), F.lit("_RPF\n"), "seq").alias("record"))

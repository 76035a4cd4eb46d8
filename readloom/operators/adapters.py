"""Adapter detection and the table of known adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions.sequence import best_adapter_match

#: Known adapters, in order: fixed values.
KNOWN_ADAPTERS = (
    ("Guo14", "TCGTATGCCGTCTTCTG"),
    ("Hakon2", "CACTCGGGCACCAAGGA"),
    ("Hakon3", "GTGTCAGTCACTTCCAGCGG"),
    ("Hakon4", "TGTAGGCACCATC"),
    ("Hakon5", "AAAAAAAAAA"),
    ("Hakon6", "TCGTATGCCGTCTTCTGCTT"),
    ("Kiniry1", "CTGTAGGCACCATCAAT"),
    ("Kiniry2", "AGATCGGAAGAGC"),
    ("Kiniry3", "CGCCTTGGCCGTACAGCAG"),
    ("Kiniry5", "TGGAATTCTCGGGTGCCAAGG"),
    ("Kiniry6", "CCTTGGCACCCGAGAATT"),
    ("Kiniry7", "GATCGGAAGAGCGTCGT"),
    ("Kiniry8", "CTGATGGCGCGAGGGAG"),
    ("Kiniry9", "GATCGGAAGAGCACACG"),
    ("Kiniry10", "AATGATACGGCGACCAC"),
    ("Kiniry11", "GATCGGAAGAGCTCGTA"),
    ("Kiniry12", "CAAGCAGAAGACGGCAT"),
    ("Kiniry13", "ACACTCTTTCCCTACA"),
    ("Kiniry14", "GATCGGAAGAGCGGTT"),
    ("Kiniry15", "ACAGGTTCAGAGTTCTA"),
    ("Kiniry16", "CAAGCAGAAGACGGCAT"),
    ("Kiniry17", "ACAGGTTCAGAGTTCTA"),
    ("Kiniry19", "TGATCGGAAGAGCACAC"),
    ("Kiniry20", "GATCGGAAGAGCACACGT"),
    ("Kiniry21", "AGATCGGAAGAGCAC"),
    ("Kiniry22", "AGATCGGAAGAGCACACGTCT"),
    ("Illumina Universal Adapter", "AGATCGGAAGAGC"),
    ("Illumina Small RNA 3' Adapter", "TGGAATTCTCGG"),
    ("Illumina Small RNA 5' Adapter", "GATCGTCGGACT"),
    ("Nextera Transposase Sequence", "CTGTCTCTTATA"),
    ("SOLID Small RNA Adapter", "CGCCTTGGCCGT"),
    ("Ingolia 2012 adapter", "CTGTAGGCACCATCAAT"),
    ("Illumina Uni. Adapter var2", "ATCGTAGATCGGAAG"),
    ("Tru-seq Small RNA", "TGGAATTCTCGGGTGCCAAGG"),
    ("Tru-seq Small RNA 2", "GGAATTCTCGGGTGCCAAGG"),
    ("Illumina", "CTGTCTCTTATACACATCT"),
)
SCANNED = 20
SCAN_SHARE = 0.1


def known_adapters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(KNOWN_ADAPTERS)], "idx int, name string, seq string")


def all_adapters() -> list[str]:
    """The distinct sequences, longest first, then by letters."""
    return sorted({s for _, s in KNOWN_ADAPTERS}, key=lambda s: (-len(s), s))


def by_length(adapters: DataFrame) -> DataFrame:
    """(place, seq): the distinct sequences of ``adapters``, longest first, then by letters. A table of adapters is short."""
    return adapters.select("seq").distinct().withColumn("place", F.row_number().over(Window.orderBy(F.length("seq").desc(), "seq")) - 1).select("place", "seq")


def matches(reads: DataFrame, adapter: str, min_overlap: int = 10, max_mismatches: int = 1) -> DataFrame:
    """Reads that hold the adapter, with mm, pos and variant, the bases matched. Row-local: nothing shuffles."""
    upper = reads.withColumn("seq", F.upper("seq"))
    # a generator of none or one row, so that no filter is pushed below the search and derives the read again
    match = F.array_compact(F.array(best_adapter_match("seq", adapter.upper(), min_overlap, max_mismatches)))
    found = upper.select("*", F.inline(match))
    return found.withColumn("variant", F.substring("seq", F.col("pos") + 1, F.lit(min_overlap)))


def histogram(found: DataFrame, by: str) -> DataFrame:
    return found.groupBy(by).agg(F.sum("cnt").alias("n"))


def match_summary(reads: DataFrame, adapter: str, min_overlap: int = 10, max_mismatches: int = 1) -> DataFrame:
    """One row (total, with_adapter, rate): the weighted percentage of reads with the adapter, 0 without reads."""
    hit = best_adapter_match("seq", adapter.upper(), min_overlap, max_mismatches).isNotNull()
    found = reads.withColumn("seq", F.upper("seq")).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(hit, F.col("cnt"))), F.lit(0)).alias("with_adapter"))
    return found.withColumn("rate", F.coalesce(F.try_divide(100 * F.col("with_adapter").cast("double"), F.col("total")), F.lit(0.0)))


def containment_counts(reads: DataFrame, adapters: tuple = KNOWN_ADAPTERS[:SCANNED]) -> DataFrame:
    """(idx, seq, n, total): how many reads hold each adapter, by one pass of conditional counts."""
    counted = reads.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.contains("seq", F.lit(s))).alias(str(i)) for i, (_, s) in enumerate(adapters)])
    rows = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(s).alias("seq"), F.col(str(i)).alias("n")) for i, (_, s) in enumerate(adapters)])
    return counted.select("total", F.explode(rows).alias("r")).select("r.idx", "r.seq", "r.n", "total")


def best_contained(reads: DataFrame) -> DataFrame:
    """One row (idx, seq, n, total) if the most frequent known adapter is in more than a tenth of the reads, else none."""
    best = containment_counts(reads).agg(F.max_by(F.struct("idx", "seq", "n", "total"), F.struct("n", -F.col("idx"))).alias("b"))
    return best.select("b.*").where(F.col("n") > SCAN_SHARE * F.col("total"))

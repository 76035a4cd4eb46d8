"""Quality control of a stream of reads: mergeable sums, in complete or update mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.sequence import best_adapter_match, gc_count


def running_lengths(reads: DataFrame) -> DataFrame:
    return reads.groupBy(F.length("seq").alias("len")).agg(F.sum("cnt").alias("n"))


def running_summary(reads: DataFrame, adapter: str) -> DataFrame:
    hit = best_adapter_match("seq", adapter).isNotNull()
    return reads.agg(F.sum("cnt").alias("total_reads"), F.sum(F.length("seq") * F.col("cnt")).alias("total_bases"), F.sum(gc_count() * F.col("cnt")).alias("gc_count"), F.sum(F.when(hit, F.col("cnt")).otherwise(0)).alias("with_adapter"))


def windowed_counts(reads: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Reads by event time (column ts), with late ones up to ``late``."""
    return reads.withWatermark("ts", late).groupBy(F.window("ts", every)).agg(F.sum("cnt").alias("n")).select("window.start", "n")

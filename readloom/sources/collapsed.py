"""Collapsed reads: counts in headers, last-wins deduplication and expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.sequence import header_count


def with_counts(records: DataFrame, template: str = "read_{id}_{count}") -> DataFrame:
    """(ordinal, header, seq) with cnt. Of records with one header the last one's values stay, at the first one's place."""
    counted = records.withColumn("cnt", header_count("header", template))
    return counted.groupBy("header").agg(F.min("ordinal").alias("ordinal"), F.max_by(F.struct("seq", "cnt"), "ordinal").alias("x")).select("ordinal", "header", "x.seq", "x.cnt")


def head(records: DataFrame, n: int) -> DataFrame:
    """The records before the n-th: a cap of n ends the reading when the n-th header is met, before its sequence. All, if there are fewer."""
    first = records.orderBy("ordinal").limit(n)
    met = first.agg(F.count(F.lit(1)).alias("_met"), F.max("ordinal").alias("_last"))
    return first.join(F.broadcast(met)).where((F.col("_met") < n) | (F.col("ordinal") < F.col("_last"))).drop("_met", "_last")  # one row


def join_counts(sequences: DataFrame, counts: DataFrame) -> DataFrame:
    """Sequences with their counts by header, 1 where there is none."""
    return sequences.join(counts, "header", "left").withColumn("cnt", F.coalesce("cnt", F.lit(1)))


def expand(records: DataFrame, limit: int | None = None) -> DataFrame:
    """(ordinal, copy, header, seq, qual): each record ``cnt`` times, with copy numbers from 1 and a constant quality."""
    rows = records.where("cnt > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("cnt").cast("long"))))
    rows = rows.select("ordinal", "copy", F.concat(F.lit("@"), "header", F.lit("_copy_"), F.col("copy").cast("string")).alias("header"), "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual"))
    return rows if limit is None else rows.orderBy("ordinal", "copy").limit(limit)


def fasta_to_fastq(records: DataFrame) -> DataFrame:
    return records.withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))



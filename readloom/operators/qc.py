"""Quality-control aggregates: lengths, base composition from both ends, qualities, GC and entropy.

Frequencies divide by all reads at every position, not by the reads that reach it, so they sum to less than 1 where reads
have ended. Weights are the ``cnt`` of collapsed reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.sequence import BASES, gc_count, phred, symbols


def length_histogram(reads: DataFrame) -> DataFrame:
    return reads.groupBy(F.length("seq").alias("len")).agg(F.sum("cnt").alias("n"), F.min("ordinal").alias("first_ordinal"))


def ends(counted: DataFrame) -> DataFrame:
    """Rows of (_n, _i), place i of the n of a read, once from the 5' end and once from the 3' end, as (end, pos)."""
    both = F.array(F.struct(F.lit("5p").alias("end"), F.col("_i").alias("pos")), F.struct(F.lit("3p").alias("end"), (F.col("_n") - 1 - F.col("_i")).alias("pos")))
    return counted.withColumn("_e", F.explode(both)).select("_e.end", "_e.pos", *[c for c in counted.columns if c not in ("_n", "_i")])


def bases_from_ends(reads: DataFrame) -> DataFrame:
    """(end, pos, symbol, cnt): the bases at each place from the 5' end and from the 3' end, with the reads that have them.

    One scan; what is counted is places of reads of one length, of which there are few, before either end is told.
    """
    found = reads.select("cnt", F.length("seq").alias("_n"), F.posexplode(symbols("seq")).alias("_i", "symbol"))
    return ends(found.groupBy("_n", "_i", "symbol").agg(F.sum("cnt").alias("cnt")))


def base_counts(reads: DataFrame) -> DataFrame:
    """(end, pos, A, C, G, T), zeros included; other symbols count for none."""
    upper = reads.withColumn("seq", F.upper("seq"))
    sums = [F.sum(F.when(F.col("symbol") == b, F.col("cnt")).otherwise(0)).alias(b) for b in BASES]
    return bases_from_ends(upper).groupBy("end", "pos").agg(*sums)


def base_frequencies(reads: DataFrame) -> DataFrame:
    """(end, pos, base, n, freq)."""
    total = reads.agg(F.sum("cnt").alias("total"))
    long = base_counts(reads).unpivot(["end", "pos"], list(BASES), "base", "n")
    return long.join(F.broadcast(total)).select("end", "pos", "base", "n", (F.col("n") / F.col("total")).alias("freq"))  # one row


def quality_profile(reads: DataFrame) -> DataFrame:
    """(pos, mean, std) of qualities, unweighted; the deviation is that of the population."""
    found = reads.where("qual is not null").select(F.posexplode(symbols("qual")).alias("pos", "q"))
    value = phred(F.col("q"), F.lit(0))
    return found.groupBy("pos").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n"))


def gc_summary(reads: DataFrame) -> DataFrame:
    """(total_reads, total_bases, gc_count, gc_pct); the percentage is null without bases."""
    upper = reads.withColumn("seq", F.upper("seq"))
    found = upper.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_reads"), F.coalesce(F.sum(F.length("seq") * F.col("cnt")), F.lit(0)).alias("total_bases"), F.coalesce(F.sum(gc_count() * F.col("cnt")), F.lit(0)).alias("gc_count"))
    return found.withColumn("gc_pct", F.try_divide(100 * F.col("gc_count").cast("double"), F.col("total_bases")))


def length_metrics(reads: DataFrame, low: int = 26, high: int = 35) -> DataFrame:
    """(total, in_range, fraction, mode, mode_fraction); the mode's ties go to the length seen first."""
    hist = length_histogram(reads)
    n = F.sum("n")
    inside = F.coalesce(F.sum(F.when(F.col("len").between(low, high), F.col("n"))), F.lit(0))
    found = hist.agg(n.alias("total"), inside.alias("in_range"), F.max_by("len", F.struct("n", -F.col("first_ordinal"))).alias("mode"), F.max("n").alias("mode_n"))
    return found.select("total", "in_range", (F.col("in_range") / F.col("total")).alias("fraction"), "mode", (F.col("mode_n") / F.col("total")).alias("mode_fraction"))


def worst_bases(frequencies: DataFrame) -> DataFrame:
    """(end, pos, base, freq): the most frequent base of each position, ties to the first letter."""
    best = F.max_by(F.struct("base", "freq"), F.struct("freq", -F.ascii("base")))
    return frequencies.groupBy("end", "pos").agg(best.alias("m")).select("end", "pos", "m.base", "m.freq")


def frequency_entropy(frequencies: DataFrame, ignore_ends: int = 2) -> DataFrame:
    """(end, pos, entropy) in bits of the frequencies as they are, for the positions at least ``ignore_ends`` from both
    ends of the longest read; 0 where at most one base occurs."""
    f = F.col("freq")
    term = F.when(f > 0, -f * F.log2(f)).otherwise(0.0)
    per = frequencies.groupBy("end", "pos").agg(F.sum(term).alias("h"), F.sum(F.when(f > 0, 1).otherwise(0)).alias("kinds"))
    last = F.max("pos").over(Window.partitionBy("end"))
    per = per.withColumn("last", last).where((F.col("pos") >= ignore_ends) & (F.col("pos") <= F.col("last") - ignore_ends))
    return per.select("end", "pos", F.when(F.col("kinds") <= 1, 0.0).otherwise(F.col("h")).alias("entropy"))

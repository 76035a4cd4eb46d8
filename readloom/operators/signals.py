"""Positional signals of reads: composition, entropy and dinucleotides from both ends, up to the 95th length percentile.

Unlike the quality-control frequencies these divide by the reads that reach a position, and count every symbol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.qc import bases_from_ends, ends

MIN_LENGTH = 20


def usable(reads: DataFrame) -> DataFrame:
    """Reads long enough to tell a layout, each counted once."""
    return reads.where(F.length("seq") >= MIN_LENGTH).withColumn("cnt", F.lit(1).cast("long"))


def length_cap(reads: DataFrame) -> DataFrame:
    """One row (cap): the length of the read at place int(0.95 n) in order of length, from the histogram."""
    hist = usable(reads).groupBy(F.length("seq").alias("len")).agg(F.count(F.lit(1)).alias("n"))  # a row for each length
    upto = Window.orderBy("len")
    hist = hist.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy())})
    return hist.where(F.col("upto") > F.floor(F.col("total") * 0.95)).agg(F.min("len").alias("cap"))


def composition(reads: DataFrame) -> DataFrame:
    """(end, pos, symbol, n, freq)."""
    counted = bases_from_ends(usable(reads)).groupBy("end", "pos", "symbol").agg(F.sum("cnt").alias("n"))
    counted = counted.join(F.broadcast(length_cap(reads))).where("pos < cap").drop("cap")  # one row
    return counted.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy("end", "pos")))


def gathered(parts: DataFrame) -> DataFrame:
    """``parts``, whose rows are as many as places times symbols, computed now and once, for those that read it several times."""
    return parts.sparkSession.createDataFrame(parts.collect(), parts.schema)


def entropy(parts: DataFrame) -> DataFrame:
    """(end, pos, h, max_freq) of ``composition``."""
    return parts.groupBy("end", "pos").agg(F.sum(-F.col("freq") * F.log2("freq")).alias("h"), F.max("freq").alias("max_freq"))


def composition_maps(parts: DataFrame) -> DataFrame:
    return parts.groupBy("end", "pos").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", "freq")))).alias("composition"))


def dinucleotides(reads: DataFrame) -> DataFrame:
    """(end, pos, pair, n, freq) of neighbouring bases; from the 3' end, position i is the pair that ends i bases before the end."""
    found = usable(reads).select("seq", (F.length("seq") - 1).alias("_n"), F.explode(F.sequence(F.lit(0), F.length("seq") - 2)).alias("_i"))
    found = found.select("_n", "_i", F.substring("seq", F.col("_i") + 1, F.lit(2)).alias("pair")).groupBy("_n", "_i", "pair").agg(F.count(F.lit(1)).alias("n"))
    counted = ends(found).groupBy("end", "pos", "pair").agg(F.sum("n").alias("n"))
    counted = counted.join(F.broadcast(length_cap(reads))).where("pos < cap - 1").drop("cap")  # one row
    return counted.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy("end", "pos")))

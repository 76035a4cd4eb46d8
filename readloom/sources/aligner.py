"""What goes to an external aligner and what it leaves: its index, its input and its log."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators import alignment
from readloom.sources import collapsed

#: Files of an aligner's index: fixed values.
INDEX_FILES = ("chrName.txt", "chrLength.txt", "chrStart.txt", "Genome", "genomeParameters.txt", "SA", "SAindex")


def missing_index_files(folder: str | Path) -> list[str]:
    """Which of ``INDEX_FILES`` a folder lacks; FileNotFoundError without the folder."""
    if not Path(folder).is_dir():
        raise FileNotFoundError(f"no index folder {folder}")
    return [name for name in INDEX_FILES if not (Path(folder) / name).exists()]


def aligner_input(records: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    """(ordinal, header, seq, qual) as an aligner takes them: FASTQ as it is, FASTA with a constant quality, collapsed reads
    ``cnt`` times each. ``limit`` is of reads written, and holds for collapsed ones alone."""
    if kind == "fastq":
        return records.select("ordinal", F.concat(F.lit("@"), "header").alias("header"), "seq", "qual")
    if kind == "fasta":
        return collapsed.fasta_to_fastq(records).select("ordinal", F.concat(F.lit("@"), "header").alias("header"), "seq", "qual")
    if kind == "collapsed":
        return collapsed.expand(records, limit).select("ordinal", "header", "seq", "qual")
    raise ValueError(f"an aligner's input is fastq, fasta or collapsed, not {kind!r}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """One row of the counters of an aligner's log file, zeros if there is no such file."""
    try:
        lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    except Exception as wrong:
        if "PATH_NOT_FOUND" not in str(wrong):
            raise
        lines = spark.createDataFrame([], "value string, line_no long")
    return alignment.log_counters(lines)

"""Soft clips of alignments and the trims they suggest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUANTILE = 0.85
GLOBAL_SHARE = 0.75


def clips(sam: DataFrame) -> DataFrame:
    """(ordinal, read_len, clip5, clip3) of mapped reads of (ordinal, flag, cigar, read_len)."""
    n = lambda pattern: F.coalesce(F.regexp_extract("cigar", pattern, 1).try_cast("int"), F.lit(0))
    return sam.where(F.col("flag").bitwiseAND(F.lit(4)) == 0).select("ordinal", "read_len", n(r"^(\d+)S").alias("clip5"), n(r"(\d+)S$").alias("clip3"))


def clip_stats(found: DataFrame) -> DataFrame:
    """One row of totals, with clip_rate and mean_total for the check."""
    any_clip = (F.col("clip5") > 0) | (F.col("clip3") > 0)
    stats = found.agg(
        F.count(F.lit(1)).alias("n_reads"), F.count_if(any_clip).alias("clipped"), F.avg("clip5").alias("mean5"), F.avg("clip3").alias("mean3"), F.max("clip5").alias("max5"), F.max("clip3").alias("max3")
    )
    return stats.withColumns({"clip_rate": F.try_divide("clipped", "n_reads"), "mean_total": F.col("mean5") + F.col("mean3")})


def per_length(found: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(read_len, n_reads, trim5, trim3, mean5, mean3, cleaned): trims are the clip at place min(int(n q), n - 1) in order,
    from cumulative histograms, and cleaned is the lesser share of reads whose clip is at most the trim."""
    long = found.unpivot(["read_len"], ["clip5", "clip3"], "end", "clip")
    hist = long.groupBy("read_len", "end", "clip").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("read_len", "end").orderBy("clip")
    hist = hist.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy("read_len", "end"))})
    place = F.least(F.floor(F.col("total") * quantile), F.col("total") - 1)
    per = hist.groupBy("read_len", "end").agg(F.first("total").alias("n"), F.min(F.when(F.col("upto") > place, F.col("clip"))).alias("trim"), (F.sum(F.col("clip") * F.col("n")) / F.sum("n")).alias("mean"), F.min(F.when(F.col("upto") > place, F.col("upto"))).alias("at_most"))
    per = per.withColumn("share", F.col("at_most") / F.col("n"))
    of = lambda end, c: F.max(F.when(F.col("end") == end, F.col(c)))
    return per.groupBy("read_len").agg(F.max("n").alias("n_reads"), of("clip5", "trim").alias("trim5"), of("clip3", "trim").alias("trim3"), of("clip5", "mean").alias("mean5"), of("clip3", "mean").alias("mean3"), F.min("share").alias("cleaned"))


def global_consensus(recommended: DataFrame) -> DataFrame:
    """One row (detected, trim5, trim3, level): read-weighted modes of the trims by length, ties to the shortest length."""
    both = recommended.unpivot(["read_len", "n_reads"], ["trim5", "trim3"], "end", "trim")
    votes = both.groupBy("end", "trim").agg(F.sum("n_reads").alias("n"), F.min("read_len").alias("first"))
    ends = votes.groupBy("end").agg(F.max_by("trim", F.struct("n", -F.col("first"))).alias("mode"), (F.max("n") / F.sum("n")).alias("share"), F.count(F.lit(1)).alias("kinds"))
    of = lambda end: F.max(F.when(F.col("end") == end, F.col("mode")))
    lengths = recommended.agg(F.count(F.lit(1)).alias("lengths"))
    found = ends.agg(of("trim5").alias("trim5"), of("trim3").alias("trim3"), F.min("share").alias("share"), F.max("kinds").alias("kinds")).join(F.broadcast(lengths))  # one row each
    detected = (F.col("share") >= GLOBAL_SHARE) & ((F.col("lengths") < 3) | (F.col("kinds") <= 2))
    return found.select(F.coalesce(detected, F.lit(False)).alias("detected"), F.coalesce("trim5", F.lit(0)).alias("trim5"), F.coalesce("trim3", F.lit(0)).alias("trim3"), F.coalesce(F.bround("share", 3), F.lit(0.0)).alias("level"))


def log_counters(lines: DataFrame) -> DataFrame:
    """One row of the four counters of an aligner log of (line_no, value); the last line of a kind wins, 0 without one."""
    number = F.element_at(F.split(F.trim("value"), "\t"), -1).try_cast("long")
    of = lambda key: F.coalesce(F.max_by(number, F.when(F.contains("value", F.lit(key)), F.col("line_no"))), F.lit(0))
    return lines.agg(of("Number of input reads").alias("input_reads"), of("Uniquely mapped reads number").alias("unique_reads"), of("Number of reads mapped to multiple loci").alias("multi_reads"), of("Number of reads unmapped").alias("unmapped_reads"))


def alignment_rate(counters: DataFrame) -> DataFrame:
    return counters.withColumn("rate", F.coalesce(F.try_divide(F.col("unique_reads") + F.col("multi_reads"), F.col("input_reads")), F.lit(0.0)))


def decide_trim(architecture: DataFrame, alignment: DataFrame) -> DataFrame:
    """The trims that layout (arch5, matched) and alignment (trim5, level, detected) agree on, for each pair of rows by ``id``."""
    a, b = F.col("arch5"), F.col("trim5")
    found = architecture.join(alignment, "id")
    method = F.when(a == b, "agreement").when(F.col("matched") & (a > 0), "architecture_dominant").when(F.col("detected") & (F.col("level") > 0.8), "alignment_dominant").otherwise("fallback")
    found = found.withColumn("method", method)
    value = F.when(F.col("method").isin("agreement", "architecture_dominant"), a).when(F.col("method") == "alignment_dominant", b).otherwise(F.when(F.col("matched"), a).otherwise(b))
    return found.select("id", "method", value.alias("final5"), F.lit(0).alias("final3"), F.when(F.col("method") == "agreement", 0.9).otherwise(0.7).alias("confidence"))


def alignment_report(counters, trims, per_length: list, output_files: list[str] = ()) -> dict:
    """The aligner's counters, the trims and their recommendations by length, as plain values."""
    aligned = counters.unique_reads + counters.multi_reads
    return {
        "input_reads": counters.input_reads,
        "aligned_reads": aligned,
        "unmapped_reads": counters.unmapped_reads,
        "alignment_rate": aligned / counters.input_reads if counters.input_reads else 0.0,
        "uniquely_aligned": counters.unique_reads,
        "multimapping_reads": counters.multi_reads,
        "trim_recommendations": {"detected": trims.detected, "recommended_5prime_trim": trims.trim5, "recommended_3prime_trim": trims.trim3, "consensus_level": trims.level},
        "per_length_analysis": {str(r.read_len): {"n_reads": r.n_reads, "trim5": r.trim5, "trim3": r.trim3, "mean5": r.mean5, "mean3": r.mean3, "cleaned": r.cleaned} for r in per_length},
        "output_files": list(output_files),
    }

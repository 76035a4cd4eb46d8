"""Pass, warn and fail rules over the quality-control aggregates; each gives one row (idx, check, status, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.sequence import BASES, gc_count
from readloom.operators import qc

PASS, WARNING, FAIL = "PASS", "WARNING", "FAIL"


def _length(f: Column, mode: Column, low: int, high: int, warn: float, fail: float) -> tuple[Column, Column]:
    status = F.when(f < fail, FAIL).when((f < warn) | ~mode.between(low, high), WARNING).otherwise(PASS)
    return status, F.when(f < fail, F.lit("few reads in RPF range")).when(f < warn, F.lit("low share of reads in RPF range")).when(~mode.between(low, high), F.lit("modal length outside RPF range")).otherwise("length distribution good")


def _any(n: Column, bad: str, good: str) -> tuple[Column, Column]:
    return F.when(n > 0, FAIL).otherwise(PASS), F.when(n > 0, bad).otherwise(good)


def _gc(gc: Column, low: float, high: float) -> tuple[Column, Column]:
    bad = gc.isNull() | (gc < low) | (gc > high)
    return F.when(bad, WARNING).otherwise(PASS), F.when(gc.isNull(), "no GC content").when(gc < low, "low GC content").when(gc > high, "high GC content").otherwise("GC content good")


def metrics(reads: DataFrame, low: int = 26, high: int = 35, min_entropy: float = 1.0, ignore_ends: int = 2, end_positions: int = 3, end_bias: float = 0.7, max_freq: float = 0.85) -> DataFrame:
    """One row of what the checks ask: fraction, mode, gc, and how many positions have low entropy, biased ends, an extreme base.

    Two scans: the lengths with their GC counts, and the bases by place.
    """
    upper = reads.withColumn("seq", F.upper("seq"))
    n, gc = F.col("n"), F.col("gc").cast("double")
    hist = upper.groupBy(F.length("seq").alias("len")).agg(F.sum("cnt").alias("n"), F.min("ordinal").alias("first"), F.sum(gc_count() * F.col("cnt")).alias("gc"))
    whole = hist.agg(
        F.sum("n").alias("total"),
        F.try_divide(F.coalesce(F.sum(F.when(F.col("len").between(low, high), n)), F.lit(0)), F.sum("n")).alias("fraction"),
        F.max_by("len", F.struct("n", -F.col("first"))).alias("mode"),
        F.try_divide(F.sum(gc), F.sum(F.col("len") * n)).alias("gc"),
    )
    counted = qc.base_counts(reads).agg(F.collect_list(F.struct("end", "pos", *BASES)).alias("rows"))  # two for each place of the longest read
    places = whole.join(F.broadcast(counted)).select(*whole.columns, F.explode_outer("rows").alias("r")).select(*whole.columns, "r.*")  # one row each
    freqs = [F.try_divide(b, "total") for b in BASES]
    terms = [F.when(f > 0, -f * F.log2(f)).otherwise(0.0) for f in freqs]
    kinds = sum((F.when(f > 0, 1).otherwise(0) for f in freqs), F.lit(0))
    places = places.select(*whole.columns, "end", "pos", F.greatest(*freqs).alias("most"), F.when(kinds <= 1, 0.0).otherwise(sum(terms, F.lit(0.0))).alias("entropy"))
    places = places.withColumn("last", F.max("pos").over(Window.partitionBy("end")))
    five = F.col("end") == "5p"
    inside = (F.col("pos") >= ignore_ends) & (F.col("pos") <= F.col("last") - ignore_ends)
    held = [F.first(c).alias(c) for c in whole.columns]
    return places.agg(*held, F.count_if(five & inside & (F.col("entropy") < min_entropy)).alias("low"), F.count_if((F.col("pos") < end_positions) & (F.col("most") > end_bias)).alias("biased"), F.count_if(five & (F.col("most") > max_freq)).alias("extreme"))


def _rows(held: DataFrame, *checks: tuple[int, str, tuple[Column, Column]]) -> DataFrame:
    rows = [F.struct(F.lit(i).alias("idx"), F.lit(name).alias("check"), status.alias("status"), message.alias("message")) for i, name, (status, message) in checks]
    return held.select(F.inline(F.array(*rows)))


def _basic(low: int, high: int, warn: float, fail: float, gc_low: float, gc_high: float) -> list[tuple[int, str, tuple[Column, Column]]]:
    c = F.col
    return [
        (0, "length_distribution", _length(c("fraction"), c("mode"), low, high, warn, fail)),
        (3, "base_composition", _any(c("extreme"), "extreme base bias", "base composition good")),
        (4, "gc_content", _gc(c("gc"), gc_low, gc_high)),
    ]


def soft_clip_check(stats: DataFrame, max_rate: float = 0.1, max_mean: float = 1.0) -> DataFrame:
    """Over one row (clip_rate, mean_total)."""
    status = F.when(F.col("clip_rate").isNull(), WARNING).when((F.col("clip_rate") > max_rate) | (F.col("mean_total") > max_mean), FAIL).otherwise(PASS)
    return _rows(stats, (5, "soft_clipping", (status, F.when(status == FAIL, "excessive soft clipping").when(status == WARNING, "no alignment statistics").otherwise("soft clipping good"))))


def check_suite(reads: DataFrame, clip_stats: DataFrame | None = None, low: int = 26, high: int = 35, warn: float = 0.5, fail: float = 0.3, gc_low: float = 0.35, gc_high: float = 0.65) -> DataFrame:
    c = F.col
    more = [(1, "information_content", _any(c("low"), "low information entropy", "information content good")), (2, "end_bias", _any(c("biased"), "biased read ends", "no end bias"))]
    rows = _rows(metrics(reads, low, high), *sorted([*_basic(low, high, warn, fail, gc_low, gc_high), *more], key=lambda x: x[0]))
    return rows if clip_stats is None else rows.unionByName(soft_clip_check(clip_stats))


def basic_suite(reads: DataFrame, low: int = 26, high: int = 35, warn: float = 0.5, fail: float = 0.3, gc_low: float = 0.35, gc_high: float = 0.65) -> DataFrame:
    """The three checks of the short report, under their titles."""
    titles = {"length_distribution": "Length Distribution", "base_composition": "Base Composition", "gc_content": "GC Content"}
    return _rows(metrics(reads, low, high), *_basic(low, high, warn, fail, gc_low, gc_high)).replace(titles, subset=["check"])


def failure_categories(checks: DataFrame) -> DataFrame:
    """One row (categories by ', ', primary, is_clean) of the failed checks in order; warnings don't count."""
    name = F.lower("check")
    kind = (
        F.when(F.contains(name, F.lit("length")), "length_distribution")
        .when(F.contains(name, F.lit("end")) | F.contains(name, F.lit("bias")), "end_bias")
        .when(F.contains(name, F.lit("information")) | F.contains(name, F.lit("entropy")), "low_complexity")
        .when(F.contains(name, F.lit("clipping")), "soft_clipping")
        .when(F.contains(name, F.lit("composition")), "base_composition")
        .otherwise("other")
    )
    failed = F.array_sort(F.collect_list(F.when(F.col("status") == FAIL, F.struct("idx", kind.alias("kind")))))
    found = checks.agg(failed.alias("f"))
    return found.select(F.concat_ws(", ", "f.kind").alias("categories"), F.try_element_at("f", F.lit(1))["kind"].alias("primary"), (F.size("f") == 0).alias("is_clean"))

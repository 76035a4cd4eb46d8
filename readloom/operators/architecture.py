"""Known read layouts and how well signals match them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.operators.adapters import all_adapters

SCHEMA = (
    "priority int, name string, source string, umi array<struct<s:int,e:int>>, barcode array<struct<s:int,e:int>>, adapters array<string>, "
    "rpf_start int, rpf_end int, exp_min int, exp_max int"
)
MATCH_SCORE = 0.8

#: Built-in layouts in order of trial (name, source, UMI ranges, barcode ranges, adapters, RPF start and end, length range): fixed values.
BUILTIN = (
    ("comprehensive_adapter_check", "Automated Comprehensive Adapter Scan", [], [], None, 0, -1, 20, 40),
    ("err605046_stau1_riboseq", "ERR605046 STAU1 ribosome profiling dataset", [], [], ["AGATCGGAAGAGC", "GATCGGAAGAGC"], 1, -1, 15, 45),
    ("ena_riboseq_standard", "ENA ribosome profiling dataset ERR10323209", [], [], ["GGAATTCTCGGGTGCCAAGG", "TGGAATTCTCGGGTGCCAAGG"], 0, -1, 25, 80),
    ("preprocessed_with_adapter_contamination", "Partially processed ribosome profiling reads", [], [], ["AGATCGGAAGAGCAC"], 0, -1, 25, 40),
    ("mcglincy_ingolia_2017", "Ingolia Lab - Nature Protocols 2017", [(0, 5)], [(5, 10)], ["AGATCGGAAGAGCAC"], 10, -1, 26, 34),
    ("ingolia_2009", "Ingolia et al. Science 2009", [], [], ["CTGTAGGCACCATCAAT"], 0, -17, 28, 35),
    ("generic_umi_protocol", "Common UMI-based protocol", [(0, 6)], [], ["TGGAATTCTCGGGTGCCAAGG"], 6, -1, 25, 35),
)


def builtin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, s, u, b, all_adapters() if a is None else a, *rest) for i, (n, s, u, b, a, *rest) in enumerate(BUILTIN)], SCHEMA)


def with_more(architectures: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` after ``architectures``, by priority."""
    last = architectures.agg((F.max("priority") + 1).alias("_after"))
    return architectures.unionByName(more.join(F.broadcast(last)).withColumn("priority", F.col("priority") + F.coalesce("_after", F.lit(0))).drop("_after"))


def umi_scores(architectures: DataFrame, entropies: DataFrame) -> DataFrame:
    """(priority, umi_score): 1 if every UMI range has a mean entropy of 1 bit or more and lies within the signal, 1 without UMI, else 0."""
    five = entropies.where("end = '5p'").select("pos", "h")
    ranges = architectures.select("priority", F.posexplode("umi").alias("k", "u")).select("priority", "k", "u.s", "u.e")
    held = ranges.join(five, (F.col("pos") >= F.col("s")) & (F.col("pos") < F.col("e")), "left")
    means = held.groupBy("priority", "k", "s", "e").agg(F.avg("h").alias("h"), F.count("h").alias("n"))
    ok = means.groupBy("priority").agg(F.bool_and((F.col("n") == F.col("e") - F.col("s")) & (F.col("h") >= 1.0)).alias("ok"), F.avg("h").alias("umi_entropy"))
    return architectures.select("priority").join(ok, "priority", "left").select("priority", "umi_entropy", F.when(F.coalesce("ok", F.lit(True)), 1.0).otherwise(0.0).alias("umi_score"))


def adapter_footprints(architectures: DataFrame, parts: DataFrame, min_freq: float = 0.4) -> DataFrame:
    """(priority, adapter, matched, footprint): the share of the adapter's bases, from its end, that more than ``min_freq``
    of the reads have at that distance from theirs."""
    three = parts.where("end = '3p'").select("pos", F.col("symbol").alias("base"), "freq")
    span = three.agg((F.max("pos") + 1).alias("span"))
    bases = architectures.select("priority", F.explode("adapters").alias("adapter")).select("priority", "adapter", F.posexplode(F.split(F.reverse("adapter"), "")).alias("pos", "base"))
    held = bases.join(F.broadcast(three), ["pos", "base"], "left").join(F.broadcast(span))  # positions times symbols; one row
    hits = F.count_if(F.col("freq") > min_freq)
    found = held.groupBy("priority", "adapter").agg(hits.alias("matched"), F.first("span").alias("span"))
    return found.select("priority", "adapter", "matched", F.coalesce(F.try_divide(F.col("matched"), F.least(F.length("adapter"), F.col("span"))), F.lit(0.0)).alias("footprint"))


def evaluate(architectures: DataFrame, parts: DataFrame, entropies: DataFrame) -> DataFrame:
    """(priority, name, umi_score, adapter_score, score, is_match)."""
    best = adapter_footprints(architectures, parts).groupBy("priority").agg(F.max("footprint").alias("f"))
    f = F.col("f")
    adapter = F.when(f.isNull(), 1.0).when(f > 0.7, 1.0).when(f > 0.4, 0.5).otherwise(0.0)
    found = architectures.select("priority", "name", F.size("umi").alias("n_umi"), F.size("adapters").alias("n_adapters"))
    found = found.join(umi_scores(architectures, entropies), "priority").join(best, "priority", "left").withColumn("adapter_score", adapter)
    rejected = ((F.col("n_umi") > 0) & (F.col("umi_score") == 0)) | ((F.col("n_adapters") > 0) & (F.col("adapter_score") == 0))
    found = found.withColumn("score", F.when(rejected, 0.0).otherwise(0.4 * F.col("umi_score") + 0.6 * F.col("adapter_score")))
    return found.select("priority", "name", "umi_score", "adapter_score", "score", (F.col("score") >= MATCH_SCORE).alias("is_match"))


def best_match(evaluated: DataFrame) -> DataFrame:
    """The match of highest score, the first of equals."""
    order = Window.orderBy(F.desc("score"), "priority")  # a row for each layout
    return evaluated.where("is_match").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def segments(architectures: DataFrame) -> DataFrame:
    """(priority, k, type, s, e): UMI, barcode and RPF ranges; an RPF end that is not positive means the read's end, -1."""
    as_segments = lambda col, kind: F.transform(col, lambda x: F.struct(F.lit(kind).alias("type"), x["s"].alias("s"), x["e"].alias("e")))
    rpf = F.array(F.struct(F.lit("rpf").alias("type"), F.col("rpf_start").alias("s"), F.when(F.col("rpf_end") > 0, F.col("rpf_end")).otherwise(-1).alias("e")))
    return architectures.select("priority", F.posexplode(F.concat(as_segments("umi", "umi"), as_segments("barcode", "barcode"), rpf)).alias("k", "x")).select("priority", "k", "x.*")


def trim_recommendation(found: DataFrame) -> DataFrame:
    """(priority, trim5, trim3): the start of the first RPF segment, 0 without one; nothing at the 3' end."""
    first = F.min_by("s", F.when(F.col("type") == "rpf", F.col("k")))
    return found.groupBy("priority").agg(F.coalesce(first, F.lit(0)).alias("trim5"), F.lit(0).alias("trim3"))

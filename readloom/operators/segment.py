"""Layouts without a known match: the best path of a left-to-right model UMI, RPF, adapter over the entropy signal.

The states only go forward, so a path is a pair of boundaries i <= j: UMI before i, RPF up to j, adapter after. Prefix sums
of the state scores give each path's score from two rows, and the best of the at most (L + 1)(L + 2) / 2 paths of a group is
one aggregate; all groups (length bins) go in one job.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators import signals

#: Model constants: start, transition and emission values; fixed.
START_UMI, START_RPF = 0.3, 0.6
UMI_STAY, UMI_RPF, RPF_STAY, RPF_ADAPTER, ADAPTER_STAY = 0.8, 0.2, 0.95, 0.05, 0.99
MEAN = {"umi": 1.8, "rpf": 1.2, "adapter": 0.2}
SIGMA = {"umi": 0.5, "rpf": 0.6, "adapter": 0.4}
BOOST_FREQ, BOOST = 0.8, 2.0
MIN_BIN = 1000


def emissions(entropies: DataFrame) -> DataFrame:
    """``entropies`` with the log scores e_umi, e_rpf and e_adapter."""
    score = lambda s: -0.5 * F.pow((F.col("h") - MEAN[s]) / SIGMA[s], F.lit(2.0))
    boosted = score("adapter") + F.when(F.col("max_freq") > BOOST_FREQ, BOOST).otherwise(0.0)
    return entropies.withColumns({"e_umi": score("umi"), "e_rpf": score("rpf"), "e_adapter": boosted})


def best_paths(scored: DataFrame, group: str = "bin") -> DataFrame:
    """(group, i, j, n, score) of the best path of each group of (group, pos, e_umi, e_rpf, e_adapter)."""
    before = Window.partitionBy(group).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = scored.select(group, (F.col("pos") + 1).cast("int").alias("at"), *[F.sum(f"e_{s}").over(before).alias(s) for s in ("umi", "rpf", "adapter")])
    zero = scored.select(group).distinct().select(group, F.lit(0).alias("at"), *[F.lit(0.0).alias(s) for s in ("umi", "rpf", "adapter")])
    sums = sums.unionByName(zero)
    last = sums.groupBy(group).agg(F.max("at").alias("n"), F.max_by("adapter", "at").alias("total"))
    first = sums.select(group, F.col("at").alias("i"), F.col("umi").alias("u_i"), F.col("rpf").alias("r_i"))
    second = sums.select(group, F.col("at").alias("j"), F.col("rpf").alias("r_j"), F.col("adapter").alias("a_j"))
    i, j, n, ln = F.col("i"), F.col("j"), F.col("n"), lambda p: F.lit(math.log(p))
    paths = first.join(second, group).join(last, group).where(((i < j) & (j <= n)) | ((i == n) & (j == n)))
    start = F.when(i > 0, ln(START_UMI) + (i - 1) * ln(UMI_STAY)).otherwise(ln(START_RPF)) + F.col("u_i")
    middle = F.when((i > 0) & (i < n), ln(UMI_RPF)).otherwise(0.0) + (F.col("r_j") - F.col("r_i")) + F.when(j > i, (j - i - 1) * ln(RPF_STAY)).otherwise(0.0)
    end = F.when(j < n, ln(RPF_ADAPTER) + (F.col("total") - F.col("a_j")) + (n - j - 1) * ln(ADAPTER_STAY)).otherwise(0.0)
    # equal scores, up to rounding, go to the path that stays longest in the earlier states
    best = F.max_by(F.struct("i", "j", "n", "score"), F.struct(F.round("score", 9), "i", "j"))
    return paths.withColumn("score", start + middle + end).groupBy(group).agg(best.alias("b")).select(group, "b.*")


def path_segments(paths: DataFrame, group: str = "bin") -> DataFrame:
    """(group, k, type, s, e) of the segments that are not empty."""
    seg = lambda kind, s, e: F.struct(F.lit(kind).alias("type"), s.cast("int").alias("s"), e.cast("int").alias("e"))
    parts = F.array(seg("umi", F.lit(0), F.col("i")), seg("rpf", F.col("i"), F.col("j")), seg("adapter", F.col("j"), F.col("n")))
    return paths.select(group, F.posexplode(F.filter(parts, lambda x: x["e"] > x["s"])).alias("k", "x")).select(group, "k", "x.*")


def runs(states: DataFrame, group: str, pos: str, state: str) -> DataFrame:
    """(group, state, s, e) of the maximal runs of equal states along pos."""
    order = Window.partitionBy(group).orderBy(pos)
    marked = states.withColumn("_new", F.when(F.col(state).eqNullSafe(F.lag(state).over(order)), 0).otherwise(1))
    marked = marked.withColumn("_run", F.sum("_new").over(order))
    return marked.groupBy(group, "_run", state).agg(F.min(pos).alias("s"), (F.max(pos) + 1).alias("e")).drop("_run")


def length_bins(reads: DataFrame, min_bin: int = MIN_BIN) -> DataFrame:
    """(len, n) of the lengths with more than ``min_bin`` reads."""
    return reads.groupBy(F.length("seq").alias("len")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_bin)


def bin_entropies(reads: DataFrame, min_bin: int = MIN_BIN) -> DataFrame:
    """(bin, pos, h, max_freq) from the 5' end for each length bin, of one scan: as all reads of a bin reach each of its places, what is counted there tells the bin's size."""
    held = signals.usable(reads).select(F.length("seq").alias("bin"), F.posexplode(F.split("seq", "")).alias("pos", "symbol"))
    counted = held.groupBy("bin", "pos", "symbol").agg(F.count(F.lit(1)).alias("n"))
    parts = counted.withColumn("size", F.sum("n").over(Window.partitionBy("bin", "pos"))).where(F.col("size") > min_bin)
    parts = parts.withColumn("freq", F.col("n") / F.col("size"))
    return parts.groupBy("bin", "pos").agg(F.sum(-F.col("freq") * F.log2("freq")).alias("h"), F.max("freq").alias("max_freq"))


def global_entropies(reads: DataFrame) -> DataFrame:
    return signals.entropy(signals.composition(reads)).where("end = '5p'").select(F.lit(0).alias("bin"), "pos", "h", "max_freq")


def bin_votes(found: DataFrame) -> DataFrame:
    """One row (umi_len, rpf_start, votes, bins, representative) if more than half of the bins agree, else none. Bins without RPF have no vote."""
    first = lambda kind, what: F.min_by(what, F.when(F.col("type") == kind, F.col("k")))
    per = found.groupBy("bin").agg(F.coalesce(first("umi", F.col("e") - F.col("s")), F.lit(0)).alias("umi_len"), F.coalesce(first("rpf", F.col("s")), F.lit(0)).alias("rpf_start"))
    votes = per.groupBy("umi_len", "rpf_start").agg(F.count(F.lit(1)).alias("votes"), F.min("bin").alias("first"))
    best = votes.agg(F.max_by(F.struct("umi_len", "rpf_start", "votes"), F.struct("votes", -F.col("first"))).alias("b"), F.sum("votes").alias("bins"))
    best = best.select("b.*", "bins").where(F.col("votes") > 0.5 * F.col("bins"))
    holders = per.groupBy("umi_len").agg(F.min("bin").alias("representative"))
    return best.join(F.broadcast(holders), "umi_len")


def scaled_segments(reads: DataFrame, min_bin: int = MIN_BIN) -> DataFrame:
    """(bin, k, type, s, e) of each length bin, and of all reads as bin 0, by one job of paths."""
    entropies = bin_entropies(reads, min_bin).unionByName(global_entropies(reads))
    return path_segments(best_paths(emissions(entropies)))


def decided_segments(found: DataFrame, bins: DataFrame) -> DataFrame:
    """(k, type, s, e, bin) of ``scaled_segments`` that speak for all: of two length bins (len, n) or more, those of the
    representative of the majority of bins; without one, those of all reads, bin 0."""
    vote = bin_votes(found.where("bin > 0")).select("representative")
    told = bins.agg((F.count(F.lit(1)) > 1).alias("several")).join(F.broadcast(vote), how="left")  # one row each
    told = told.select(F.when(F.col("several"), F.col("representative")).alias("bin")).select(F.coalesce("bin", F.lit(0)).alias("bin"))
    return found.join(F.broadcast(told), "bin").select("k", "type", "s", "e", "bin")


def needs_adapter_scan(found: DataFrame, max_umi: int = 40) -> DataFrame:
    """(bin, scan): no RPF segment, or a first segment that is a UMI ending beyond ``max_umi``."""
    head = F.min_by(F.struct("type", "e"), "k")
    per = found.groupBy("bin").agg(F.bool_or(F.col("type") == "rpf").alias("has"), head.alias("h"))
    return per.select("bin", (~F.col("has") | ((F.col("h.type") == "umi") & (F.col("h.e") > max_umi))).alias("scan"))



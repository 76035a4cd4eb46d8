"""Registry of the read-analytics queries and their SQL oracles.

Keys name the operators they stand for. Reads come from ``events`` and alignments from ``orders`` by fixed expressions (see
``readloom.sources.tables``), since the tables hold no sequence files.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import sequence as fn
from readloom.operators import adapters, alignment, architecture, checks, extract, qc, segment, seqspec, signals
from readloom.sources import aligner, collapsed, specifications
from readloom.sources.tables import ALIGNMENTS_SQL, FRAMED_SQL, READS_SQL, alignments, framed_reads, reads, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

ADAPTER = "AGATCGGAAGAG"
R = f"WITH {READS_SQL}"
FR = f"{R}, {FRAMED_SQL}"
AL = f"WITH {ALIGNMENTS_SQL}"


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


def _r(*columns: str) -> Callable[[DataFrame], DataFrame]:
    """Rounds to six places, for comparison."""
    return lambda df: df.withColumns({c: F.round(c, 6) for c in columns})


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction(spark, sf_dir)


# sources

HEADERS = "headers AS (SELECT ordinal, concat('read_', ordinal % 50, '_', CASE WHEN ordinal % 3 = 0 THEN concat(cnt, '_', 500) WHEN ordinal % 7 = 0 THEN 'x' ELSE cast(cnt AS string) END) AS header, seq FROM reads)"


def _headers(spark, d):
    o, c = F.col("ordinal"), F.col("cnt").cast("string")
    tail = F.when(o % 3 == 0, F.concat(c, F.lit("_500"))).when(o % 7 == 0, "x").otherwise(c)
    return reads(spark, d).select("ordinal", F.concat(F.lit("read_"), (o % 50).cast("string"), F.lit("_"), tail).alias("header"), "seq")


_add(
    "s05_header_count",
    lambda s, d: _headers(s, d).select("ordinal", fn.header_count("header", "read_{count}").alias("grouped"), fn.header_count("header").alias("cnt")),
    f"{R}, {HEADERS} SELECT ordinal, CAST(CASE WHEN ordinal % 3 <> 0 AND ordinal % 7 = 0 THEN 1 ELSE CAST(replace(substr(header, 6), '_', '') AS BIGINT) END AS BIGINT) AS grouped, "
    "CAST(CASE WHEN ordinal % 3 = 0 THEN 500 WHEN ordinal % 7 = 0 THEN 1 ELSE CAST(split_part(header, '_', 3) AS INT) END AS BIGINT) AS cnt FROM headers",
)
_add("s08_head_sample", lambda s, d: extract.head(reads(s, d), 5000).select("ordinal", "seq"), f"{R} SELECT ordinal, seq FROM reads ORDER BY ordinal LIMIT 5000")
KNOWN = "known(idx, name, seq) AS (VALUES " + ", ".join(f"({i}, {_q(n)}, {_q(s)})" for i, (n, s) in enumerate(adapters.KNOWN_ADAPTERS)) + ")"
_add("s09_known_adapters", lambda s, d: adapters.known_adapters(s).withColumn("n", F.length("seq")), f"WITH {KNOWN} SELECT idx, name, seq, length(seq) AS n FROM known")
ARCH = "arch(priority, name, rpf_start, rpf_end, us, ue) AS (VALUES " + ", ".join(f"({i}, '{a[0]}', {a[5]}, {a[6]}, {a[2][0][0] if a[2] else 'NULL'}, {a[2][0][1] if a[2] else 'NULL'})" for i, a in enumerate(architecture.BUILTIN)) + ")"
_add("s10_architectures", lambda s, d: architecture.builtin(s).select("priority", "name", "rpf_start", "rpf_end", F.size("umi").alias("n_umi")), f"WITH {ARCH} SELECT priority, name, rpf_start, rpf_end, CASE WHEN us IS NULL THEN 0 ELSE 1 END AS n_umi FROM arch")
REGIONS = "regions(spec, idx, region_id, kind0, length, min_len, max_len) AS (SELECT n_nationkey, k, concat(['umi_x', 'Barcode', 'insert', 'p7 Adapter', 'linker'][k + 1], n_nationkey), ['umi', 'barcode', CASE WHEN n_nationkey % 3 = 0 THEN 'cdna' ELSE 'named' END, 'custom', 'linker'][k + 1], (n_nationkey + 3 * k) % 11 + 1, 20 + n_nationkey % 9, 30 + n_nationkey % 7 FROM nation, unnest(range(5)) t(k))"


def _regions(spark, d):
    n, k = F.col("n_nationkey"), F.col("idx")
    found = table(spark, d, "nation").select(n, F.explode(F.sequence(F.lit(0), F.lit(4))).alias("idx"))
    ids = F.array(*map(F.lit, ["umi_x", "Barcode", "insert", "p7 Adapter", "linker"]))
    kinds = F.array(F.lit("umi"), F.lit("barcode"), F.when(n % 3 == 0, "cdna").otherwise("named"), F.lit("custom"), F.lit("linker"))
    return found.select(n.alias("spec"), "idx", F.concat(F.get(ids, k), n.cast("string")).alias("region_id"), F.get(kinds, k).alias("kind0"), ((n + 3 * k) % 11 + 1).alias("length"), (20 + n % 9).alias("min_len"), (30 + n % 7).alias("max_len"))


_add("s13_seqspec_offsets", lambda s, d: seqspec.region_offsets(_regions(s, d)).select("spec", "idx", "start", "end"), f'WITH {REGIONS} SELECT spec, CAST(idx AS INT) AS idx, CAST(coalesce(sum(length) OVER w, 0) AS BIGINT) AS start, CAST(coalesce(sum(length) OVER w, 0) + length AS BIGINT) AS "end" FROM regions WINDOW w AS (PARTITION BY spec ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)')
_add("s15_sam_clips", lambda s, d: alignment.clips(alignments(s, d)), f"{AL} SELECT * FROM clips")
LOG = "log AS (SELECT o_orderkey AS line_no, concat(['Number of input reads |', 'Uniquely mapped reads number |', 'Number of reads mapped to multiple loci |', 'Number of reads unmapped: too short |', 'Started job |'][o_orderkey % 5 + 1], chr(9), o_orderkey * 3 + 7) AS value FROM orders)"


def _log(spark, d):
    k = F.col("o_orderkey")
    keys = F.array(*map(F.lit, ["Number of input reads |", "Uniquely mapped reads number |", "Number of reads mapped to multiple loci |", "Number of reads unmapped: too short |", "Started job |"]))
    return table(spark, d, "orders").select(k.alias("line_no"), F.concat(F.get(keys, (k % 5).cast("int")), F.lit("\t"), (k * 3 + 7).cast("string")).alias("value"))


def _log_sql(key):
    return f"CAST(coalesce(max(CASE WHEN contains(value, '{key}') THEN line_no END) * 3 + 7, 0) AS BIGINT)"


COUNTERS = f"SELECT {_log_sql('Number of input reads')} AS input_reads, {_log_sql('Uniquely mapped')} AS unique_reads, {_log_sql('multiple loci')} AS multi_reads, {_log_sql('reads unmapped')} AS unmapped_reads FROM log"
_add("s16_aligner_log", lambda s, d: alignment.log_counters(_log(s, d)), f"WITH {LOG} {COUNTERS}")
_add("s19_fasta_to_fastq", lambda s, d: collapsed.fasta_to_fastq(reads(s, d).drop("qual")).select("ordinal", "seq", "qual"), f"{R} SELECT ordinal, seq, repeat('I', length(seq)) AS qual FROM reads")
_add(
    "s20_expand_collapsed",
    lambda s, d: collapsed.expand(reads(s, d).select("ordinal", F.concat(F.lit("r"), "ordinal").alias("header"), "seq", (F.col("cnt") - 1).alias("cnt")), 3000),
    f"{R} SELECT ordinal, CAST(copy AS BIGINT) AS copy, concat('@r', ordinal, '_copy_', copy) AS header, seq, repeat('I', length(seq)) AS qual FROM reads, unnest(range(1, cnt)) t(copy) ORDER BY ordinal, copy LIMIT 3000",
)

# adapters and layouts that a table tells, so that the queries on them read one

TAILS = "tails AS (SELECT ordinal, substr(seq, length(seq) - CAST(5 + ordinal % 4 AS INT)) AS seq FROM reads WHERE ordinal % 4 = 0)"


def _tails(spark, d):
    """What looks like an adapter at the end of a read."""
    o = F.col("ordinal")
    return reads(spark, d).where(o % 4 == 0).select("ordinal", F.substring(F.col("seq"), (F.length("seq") - (5 + o % 4)).cast("int"), F.lit(20)).alias("seq"))


TOLD = """told AS (SELECT CAST(n_nationkey AS INT) AS priority, concat('kit_', lower(n_name)) AS name, CASE WHEN n_nationkey % 3 = 0 THEN CAST(4 + n_nationkey % 5 AS INT) END AS u, CASE WHEN n_nationkey % 4 = 0 THEN CAST(n_nationkey % 7 AS INT) END AS b0,
  concat(substr('AGATCGGAAGAGC', 1, CAST(10 + n_nationkey % 3 AS INT)), substr('ACGT', CAST(1 + n_nationkey % 4 AS INT), 1)) AS adapter, CAST(n_nationkey % 6 AS INT) AS rpf_start, CASE WHEN n_nationkey % 5 = 0 THEN 30 ELSE CAST(-(n_nationkey % 3) AS INT) END AS rpf_end FROM nation)"""


def _told(spark, d):
    """A layout for each nation."""
    k = F.col("n_nationkey").cast("int")
    span = lambda s, e: F.array(F.struct(s.cast("int").alias("s"), e.cast("int").alias("e")))
    none = F.array().cast("array<struct<s:int,e:int>>")
    adapter = F.concat(F.substring(F.lit("AGATCGGAAGAGC"), F.lit(1), (10 + k % 3).cast("int")), F.substring(F.lit("ACGT"), (1 + k % 4).cast("int"), F.lit(1)))
    return table(spark, d, "nation").select(
        k.alias("priority"), F.concat(F.lit("kit_"), F.lower("n_name")).alias("name"), F.lit("told").alias("source"),
        F.when(k % 3 == 0, span(F.lit(0), 4 + k % 5)).otherwise(none).alias("umi"), F.when(k % 4 == 0, span(k % 7, k % 7 + 3)).otherwise(none).alias("barcode"), F.array(adapter).alias("adapters"),
        (k % 6).alias("rpf_start"), F.when(k % 5 == 0, 30).otherwise(-(k % 3)).cast("int").alias("rpf_end"), F.lit(20).alias("exp_min"), (30 + k % 9).alias("exp_max"),
    )


TOLD_SEGS = "tsegs AS (SELECT priority, CAST(row_number() OVER (PARTITION BY priority ORDER BY o) - 1 AS INT) AS k, type, s, e FROM (SELECT priority, 0 AS o, 'umi' AS type, 0 AS s, u AS e FROM told WHERE u IS NOT NULL UNION ALL SELECT priority, 1, 'barcode', b0, b0 + 3 FROM told WHERE b0 IS NOT NULL UNION ALL SELECT priority, 2, 'rpf', rpf_start, CASE WHEN rpf_end > 0 THEN rpf_end ELSE -1 END FROM told))"

# projections and filters

MIXED = "mixed AS (SELECT ordinal, cnt, CASE WHEN ordinal % 5 = 0 THEN concat(lower(substr(seq, 1, 9)), 'N', substr(seq, 11)) ELSE seq END AS seq FROM reads)"
MX = f"{R}, {MIXED}"


def _mixed(spark, d):
    return reads(spark, d).withColumn("seq", F.when(F.col("ordinal") % 5 == 0, F.concat(F.lower(F.substring("seq", 1, 9)), F.lit("N"), F.substring(F.col("seq"), F.lit(11), F.length("seq")))).otherwise(F.col("seq"))).select("ordinal", "cnt", "seq")


_add("f01_upper", lambda s, d: _mixed(s, d).select("ordinal", F.upper("seq").alias("seq")), f"{MX} SELECT ordinal, upper(seq) AS seq FROM mixed")
_add("f02_reverse", lambda s, d: reads(s, d).select("ordinal", F.reverse("seq").alias("seq")), f"{R} SELECT ordinal, reverse(seq) AS seq FROM reads")
_add("f03_base_filter", lambda s, d: _mixed(s, d).select("ordinal", fn.count_of("seq", "ACGT").alias("n_bases"), F.length("seq").cast("long").alias("n")), f"{MX} SELECT ordinal, CAST(length(regexp_replace(seq, '[^ACGT]', '', 'g')) AS BIGINT) AS n_bases, CAST(length(seq) AS BIGINT) AS n FROM mixed")
_add("f04_gc_count", lambda s, d: reads(s, d).select("ordinal", fn.gc_count().alias("gc")), f"{R} SELECT ordinal, CAST(length(regexp_replace(seq, '[^GC]', '', 'g')) AS BIGINT) AS gc FROM reads")
_add("f05_segment_slice", lambda s, d: extract.sliced(reads(s, d), 5, 25).select("ordinal", "seq", "qual"), f"{R} SELECT ordinal, substr(seq, 6, 20) AS seq, substr(qual, 6, 20) AS qual FROM reads")
TRIM = "coalesce(" + ", ".join(f"CASE WHEN instr(seq, '{a}') > 0 THEN instr(seq, '{a}') - 1 END" for a in adapters.all_adapters()) + ", length(seq))"
_add("f06_adapter_trim", lambda s, d: extract.trimmed(reads(s, d), adapters.all_adapters()).select("ordinal", "seq"), f"{R} SELECT ordinal, substr(seq, 1, CAST({TRIM} AS INT)) AS seq FROM reads")
_add("f07_min_length", lambda s, d: signals.usable(reads(s, d)).select("ordinal"), f"{R} SELECT ordinal FROM reads WHERE length(seq) >= 20")
_add("f08_bin_coverage", lambda s, d: segment.length_bins(reads(s, d), 100), f"{R} SELECT length(seq) AS len, count(*) AS n FROM reads GROUP BY 1 HAVING count(*) > 100")
_add("f09_mapped", lambda s, d: alignments(s, d).where(F.col("flag").bitwiseAND(F.lit(4)) == 0).select("ordinal"), f"{AL} SELECT ordinal FROM sam WHERE flag & 4 = 0")
_add("f10_contains", lambda s, d: reads(s, d).where(F.contains("seq", F.lit(ADAPTER))).select("ordinal"), f"{R} SELECT ordinal FROM reads WHERE contains(seq, '{ADAPTER}')")
_add("f11_in_range", lambda s, d: qc.length_metrics(reads(s, d)).select("total", "in_range"), f"{R} SELECT CAST(sum(cnt) AS BIGINT) AS total, CAST(sum(CASE WHEN length(seq) BETWEEN 26 AND 35 THEN cnt ELSE 0 END) AS BIGINT) AS in_range FROM reads")
_add("f12_alphabet", lambda s, d: _mixed(s, d).select("ordinal", fn.is_adapter("seq").alias("ok")), f"{MX} SELECT ordinal, regexp_full_match(seq, '[ACGTNacgtn]+') AS ok FROM mixed")
ANNOTATED = "annotated AS (SELECT ordinal, seq, concat('read ', CASE WHEN ordinal % 2 = 0 THEN 'UMI:' ELSE 'umi:' END, 4 + ordinal % 5, ' barcode:', ordinal % 4, CASE WHEN ordinal % 3 = 0 THEN ' Adapter_5:12' ELSE '' END, ' rpf:', length(seq)) AS header FROM reads)"
AN = f"{R}, {ANNOTATED}"
ELEMENTS = "els AS (SELECT ordinal, unnest(range(len(a))) AS idx, lower(unnest(a)) AS element, CAST(unnest(b) AS INT) AS n FROM (SELECT ordinal, regexp_extract_all(header, '([a-zA-Z_][a-zA-Z0-9_]*):(\\d+)', 1) AS a, regexp_extract_all(header, '([a-zA-Z_][a-zA-Z0-9_]*):(\\d+)', 2) AS b FROM annotated))"


def _annotated(spark, d):
    o, t = F.col("ordinal"), lambda c: c.cast("string")
    return reads(spark, d).select(
        "ordinal", "seq", F.concat(F.lit("read "), F.when(o % 2 == 0, "UMI:").otherwise("umi:"), t(4 + o % 5), F.lit(" barcode:"), t(o % 4), F.when(o % 3 == 0, " Adapter_5:12").otherwise(""), F.lit(" rpf:"), t(F.length("seq"))).alias("header")
    )


_add("f13_header_annotation", lambda s, d: seqspec.has_annotations(_annotated(s, d)), f"{AN} SELECT bool_or(regexp_matches(lower(header), 'umi:|barcode:|adapter:|spacer:|rpf:|untemplated:')) AS annotated FROM (SELECT * FROM annotated ORDER BY ordinal LIMIT 10)")
_add("f14_adapter_fasta", lambda s, d: seqspec.adapter_fasta(adapters.known_adapters(s)), f"WITH {KNOWN} SELECT idx, concat('>', name, chr(10), seq) AS record FROM known WHERE seq NOT IN ('', 'N', 'X') AND regexp_matches(seq, '[^Nn]')")
_add("f15_header_structure", lambda s, d: seqspec.annotated_regions(_annotated(s, d)).select("ordinal", "idx", "element", "n"), f"{AN}, {ELEMENTS} SELECT ordinal, CAST(idx AS INT) AS idx, element, n FROM els")
ENDS = """ends AS (
  SELECT '5p' AS "end", CAST(i - 1 AS INT) AS pos, substr(seq, CAST(i AS INT), 1) AS symbol, cnt, ordinal, length(seq) AS len FROM src, unnest(range(1, length(seq) + 1)) t(i)
  UNION ALL SELECT '3p', CAST(length(seq) - i AS INT), substr(seq, CAST(i AS INT), 1), cnt, ordinal, length(seq) FROM src, unnest(range(1, length(seq) + 1)) t(i)
)"""
QC = f"{R}, src AS (SELECT ordinal, cnt, upper(seq) AS seq FROM reads), {ENDS}"
SG = f"{R}, src AS (SELECT ordinal, 1 AS cnt, seq FROM reads WHERE length(seq) >= 20), {ENDS}"
_add("f16_bases_from_ends", lambda s, d: qc.bases_from_ends(reads(s, d).withColumn("cnt", F.lit(1).cast("long"))).groupBy("end", "pos").agg(F.sum("cnt").alias("coverage")), f'{QC} SELECT "end", pos, count(*) AS coverage FROM ends GROUP BY ALL')
_add("f17_empty_guard", lambda s, d: signals.usable(reads(s, d).where(F.length("seq") < 20)).agg(F.count(F.lit(1)).alias("sample_size")), f"{R} SELECT count(*) AS sample_size FROM reads WHERE length(seq) < 20 AND length(seq) >= 20")

# aggregates

_add("a01_length_histogram", lambda s, d: qc.length_histogram(reads(s, d)).select("len", "n"), f"{R} SELECT length(seq) AS len, CAST(sum(cnt) AS BIGINT) AS n FROM reads GROUP BY 1")
_bases = ", ".join(f"CAST(sum(CASE WHEN symbol = '{b}' THEN cnt ELSE 0 END) AS BIGINT) AS {b}" for b in "ACGT")
_add("a02_base_counts", lambda s, d: qc.base_counts(_mixed(s, d)).where("end = '5p'"), f"{QC.replace('FROM reads)', 'FROM mixed)').replace(', src AS', ', ' + MIXED + ', src AS')} SELECT \"end\", pos, {_bases} FROM ends WHERE \"end\" = '5p' GROUP BY ALL")
FREQ = """freq AS (
  SELECT "end", pos, base, CAST(sum(CASE WHEN symbol = base THEN cnt ELSE 0 END) AS BIGINT) AS n, sum(CASE WHEN symbol = base THEN cnt ELSE 0 END) / CAST((SELECT sum(cnt) FROM reads) AS DOUBLE) AS freq
  FROM ends, (VALUES ('A'), ('C'), ('G'), ('T')) b(base) GROUP BY ALL
)"""
_add("a03_base_frequencies", lambda s, d: _r("freq")(qc.base_frequencies(reads(s, d)).where("end = '5p'")), f"{QC}, {FREQ} SELECT \"end\", pos, base, n, round(freq, 6) AS freq FROM freq WHERE \"end\" = '5p'")
_add("a04_quality_profile", lambda s, d: _r("mean", "std")(qc.quality_profile(reads(s, d))), f"{R} SELECT CAST(i - 1 AS INT) AS pos, round(avg(ascii(substr(qual, CAST(i AS INT), 1)) - 33), 6) AS mean, round(stddev_pop(ascii(substr(qual, CAST(i AS INT), 1)) - 33), 6) AS std, count(*) AS n FROM reads, unnest(range(1, length(qual) + 1)) t(i) GROUP BY 1")
_add("a05_gc_summary", lambda s, d: _r("gc_pct")(qc.gc_summary(_mixed(s, d))), f"{MX} SELECT CAST(sum(cnt) AS BIGINT) AS total_reads, CAST(sum(cnt * length(seq)) AS BIGINT) AS total_bases, CAST(sum(cnt * length(regexp_replace(upper(seq), '[^GC]', '', 'g'))) AS BIGINT) AS gc_count, round(100e0 * sum(cnt * length(regexp_replace(upper(seq), '[^GC]', '', 'g'))) / sum(cnt * length(seq)), 6) AS gc_pct FROM mixed")
_add("a06_reversed_frequencies", lambda s, d: _r("freq")(qc.base_frequencies(reads(s, d)).where("end = '3p'")), f"{QC}, {FREQ} SELECT \"end\", pos, base, n, round(freq, 6) AS freq FROM freq WHERE \"end\" = '3p'")
MATCH = f"m AS (SELECT ordinal, cnt, seq, min(hamming(substr(seq, CAST(p AS INT), 10), '{ADAPTER[:10]}') * 1000 + p - 1) AS best FROM reads, unnest(range(1, length(seq) - 8)) t(p) GROUP BY ALL HAVING min(hamming(substr(seq, CAST(p AS INT), 10), '{ADAPTER[:10]}') * 1000 + p - 1) < 2000), hits AS (SELECT ordinal, cnt, CAST(best // 1000 AS INT) AS mm, CAST(best % 1000 AS INT) AS pos, substr(seq, CAST(best % 1000 + 1 AS INT), 10) AS variant FROM m)"
_hits = lambda s, d: adapters.matches(reads(s, d), ADAPTER)
_add("a07_adapter_positions", lambda s, d: adapters.histogram(_hits(s, d), "pos"), f"{R}, {MATCH} SELECT pos, CAST(sum(cnt) AS BIGINT) AS n FROM hits GROUP BY pos")
_add("a08_match_lengths", lambda s, d: adapters.histogram(_hits(s, d).withColumn("match_len", F.length("variant")), "match_len"), f"{R}, {MATCH} SELECT length(variant) AS match_len, CAST(sum(cnt) AS BIGINT) AS n FROM hits GROUP BY 1")
_add("a09_variants", lambda s, d: adapters.histogram(_hits(s, d), "variant"), f"{R}, {MATCH} SELECT variant, CAST(sum(cnt) AS BIGINT) AS n FROM hits GROUP BY 1")
_add("a10_best_adapter_match", lambda s, d: _hits(s, d).select("ordinal", "mm", "pos", "variant"), f"{R}, {MATCH} SELECT ordinal, mm, pos, variant FROM hits")
_add("a11_contamination_rate", lambda s, d: _r("rate")(adapters.match_summary(reads(s, d), ADAPTER)), f"{R}, {MATCH} SELECT CAST((SELECT sum(cnt) FROM reads) AS BIGINT) AS total, CAST(sum(cnt) AS BIGINT) AS with_adapter, round(100e0 * sum(cnt) / (SELECT sum(cnt) FROM reads), 6) AS rate FROM hits")
HIST = "hist AS (SELECT length(seq) AS len, CAST(sum(cnt) AS BIGINT) AS n, min(ordinal) AS first FROM reads GROUP BY 1), lm AS (SELECT sum(n) AS total, sum(CASE WHEN len BETWEEN 26 AND 35 THEN n ELSE 0 END) AS in_range, (SELECT len FROM hist ORDER BY n DESC, first LIMIT 1) AS mode, max(n) AS mode_n FROM hist)"
_add("a12_length_metrics", lambda s, d: _r("fraction", "mode_fraction")(qc.length_metrics(reads(s, d))), f"{R}, {HIST} SELECT CAST(total AS BIGINT) AS total, CAST(in_range AS BIGINT) AS in_range, round(in_range / CAST(total AS DOUBLE), 6) AS fraction, mode, round(mode_n / CAST(total AS DOUBLE), 6) AS mode_fraction FROM lm")
WORST = """worst AS (SELECT "end", pos, base, freq FROM freq QUALIFY row_number() OVER (PARTITION BY "end", pos ORDER BY freq DESC, base) = 1)"""
_add("a13_worst_bases", lambda s, d: _r("freq")(qc.worst_bases(qc.base_frequencies(reads(s, d)))), f'{QC}, {FREQ}, {WORST} SELECT "end", pos, base, round(freq, 6) AS freq FROM worst')
ENT = """ent AS (
  SELECT "end", pos, CASE WHEN count(CASE WHEN freq > 0 THEN 1 END) <= 1 THEN 0 ELSE sum(CASE WHEN freq > 0 THEN -freq * log2(freq) ELSE 0 END) END AS entropy FROM freq
  WHERE pos >= 2 AND pos <= (SELECT max(pos) FROM freq) - 2 GROUP BY ALL
)"""
_add("a14_frequency_entropy", lambda s, d: _r("entropy")(qc.frequency_entropy(qc.base_frequencies(reads(s, d)))), f'{QC}, {FREQ}, {ENT} SELECT "end", pos, round(entropy, 6) AS entropy FROM ent')
CAP = "cap AS (SELECT min(len) AS cap FROM (SELECT len, sum(count(*)) OVER (ORDER BY len) AS upto, (SELECT count(*) FROM src) AS total FROM (SELECT length(seq) AS len FROM src) GROUP BY len) WHERE upto > CAST(floor(total * 0.95e0) AS BIGINT))"
COMP = f"""{CAP}, parts AS (SELECT "end", pos, symbol, n, n / CAST(sum(n) OVER (PARTITION BY "end", pos) AS DOUBLE) AS freq FROM (SELECT "end", pos, symbol, count(*) AS n FROM ends WHERE pos < (SELECT cap FROM cap) GROUP BY ALL)),
ents AS (SELECT "end", pos, sum(-freq * log2(freq)) AS h, max(freq) AS max_freq FROM parts GROUP BY ALL)"""
_add("a15_signal_entropy", lambda s, d: _r("h", "max_freq")(signals.entropy(signals.composition(reads(s, d)))), f'{SG}, {COMP} SELECT "end", pos, round(h, 6) AS h, round(max_freq, 6) AS max_freq FROM ents')
_add("a16_composition", lambda s, d: _r("freq")(signals.composition(reads(s, d))), f'{SG}, {COMP} SELECT "end", pos, symbol, n, round(freq, 6) AS freq FROM parts')
_add(
    "a17_dinucleotides",
    lambda s, d: _r("freq")(signals.dinucleotides(reads(s, d))),
    f"""{SG}, {CAP}, di AS (
  SELECT '5p' AS "end", CAST(i - 1 AS INT) AS pos, substr(seq, CAST(i AS INT), 2) AS pair FROM src, unnest(range(1, length(seq))) t(i)
  UNION ALL SELECT '3p', CAST(length(seq) - 1 - i AS INT), substr(seq, CAST(i AS INT), 2) FROM src, unnest(range(1, length(seq))) t(i))
SELECT "end", pos, pair, n, round(n / CAST(sum(n) OVER (PARTITION BY "end", pos) AS DOUBLE), 6) AS freq FROM (SELECT "end", pos, pair, count(*) AS n FROM di WHERE pos < (SELECT cap - 1 FROM cap) GROUP BY ALL)""",
)
_add("a18_length_cap", lambda s, d: signals.length_cap(reads(s, d)), f"{SG}, {CAP} SELECT cap FROM cap")
_add("a19_length_bins", lambda s, d: segment.length_bins(reads(s, d), 50).orderBy("len"), f"{R} SELECT length(seq) AS len, count(*) AS n FROM reads GROUP BY 1 HAVING count(*) > 50 ORDER BY 1")

BIN_SEGMENTS = "segs AS (SELECT n_nationkey AS bin, k, type, s, e FROM nation, (VALUES (0, 'umi'), (1, 'rpf')) v(k, type), LATERAL (SELECT CASE WHEN k = 0 THEN 0 ELSE 4 + n_nationkey % 5 // 3 END AS s, CASE WHEN k = 0 THEN 4 + n_nationkey % 5 // 3 ELSE 30 END AS e) WHERE n_nationkey % 7 < 6 OR k = 1)"


def _bin_segments(spark, d):
    n, k = F.col("n_nationkey"), F.col("k")
    width = 4 + F.floor((n % 5) / 3).cast("int")
    found = table(spark, d, "nation").select(n, F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).where((n % 7 < 6) | (k == 1))
    return found.select(n.alias("bin"), "k", F.when(k == 0, "umi").otherwise("rpf").alias("type"), F.when(k == 0, 0).otherwise(width).alias("s"), F.when(k == 0, width).otherwise(30).alias("e"))


_add(
    "a20_bin_votes",
    lambda s, d: segment.bin_votes(_bin_segments(s, d)),
    f"""WITH {BIN_SEGMENTS}, per AS (SELECT bin, coalesce(max(CASE WHEN type = 'umi' THEN e - s END), 0) AS umi_len, coalesce(max(CASE WHEN type = 'rpf' THEN s END), 0) AS rpf_start FROM segs GROUP BY bin),
v AS (SELECT umi_len, rpf_start, count(*) AS votes, min(bin) AS first FROM per GROUP BY ALL)
SELECT CAST(umi_len AS INT) AS umi_len, CAST(rpf_start AS INT) AS rpf_start, votes, (SELECT count(*) FROM per) AS bins, (SELECT min(bin) FROM per WHERE per.umi_len = v.umi_len) AS representative
FROM v WHERE votes > 0.5e0 * (SELECT count(*) FROM per) ORDER BY votes DESC, first LIMIT 1""",
)
CONTAINED = f"cnts AS (SELECT idx, known.seq, count(CASE WHEN contains(reads.seq, known.seq) THEN 1 END) AS n, count(*) AS total FROM known, reads WHERE idx < {adapters.SCANNED} GROUP BY ALL)"
_add("a21_adapter_hits", lambda s, d: adapters.containment_counts(reads(s, d)), f"{R}, {KNOWN}, {CONTAINED} SELECT idx, seq, n, total FROM cnts")
FS = f"{FR}, src AS (SELECT ordinal, 1 AS cnt, seq FROM framed WHERE length(seq) >= 20), {ENDS}, {COMP}, {KNOWN}"
AA = "aa AS (" + " UNION ALL ".join(f"SELECT {i} AS priority, seq AS adapter FROM (SELECT DISTINCT seq FROM known)" if a[4] is None else " UNION ALL ".join(f"SELECT {i}, '{x}'" for x in a[4]) for i, a in enumerate(architecture.BUILTIN)) + ")"
FOOT = f"{ARCH}, {AA}, ab AS (SELECT priority, adapter, CAST(i - 1 AS INT) AS pos, substr(reverse(adapter), CAST(i AS INT), 1) AS base FROM aa, unnest(range(1, length(adapter) + 1)) t(i)), foot AS (SELECT priority, adapter, count(CASE WHEN freq > 0.4 THEN 1 END) AS matched, count(CASE WHEN freq > 0.4 THEN 1 END) / CAST(least(length(adapter), (SELECT max(pos) + 1 FROM parts WHERE \"end\" = '3p')) AS DOUBLE) AS footprint FROM ab LEFT JOIN (SELECT * FROM parts WHERE \"end\" = '3p') p ON p.pos = ab.pos AND p.symbol = ab.base GROUP BY priority, adapter)"
_framed_parts = lambda s, d: signals.composition(framed_reads(s, d))
_add("a22_adapter_footprints", lambda s, d: _r("footprint")(architecture.adapter_footprints(architecture.builtin(s), _framed_parts(s, d))), f"{FS}, {FOOT} SELECT priority, adapter, matched, round(footprint, 6) AS footprint FROM foot")
UMI = "um AS (SELECT priority, us, ue, avg(h) AS h, count(h) AS n FROM arch LEFT JOIN (SELECT pos, h FROM ents WHERE \"end\" = '5p') e ON e.pos >= us AND e.pos < ue GROUP BY ALL), umi AS (SELECT priority, h AS umi_entropy, CASE WHEN us IS NULL THEN 1e0 WHEN n = ue - us AND h >= 1 THEN 1e0 ELSE 0e0 END AS umi_score FROM um)"
_add("a23_umi_entropy", lambda s, d: _r("umi_entropy")(architecture.umi_scores(architecture.builtin(s), signals.entropy(_framed_parts(s, d)))), f"{FS}, {ARCH}, {UMI} SELECT priority, round(umi_entropy, 6) AS umi_entropy, umi_score FROM umi")

GROUPED = "gs AS (SELECT ordinal % 7 AS k, ordinal, CASE WHEN ordinal % 7 = 0 THEN 'ACGTAC' WHEN ordinal % 7 < 5 THEN concat('AC', CASE WHEN ordinal % 10 < ordinal % 7 THEN 'G' ELSE 'T' END, substr('ACGT', CAST(1 + ordinal % 2 AS INT), 2)) ELSE seq END AS seq FROM reads WHERE ordinal < 700)"


def _grouped(spark, d):
    o = F.col("ordinal")
    short = F.concat(F.lit("AC"), F.when(o % 10 < o % 7, "G").otherwise("T"), F.substring(F.lit("ACGT"), (1 + o % 2).cast("int"), F.lit(2)))
    return reads(spark, d).where("ordinal < 700").select((o % 7).alias("k"), "ordinal", F.when(o % 7 == 0, "ACGTAC").when(o % 7 < 5, short).otherwise(F.col("seq")).alias("seq"))


_add(
    "a24_consensus",
    lambda s, d: seqspec.consensus(_grouped(s, d)),
    f"""{R}, {GROUPED}, per AS (SELECT k, count(*) AS n, count(DISTINCT seq) AS kinds, arg_min(seq, ordinal) AS first FROM gs GROUP BY k),
b AS (SELECT k, i, substr(seq, CAST(i AS INT), 1) AS b, count(*) AS m, min(ordinal) AS seen FROM gs, unnest(range(1, length(seq) + 1)) t(i) GROUP BY ALL),
t AS (SELECT k, i, b, m, sum(m) OVER (PARTITION BY k, i) AS total FROM b QUALIFY row_number() OVER (PARTITION BY k, i ORDER BY m DESC, seen) = 1),
l AS (SELECT k, string_agg(CASE WHEN m / CAST(total AS DOUBLE) > 0.7e0 THEN b ELSE 'N' END, '' ORDER BY i) AS letters FROM t JOIN per USING (k) WHERE i <= length(first) GROUP BY k)
SELECT k, CASE WHEN kinds = 1 THEN first WHEN kinds / CAST(n AS DOUBLE) > 0.8e0 THEN repeat('N', length(first)) ELSE letters END AS consensus FROM per JOIN l USING (k)""",
)
DIV = "dv AS (SELECT k, count(DISTINCT seq) / CAST(count(*) AS DOUBLE) AS diversity FROM (SELECT * FROM gs QUALIFY row_number() OVER (PARTITION BY k ORDER BY ordinal) <= 10) GROUP BY k)"
_add("a25_diversity", lambda s, d: _r("diversity")(seqspec.diversity(_grouped(s, d))), f"{R}, {GROUPED}, {DIV} SELECT k, round(diversity, 6) AS diversity FROM dv")
_add("a26_read_lengths", lambda s, d: seqspec.read_lengths(reads(s, d)), f"{R} SELECT min(length(seq)) AS low, max(length(seq)) AS high, CAST(floor(avg(length(seq))) AS BIGINT) AS mean FROM (SELECT * FROM reads ORDER BY ordinal LIMIT 100)")
TYPES = "types(element, region_type) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in seqspec.REGION_TYPES.items()) + ")"
_add("a27_annotation_stats", lambda s, d: seqspec.annotation_stats(seqspec.annotated_regions(_annotated(s, d))), f"{AN}, {ELEMENTS}, {TYPES} SELECT element, coalesce(any_value(region_type), 'unknown') AS region_type, min(n) AS min_len, max(n) AS max_len, count(*) AS occurrences FROM els LEFT JOIN types USING (element) GROUP BY element")
STATS = "stats AS (SELECT count(*) AS n_reads, count(CASE WHEN clip5 > 0 OR clip3 > 0 THEN 1 END) AS clipped, avg(clip5) AS mean5, avg(clip3) AS mean3, max(clip5) AS max5, max(clip3) AS max3 FROM clips)"
_stats = lambda s, d: alignment.clip_stats(alignment.clips(alignments(s, d)))
_add("a28_clip_stats", lambda s, d: _r("mean5", "mean3")(_stats(s, d)).select("n_reads", "clipped", "mean5", "mean3", "max5", "max3"), f"{AL}, {STATS} SELECT n_reads, clipped, round(mean5, 6) AS mean5, round(mean3, 6) AS mean3, max5, max3 FROM stats")
PER = """per AS (SELECT read_len, n AS n_reads, list_sort(c5)[CAST(least(floor(n * 0.85e0), n - 1) AS INT) + 1] AS trim5, list_sort(c3)[CAST(least(floor(n * 0.85e0), n - 1) AS INT) + 1] AS trim3, mean5, mean3, c5, c3 FROM (SELECT read_len, count(*) AS n, list(clip5) AS c5, list(clip3) AS c3, avg(clip5) AS mean5, avg(clip3) AS mean3 FROM clips GROUP BY 1)),
perl AS (SELECT read_len, n_reads, trim5, trim3, mean5, mean3, least((SELECT count(*) FROM clips c WHERE c.read_len = per.read_len AND clip5 <= trim5), (SELECT count(*) FROM clips c WHERE c.read_len = per.read_len AND clip3 <= trim3)) / CAST(n_reads AS DOUBLE) AS cleaned FROM per)"""
_per = lambda s, d: alignment.per_length(alignment.clips(alignments(s, d)))
_add("a29_per_length_trims", lambda s, d: _r("mean5", "mean3", "cleaned")(_per(s, d)), f"{AL}, {PER} SELECT read_len, n_reads, trim5, trim3, round(mean5, 6) AS mean5, round(mean3, 6) AS mean3, round(cleaned, 6) AS cleaned FROM perl")
GC_SQL = """v5 AS (SELECT trim5 AS t, sum(n_reads) AS n, min(read_len) AS f FROM perl GROUP BY 1), v3 AS (SELECT trim3 AS t, sum(n_reads) AS n, min(read_len) AS f FROM perl GROUP BY 1),
gc AS (SELECT (SELECT t FROM v5 ORDER BY n DESC, f LIMIT 1) AS trim5, (SELECT t FROM v3 ORDER BY n DESC, f LIMIT 1) AS trim3, least((SELECT max(n) / CAST(sum(n) AS DOUBLE) FROM v5), (SELECT max(n) / CAST(sum(n) AS DOUBLE) FROM v3)) AS share, (SELECT count(*) FROM v5) AS k5, (SELECT count(*) FROM v3) AS k3, (SELECT count(*) FROM perl) AS lengths)"""
_add("a30_global_consensus", lambda s, d: alignment.global_consensus(_per(s, d)), f"{AL}, {PER}, {GC_SQL} SELECT share >= 0.75 AND (lengths < 3 OR (k5 <= 2 AND k3 <= 2)) AS detected, trim5, trim3, round_even(share, 3) AS level FROM gc")
_add("a31_alignment_rate", lambda s, d: _r("rate")(alignment.alignment_rate(alignment.log_counters(_log(s, d)))), f"WITH {LOG}, c AS ({COUNTERS}) SELECT *, round((unique_reads + multi_reads) / CAST(input_reads AS DOUBLE), 6) AS rate FROM c")
SUITE = """suite AS (
  SELECT 0 AS idx, 'length_distribution' AS "check", CASE WHEN in_range / CAST(total AS DOUBLE) < 0.3 THEN 'FAIL' WHEN in_range / CAST(total AS DOUBLE) < 0.5 OR mode NOT BETWEEN 26 AND 35 THEN 'WARNING' ELSE 'PASS' END AS status FROM lm
  UNION ALL SELECT 1, 'information_content', CASE WHEN count(CASE WHEN entropy < 1 THEN 1 END) > 0 THEN 'FAIL' ELSE 'PASS' END FROM ent WHERE "end" = '5p'
  UNION ALL SELECT 2, 'end_bias', CASE WHEN count(CASE WHEN freq > 0.7 THEN 1 END) > 0 THEN 'FAIL' ELSE 'PASS' END FROM freq WHERE pos < 3
  UNION ALL SELECT 3, 'base_composition', CASE WHEN count(CASE WHEN freq > 0.85 THEN 1 END) > 0 THEN 'FAIL' ELSE 'PASS' END FROM freq WHERE "end" = '5p'
  UNION ALL SELECT 4, 'gc_content', CASE WHEN g < 0.35 OR g > 0.65 THEN 'WARNING' ELSE 'PASS' END FROM (SELECT sum(cnt * length(regexp_replace(seq, '[^GC]', '', 'g'))) / CAST(sum(cnt * length(seq)) AS DOUBLE) AS g FROM src)
)"""
CK = f"{QC}, {FREQ}, {ENT}, {HIST}, {SUITE}"
_add(
    "a32_failure_categories",
    lambda s, d: checks.failure_categories(checks.check_suite(reads(s, d))),
    f"""{CK}, k AS (SELECT idx, CASE WHEN contains("check", 'length') THEN 'length_distribution' WHEN contains("check", 'end') OR contains("check", 'bias') THEN 'end_bias' WHEN contains("check", 'information') THEN 'low_complexity' WHEN contains("check", 'clipping') THEN 'soft_clipping' WHEN contains("check", 'composition') THEN 'base_composition' ELSE 'other' END AS kind FROM suite WHERE status = 'FAIL')
SELECT coalesce(string_agg(kind, ', ' ORDER BY idx), '') AS categories, arg_min(kind, idx) AS "primary", count(*) = 0 AS is_clean FROM k""",
)
CLASS = "cls AS (SELECT *, CASE WHEN contains(lower(concat_ws(' ', region_id, kind0)), 'adapter') THEN 'adapter' WHEN contains(lower(concat_ws(' ', region_id, kind0)), 'umi') THEN 'umi' WHEN contains(lower(concat_ws(' ', region_id, kind0)), 'barcode') THEN 'barcode' WHEN contains(lower(concat_ws(' ', region_id, kind0)), 'rpf') OR contains(lower(concat_ws(' ', region_id, kind0)), 'cdna') THEN 'rpf' ELSE 'unknown' END AS kind FROM regions)"
_classified = lambda s, d: _regions(s, d).withColumn("kind", seqspec.classify_region(F.col("region_id"), F.col("kind0")))
_add("a33_rpf_length_range", lambda s, d: seqspec.rpf_length_range(_classified(s, d)), f"WITH {REGIONS}, {CLASS} SELECT spec, coalesce(min(CASE WHEN kind = 'rpf' THEN min_len END), 20) AS low, coalesce(max(CASE WHEN kind = 'rpf' THEN max_len END), 40) AS high FROM cls GROUP BY spec")
_add("a34_clip_metrics", lambda s, d: _r("clip_rate", "mean_total")(_stats(s, d)).select("clip_rate", "mean_total"), f"{AL}, {STATS} SELECT round(clipped / CAST(n_reads AS DOUBLE), 6) AS clip_rate, round(mean5 + mean3, 6) AS mean_total FROM stats")

# joins

_add(
    "j01_counts_by_header",
    lambda s, d: collapsed.with_counts(_headers(s, d).withColumn("header", F.concat(F.lit("read_"), (F.col("ordinal") % 300).cast("string"), F.lit("_"), (F.col("ordinal") % 300 % 9).cast("string")))).select("ordinal", "header", "seq", "cnt"),
    f"{R} SELECT min(ordinal) AS ordinal, concat('read_', ordinal % 300, '_', ordinal % 300 % 9) AS header, arg_max(seq, ordinal) AS seq, CAST(any_value(ordinal % 300 % 9) AS BIGINT) AS cnt FROM reads GROUP BY ordinal % 300",
)
EVAL = """evald AS (
  SELECT a.priority, a.name, umi_score, CASE WHEN f > 0.7 THEN 1e0 WHEN f > 0.4 THEN 0.5e0 ELSE 0e0 END AS adapter_score,
         CASE WHEN (us IS NOT NULL AND umi_score = 0) OR f <= 0.4 THEN 0e0 ELSE 0.4e0 * umi_score + 0.6e0 * (CASE WHEN f > 0.7 THEN 1e0 ELSE 0.5e0 END) END AS score
  FROM arch a JOIN umi USING (priority) JOIN (SELECT priority, max(footprint) AS f FROM foot GROUP BY 1) USING (priority)
)"""
FE = f"{FS}, {FOOT}, {UMI}, {EVAL}"


def _evaluated(s, d):
    parts = signals.gathered(_framed_parts(s, d))
    return architecture.evaluate(architecture.builtin(s), parts, signals.entropy(parts))


_add("j02_evaluate_layouts", lambda s, d: _r("score")(_evaluated(s, d)), f"{FE} SELECT priority, name, umi_score, adapter_score, round(score, 6) AS score, score >= 0.8e0 AS is_match FROM evald")
_add("j03_adapter_composition", lambda s, d: architecture.adapter_footprints(architecture.builtin(s), _framed_parts(s, d)).select("priority", "adapter", "matched"), f"{FS}, {FOOT} SELECT priority, adapter, matched FROM foot")
_add("j04_umi_range_join", lambda s, d: architecture.umi_scores(architecture.builtin(s), signals.entropy(_framed_parts(s, d))).select("priority", "umi_score"), f"{FS}, {ARCH}, {UMI} SELECT priority, umi_score FROM umi")
_add("j05_reads_by_adapters", lambda s, d: adapters.containment_counts(reads(s, d)).select("idx", "n"), f"{R}, {KNOWN}, {CONTAINED} SELECT idx, n FROM cnts")
_add("j06_first_adapter", lambda s, d: reads(s, d).select("ordinal", fn.trim_at_adapters("seq", adapters.all_adapters()).cast("long").alias("at")), f"{R} SELECT ordinal, CAST({TRIM} AS BIGINT) AS at FROM reads")
_add("j07_fuzzy_adapter", lambda s, d: _hits(s, d).groupBy("mm").agg(F.count(F.lit(1)).alias("n")), f"{R}, {MATCH} SELECT mm, count(*) AS n FROM hits GROUP BY mm")
DECIDE = """dec AS (SELECT p_partkey AS id, CAST(p_partkey % 4 AS INT) AS arch5, p_partkey % 3 = 0 AS matched, CAST(p_size % 4 AS INT) AS trim5, (p_size % 10) / 10e0 AS level, p_size % 2 = 0 AS detected FROM part),
decided AS (SELECT *, CASE WHEN arch5 = trim5 THEN 'agreement' WHEN matched AND arch5 > 0 THEN 'architecture_dominant' WHEN detected AND level > 0.8e0 THEN 'alignment_dominant' ELSE 'fallback' END AS method FROM dec)"""


def _decided(s, d):
    p = table(s, d, "part")
    left = p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4).cast("int").alias("arch5"), (F.col("p_partkey") % 3 == 0).alias("matched"))
    right = p.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).cast("int").alias("trim5"), ((F.col("p_size") % 10) / 10.0).alias("level"), (F.col("p_size") % 2 == 0).alias("detected"))
    return alignment.decide_trim(left, right)


DECIDED = f"WITH {DECIDE} SELECT id, method, CASE WHEN method IN ('agreement', 'architecture_dominant') THEN arch5 WHEN method = 'alignment_dominant' THEN trim5 WHEN matched THEN arch5 ELSE trim5 END AS final5, 0 AS final3, CASE WHEN method = 'agreement' THEN 0.9e0 ELSE 0.7e0 END AS confidence FROM decided"
_add("j08_recommendation_pairs", lambda s, d: _decided(s, d).groupBy("method").agg(F.count(F.lit(1)).alias("n")), f"WITH {DECIDE} SELECT method, count(*) AS n FROM decided GROUP BY 1")
_add("j09_headers_with_reads", lambda s, d: _annotated(s, d).select("ordinal", "header").join(reads(s, d).select("ordinal", "seq"), "ordinal").where("ordinal < 100"), f"{AN} SELECT ordinal, header, seq FROM annotated WHERE ordinal < 100")

# windows and paths

EMIT = "em AS (SELECT pos, h, max_freq, -0.5e0 * pow((h - 1.8e0) / 0.5e0, 2) AS e_umi, -0.5e0 * pow((h - 1.2e0) / 0.6e0, 2) AS e_rpf, -0.5e0 * pow((h - 0.2e0) / 0.4e0, 2) + CASE WHEN max_freq > 0.8e0 THEN 2e0 ELSE 0e0 END AS e_adapter FROM ents WHERE \"end\" = '5p')"
_global = lambda s, d: segment.emissions(segment.global_entropies(framed_reads(s, d)))
_add("w01_emissions", lambda s, d: _r("e_umi", "e_rpf", "e_adapter")(_global(s, d)).select("pos", "e_umi", "e_rpf", "e_adapter"), f"{FS}, {EMIT} SELECT pos, round(e_umi, 6) AS e_umi, round(e_rpf, 6) AS e_rpf, round(e_adapter, 6) AS e_adapter FROM em")


def _paths_sql(source: str) -> str:
    ln = lambda p: f"({math.log(p)!r}e0)"
    return f"""sums AS (SELECT bin, CAST(pos + 1 AS INT) AS bnd, sum(e_umi) OVER w AS u, sum(e_rpf) OVER w AS r, sum(e_adapter) OVER w AS a FROM {source} WINDOW w AS (PARTITION BY bin ORDER BY pos)
  UNION ALL SELECT DISTINCT bin, 0, 0e0, 0e0, 0e0 FROM {source}), ends2 AS (SELECT bin, max(bnd) AS n, arg_max(a, bnd) AS total FROM sums GROUP BY bin),
paths AS (SELECT x.bin, x.bnd AS i, y.bnd AS j, n, CASE WHEN x.bnd > 0 THEN {ln(0.3)} + (x.bnd - 1) * {ln(0.8)} ELSE {ln(0.6)} END + x.u + CASE WHEN x.bnd > 0 AND x.bnd < n THEN {ln(0.2)} ELSE 0e0 END + (y.r - x.r)
  + CASE WHEN y.bnd > x.bnd THEN (y.bnd - x.bnd - 1) * {ln(0.95)} ELSE 0e0 END + CASE WHEN y.bnd < n THEN {ln(0.05)} + (total - y.a) + (n - y.bnd - 1) * {ln(0.99)} ELSE 0e0 END AS score
  FROM sums x JOIN sums y ON x.bin = y.bin JOIN ends2 z ON z.bin = x.bin WHERE x.bnd < y.bnd OR (x.bnd = n AND y.bnd = n)),
best AS (SELECT bin, i, j, n, score FROM paths QUALIFY row_number() OVER (PARTITION BY bin ORDER BY round(score, 9) DESC, i DESC, j DESC) = 1)"""


_add("w02_best_path", lambda s, d: _r("score")(segment.best_paths(_global(s, d))), f"{FS}, {EMIT}, emb AS (SELECT 0 AS bin, * FROM em), {_paths_sql('emb')} SELECT bin, i, j, n, round(score, 6) AS score FROM best")
_add("w03_running_offset", lambda s, d: seqspec.annotated_regions(_annotated(s, d)).select("ordinal", "idx", "start"), f"{AN}, {ELEMENTS} SELECT ordinal, CAST(idx AS INT) AS idx, CAST(coalesce(sum(n) OVER (PARTITION BY ordinal ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM els")
_add(
    "w04_state_runs",
    lambda s, d: segment.runs(table(s, d, "orders").select((F.col("o_custkey") % 20).alias("g"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("state")), "g", "pos", "state"),
    "WITH x AS (SELECT o_custkey % 20 AS g, o_orderkey AS pos, o_orderstatus AS state FROM orders), y AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY pos) - row_number() OVER (PARTITION BY g, state ORDER BY pos) AS run FROM x) SELECT g, state, min(pos) AS s, max(pos) + 1 AS e FROM y GROUP BY g, state, run",
)
_add("w05_observations", lambda s, d: _r("h", "max_freq")(segment.global_entropies(framed_reads(s, d))).select("pos", "h", "max_freq"), f"{FS}, {EMIT} SELECT pos, round(h, 6) AS h, round(max_freq, 6) AS max_freq FROM em")
_add("w06_first_best", lambda s, d: architecture.best_match(_evaluated(s, d)).select("priority", "name"), f"{FE} SELECT priority, name FROM evald WHERE score >= 0.8e0 ORDER BY score DESC, priority LIMIT 1")
_add("w07_histogram_quantile", lambda s, d: _per(s, d).select("read_len", "trim5", "trim3"), f"{AL}, {PER} SELECT read_len, trim5, trim3 FROM perl")
BINS = """bsrc AS (SELECT length(seq) AS bin, seq FROM reads WHERE length(seq) >= 20 AND length(seq) IN (SELECT length(seq) FROM reads GROUP BY 1 HAVING count(*) > 20)),
bc AS (SELECT bin, CAST(i - 1 AS INT) AS pos, substr(seq, CAST(i AS INT), 1) AS b, count(*) AS n FROM bsrc, unnest(range(1, length(seq) + 1)) t(i) GROUP BY ALL),
bf AS (SELECT bin, pos, n / CAST(sum(n) OVER (PARTITION BY bin, pos) AS DOUBLE) AS f FROM bc), bh AS (SELECT bin, pos, sum(-f * log2(f)) AS h, max(f) AS max_freq FROM bf GROUP BY ALL),
bem AS (SELECT bin, pos, -0.5e0 * pow((h - 1.8e0) / 0.5e0, 2) AS e_umi, -0.5e0 * pow((h - 1.2e0) / 0.6e0, 2) AS e_rpf, -0.5e0 * pow((h - 0.2e0) / 0.4e0, 2) + CASE WHEN max_freq > 0.8e0 THEN 2e0 ELSE 0e0 END AS e_adapter FROM bh)"""
_binned = lambda s, d: segment.best_paths(segment.emissions(segment.bin_entropies(reads(s, d), 20)))
_add("w08_binned_paths", lambda s, d: _r("score")(_binned(s, d)), f"{R}, {BINS}, {_paths_sql('bem')} SELECT bin, i, j, n, round(score, 6) AS score FROM best")

# sorts, limits and sets

_add("l01_head", lambda s, d: reads(s, d).orderBy("ordinal").limit(1000).select("ordinal", "seq"), f"{R} SELECT ordinal, seq FROM reads ORDER BY ordinal LIMIT 1000")
_add("l02_collapsed_head", lambda s, d: collapsed.head(reads(s, d), 100).select("ordinal", "cnt"), f"{R} SELECT ordinal, cnt FROM reads ORDER BY ordinal LIMIT 99")
_add("l03_output_cap", lambda s, d: extract.extract(reads(s, d), 6, adapters=adapters.all_adapters(), limit=200).select("ordinal", "seq"), f"{R}, c AS (SELECT ordinal, substr(seq, 7) AS seq FROM reads) SELECT ordinal, substr(seq, 1, CAST({TRIM} AS INT)) AS seq FROM c WHERE {TRIM} >= 20 ORDER BY ordinal LIMIT 200")
_add("l04_sample_caps", lambda s, d: extract.head(reads(s, d), 50).agg(F.count(F.lit(1)).alias("n"), F.max("ordinal").alias("last")), f"{R} SELECT count(*) AS n, max(ordinal) AS last FROM (SELECT ordinal FROM reads ORDER BY ordinal LIMIT 50)")
_add("l05_sorted_variants", lambda s, d: adapters.histogram(_hits(s, d), "variant").orderBy(F.desc("n"), "variant").limit(25), f"{R}, {MATCH} SELECT variant, CAST(sum(cnt) AS BIGINT) AS n FROM hits GROUP BY 1 ORDER BY n DESC, variant LIMIT 25")
_add("l06_adapters_by_length", lambda s, d: adapters.by_length(_tails(s, d)), f"{R}, {TAILS} SELECT CAST(row_number() OVER (ORDER BY length(seq) DESC, seq) - 1 AS INT) AS place, seq FROM (SELECT DISTINCT seq FROM tails)")
_add("l07_most_common", lambda s, d: qc.length_metrics(reads(s, d)).select("mode"), f"{R}, {HIST} SELECT mode FROM lm")
_add(
    "u01_union_layouts",
    lambda s, d: architecture.with_more(architecture.builtin(s), _told(s, d)).select("priority", "name"),
    f"WITH {ARCH}, {TOLD} SELECT priority, name FROM arch UNION ALL SELECT {len(architecture.BUILTIN)} + priority, name FROM told",
)
_add("u02_distinct_adapters", lambda s, d: _tails(s, d).select("seq").distinct(), f"{R}, {TAILS} SELECT DISTINCT seq FROM tails")
_add("u03_distinct_structures", lambda s, d: _annotated(s, d).agg(F.count_distinct(F.transform(fn.header_elements("header"), lambda x: x["element"])).alias("structures"), F.count_distinct("seq").alias("seqs")), f"{AN} SELECT count(DISTINCT array_to_string(regexp_extract_all(lower(header), '([a-z_][a-z0-9_]*):', 1), ' ')) AS structures, count(DISTINCT seq) AS seqs FROM annotated")
_add("u04_clean_and_contaminated", lambda s, d: reads(s, d).select("ordinal", "seq").unionByName(framed_reads(s, d).select("ordinal", "seq")).groupBy(F.length("seq").alias("len")).agg(F.count(F.lit(1)).alias("n")), f"{FR} SELECT length(seq) AS len, count(*) AS n FROM (SELECT seq FROM reads UNION ALL SELECT seq FROM framed) GROUP BY 1")

# rules

for _i, _n in enumerate(["r01_length_check", "r04_information_check", "r05_end_bias_check", "r02_composition_check", "r03_gc_check"]):
    _add(_n, lambda s, d, i=_i: checks.check_suite(reads(s, d)).where(F.col("idx") == i).select("idx", "check", "status"), f'{CK} SELECT idx, "check", status FROM suite WHERE idx = {_i}')
CLIP = "SELECT 5 AS idx, 'soft_clipping' AS \"check\", CASE WHEN clipped / CAST(n_reads AS DOUBLE) > 0.1 OR mean5 + mean3 > 1 THEN 'FAIL' ELSE 'PASS' END AS status FROM stats"
_add("r06_soft_clip_check", lambda s, d: checks.soft_clip_check(_stats(s, d)).select("idx", "check", "status"), f"{AL}, {STATS} {CLIP}")
_add("r07_check_suite", lambda s, d: checks.check_suite(reads(s, d), _stats(s, d)).select("idx", "check", "status"), f'{CK}, {ALIGNMENTS_SQL}, {STATS} SELECT idx, "check", status FROM suite UNION ALL {CLIP}')
_add("r08_basic_suite", lambda s, d: checks.basic_suite(reads(s, d)).select("check", "status"), f"{CK} SELECT CASE idx WHEN 0 THEN 'Length Distribution' WHEN 3 THEN 'Base Composition' ELSE 'GC Content' END AS \"check\", status FROM suite WHERE idx IN (0, 3, 4)")
_add("r09_umi_profile", lambda s, d: _evaluated(s, d).select("priority", "umi_score"), f"{FE} SELECT priority, umi_score FROM evald")
_add("r10_adapter_score", lambda s, d: _evaluated(s, d).select("priority", "adapter_score"), f"{FE} SELECT priority, adapter_score FROM evald")
_add("r11_layout_score", lambda s, d: _r("score")(_evaluated(s, d)).select("priority", "score"), f"{FE} SELECT priority, round(score, 6) AS score FROM evald")
_add("r12_best_layout", lambda s, d: _r("score")(architecture.best_match(_evaluated(s, d))).select("priority", "name", "score"), f"{FE} SELECT priority, name, round(score, 6) AS score FROM evald WHERE score >= 0.8e0 ORDER BY evald.score DESC, priority LIMIT 1")
_add("r13_layout_segments", lambda s, d: architecture.segments(_told(s, d)), f"WITH {TOLD}, {TOLD_SEGS} SELECT priority, k, type, s, e FROM tsegs")
_add("r14_trim_recommendation", lambda s, d: architecture.trim_recommendation(architecture.segments(_told(s, d))), f"WITH {TOLD} SELECT priority, rpf_start AS trim5, 0 AS trim3 FROM told")
PSEG = "psegs AS (SELECT bin, CAST(row_number() OVER (PARTITION BY bin ORDER BY o) - 1 AS INT) AS k, type, s, e FROM (SELECT bin, 0 AS o, 'umi' AS type, 0 AS s, i AS e FROM best UNION ALL SELECT bin, 1, 'rpf', i, j FROM best UNION ALL SELECT bin, 2, 'adapter', j, n FROM best) WHERE e > s)"
_add("r15_de_novo_segments", lambda s, d: segment.path_segments(_binned(s, d)), f"{R}, {BINS}, {_paths_sql('bem')}, {PSEG} SELECT bin, k, type, s, e FROM psegs")
_add("r16_safety_net", lambda s, d: segment.needs_adapter_scan(segment.path_segments(_binned(s, d))), f"{R}, {BINS}, {_paths_sql('bem')}, {PSEG} SELECT bin, count(CASE WHEN type = 'rpf' THEN 1 END) = 0 OR bool_or(k = 0 AND type = 'umi' AND e > 40) AS scan FROM psegs GROUP BY bin")
_add("r17_trim_decision", _decided, DECIDED)
_add("r18_region_class", lambda s, d: _classified(s, d).select("spec", "idx", "kind"), f"WITH {REGIONS}, {CLASS} SELECT spec, CAST(idx AS INT) AS idx, kind FROM cls")
_add("r19_region_types", lambda s, d: seqspec.annotated_regions(_annotated(s, d)).select("element").distinct().select("element", seqspec.region_type(F.col("element")).alias("region_type")), f"{AN}, {ELEMENTS}, {TYPES} SELECT DISTINCT element, coalesce(region_type, 'unknown') AS region_type FROM els LEFT JOIN types USING (element)")
_kinds = ["umi", "barcode", "adapter", "spacer", "rpf", "untemplated", "other"]
_add(
    "r20_sequence_types",
    lambda s, d: seqspec.diversity(_grouped(s, d)).withColumn("kind", F.get(F.array(*map(F.lit, _kinds)), F.col("k").cast("int"))).select("k", "kind", seqspec.sequence_type(F.col("kind"), F.col("diversity")).alias("sequence_type")),
    f"{R}, {GROUPED}, {DIV}, x AS (SELECT k, {_kinds!r}[k + 1] AS kind, diversity AS v FROM dv) SELECT k, kind, CASE kind WHEN 'umi' THEN CASE WHEN v > 0.7e0 THEN 'random' ELSE 'onlist' END WHEN 'barcode' THEN CASE WHEN v < 0.5e0 THEN 'onlist' ELSE 'random' END WHEN 'adapter' THEN CASE WHEN v < 0.3e0 THEN 'fixed' ELSE 'joined' END WHEN 'spacer' THEN CASE WHEN v < 0.5e0 THEN 'fixed' ELSE 'random' END WHEN 'untemplated' THEN 'random' ELSE 'joined' END AS sequence_type FROM x",
)
_add(
    "r21_segment_types",
    lambda s, d: architecture.segments(_told(s, d)).select("type").distinct().select("type", *[c.alias(n) for c, n in zip(seqspec.segment_types(F.col("type")), ("region_type", "sequence_type"))]),
    f"WITH {TOLD}, {TOLD_SEGS} SELECT DISTINCT type, CASE type WHEN 'rpf' THEN 'cdna' ELSE type END AS region_type, CASE type WHEN 'umi' THEN 'random' WHEN 'barcode' THEN 'onlist' ELSE 'joined' END AS sequence_type FROM tsegs",
)

# the decision by length bins, and specifications

DECIDED_BINS = f"""{SG}, {COMP}, {EMIT}, {BINS}, allem AS (SELECT bin, pos, e_umi, e_rpf, e_adapter FROM bem UNION ALL SELECT 0, pos, e_umi, e_rpf, e_adapter FROM em), {_paths_sql('allem')}, {PSEG},
per_bin AS (SELECT bin, coalesce(max(CASE WHEN type = 'umi' THEN e - s END), 0) AS umi_len, coalesce(max(CASE WHEN type = 'rpf' THEN s END), 0) AS rpf_start FROM psegs WHERE bin > 0 GROUP BY bin),
ballot AS (SELECT umi_len, rpf_start, count(*) AS votes, min(bin) AS first FROM per_bin GROUP BY ALL), winner AS (SELECT *, (SELECT count(*) FROM per_bin) AS n FROM ballot ORDER BY votes DESC, first LIMIT 1),
speaks AS (SELECT (SELECT min(bin) FROM per_bin p, winner w WHERE p.umi_len = w.umi_len AND 2 * w.votes > w.n AND (SELECT count(*) FROM (SELECT length(seq) FROM reads GROUP BY 1 HAVING count(*) > 20)) > 1) AS bin)"""
_add("x01_decided_segments", lambda s, d: segment.decided_segments(segment.scaled_segments(reads(s, d), 20), segment.length_bins(reads(s, d), 20)), f"{DECIDED_BINS} SELECT k, type, s, e, bin FROM psegs WHERE bin = (SELECT coalesce(bin, 0) FROM speaks)")


def _specs(spark, d):
    """YAML texts of the regions, one for each nation, with lines that cleaning drops."""
    region = lambda r: F.concat(
        F.lit("- region_id: "), r["region_id"], F.lit("\n  region_type: "), r["kind0"], F.when(r["idx"] == 3, "\n  sequence: ACGTACGT").otherwise(""),
        F.lit("\n  min_len: "), r["min_len"].cast("string"), F.lit("\n  max_len: "), r["max_len"].cast("string"), F.lit("\n  !!python/none x\n"),
    )
    held = _regions(spark, d).groupBy("spec").agg(F.array_sort(F.collect_list(F.struct("idx", "region_id", "kind0", "min_len", "max_len"))).alias("rs"))
    text = F.concat(F.lit("assay_id: a"), F.col("spec").cast("string"), F.lit("\nkind: !!python/object/apply:x\nsequence_spec:\n"), F.array_join(F.transform("rs", region), ""))
    return held.select(F.concat(F.lit("f"), F.lpad(F.col("spec").cast("string"), 2, "0"), F.when(F.col("spec") % 2 == 0, ".yaml").otherwise(".yml")).alias("file"), F.when(F.col("spec") == 7, "a: [").otherwise(text).alias("text"))


SPECS = f"""{REGIONS}, kinds AS (SELECT *, CASE idx WHEN 0 THEN 'umi' WHEN 1 THEN 'barcode' WHEN 3 THEN 'adapter' WHEN 4 THEN 'unknown' ELSE CASE WHEN kind0 = 'cdna' THEN 'rpf' ELSE 'unknown' END END AS kind, CASE WHEN idx = 3 THEN greatest(min_len, max_len, 8) ELSE max_len END AS n FROM regions WHERE spec <> 7),
placed AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY spec ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM kinds)"""
_add("s12_specifications", lambda s, d: specifications.layouts(specifications.parsed(_specs(s, d))).select("priority", "name", "source", F.col("umi")[0]["e"].alias("umi_end"), F.col("barcode")[0]["s"].alias("barcode_start"), F.col("adapters")[0].alias("adapter"), "exp_min", "exp_max"), f"""WITH {SPECS}, per_spec AS (
SELECT spec, max(CASE WHEN kind = 'umi' THEN start + n END) AS umi_end, max(CASE WHEN kind = 'barcode' THEN start END) AS barcode_start, coalesce(min(CASE WHEN kind = 'rpf' THEN min_len END), 20) AS exp_min, coalesce(max(CASE WHEN kind = 'rpf' THEN max_len END), 40) AS exp_max FROM placed GROUP BY spec)
SELECT CAST(row_number() OVER (ORDER BY spec % 2, lpad(CAST(spec AS VARCHAR), 2, '0')) - 1 AS INT) AS priority, concat('a', spec) AS name, 'Unknown' AS source, CAST(umi_end AS INT) AS umi_end, CAST(barcode_start AS INT) AS barcode_start, 'ACGTACGT' AS adapter, CAST(exp_min AS INT) AS exp_min, CAST(exp_max AS INT) AS exp_max FROM per_spec""")
_add("s14_yaml_cleaning", lambda s, d: _regions(s, d).select("spec", "idx", specifications.cleaned_yaml(F.concat(F.lit("a: 1\n  !!tag x\n"), "region_id", F.lit("\nb: !!python/object/apply:z\nc"))).alias("text")), f"WITH {REGIONS} SELECT spec, CAST(idx AS INT) AS idx, concat('a: 1', chr(10), region_id, chr(10), 'c') AS text FROM regions")
_add(
    "s21_aligner_input",
    lambda s, d: aligner.aligner_input(reads(s, d).select("ordinal", F.col("read_id").cast("string").alias("header"), "seq", "cnt"), "collapsed", 2000).unionByName(aligner.aligner_input(reads(s, d).select("ordinal", F.col("read_id").cast("string").alias("header"), "seq", "qual"), "fastq").where("ordinal % 10 = 0")),
    f"{R} (SELECT ordinal, concat('@', read_id, '_copy_', copy) AS header, seq, repeat('I', length(seq)) AS qual FROM reads, unnest(range(1, cnt + 1)) t(copy) ORDER BY ordinal, copy LIMIT 2000) UNION ALL SELECT ordinal, concat('@', read_id), seq, qual FROM reads WHERE ordinal % 10 = 0",
)


def _consensus_sql(pieces: str, key: str) -> str:
    """CTE agreed (key, consensus) of the CTE ``pieces`` (key, ordinal, seq)."""
    return f"""cper AS (SELECT {key}, count(*) AS n, count(DISTINCT seq) AS kinds, arg_min(seq, ordinal) AS first FROM {pieces} GROUP BY {key}),
cb AS (SELECT {key}, i, substr(seq, CAST(i AS INT), 1) AS b, count(*) AS m, min(ordinal) AS seen FROM {pieces}, unnest(range(1, length(seq) + 1)) t(i) GROUP BY ALL),
ct AS (SELECT {key}, i, b, m, sum(m) OVER (PARTITION BY {key}, i) AS total FROM cb QUALIFY row_number() OVER (PARTITION BY {key}, i ORDER BY m DESC, seen) = 1),
cl AS (SELECT {key}, string_agg(CASE WHEN m / CAST(total AS DOUBLE) > 0.7e0 THEN b ELSE 'N' END, '' ORDER BY i) AS letters FROM ct JOIN cper USING ({key}) WHERE i <= length(first) GROUP BY {key}),
agreed AS (SELECT {key}, CASE WHEN kinds = 1 THEN first WHEN kinds / CAST(n AS DOUBLE) > 0.8e0 THEN repeat('N', length(first)) ELSE letters END AS consensus FROM cper JOIN cl USING ({key}))"""


HEAD = "heads AS (SELECT ordinal, seq FROM reads ORDER BY ordinal LIMIT 50)"
_add(
    "g02_layout_regions",
    lambda s, d: seqspec.layout_regions(_told(s, d), reads(s, d)),
    f"""{R}, {TOLD}, {HEAD}, ranges AS (SELECT priority, 0 AS o, 'umi' AS kind, 0 AS s, u AS e FROM told WHERE u IS NOT NULL UNION ALL SELECT priority, 1, 'barcode', b0, b0 + 3 FROM told WHERE b0 IS NOT NULL),
gp AS (SELECT priority * 10 + o AS k, ordinal, substr(seq, s + 1, e - s) AS seq FROM heads, ranges WHERE e <= length(seq)), {_consensus_sql("gp", "k")}, every_one AS (
SELECT priority, o, concat(kind, '_1') AS region_id, kind AS region_type, CASE WHEN kind = 'umi' OR consensus IS NULL THEN 'random' ELSE 'onlist' END AS sequence_type, CASE kind WHEN 'umi' THEN 'UMI 1' ELSE 'Sample Barcode 1' END AS name, CASE kind WHEN 'umi' THEN coalesce(consensus, repeat('N', e - s)) ELSE consensus END AS sequence, e - s AS min_len, e - s AS max_len FROM ranges LEFT JOIN agreed ON k = priority * 10 + o
UNION ALL SELECT priority, 2, 'adapter_1', CASE WHEN contains(adapter, 'AGATCGG') THEN 'illumina_p7' ELSE 'custom_primer' END, 'fixed', 'Adapter 1', adapter, length(adapter), length(adapter) FROM told
UNION ALL SELECT priority, 3, 'rpf_sequence', 'cdna', 'joined', 'Ribosome Protected Fragment', NULL, 20, CAST(30 + priority % 9 AS INT) FROM told)
SELECT priority, CAST(row_number() OVER (PARTITION BY priority ORDER BY o) - 1 AS INT) AS idx, region_id, region_type, sequence_type, name, sequence, CAST(min_len AS INT) AS min_len, CAST(max_len AS INT) AS max_len FROM every_one""",
)
_add(
    "g03_segment_regions",
    lambda s, d: seqspec.segment_regions(segment.path_segments(_binned(s, d)), reads(s, d)),
    f"""{R}, {BINS}, {_paths_sql('bem')}, {PSEG}, {HEAD}, gp AS (SELECT bin * 10 + k AS q, ordinal, substr(seq, CAST(s AS INT) + 1, CAST(e - s AS INT)) AS seq FROM heads, psegs WHERE e <= length(seq)), {_consensus_sql("gp", "q")}
SELECT bin, k AS idx, concat_ws('_', type, s, e) AS region_id, CASE type WHEN 'rpf' THEN 'cdna' WHEN 'adapter' THEN 'illumina_p7' ELSE type END AS region_type, CASE type WHEN 'rpf' THEN 'joined' WHEN 'adapter' THEN 'fixed' ELSE 'random' END AS sequence_type,
CASE type WHEN 'rpf' THEN 'Rpf' WHEN 'umi' THEN 'Umi' ELSE 'Adapter' END || ' region (' || s || '-' || e || ')' AS name, consensus AS sequence, CAST(e - s AS INT) AS min_len, CAST(e - s AS INT) AS max_len FROM psegs LEFT JOIN agreed ON q = bin * 10 + k""",
)
_add(
    "g04_header_regions",
    lambda s, d: seqspec.header_regions(_annotated(s, d).select("ordinal", "header"), reads(s, d)).select("region_id", "region_type", "sequence", "min_len", "max_len", "occurrences"),
    f"""{AN}, {ELEMENTS}, {TYPES}, first_hundred AS (SELECT ordinal, seq FROM annotated ORDER BY ordinal LIMIT 100),
starts AS (SELECT e.ordinal, idx, element, n, coalesce(sum(n) OVER (PARTITION BY e.ordinal ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM els e JOIN first_hundred USING (ordinal)),
gp AS (SELECT element, n, s.ordinal, substr(seq, CAST(start + 1 AS INT), n) AS seq FROM starts s JOIN first_hundred USING (ordinal) WHERE start + n <= length(seq)), full_gp AS (SELECT * FROM gp WHERE seq <> ''), {_consensus_sql("full_gp", "element")}
SELECT concat('region_', element) AS region_id, coalesce(any_value(region_type), 'unknown') AS region_type, any_value(consensus) AS sequence, min(n) AS min_len, max(n) AS max_len, count(*) AS occurrences FROM gp LEFT JOIN agreed USING (element) LEFT JOIN types USING (element) GROUP BY element""",
)

# whole extraction


def extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of framed reads: the layout is matched on the signals, its RPF start sliced, adapters cut, short ones dropped."""
    source = framed_reads(spark, sf_dir)
    parts = signals.gathered(signals.composition(source))
    layouts = architecture.builtin(spark)
    found = architecture.best_match(architecture.evaluate(layouts, parts, signals.entropy(parts))).select("priority")
    start = layouts.join(found, "priority").select("rpf_start")
    cut = source.join(F.broadcast(start)).withColumn("seq", F.substring(F.col("seq"), F.col("rpf_start") + 1, F.length("seq"))).drop("rpf_start")  # one row
    return extract.trimmed(cut, adapters.all_adapters()).where(F.length("seq") >= extract.MIN_LENGTH).select("ordinal", "seq", F.length("seq").cast("long").alias("n"))


_add("k04_extract_fragments", extraction, f"{FE}, c AS (SELECT ordinal, substr(seq, CAST((SELECT rpf_start FROM arch JOIN evald USING (priority) WHERE score >= 0.8e0 ORDER BY score DESC, priority LIMIT 1) + 1 AS INT)) AS seq FROM framed), t AS (SELECT ordinal, substr(seq, 1, CAST({TRIM} AS INT)) AS seq FROM c) SELECT ordinal, seq, CAST(length(seq) AS BIGINT) AS n FROM t WHERE length(seq) >= 20")
_add("k04_fastq_records", lambda s, d: extract.as_fastq(extract.extract(reads(s, d), 0)), f"{R} SELECT ordinal, concat('@', read_id, '_RPF', chr(10), seq, chr(10), '+', chr(10), qual) AS record FROM reads WHERE length(seq) >= 20")

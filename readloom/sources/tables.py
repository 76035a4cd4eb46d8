"""Reads and alignments derived from general tables, for use without sequence files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS, READ_LETTERS, QUALITIES = "0123456789abcdef", "ACGTACGTACGTACGT", "#+5:?@ABCDEFGHIJ"
SHIFTED_ADAPTER = "AGATCGGAAGAGCAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, read_id, seq, qual, cnt) from ``events``; the ordinal is the event's own key, so nothing is numbered in one task."""
    key = F.col("event_id").cast("string")
    md5 = lambda *parts: F.md5(F.concat(*parts))
    body = F.translate(F.concat(F.md5(key), md5(F.lit("b"), key)), LETTERS, READ_LETTERS)
    tail = F.when(F.col("event_id") % 4 == 0, F.substring(F.lit(SHIFTED_ADAPTER), F.lit(1), (6 + F.col("event_id") % 10).cast("int"))).otherwise("")
    events = table(spark, sf_dir, "events").select("event_id")
    seq = F.concat(F.substring(body, F.lit(1), (18 + F.col("event_id") % 23).cast("int")), tail)
    quality = F.translate(F.concat(md5(F.lit("q"), key), md5(F.lit("r"), key)), LETTERS, QUALITIES)
    found = events.select("event_id", seq.alias("seq"), quality.alias("q"))
    return found.select(
        F.col("event_id").alias("ordinal"), F.col("event_id").alias("read_id"), "seq", F.substring("q", F.lit(1), F.length("seq")).alias("qual"), (1 + F.col("event_id") % 20).alias("cnt")
    )


READS_SQL = f"""reads AS (
  SELECT event_id AS ordinal, event_id AS read_id, 1 + event_id % 20 AS cnt, seq, substr(q64, 1, length(seq)) AS qual FROM (
    SELECT event_id,
      concat(substr(translate(concat(md5(cast(event_id AS string)), md5(concat('b', cast(event_id AS string)))), '{LETTERS}', '{READ_LETTERS}'), 1, cast(18 + event_id % 23 AS int)),
             CASE WHEN event_id % 4 = 0 THEN substr('{SHIFTED_ADAPTER}', 1, cast(6 + event_id % 10 AS int)) ELSE '' END) AS seq,
      translate(concat(md5(concat('q', cast(event_id AS string))), md5(concat('r', cast(event_id AS string)))), '{LETTERS}', '{QUALITIES}') AS q64
    FROM events) z
)"""


def framed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with a fixed layout: a leading random part, the body cut to 30, and a full adapter at the end."""
    found = reads(spark, sf_dir)
    return found.withColumn("seq", F.concat(F.substring("seq", 1, 24), F.lit("TGGAATTCTCGGGTGCCAAGG"))).drop("qual")


FRAMED_SQL = "framed AS (SELECT ordinal, read_id, cnt, concat(substr(seq, 1, 24), 'TGGAATTCTCGGGTGCCAAGG') AS seq FROM reads)"


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAM-like rows (flag, cigar, read_len) from ``orders``."""
    k = F.col("o_orderkey")
    length = (26 + k % 9).cast("int")
    five, three = F.when(k % 3 == 0, F.lit(0)).otherwise((k % 5) % 3).cast("int"), F.when(k % 7 == 0, F.lit(2)).otherwise(F.lit(0)).cast("int")
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    cigar = F.concat(clip(five), (length - five - three).cast("string"), F.lit("M"), clip(three))
    flag = F.when(k % 11 == 0, 4).otherwise(F.when(k % 2 == 0, 16).otherwise(0))
    return table(spark, sf_dir, "orders").select(k.alias("ordinal"), flag.alias("flag"), cigar.alias("cigar"), length.alias("read_len"))


ALIGNMENTS_SQL = """sam AS (
  SELECT k AS ordinal, CASE WHEN k % 11 = 0 THEN 4 WHEN k % 2 = 0 THEN 16 ELSE 0 END AS flag, n AS read_len,
         concat(CASE WHEN five > 0 THEN concat(five, 'S') ELSE '' END, n - five - three, 'M', CASE WHEN three > 0 THEN concat(three, 'S') ELSE '' END) AS cigar
  FROM (SELECT o_orderkey AS k, cast(26 + o_orderkey % 9 AS int) AS n, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE (o_orderkey % 5) % 3 END AS five,
               CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 0 END AS three FROM orders) z
), clips AS (
  SELECT ordinal, read_len, coalesce(try_cast(regexp_extract(cigar, '^(\\d+)S', 1) AS int), 0) AS clip5, coalesce(try_cast(regexp_extract(cigar, '(\\d+)S$', 1) AS int), 0) AS clip3
  FROM sam WHERE flag & 4 = 0
)"""

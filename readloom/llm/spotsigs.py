"""SpotSigs fingerprints: chains of content words that follow common words.

A text is lower-cased and split into runs of letters and digits. Words of ``ANCHORS`` are anchors, all others content. A
spot is a content word right after one or more anchors; its signature is these anchors and the chain of ``CHAIN`` content
words that starts there, as sixteen hex digits. The set of signatures, sorted, is the fingerprint; likeness is the Jaccard
coefficient of two sets, and sets whose lengths alone keep it below a threshold are not compared. A text without a spot
has its own digest as only signature; an empty one has none, and two empty sets have likeness 1.

All is DataFrame functions. ``with_next`` gives each row the text and signatures of the next document by id: bounds from
mergeable quantile sketches deal the ids into ordered buckets of about ``BUCKET_ROWS`` rows, the least row of each bucket
visits the bucket before it as well, and a window within the bucket looks one row ahead. So texts shuffle once and no task
gets more than its buckets, whatever the ids' distribution. Beyond ``MAX_BUCKETS`` times ``BUCKET_ROWS`` rows buckets grow
(so many bounds are what the driver and the plan hold at most); a bucket is sorted and read through once, with spill.

Defined results: null text counts as empty; a null id sorts first; of rows with equal ids the lesser text comes first; the
document after the last is the first; a sole document follows itself. Extra columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import table

CHAIN = 3
DIGITS = 16
BUCKET_ROWS = 128
MAX_BUCKETS = 90_000

#: Common words of English, French, German and Spanish: fixed values.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "auf das dem den der die ein eine ist mit nicht sich sie und von zu "
    "al con del el ha las lo los no para por su una y"
).split()


def with_signatures(df: DataFrame, text: str = "text", into: str = "signatures", chain: int = CHAIN) -> DataFrame:
    """``df`` with the sorted array of the text's distinct signatures."""
    anchors = "|".join(sorted(ANCHORS))
    words, marked, spots, content = (f"_{into}_{x}" for x in ("words", "marked", "spots", "content"))
    # anchors are tied to the word after them, so that an array element is a content word with its anchors
    df = df.withColumn(words, F.concat(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" ")))
    df = df.withColumn(marked, F.split(F.trim(F.regexp_replace(words, rf"(?<![^ ])({anchors}) ", "$1~")), " "))
    df = df.withColumn(marked, F.filter(marked, lambda w: (w != "") & ~w.endswith("~"))).drop(words)
    df = df.withColumn(content, F.transform(marked, lambda w: F.substring_index(w, "~", -1)))
    indexes = F.when(F.size(marked) >= chain, F.sequence(F.lit(0), F.size(marked) - chain)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(spots, F.filter(indexes, lambda i: F.contains(F.get(marked, i), F.lit("~"))))
    signature = lambda i: F.substring(F.md5(F.concat_ws(" ", F.get(marked, i), *[F.get(content, i + k) for k in range(1, chain)])), 1, DIGITS)
    found = F.array_sort(F.array_distinct(F.transform(spots, signature)))
    df = df.withColumn(into, found).drop(marked, spots, content)
    alone = F.when(F.length(text) > 0, F.array(F.substring(F.md5(text), 1, DIGITS))).otherwise(F.array().cast("array<string>"))
    return df.withColumn(into, F.when(F.size(into) > 0, F.col(into)).otherwise(alone))


def likeness(a: str, b: str, threshold: float = 0.0) -> Column:
    """Jaccard coefficient of two signature arrays; 0 for those that cannot reach the threshold by their lengths."""
    less, more = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    full = common / (less + more - common)
    return F.when(more == 0, 1.0).when((less == 0) | (less < threshold * more), 0.0).otherwise(full)


def with_next(documents: DataFrame) -> DataFrame:
    """(doc_id, text, signatures, next_text, next_signatures) for each document; null text as empty."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("_key"))
    n = docs.count()
    if not n:
        empty = with_signatures(docs.drop("_key"))
        return empty.withColumns({"next_text": F.col("text"), "next_signatures": F.col("signatures")})
    buckets = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    cuts = [k / buckets for k in range(1, buckets)] or [0.5]
    least, marks = docs.agg(F.min("_key"), F.percentile_approx("_key", cuts, min(1_000_000, max(10_000, 10 * buckets)))).first()
    bounds = sorted({least, *(marks if buckets > 1 else [])})  # at most MAX_BUCKETS numbers
    step = max(1, math.isqrt(len(bounds)))
    tops, parts = bounds[::step], [bounds[i : i + step] for i in range(0, len(bounds), step)]
    literal = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    docs = docs.withColumn("_top", F.size(F.filter(literal(tops), lambda b: b <= F.col("_key"))) - 1)
    docs = docs.withColumn("_part", F.get(F.array(*map(literal, parts)), F.col("_top")))
    docs = docs.withColumn("_at", F.size(F.filter("_part", lambda b: b <= F.col("_key"))) - 1)
    docs = docs.withColumn("_bucket", F.col("_top") * step + F.col("_at")).withColumn("_first", F.get("_part", F.col("_at")) == F.col("_key"))
    stays = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("guest"))
    visits = F.struct(F.pmod(F.col("_bucket") - 1, F.lit(len(bounds))).alias("bucket"), F.lit(1).alias("guest"))
    docs = docs.withColumn("_seat", F.explode(F.when(F.col("_first"), F.array(stays, visits)).otherwise(F.array(stays))))
    dealt = docs.select("doc_id", "text", "_key", F.col("_seat.bucket").alias("_bucket"), F.col("_seat.guest").alias("_guest")).repartition("_bucket")
    ahead = Window.partitionBy("_bucket").orderBy("_guest", "_key", "text")
    seen = with_signatures(dealt)
    seen = seen.withColumns({"next_text": F.lead("text").over(ahead), "next_signatures": F.lead("signatures").over(ahead)})
    return seen.where("_guest = 0").drop("_key", "_bucket", "_guest")


def similar_pairs(documents: DataFrame, threshold: float = 0.75, growth: float = 1.25) -> tuple[DataFrame, DataFrame]:
    """Pairs of fingerprints with likeness of at least ``threshold``, and the fingerprint of each document.

    Returns (pairs: left, right, likeness; membership: doc_id, fingerprint), with fingerprints as lesser and greater
    string; documents of equal fingerprints are one class, so copies make no pairs. Lengths are partitioned by powers of
    ``growth``; a set meets those partitions that hold lengths within the threshold. It is looked up there by the least
    ``n - ceil(threshold n) + 1`` of its signatures, of which two sets over the threshold share one.
    """
    sets = with_signatures(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    sets = sets.withColumn("fingerprint", F.concat_ws("", "signatures"))
    # empty texts alone have no signatures; a filter on these would be pushed below and derive them anew for each word
    classes = sets.where(F.length("text") > 0).groupBy("fingerprint").agg(F.any_value("signatures").alias("s"))
    classes = classes.withColumns({"class": F.unhex(F.md5("fingerprint")), "n": F.size("s")})
    part = lambda n: F.floor(F.log(n) / math.log(growth)).cast("int")
    n = F.col("n")
    # probes carry a class's name and length, not its set; sets go to the pairs that lengths and a signature leave
    probes = classes.select("class", "n", F.explode(F.slice("s", F.lit(1), (n - F.ceil(threshold * n - 1e-9) + 1).cast("int"))).alias("signature"))
    home = probes.select(F.col("class").alias("other"), F.col("n").alias("m"), "signature", part(n).alias("part"))
    # the shorter set visits its own partition and the longer ones in reach
    roam = probes.withColumn("part", F.explode(F.sequence(part(n), part(F.floor(n / threshold + 1e-9)))))
    longer = (n < F.col("m")) | ((n == F.col("m")) & (F.col("class") < F.col("other")))
    met = roam.join(home, ["part", "signature"]).where(longer & (n >= threshold * F.col("m") - 1e-9)).select("class", "other").distinct()
    one = classes.select("class", F.col("fingerprint").alias("f"), "s")
    two = classes.select(F.col("class").alias("other"), F.col("fingerprint").alias("g"), F.col("s").alias("t"))
    found = met.join(one, "class").join(two, "other").withColumn("likeness", likeness("s", "t", threshold)).where(F.col("likeness") >= threshold)
    pairs = found.select(F.least("f", "g").alias("left"), F.greatest("f", "g").alias("right"), "likeness")
    return pairs, sets.select("doc_id", "fingerprint")


def fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(table(spark, sf_dir, "documents"))
    docs = docs.withColumn("near_next", likeness("signatures", "next_signatures")).drop("next_signatures")
    docs = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("_cut", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("_cut")).cast("int")), F.substring("next_text", F.lit(1), F.col("_cut")))
    docs = with_signatures(docs.withColumn("edited", edited).drop("text", "next_text", "_cut"), "edited", "edited_signatures")
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.concat_ws("", "signatures").alias("fingerprint"),
        F.concat_ws("", "edited_signatures").alias("edited_fingerprint"),
        likeness("signatures", "edited_signatures").alias("near_edited"),
        "near_next",
    )


def _oracle_signatures(source: str, out: str) -> str:
    """CTEs that give (doc_id, sigs) as ``out`` for the (doc_id, text) of ``source``."""
    anchors = ", ".join(f"'{a}'" for a in sorted(ANCHORS))
    following = "".join(f", lead(w, {k}) OVER by_doc AS w{k}" for k in range(1, CHAIN))
    chain = " || ' ' || ".join(f"w{k}" for k in range(1, CHAIN))
    return f"""{out}_w AS (
  SELECT doc_id, text, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), ' ') AS ws FROM {source}
), {out}_p AS (
  SELECT doc_id, ws, pos, ws[pos] AS w FROM {out}_w, unnest(range(1, len(ws) + 1)) AS t(pos)
), {out}_c AS (
  SELECT doc_id, ws, pos, w, coalesce(lag(pos) OVER by_doc, 0) AS before{following}
  FROM {out}_p WHERE w <> '' AND w NOT IN ({anchors}) WINDOW by_doc AS (PARTITION BY doc_id ORDER BY pos)
), {out}_s AS (
  SELECT doc_id, list_sort(list(DISTINCT substr(md5(array_to_string(list_slice(ws, before + 1, pos - 1), '~') || '~' || w || ' ' || {chain}), 1, {DIGITS}))) AS sigs
  FROM {out}_c WHERE pos - before > 1 AND w{CHAIN - 1} IS NOT NULL GROUP BY doc_id
), {out} AS (
  SELECT a.doc_id, CASE WHEN sigs IS NOT NULL THEN sigs WHEN length(text) > 0 THEN [substr(md5(text), 1, {DIGITS})] ELSE CAST([] AS VARCHAR[]) END AS sigs
  FROM {out}_w a LEFT JOIN {out}_s USING (doc_id)
)"""


def _oracle_likeness(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE {common} / CAST(len({a}) + len({b}) - {common} AS DOUBLE) END"


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), o AS (
  SELECT doc_id, text, n, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text,
         coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM d WINDOW w AS (ORDER BY doc_id)
), e AS (
  SELECT doc_id, next_id, n, substr(text, 1, n - n // 2) || substr(next_text, 1, n // 2) AS text FROM o
), {_oracle_signatures("d", "own")}, {_oracle_signatures("e", "ed")}
SELECT e.doc_id, CAST(n AS BIGINT) AS n_chars, sha256(text) AS edited_sha256, array_to_string(own.sigs, '') AS fingerprint,
       array_to_string(ed.sigs, '') AS edited_fingerprint, {_oracle_likeness("own.sigs", "ed.sigs")} AS near_edited,
       {_oracle_likeness("own.sigs", "nxt.sigs")} AS near_next
FROM e JOIN own USING (doc_id) JOIN ed USING (doc_id) JOIN own AS nxt ON nxt.doc_id = e.next_id
"""

"""Quality rules with cross-document line frequency.

Lines are normalised (A-Z lower-cased, runs of ASCII white space collapsed) and hashed; for each host (``source``) the
distinct documents holding a line are counted; lines above the limit are removed; documents left depleted are rejected.

What counts as a distinct document: a digest of its whole normalised text (lower case, white space collapsed), so copies
count once, however many they are, and a line that documents share is not their identity. A line is removed if more than
``max_documents`` distinct documents of the host hold it. Near copies are documents of their own.

Defined results: a null or empty text has no words and fails; a null source is a host of its own; repeated rows get equal
verdicts each; ids may be null or repeated, since documents are joined by a digest of id, source and text. A text of any
length is one row with its distinct lines. Other columns don't matter, whatever their names; ``apply`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import checkpointed, free_shuffles, slices, table, unused

MAX_DOCUMENTS = 30
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_KEPT_PERCENT = 30
WINDOW = 5

#: The characters that count as symbols and as white space: fixed values.
SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"

_FEATURES = (
    "row_key binary, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, line_keys array<binary>, line_words array<int>, content binary"
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of ``window`` words that occurs at least twice in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    ranks, span = ids[:n], len(seen)
    for k in range(1, window):
        if int(ranks.max()) + 1 > (1 << 62) // span:
            ranks = np.unique(ranks, return_inverse=True)[1]
        ranks = ranks * span + ids[k : k + n]
    order = np.argsort(ranks, kind="stable")
    same = ranks[order[1:]] == ranks[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _id_bytes(doc_id: int | None, host: str | None) -> bytes:
    return f"{'' if doc_id is None else doc_id}|{'-' if host is None else '+' + host}|".encode()


def _id_part():
    """What ``_id_bytes`` gives, as a column."""
    host = F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-"))
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), host, F.lit("|")).cast("binary")


def line_key(line: bytes) -> bytes | None:
    """Sixteen bytes for the normalised line; none for a line without a word."""
    words = line.lower().split()
    return hashlib.md5(b" ".join(words)).digest() if words else None


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _FEATURES.split(", ")]
    types = [pa.binary(), pa.int64(), pa.string(), *[pa.int64()] * 5, pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
    for batch in slices(batches):
        rows = []
        for doc_id, text, host in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            text = text or ""
            raw = text.encode()
            words = raw.split()
            lines = raw.split(b"\n")
            per_line: dict[bytes, int] = {}
            earlier: set[bytes] = set()
            dup = 0
            for line in lines:
                own = line.lower().split()
                if own:
                    dup += line in earlier
                    earlier.add(line)
                    key = hashlib.md5(b" ".join(own)).digest()
                    per_line[key] = per_line.get(key, 0) + len(own)
            rows.append(
                (
                    hashlib.md5(_id_bytes(doc_id, host) + raw).digest(),
                    doc_id,
                    host,
                    len(words),
                    len(text) - sum(map(text.count, SPACES)),
                    sum(map(text.count, SYMBOLS)),
                    dup,
                    repeated_words(words),
                    list(per_line),
                    list(per_line.values()),
                    hashlib.md5(b" ".join(raw.lower().split())).digest(),
                )
            )
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)


def features(documents: DataFrame) -> DataFrame:
    """One row per document: the base counts, and its distinct lines with the words they hold in all."""
    return documents.select("doc_id", "text", "source").mapInArrow(_features, _FEATURES)


def frequent_lines(per_document: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """(host, line_key) of the lines to remove.

    Rows are first collapsed to one for each host, line and distinct document, then to one for each host and line; both
    steps combine before they shuffle, so a line that a third of all rows hold arrives as one row from each task.
    """
    lines = per_document.select("host", "content", F.explode("line_keys").alias("line_key"))
    by_content = lines.distinct()
    return (
        by_content.groupBy("host", "line_key")
        .agg(F.count(F.lit(1)).alias("n_documents"))
        .where(F.col("n_documents") > max_documents)
        .select("host", "line_key")
    )


def removed_lines(per_document: DataFrame, frequent: DataFrame) -> DataFrame:
    """(row_key, removed, removed_words) of the documents that lose lines."""
    # repeated rows have equal keys and lines, so that each line counts once for a key
    held = per_document.select("row_key", F.coalesce(F.concat(F.lit("h"), "host"), F.lit("")).alias("host"), F.arrays_zip("line_keys", "line_words").alias("lines"))
    held = held.select("row_key", "host", F.explode("lines").alias("line")).select("row_key", "host", F.col("line.line_keys").alias("line_key"), F.col("line.line_words").alias("n"))
    frequent = frequent.select(F.coalesce(F.concat(F.lit("h"), "host"), F.lit("")).alias("host"), "line_key")
    per_key = held.join(frequent, ["host", "line_key"]).groupBy("row_key").agg(F.collect_set(F.struct("line_key", "n")).alias("lines"))
    return per_key.select("row_key", F.col("lines.line_key").alias("removed"), F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("removed_words"))


def verdicts(
    documents: DataFrame,
    max_documents: int = MAX_DOCUMENTS,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    min_kept_percent: int = MIN_KEPT_PERCENT,
) -> DataFrame:
    """One row per document: row_key, doc_id, the base counts, base_failed, removed (line keys), removed_words, kept."""
    per_document = checkpointed(features(documents))
    gone = removed_lines(per_document, frequent_lines(per_document, max_documents))
    left = F.col("n_words") - F.col("removed_words")
    return (
        per_document.drop("line_keys", "line_words", "content")
        .join(gone, "row_key", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
        .withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (left >= min_words) & (100 * left >= min_kept_percent * F.col("n_words")))
    )


def _cut(removed: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, gone = batch.column("text").to_pylist(), batch.column(removed).to_pylist()
            cut = []
            for text, keys in zip(texts, gone, strict=True):
                if text and keys:
                    drop = set(keys)
                    text = "\n".join(x for x in text.split("\n") if line_key(x.encode()) not in drop)
                cut.append(text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(cut, batch.schema.field(at).type)).drop_columns([removed])

    return run


def apply(documents: DataFrame, **limits: int) -> DataFrame:
    """The kept documents, without the lines removed; n_chars follows the text. Other columns pass unchanged."""
    columns, row_key, removed = documents.columns, unused(documents, "row_key"), unused(documents, "removed")
    found = checkpointed(verdicts(documents, **limits).where("kept").groupBy("row_key").agg(F.first("removed").alias(removed)).withColumnRenamed("row_key", row_key))
    free_shuffles(documents.sparkSession)  # before the texts shuffle
    key = F.unhex(F.md5(F.concat(_id_part(), F.coalesce(F.col("text").cast("binary"), F.lit(b"")))))
    joined = documents.withColumn(row_key, key).join(found, row_key).select(*columns, removed)
    cut = joined.mapInArrow(_cut(removed), documents.schema)
    if "n_chars" in columns:
        cut = cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long")))
    return cut.select(*columns)


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
         string_split(text, chr(10)) AS lines FROM d
), g AS (
  SELECT doc_id, i, list_slice(words, i, i + 4) AS gram FROM w, unnest(range(1, CAST(len(words) - 3 AS BIGINT))) AS t(i)
), hit AS (
  SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS at
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT doc_id, count(*) AS n_repeat_words FROM hit GROUP BY doc_id
), l AS (
  SELECT doc_id, source, unnest(lines) AS line, regexp_extract_all(unnest(lines), '[^\\x20\\x09-\\x0D]+') AS lw FROM w
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE len(lw) > 0 GROUP BY doc_id
), k AS (
  SELECT doc_id, source, len(lw) AS n, md5(translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS key
  FROM l WHERE len(lw) > 0
), whole AS (
  SELECT doc_id, md5(translate(array_to_string(words, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS content FROM w
), freq AS (
  SELECT source, key FROM k JOIN whole USING (doc_id) GROUP BY source, key HAVING count(DISTINCT content) > {MAX_DOCUMENTS}
), gone AS (
  SELECT doc_id, sum(n) AS removed_words FROM k JOIN freq ON k.key = freq.key AND k.source IS NOT DISTINCT FROM freq.source GROUP BY doc_id
), base AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
), failed AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - removed_words >= {MIN_WORDS} AND 100 * (n_words - removed_words) >= {MIN_KEPT_PERCENT} * n_words AS kept,
       removed_words
FROM failed
"""

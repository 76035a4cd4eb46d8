"""Sequence files as a PySpark Python data source: FASTQ, FASTA and collapsed FASTA, plain, gzip or bzip2.

``spark.read.format("sequences").option("format", "fastq").load(path)`` yields (file, ordinal, read_id, seq, qual), the
ordinal growing with the place in the file. Plain FASTQ files of over ``SPLIT_BYTES`` are read in ranges of that size: a range
begins with the first header in it, a line that starts with ``@`` two lines above one that starts with ``+`` (a quality line
may start with ``@``, but the line two below it is a sequence), and ordinals are byte offsets there. Other files are a
partition each; write the result as Parquet once, and later scans split, prune and push down.
"""

from __future__ import annotations

import bz2
import glob
import gzip
import io
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, ordinal long, read_id string, seq string, qual string"
FORMATS = ("fastq", "fasta", "collapsed")
BATCH_ROWS = 8192
SPLIT_BYTES = 64 << 20


def check_format(kind: str) -> str:
    if kind.lower() not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}, not {kind!r}")
    return kind.lower()


def check_readable(path: str | os.PathLike) -> None:
    """Raises for what is no path, missing, or not readable."""
    if not isinstance(path, str | os.PathLike):
        raise TypeError(f"a path is a string or path object, not {type(path).__name__}")
    if not os.path.exists(path):
        raise FileNotFoundError(str(path))
    if not os.access(path, os.R_OK):
        raise PermissionError(str(path))


def open_text(path: str) -> io.TextIOBase:
    """By suffix: .gz, .bz2, else plain."""
    opener = {".gz": gzip.open, ".bz2": bz2.open}.get(os.path.splitext(path)[1], open)
    return opener(path, "rt")


def fastq(lines: Iterator[str], strict: bool = False) -> Iterator[tuple[str, str, str | None]]:
    """Four lines a record; ends at a blank header. Records without bases are left out. ``strict`` refuses malformed ones."""
    for header in lines:
        header = header.rstrip("\r\n")
        if not header.strip():
            return
        seq, plus, qual = (next(lines, "").strip() for _ in range(3))
        if strict and (not header.startswith("@") or not plus.startswith("+") or len(seq) != len(qual)):
            raise ValueError(f"malformed record {header!r}")
        if seq:
            yield header[1:] if header.startswith("@") else header, seq, qual


def fasta(lines: Iterator[str]) -> Iterator[tuple[str, str, str | None]]:
    """A header and any number of sequence lines; blank lines don't count."""
    header, parts = None, []
    for line in lines:
        line = line.strip()
        if line.startswith(">"):
            if header is not None and parts:
                yield header, "".join(parts), None
            header, parts = line[1:], []
        elif line:
            parts.append(line)
    if header is not None and parts:
        yield header, "".join(parts), None


def first_header(held, start: int) -> int:
    """The offset of the first FASTQ header at or after ``start`` in a binary file; its size if there is none."""
    held.seek(max(0, start - 1))
    at = start if not start else start - 1 + len(held.readline())  # a line that begins before is another range's
    lines: list[tuple[int, bytes]] = []
    while line := held.readline():
        lines.append((at, line))
        at += len(line)
        if len(lines) >= 3 and lines[-3][1].startswith(b"@") and line.startswith(b"+"):
            return lines[-3][0]
    return at


def fastq_range(held, start: int, end: int, strict: bool = False) -> Iterator[tuple[int, str, str, str]]:
    """(offset, read_id, seq, qual) of the records whose headers begin from ``start`` to before ``end``."""
    at = first_header(held, start)
    held.seek(at)
    while at < end:
        raw = [held.readline() for _ in range(4)]
        for record in fastq(iter([x.decode() for x in raw]), strict):
            yield at, *record
        at += sum(map(len, raw))
        if not raw[0].strip():
            return


@dataclass
class File(InputPartition):
    path: str
    start: int = 0
    end: int = -1


class SequenceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], check_format(options.get("format", "fastq"))
        self.strict, self.limit = options.get("strict", "false") == "true", int(options.get("maxrecords", options.get("maxRecords", -1)))

    def partitions(self) -> list[File]:
        paths = sorted(p for p in glob.glob(os.path.join(self.path, "*") if os.path.isdir(self.path) else self.path) if os.path.isfile(p))
        if not paths:
            raise FileNotFoundError(self.path)
        for path in paths:
            check_readable(path)
        out = []
        for path in paths:
            size = os.path.getsize(path)
            whole = self.kind != "fastq" or self.limit >= 0 or path.endswith((".gz", ".bz2")) or size <= SPLIT_BYTES
            out += [File(path)] if whole else [File(path, a, min(size, a + SPLIT_BYTES)) for a in range(0, size, SPLIT_BYTES)]
        return out

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        with open_text(partition.path) if partition.end < 0 else open(partition.path, "rb") as held:
            if partition.end < 0:
                records = fastq(held, self.strict) if self.kind == "fastq" else fasta(held)
                records = ((i, *r) for i, r in enumerate(records if self.limit < 0 else islice(records, self.limit)))
            else:
                records = fastq_range(held, partition.start, partition.end, self.strict)
            while rows := [(partition.path, *r) for r in islice(records, BATCH_ROWS)]:
                types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)


class SequenceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sequences"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SequenceReader:
        return SequenceReader(dict(self.options))


def read_sequences(spark: SparkSession, path: str, kind: str = "fastq", **options: str) -> DataFrame:
    spark.dataSource.register(SequenceSource)
    return spark.read.format("sequences").options(format=check_format(kind), **options).load(str(path))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, flag, cigar, read_len) of SAM text; the ordinal is a unique key, not a line number."""
    from pyspark.sql import functions as F

    lines = spark.read.text(path).where("value not like '@%' and value != ''").withColumn("f", F.split("value", "\t"))
    return lines.select(F.monotonically_increasing_id().alias("ordinal"), F.get("f", F.lit(1)).cast("int").alias("flag"), F.get("f", F.lit(5)).alias("cigar"), F.length(F.get("f", F.lit(9))).alias("read_len"))


def read_architectures(spark: SparkSession, path: str) -> DataFrame:
    """Layouts of a JSON file {"architectures": [...]}, in order; the built-in ones if it can't be read as such."""
    import json

    from readloom.operators import architecture

    try:
        with open(path) as held:
            rows = [
                (i, a["protocol_name"], a["lab_source"], [tuple(x) for x in a["umi_positions"]], [tuple(x) for x in a["barcode_positions"]], a["adapter_sequences"], a["rpf_start"], a["rpf_end"], *a["expected_rpf_length"])
                for i, a in enumerate(json.load(held)["architectures"])
            ]
    except (OSError, ValueError, KeyError, TypeError):
        return architecture.builtin(spark)
    return spark.createDataFrame(rows, architecture.SCHEMA)

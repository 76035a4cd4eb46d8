"""Command line: check, check-cleanliness, detect-adapter, extract, align-detect and decide-trim over sequence files."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from readloom.operators import alignment, architecture, checks, decision, extract, segment, seqspec
from readloom.plans import report
from readloom.sources import aligner, collapsed, specifications
from readloom.sources.sequence_files import FORMATS, check_readable, read_architectures, read_sam, read_sequences


def load(spark: SparkSession, path: str, kind: str, template: str, limit: int | None = None) -> DataFrame:
    """Reads of a file or folder; ``limit`` is of records in all, in order of file and place."""
    check_readable(path)
    options = {} if limit is None else {"maxRecords": str(limit)}  # no file gives more
    found = read_sequences(spark, path, kind, **options)
    found = found if limit is None else extract.head(found, limit)
    if kind == "collapsed":
        return collapsed.with_counts(found.withColumnRenamed("read_id", "header"), template).withColumnRenamed("header", "read_id")
    return (found if kind == "fastq" else found.drop("qual")).withColumn("cnt", F.lit(1).cast("long"))


def extracted(reads: DataFrame, decided: decision.Decision) -> DataFrame:
    """The fragments; none where no RPF segment was found."""
    if decided.rpf is None:
        return reads.limit(0)
    return extract.extract(reads, *decided.rpf, adapters=decided.adapters)


def run_extract(reads: DataFrame, layouts: DataFrame, output: str, kind: str, specified: bool) -> None:
    """Fragments to the folder ``output``, and its reports beside it."""
    decided = decision.decide(reads, layouts)
    kept = extracted(reads, decided)
    kept = kept.orderBy(*[c for c in ("file", "ordinal") if c in kept.columns])
    text = extract.as_fastq(kept) if "qual" in kept.columns else extract.as_fasta(kept)
    seen = Observation("fragments")
    text.select("record").observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(output)
    base = output.rstrip("/")
    entropies = [r.h for r in segment.global_entropies(reads).orderBy("pos").collect()]
    spec = None
    if specified:
        spec = seqspec.specification(reads, decided, reads.select("ordinal", F.col("read_id").alias("header")), layouts)
        Path(f"{base}.seqspec.yaml").write_text(seqspec.to_yaml(spec))
        fasta = seqspec.adapter_fasta(reads.sparkSession.createDataFrame([(i, f"adapter_{i + 1}", a) for i, a in enumerate(decided.adapters)], "idx int, name string, seq string")).orderBy("idx").collect()
        if fasta:
            Path(f"{base}.adapters.fa").write_text("\n".join(r.record for r in fasta) + "\n")
    Path(f"{base}.layout.txt").write_text(report.layout_report(decided.name, decided.segments, entropies))
    Path(f"{base}.report.html").write_text(report.html_report(decided.name, decided.segments, entropies, decided.trace))
    report.write_report(decision.report(decided, seen.get["n"], spec), f"{base}.report.{kind}", kind)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="readloom", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("check", "check-cleanliness", "detect-adapter", "extract", "align-detect", "decide-trim"):
        p = sub.add_parser(name)
        p.add_argument("input")
        p.add_argument("-o", "--output", required=True)
        p.add_argument("-f", "--format", choices=FORMATS, default="fastq")
        p.add_argument("-p", "--count-pattern", default="read_{count}" if name == "check" else "read_{id}_{count}")
        p.add_argument("-n", "--max-reads", type=int)
        p.add_argument("-a", "--adapter", required=name == "detect-adapter")
        p.add_argument("-m", "--min-overlap", type=int, default=10)
        p.add_argument("-M", "--max-mismatches", type=int, default=1)
        p.add_argument("--architectures")
        p.add_argument("--seqspec-dir", help="a folder of specifications whose layouts are tried as well")
        p.add_argument("--seqspec", action="store_true", help="write a specification of what is extracted")
        p.add_argument("--report", choices=("json", "csv"), default="json")
        p.add_argument("--sam", required=name in ("align-detect", "decide-trim"))
        p.add_argument("--log", help="the aligner's log")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    reads = load(spark, a.input, a.format, a.count_pattern, a.max_reads)
    layouts = read_architectures(spark, a.architectures) if a.architectures else architecture.builtin(spark)
    layouts = specifications.with_specifications(layouts, a.seqspec_dir) if a.seqspec_dir else layouts
    write = lambda path, text: Path(path).write_text(text)
    if a.command in ("check", "check-cleanliness"):
        rows = checks.basic_suite(reads) if a.command == "check" else checks.check_suite(reads)
        write(a.output, report.quality_report(reads))
        write(f"{a.output}.checks.txt", report.check_report(rows, checks.failure_categories(rows)))
    elif a.command == "detect-adapter":
        if not a.adapter or set(a.adapter.upper()) - set("ACGTN"):
            parser.error("an adapter has letters of ACGTN")
        write(a.output, report.adapter_report(reads, a.adapter, a.min_overlap, a.max_mismatches))
    elif a.command == "extract":
        run_extract(reads, layouts, a.output, a.report, a.seqspec)
    else:
        per = alignment.per_length(alignment.clips(read_sam(spark, a.sam)))
        trims = alignment.global_consensus(per)
        if a.command == "decide-trim":
            decided = decision.decide(reads, layouts)
            own = spark.createDataFrame([(0, (decided.rpf or (0, -1))[0], decided.layout is not None)], "id int, arch5 int, matched boolean")
            report.write_report(alignment.decide_trim(own, trims.withColumn("id", F.lit(0))).first(), a.output, a.report)
        elif a.log:
            held = alignment.alignment_report(aligner.read_log(spark, a.log).first(), trims.first(), per.orderBy("read_len").collect())
            report.write_report(held, a.output, a.report)
        else:
            report.write_report(trims.first(), a.output, a.report)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

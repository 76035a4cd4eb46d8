import bz2
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from readloom import cli
from readloom.functions import sequence as fn
from readloom.operators import adapters, alignment, architecture, checks, extract, qc, segment, signals
from readloom.plans import report
from readloom.sources import collapsed, sequence_files
from readloom.streaming import qc as stream_qc


def make(spark, seqs, quals=None, cnt=1):
    rows = [(i, f"r{i}", s, quals[i] if quals else None, cnt) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "ordinal long, read_id string, seq string, qual string, cnt long")


def test_header_counts(spark):
    cases = [("read_123_500", "read_{count}", 123500), ("read_123_500", "read_{id}_{count}", 500), ("seq15507_x9", "{id}_x{count}", 9), ("1_count_150", "read_{count}", 1), ("seq1", "{id}_x{count}", 1)]
    for header, template, want in cases:
        assert spark.createDataFrame([(header,)], "h string").select(fn.header_count("h", template)).first()[0] == want, header


def test_adapter_match_by_brute_force(spark):
    random.seed(1)
    adapter, width = "AGATCGGAAGAG", 10
    seqs = ["".join(random.choices("ACGT", k=random.randint(0, 30))) + random.choice(["", adapter, "AGATCGCAAG", "AGAT"]) for _ in range(200)]
    found = {r.ordinal: (r.mm, r.pos) for r in adapters.matches(make(spark, seqs), adapter).collect()}
    for i, s in enumerate(seqs):
        scored = [(sum(a != b for a, b in zip(s[p : p + width], adapter)), p) for p in range(len(s) - width + 1)]
        best = min((x for x in scored if x[0] <= 1), default=None)
        assert found.get(i) == best
    assert adapters.matches(make(spark, seqs), "ACGT").count() == 0


def test_best_path_by_dynamic_programming(spark):
    import math

    rng = random.Random(2)
    rows, want = [], {}
    for g in range(25):
        n = rng.randint(1, 14)
        e = [[rng.uniform(-4, 1) for _ in range(3)] for _ in range(n)]
        rows += [(g, p, *e[p]) for p in range(n)]
        step = {(0, 0): 0.8, (0, 1): 0.2, (1, 1): 0.95, (1, 2): 0.05, (2, 2): 0.99}
        best = [math.log(0.3) + e[0][0], math.log(0.6) + e[0][1], -math.inf]
        for p in range(1, n):
            best = [max(best[a] + math.log(step[a, b]) for a in range(3) if (a, b) in step) + e[p][b] for b in range(3)]
        want[g] = max(best)
    df = spark.createDataFrame(rows, "bin int, pos int, e_umi double, e_rpf double, e_adapter double")
    got = {r.bin: r.score for r in segment.best_paths(df).collect()}
    assert got == pytest.approx(want)


def test_checks_and_categories(spark):
    good = make(spark, ["".join(random.Random(i).choices("ACGT", k=30)) for i in range(200)])
    rows = {r.check: r.status for r in checks.check_suite(good).collect()}
    assert set(rows.values()) == {"PASS"}
    bad = make(spark, ["A" * 15 + "ACGTACGTACGTACGTACGTACGTA"] * 100)
    found = checks.failure_categories(checks.check_suite(bad)).first()
    assert not found.is_clean and found.primary == "length_distribution" and "base_composition" in found.categories
    assert [r.check for r in checks.basic_suite(good).orderBy("idx").collect()] == ["Length Distribution", "Base Composition", "GC Content"]


def test_empty_reads(spark):
    empty = make(spark, [])
    assert qc.gc_summary(empty).first().gc_pct is None and qc.base_counts(empty).count() == 0
    assert signals.composition(empty).count() == 0 and adapters.match_summary(empty, "AGATCGGAAGAG").first().rate == 0
    assert architecture.best_match(architecture.evaluate(architecture.builtin(spark), signals.composition(empty), signals.entropy(signals.composition(empty)))).count() == 0
    assert qc.base_counts(make(spark, ["", "AN"])).count() == 4


def test_sequence_files(spark, tmp_path):
    lines = "".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(["ACGT" * 7, "GGCC" * 8, "ATAT" * 5]))
    for name, opener in (("a.fastq", open), ("b.fastq.gz", gzip.open), ("c.fastq.bz2", bz2.open)):
        with opener(tmp_path / name, "wt") as out:
            out.write(lines)
    found = sequence_files.read_sequences(spark, str(tmp_path), "fastq")
    assert found.count() == 9 and found.where("qual is null").count() == 0
    (tmp_path / "x.fa").write_text(">a_x2\nAC\nGT\n\n>b_x3\nTTTT\n>a_x5\nGGGG\n")
    held = collapsed.with_counts(sequence_files.read_sequences(spark, str(tmp_path / "x.fa"), "collapsed").withColumnRenamed("read_id", "header"), "{id}_x{count}")
    assert sorted((r.seq, r.cnt) for r in held.collect()) == [("ACGT", 2), ("GGGG", 5), ("TTTT", 3)]
    assert collapsed.expand(held).count() == 10
    with pytest.raises(ValueError):
        sequence_files.check_format("bam")
    with pytest.raises(FileNotFoundError):
        sequence_files.check_readable(tmp_path / "none")


def test_cli(spark, tmp_path):
    path = tmp_path / "r.fastq"
    rng = random.Random(5)
    path.write_text("".join(f"@r{i}\n{''.join(rng.choices('ACGT', k=30))}TGGAATTCTCGGGTGCCAAGG\n+\n{'I' * 51}\n" for i in range(50)))
    assert cli.main(["check", str(path), "-o", str(tmp_path / "c.txt")]) == 0
    assert "Overall GC%" in (tmp_path / "c.txt").read_text() and "[" in (tmp_path / "c.txt.checks.txt").read_text()
    assert cli.main(["detect-adapter", str(path), "-a", "TGGAATTCTCGG", "-o", str(tmp_path / "d.txt")]) == 0
    assert "100.00%" in (tmp_path / "d.txt").read_text()
    assert cli.main(["extract", str(path), "-o", str(tmp_path / "e")]) == 0
    assert "comprehensive_adapter_check" in (tmp_path / "e.layout.txt").read_text()
    sam = tmp_path / "x.sam"
    sam.write_text("@HD\n" + "".join(f"r{i}\t0\tc\t1\t9\t{'2S' if i % 9 else ''}28M\t*\t0\t0\t{'A' * 30}\t*\n" for i in range(90)))
    assert cli.main(["align-detect", str(path), "--sam", str(sam), "-o", str(tmp_path / "t.json")]) == 0
    assert json.loads((tmp_path / "t.json").read_text()) == {"detected": True, "trim5": 2, "trim3": 0, "level": 1.0}
    assert cli.main(["decide-trim", str(path), "--sam", str(sam), "-o", str(tmp_path / "u.json")]) == 0


def test_reports_and_documents(spark):
    assert report.sparkline([]) == "" and len(report.sparkline([1.0, 1.0])) == 2
    assert "Variable / End" in report.html_report("x", [("rpf", 0, -1)], [0.0, 0.0]) and report.segment_label("a", 1, -3).endswith("Unknown")
    assert extract.extract(make(spark, ["A" * 30, "C" * 22]), 3, limit=0).count() == 0
    assert alignment.global_consensus(spark.createDataFrame([], "read_len int, n_reads long, trim5 int, trim3 int")).first().detected is False


def test_streaming_equals_batch(spark, tmp_path):
    reads = make(spark, ["ACGT" * 8, "GG" * 15 + "AGATCGGAAGAG", "A" * 20], cnt=3)
    reads.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in"))
    q = stream_qc.running_summary(stream, "AGATCGGAAGAG").writeStream.format("memory").queryName("running").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("running").first() == stream_qc.running_summary(reads, "AGATCGGAAGAG").first()

import json
import random

import pytest
from pyspark.sql import functions as F

from readloom import cli
from readloom.operators import adapters, architecture, checks, decision, extract, qc, segment, seqspec
from readloom.plans import report
from readloom.sources import aligner, collapsed, sequence_files, specifications


def make(spark, seqs, cnt=1):
    return spark.createDataFrame([(i, f"r{i}", s, "I" * len(s), cnt) for i, s in enumerate(seqs)], "ordinal long, read_id string, seq string, qual string, cnt long")


def random_reads(seed, n, length):
    rng = random.Random(seed)
    return ["".join(rng.choices("ACGT", k=length)) for _ in range(n)]


def fastq(path, seqs):
    path.write_text("".join(f"@{path.stem}{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(seqs)))


def bins(rng, length, n, umi):
    """Reads of a random UMI, a middle of two likely bases, and a constant end."""
    return ["".join(rng.choices("ACGT", k=umi)) + "".join(rng.choices("AC", weights=[7, 3], k=length - umi - 8)) + "GGGGGGGG" for _ in range(n)]


def test_length_bins_vote(spark):
    rng = random.Random(3)
    seqs = [s for length in (30, 32, 34) for s in bins(rng, length, 60, 6)] + bins(rng, 36, 60, 11)
    found = segment.scaled_segments(make(spark, seqs), 50)
    rows = {b: [(r.type, r.s, r.e) for r in sorted(found.where(F.col("bin") == b).collect(), key=lambda r: r.k)] for b in (0, 30, 32, 34, 36)}
    umi = {b: rows[b][0][2] for b in (30, 32, 34, 36)}
    assert umi[30] == umi[32] == umi[34] != umi[36]
    decided = segment.decided_segments(found, segment.length_bins(make(spark, seqs), 50)).collect()
    assert {r.bin for r in decided} == {30} and [(r.type, r.s, r.e) for r in sorted(decided, key=lambda r: r.k)] == rows[30]
    # without a majority, and with one bin, all reads speak
    half = make(spark, bins(rng, 30, 60, 6) + bins(rng, 36, 60, 12))
    assert {r.bin for r in segment.decided_segments(segment.scaled_segments(half, 50), segment.length_bins(half, 50)).collect()} == {0}
    one = make(spark, bins(rng, 30, 60, 6))
    assert {r.bin for r in segment.decided_segments(segment.scaled_segments(one, 50), segment.length_bins(one, 50)).collect()} == {0}


def test_decisions(spark):
    layouts = architecture.builtin(spark).where("name = 'ingolia_2009'")
    good = make(spark, random_reads(1, 120, 30))
    plain = decision.decide(good, layouts)
    assert plain.method == "probabilistic_hmm" and plain.segments == [("umi", 0, 30)] and plain.rpf is None
    assert cli.extracted(good, plain).count() == 0  # no RPF, nothing to extract
    at = [random.Random(i).randint(22, 45) if i % 3 == 0 else None for i in range(120)]  # in a third of reads, anywhere
    held = make(spark, [s if k is None else s[:k] + "AGATCGGAAGAGC" + s[k + 13 :] for k, s in zip(at, random_reads(2, 120, 60), strict=True)])
    cut = decision.decide(held, layouts)
    assert cut.method == "fallback_adapter_scan" and cut.name == "fallback_detected_Kiniry2" and cut.rpf == (0, -1)
    assert [len(r.seq) for r in cli.extracted(held, cut).orderBy("ordinal").collect()] == [k or 60 for k in at]
    known = decision.decide(make(spark, [s + "CTGTAGGCACCATCAAT" for s in random_reads(4, 120, 30)]), layouts)
    assert known.method == "strict_pattern_match" and known.layout["name"] == "ingolia_2009" and known.trims["recommended_5prime_trim"] == 0
    with pytest.raises(ValueError):
        decision.decide(make(spark, ["ACGT"] * 5), layouts)


def test_specifications(spark, tmp_path):
    specifications.write_samples(tmp_path / "specs")
    (tmp_path / "specs" / "z.yml").write_text("assay_id: z\nkind: !!python/object/apply:os.system\n!!x\nsequence_spec:\n- region_id: my_UMI\n  max_len: 4\n- not a region\n- region_id: c\n  region_type: cDNA\n  min_len: 9\n")
    (tmp_path / "specs" / "bad.yaml").write_text("a: [")
    (tmp_path / "specs" / "none.yaml").write_text("# nothing\n")
    (tmp_path / "specs" / "other.txt").write_text("assay_id: no")
    held = specifications.read_specifications(spark, str(tmp_path / "specs"))
    assert sorted(r.file.rsplit("/", 1)[1] for r in held.where("error is not null").collect()) == ["bad.yaml", "none.yaml"]
    rows = {r.name: r for r in specifications.with_specifications(architecture.builtin(spark), str(tmp_path / "specs")).collect()}
    assert len(rows) == len(architecture.BUILTIN) + 3
    novel, other, z = rows["novel_protocol_2024"], rows["modified_mcglincy_2024"], rows["z"]
    assert [tuple(x) for x in novel.barcode] == [(3, 11)] and novel.adapters == ["GGCCTTAAGCCCGGAA"] and (novel.exp_min, novel.exp_max, novel.source) == (20, 35, "Custom Lab Protocol")
    assert [tuple(x) for x in other.umi] == [(0, 8)] and [tuple(x) for x in other.barcode] == [(8, 13)] and (other.exp_min, other.exp_max) == (24, 36)
    assert [tuple(x) for x in z.umi] == [(0, 4)] and (z.exp_min, z.exp_max, z.rpf_start, z.rpf_end) == (9, 9, 0, -1)
    assert (other.priority, novel.priority, z.priority) == (7, 8, 9)


def test_documents_round_trip(spark):
    yaml = pytest.importorskip("yaml")
    rng = random.Random(7)
    reads = make(spark, ["".join(rng.choices("ACGT", k=5)) + "ACGTA" + "".join(rng.choices("ACGT", k=28)) for _ in range(60)])
    layouts = architecture.builtin(spark)
    known = decision.Decision("mcglincy_ingolia_2017", "x", "strict_pattern_match", [], [], layout={"priority": 4})
    spec = seqspec.specification(reads, known, None, layouts, "2024-01-01")
    regions = {r["region_id"]: r for r in spec["library_spec"][0]["regions"]}
    assert regions["umi_1"]["sequence"] == "NNNNN" and regions["barcode_1"]["sequence"] == "ACGTA" and regions["barcode_1"]["sequence_type"] == "onlist"
    assert regions["adapter_1"]["region_type"] == "illumina_p7" and (regions["rpf_sequence"]["min_len"], regions["rpf_sequence"]["max_len"]) == (26, 34)
    assert spec["assay_id"] == "ribosome_profiling_mcglincy_ingolia_2017" and spec["sequence_spec"][0]["min_len"] == 38
    text = seqspec.to_yaml(spec)
    assert text.startswith("!Assay\n") and "!Region" in text and "!File" in text
    assert json.loads(json.dumps(specifications._document(text))) == json.loads(json.dumps(spec))
    assert yaml is not None

    found = seqspec.specification(reads, decision.Decision("d", "x", "probabilistic_hmm", [("umi", 0, 5), ("rpf", 5, -1)], []), date="2024-01-01")
    a, b = found["library_spec"][0]["regions"]
    assert (a["region_type"], a["sequence"], a["name"]) == ("umi", "NNNNN", "Umi region (0-5)") and (b["min_len"], b["max_len"], b["region_id"]) == (33, 33, "rpf_5_-1")
    whole = seqspec.document_from_segments([], reads)["library_spec"][0]["regions"][0]
    assert (whole["region_id"], whole["min_len"], whole["max_len"]) == ("full_rpf_sequence", 33, 43)

    headers = reads.select("ordinal", F.when(F.col("ordinal") % 2 == 0, "x_umi:5_barcode:5").otherwise("x_umi:5_barcode:5_rpf:99").alias("header"))
    told = seqspec.specification(reads, known, headers, layouts)["library_spec"][0]["regions"]
    rows = {r.region_id: r for r in seqspec.header_regions(headers, reads).collect()}
    assert [r["region_id"] for r in told] == [r.region_id for r in sorted(rows.values(), key=lambda r: r.idx)]
    assert len(told) == 2 and "ACGTA" in [r.get("sequence") for r in told]

    mixed = seqspec.mixed_document(reads.limit(10), reads.limit(5), ["AGATCGG"], "2024-01-01")
    one, two = mixed["library_spec"][0]["regions"]
    assert one["min_len"] == 38 and [r["region_id"] for r in two["regions"]] == ["contaminant_adapter", "contaminated_rpf"] and "10 clean RPFs + 5" in mixed["description"]
    assert len(seqspec.mixed_document(reads.limit(0), reads.limit(0), ["A"])["library_spec"][0]["regions"]) == 1


def test_extraction_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seqs = [s + "CTGTAGGCACCATCAAT" for s in random_reads(4, 150, 30)]
    fastq(tmp_path / "in" / "a.fastq", seqs[:100])
    fastq(tmp_path / "in" / "b.fastq", seqs[100:])
    out = tmp_path / "out"
    assert cli.main(["extract", str(tmp_path / "in"), "-o", str(out), "--seqspec", "-n", "120"]) == 0
    held = json.loads((tmp_path / "out.report.json").read_text())
    assert held["extracted_rpfs"] == 120 and held["extraction_method"] == "strict_pattern_match" and held["seqspec_data"]["modalities"] == ["rna"]
    lines = "".join(p.read_text() for p in sorted(out.glob("part-*"))).split("\n")
    assert [x[1:-4] for x in lines[:-1:4]] == [f"a{i}" for i in range(100)] + [f"b{i}" for i in range(20)]
    assert "<h1>" in (tmp_path / "out.report.html").read_text() and (tmp_path / "out.seqspec.yaml").read_text().startswith("!Assay") and ">adapter_1" in (tmp_path / "out.adapters.fa").read_text()
    assert cli.main(["extract", str(tmp_path / "in"), "-o", str(out), "--report", "csv"]) == 0
    assert "extracted_rpfs,150" in (tmp_path / "out.report.csv").read_text() and "quality_metrics_confidence,0.95" in (tmp_path / "out.report.csv").read_text()
    sam, log = tmp_path / "x.sam", tmp_path / "x.log"
    sam.write_text("".join(f"r{i}\t0\tc\t1\t9\t2S28M\t*\t0\t0\t{'A' * 30}\t*\n" for i in range(40)))
    log.write_text("Number of input reads |\t50\nUniquely mapped reads number |\t30\nNumber of reads mapped to multiple loci |\t10\nNumber of reads unmapped: too short |\t10\n")
    assert cli.main(["align-detect", str(tmp_path / "in"), "--sam", str(sam), "--log", str(log), "-o", str(tmp_path / "t.json")]) == 0
    held = json.loads((tmp_path / "t.json").read_text())
    assert held["alignment_rate"] == 0.8 and held["trim_recommendations"]["recommended_5prime_trim"] == 2 and held["per_length_analysis"]["30"]["trim5"] == 2
    assert aligner.read_log(spark, str(tmp_path / "none.log")).first().input_reads == 0


def test_aligner_inputs(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        aligner.missing_index_files(tmp_path / "index")
    (tmp_path / "index").mkdir()
    (tmp_path / "index" / "SA").write_text("")
    assert len(aligner.missing_index_files(tmp_path / "index")) == 6
    rows = spark.createDataFrame([(0, "a", "ACGT", "IIII", 2), (1, "b", "GG", "##", 1)], "ordinal long, header string, seq string, qual string, cnt long")
    got = lambda kind, **how: sorted(tuple(r)[1:] for r in aligner.aligner_input(rows, kind, **how).collect())
    assert got("fastq") == [("@a", "ACGT", "IIII"), ("@b", "GG", "##")] and got("fasta") == [("@a", "ACGT", "IIII"), ("@b", "GG", "II")]
    assert got("collapsed") == [("@a_copy_1", "ACGT", "IIII"), ("@a_copy_2", "ACGT", "IIII"), ("@b_copy_1", "GG", "II")] and len(got("collapsed", limit=2)) == 2
    with pytest.raises(ValueError):
        got("bam")


def test_heads(spark):
    reads = make(spark, random_reads(1, 10, 5))
    assert [r.ordinal for r in extract.head(reads, 3).collect()] == [0, 1, 2]
    assert [collapsed.head(reads, n).count() for n in (0, 1, 5, 10, 11)] == [0, 0, 4, 9, 10]


def test_adapter_search_derives_the_read_once(spark):
    reads = make(spark, random_reads(1, 50, 40)).withColumn("seq", F.concat("seq", F.upper(F.substring(F.md5("seq"), 1, 3))))
    found = adapters.matches(reads, "AGATCGGAAGAG").where("mm < 2 and pos > 3 and variant like 'A%'")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") <= 2 and "regexp_instr" not in "".join(x for x in plan.split("\n") if "Generate" not in x), plan  # once more for the test of null
    for width, most in ((10, 0), (10, 2), (12, 3)):  # patterns, and windows beyond them
        adapter, seqs = "AGATCGGAAGAG", random_reads(width + most, 150, 45) + ["", "AGAT", "xAGATCGGAAGAG\n"]
        got = {r.ordinal: (r.mm, r.pos) for r in adapters.matches(make(spark, seqs), adapter, width, most).collect()}
        for i, s in enumerate(seqs):
            s = s.upper()
            scored = [(sum(a != b for a, b in zip(s[p : p + width], adapter)), p) for p in range(len(s) - width + 1)]
            assert got.get(i) == min((x for x in scored if x[0] <= most), default=None), (s, width, most)


def test_check_suite_reads_twice(spark, tmp_path):
    make(spark, random_reads(1, 50, 30)).write.parquet(str(tmp_path / "r"))
    reads = spark.read.parquet(str(tmp_path / "r"))
    plan = checks.check_suite(reads)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2
    one = checks.metrics(reads).first()
    assert one.total == 50 and one.fraction == 1.0 and one.mode == 30 and abs(100 * one.gc - qc.gc_summary(reads).first().gc_pct) < 1e-9


def test_ranges_of_a_file(tmp_path, monkeypatch):
    """Every record comes once and in order, wherever ranges cut, with quality lines that look like headers."""
    rng = random.Random(6)
    want = [(f"r{i} x@y", "".join(rng.choices("ACGT", k=n)), "".join(rng.choices("@+I#", k=n))) for i, n in enumerate(rng.choices(range(1, 40), k=80))]
    path = tmp_path / "x.fastq"
    path.write_text("".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in want))
    for size in (1, 7, 50, 333, 10**6):
        monkeypatch.setattr(sequence_files, "SPLIT_BYTES", size)
        reader = sequence_files.SequenceReader({"path": str(path)})
        parts = reader.partitions()
        got = [r for p in parts for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert [r[2:] for r in got] == want and [r[1] for r in got] == sorted(r[1] for r in got) and len(parts) == max(1, -(-path.stat().st_size // size))


def test_strict_and_layout_files(spark, tmp_path):
    (tmp_path / "x.fastq").write_text("@a\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="malformed"):
        sequence_files.read_sequences(spark, str(tmp_path / "x.fastq"), strict="true").collect()
    (tmp_path / "l.json").write_text(json.dumps({"architectures": [{"protocol_name": "own", "lab_source": "x", "umi_positions": [[0, 3]], "barcode_positions": [], "adapter_sequences": ["ACGTACGTAC"], "rpf_start": 3, "rpf_end": -1, "expected_rpf_length": [20, 30]}]}))
    assert [r.name for r in sequence_files.read_architectures(spark, str(tmp_path / "l.json")).collect()] == ["own"]
    assert sequence_files.read_architectures(spark, str(tmp_path / "none.json")).count() == len(architecture.BUILTIN)
    assert report.as_csv({"a": 1, "b": {"c": 2, "d": "x,y"}}) == 'a,1\nb_c,2\nb_d,"x,y"\n'

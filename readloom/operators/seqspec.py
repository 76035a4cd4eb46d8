"""Protocol specifications: consensus, region types, annotated headers, and the documents built from them."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.sequence import header_elements
from readloom.operators.extract import head

#: Region type of each annotation: fixed values.
REGION_TYPES = {
    "umi": "umi",
    "barcode": "barcode",
    "adapter": "illumina_p7",
    "adapter1": "illumina_p5",
    "adapter2": "illumina_p7",
    "adapter_5": "illumina_p5",
    "adapter_3": "illumina_p7",
    "spacer": "linker",
    "spacer1": "linker",
    "spacer2": "linker",
    "rpf": "cdna",
    "untemplated": "poly_tail",
    "poly_a": "poly_tail",
    "poly_t": "poly_tail",
    "random_tail": "poly_tail",
    "umi_partial": "umi",
    "adapter_partial": "illumina_p7",
}
#: Region and sequence type of each segment type: fixed values.
SEGMENT_TYPES = {"umi": ("umi", "random"), "barcode": ("barcode", "onlist"), "adapter": ("illumina_p7", "fixed"), "rpf": ("cdna", "joined"), "unknown": ("unknown", "random")}
#: Assay id and name, construct id and name, read id and name, and file name by the kind of document: fixed values.
ASSAYS = {
    "known": ("ribosome_profiling_{protocol}", "Ribosome Profiling - {protocol}", "library_construct", "{protocol} library structure", "R1", "Read 1", "input.fastq"),
    "segments": ("ribosome_profiling_denovo", "Ribosome Profiling - De Novo Detected", "detected_library_construct", "De novo detected library structure", "R1", "Read 1", "input.fastq"),
    "annotated": ("ribosome_profiling_annotated", "Ribosome Profiling - Structure Annotated", "annotated_library_construct", "Annotated library structure", "R1_annotated", "Annotated Read 1", "annotated_input.fastq"),
    "mixed": ("ribosome_profiling_mixed", "Ribosome Profiling - Mixed Clean/Contaminated", "mixed_library_construct", "Mixed library structure (clean + contaminated variants)", "R1_mixed", "Mixed Read 1", "mixed_input.fastq"),
}
PROTOCOLS = {"segments": "unknown_detected", "annotated": "complex_annotated_structure", "mixed": "mixed_processing_states"}
CONSENSUS_READS, LENGTH_READS = 50, 100
#: Annotations that mark headers as structured: fixed values.
ANNOTATIONS = ("umi:", "barcode:", "adapter:", "spacer:", "rpf:", "untemplated:")


def _lookup(value: Column, pairs: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), value), F.lit(default))


def region_type(annotation: Column) -> Column:
    return _lookup(F.lower(annotation), REGION_TYPES, "unknown")


def segment_types(segment: Column) -> tuple[Column, Column]:
    return tuple(_lookup(segment, {k: v[i] for k, v in SEGMENT_TYPES.items()}, ("unknown", "random")[i]) for i in range(2))


def sequence_type(kind: Column, diversity: Column) -> Column:
    """How a region's sequences vary, by its type and the share of distinct ones (null: none seen)."""
    kind = F.lower(kind)
    return (
        F.when(diversity.isNull(), "unknown")
        .when(kind.isin("umi", "umi_partial"), F.when(diversity > 0.7, "random").otherwise("onlist"))
        .when(kind == "barcode", F.when(diversity < 0.5, "onlist").otherwise("random"))
        .when(kind.isin("adapter", "adapter1", "adapter2", "adapter_5", "adapter_3", "adapter_partial"), F.when(diversity < 0.3, "fixed").otherwise("joined"))
        .when(kind.isin("spacer", "spacer1", "spacer2"), F.when(diversity < 0.5, "fixed").otherwise("random"))
        .when(kind.isin("untemplated", "poly_a", "poly_t", "random_tail"), "random")
        .otherwise("joined")
    )


def classify_region(region_id: Column, kind: Column) -> Column:
    """Adapter before UMI before barcode before RPF, by what id or type contains."""
    text = F.lower(F.concat_ws(" ", region_id, kind))
    has = lambda word: F.contains(text, F.lit(word))
    rpf = has("rpf") | F.coalesce(F.contains(F.lower(kind), F.lit("cdna")), F.lit(False))
    return F.when(has("adapter"), "adapter").when(has("umi"), "umi").when(has("barcode"), "barcode").when(rpf, "rpf").otherwise("unknown")


def region_offsets(regions: DataFrame, key: str = "spec") -> DataFrame:
    """``regions`` (key, idx, length) with start and end by a running sum."""
    before = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    found = regions.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return found.withColumn("end", F.col("start") + F.col("length"))


def rpf_length_range(regions: DataFrame, key: str = "spec") -> DataFrame:
    """(key, low, high): the least min_len and the greatest max_len of RPF regions, 20 to 40 without."""
    rpf = F.col("kind") == "rpf"
    return regions.groupBy(key).agg(F.coalesce(F.min(F.when(rpf, F.col("min_len"))), F.lit(20)).alias("low"), F.coalesce(F.max(F.when(rpf, F.col("max_len"))), F.lit(40)).alias("high"))


def consensus(sequences: DataFrame, key: str = "k", share: float = 0.7, distinct_share: float = 0.8) -> DataFrame:
    """(key, consensus) of (key, ordinal, seq): the sequence if all agree; as many N as the first has bases if more than
    ``distinct_share`` are distinct; else the usual base of each position of the first where more than ``share`` of those
    that reach it agree, N elsewhere. Ties go to the base seen first."""
    per = sequences.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("kinds"), F.min_by("seq", "ordinal").alias("first"))
    bases = sequences.select(key, "ordinal", F.posexplode(F.split("seq", "")).alias("pos", "b")).where("b != ''")
    counted = bases.groupBy(key, "pos", "b").agg(F.count(F.lit(1)).alias("m"), F.min("ordinal").alias("seen"))
    modes = counted.groupBy(key, "pos").agg(F.max_by(F.struct("b", "m"), F.struct("m", -F.col("seen"))).alias("t"), F.sum("m").alias("all"))
    letter = F.when(F.col("t.m") / F.col("all") > share, F.col("t.b")).otherwise("N")
    lines = modes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", letter.alias("b")))).alias("letters"))
    found = per.join(lines, key)
    by_base = F.array_join(F.slice("letters.b", F.lit(1), F.length("first")), "")
    return found.select(key, F.when(F.col("kinds") == 1, F.col("first")).when(F.col("kinds") / F.col("n") > distinct_share, F.repeat(F.lit("N"), F.length("first"))).otherwise(by_base).alias("consensus"))


def diversity(sequences: DataFrame, key: str = "k", sample: int = 10) -> DataFrame:
    """(key, diversity): distinct over all, of the first ``sample`` sequences of (key, ordinal, seq)."""
    head = sequences.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("ordinal"))).where(F.col("_n") <= sample)
    return head.groupBy(key).agg((F.count_distinct("seq") / F.count(F.lit(1))).alias("diversity"))


def annotated_regions(headers: DataFrame) -> DataFrame:
    """(element, idx, start, n, ordinal) of the structure in each header of (ordinal, header)."""
    found = headers.select("ordinal", F.posexplode(header_elements("header")).alias("idx", "x")).select("ordinal", "idx", "x.element", "x.n")
    before = Window.partitionBy("ordinal").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def annotation_stats(regions: DataFrame) -> DataFrame:
    """(element, region_type, min_len, max_len, occurrences)."""
    per = regions.groupBy("element").agg(F.min("n").alias("min_len"), F.max("n").alias("max_len"), F.count(F.lit(1)).alias("occurrences"))
    return per.select("element", region_type(F.col("element")).alias("region_type"), "min_len", "max_len", "occurrences")


def has_annotations(headers: DataFrame, sample: int = 10) -> DataFrame:
    """One row (annotated): whether one of the first headers is annotated."""
    head = headers.orderBy("ordinal").limit(sample)
    return head.agg(F.coalesce(F.bool_or(F.lower("header").rlike("|".join(ANNOTATIONS))), F.lit(False)).alias("annotated"))


def pieces(reads: DataFrame, ranges: DataFrame, sample: int = CONSENSUS_READS) -> DataFrame:
    """(k, ordinal, seq): what the first ``sample`` reads have in the ranges (k, s, e), -1 for the read's end, where they reach so far."""
    held = head(reads, sample).select("ordinal", "seq").crossJoin(F.broadcast(ranges.select("k", "s", "e")))  # some dozens by a few
    end = F.when(F.col("e") < 0, F.length("seq")).otherwise(F.col("e"))
    held = held.where((end <= F.length("seq")) & (end > F.col("s")))
    return held.select("k", "ordinal", F.substring("seq", F.col("s") + 1, end - F.col("s")).alias("seq"))


def read_lengths(reads: DataFrame, sample: int = LENGTH_READS) -> DataFrame:
    """One row (low, high, mean) of the first ``sample`` reads, nulls without any."""
    n = F.length("seq")
    return head(reads, sample).agg(F.min(n).alias("low"), F.max(n).alias("high"), F.floor(F.avg(n)).alias("mean"))


_REGION = ("region_id", "region_type", "sequence_type", "name", "sequence", "min_len", "max_len")


def _numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return rows.select(key, place.alias("idx"), *_REGION)


def layout_regions(layouts: DataFrame, reads: DataFrame) -> DataFrame:
    """(priority, idx, region_id, region_type, sequence_type, name, sequence, min_len, max_len): the regions of each layout,
    UMIs and barcodes with what the reads agree on there, then adapters, then the RPF."""
    part = lambda kind, order: layouts.select("priority", F.posexplode(kind).alias("i", "r")).select("priority", F.lit(order).alias("o"), "i", F.lit(kind).alias("kind"), "r.s", "r.e")
    ranges = part("umi", 0).unionByName(part("barcode", 1)).withColumn("k", F.concat_ws("|", "priority", "o", "i"))
    ranges = ranges.join(consensus(pieces(reads, ranges)), "k", "left")
    n, number, length = F.col("consensus"), (F.col("i") + 1).cast("string"), F.col("e") - F.col("s")
    umi = F.col("kind") == "umi"
    held = ranges.select(
        "priority", "o", "i",
        F.concat("kind", F.lit("_"), number).alias("region_id"),
        F.col("kind").alias("region_type"),
        F.when(umi | n.isNull(), "random").otherwise("onlist").alias("sequence_type"),
        F.concat(F.when(umi, "UMI ").otherwise("Sample Barcode "), number).alias("name"),
        F.when(umi, F.coalesce(n, F.repeat(F.lit("N"), length))).otherwise(n).alias("sequence"),
        length.alias("min_len"), length.alias("max_len"),
    )
    cut = layouts.select("priority", F.lit(2).alias("o"), F.posexplode("adapters").alias("i", "a"))
    cut = cut.select(
        "priority", "o", "i", F.concat(F.lit("adapter_"), number).alias("region_id"),
        F.when(F.contains("a", F.lit("AGATCGG")), "illumina_p7").otherwise("custom_primer").alias("region_type"),
        F.lit("fixed").alias("sequence_type"), F.concat(F.lit("Adapter "), number).alias("name"), F.col("a").alias("sequence"), F.length("a").alias("min_len"), F.length("a").alias("max_len"),
    )
    rpf = layouts.select(
        "priority", F.lit(3).alias("o"), F.lit(0).alias("i"), F.lit("rpf_sequence").alias("region_id"), F.lit("cdna").alias("region_type"), F.lit("joined").alias("sequence_type"),
        F.lit("Ribosome Protected Fragment").alias("name"), F.lit(None).cast("string").alias("sequence"), F.col("exp_min").alias("min_len"), F.col("exp_max").alias("max_len"),
    )
    return _numbered(held.unionByName(cut).unionByName(rpf), "priority", "o", "i")


def segment_regions(segments: DataFrame, reads: DataFrame) -> DataFrame:
    """The same of segments (bin, k, type, s, e); one that ends with the read has the lengths seen."""
    ranges = segments.withColumn("own", F.concat_ws("|", "bin", "k")).select("bin", F.col("k").alias("nth"), "type", "s", "e", F.col("own").alias("k"))
    held = pieces(reads, ranges)
    seen = held.groupBy("k").agg(F.min(F.length("seq")).alias("low"), F.max(F.length("seq")).alias("high"))
    found = ranges.join(consensus(held), "k", "left").join(seen, "k", "left")
    kind, sequence = segment_types(F.col("type"))
    length = F.col("e") - F.col("s")
    found = found.select(
        "bin", "nth", F.concat_ws("_", "type", "s", "e").alias("region_id"), kind.alias("region_type"), sequence.alias("sequence_type"),
        F.concat(F.initcap("type"), F.lit(" region ("), F.col("s").cast("string"), F.lit("-"), F.col("e").cast("string"), F.lit(")")).alias("name"), F.col("consensus").alias("sequence"),
        F.when(F.col("e") < 0, F.coalesce("low", F.lit(0))).otherwise(length).alias("min_len"), F.when(F.col("e") < 0, F.coalesce("high", F.lit(0))).otherwise(length).alias("max_len"),
    )
    return _numbered(found, "bin", "nth")


def header_regions(headers: DataFrame, reads: DataFrame, sample: int = LENGTH_READS, shown: int = 10) -> DataFrame:
    """(idx, region_id, ..., occurrences) of the elements that the first ``sample`` headers (ordinal, header) tell of, in
    order of appearance, with what the reads have there; only places that the read reaches count."""
    told = annotated_regions(head(headers, sample))
    found = told.join(reads.select("ordinal", "seq"), "ordinal").where(F.col("start") + F.col("n") <= F.length("seq"))
    found = found.select("element", "ordinal", "idx", "n", F.substring("seq", (F.col("start") + 1).cast("int"), F.col("n")).alias("seq"))
    per = found.groupBy("element").agg(F.min("n").alias("min_len"), F.max("n").alias("max_len"), F.count(F.lit(1)).alias("occurrences"))
    # an element's place is that of its first mention, counted or not
    first = told.groupBy("element").agg(F.min(F.struct("ordinal", "idx")).alias("at"))
    per = per.join(first, "element").join(consensus(found.where("seq != ''"), "element"), "element", "left").join(diversity(found, "element", shown), "element")
    title = F.array_join(F.transform(F.split("element", "_"), F.initcap), "_")
    rows = per.select(
        F.lit(0).alias("spec"), "at", "occurrences", F.concat(F.lit("region_"), "element").alias("region_id"), region_type(F.col("element")).alias("region_type"),
        sequence_type(F.col("element"), F.col("diversity")).alias("sequence_type"), F.concat(title, F.lit(" Region")).alias("name"), F.col("consensus").alias("sequence"), "min_len", "max_len",
    )
    place = F.row_number().over(Window.partitionBy("spec").orderBy("at")) - 1
    return rows.select(place.alias("idx"), *_REGION, "occurrences")


class Tagged(dict):
    """A mapping of a document that has a tag there."""

    def __init__(self, tag: str, **fields):
        super().__init__(fields)
        self.tag = tag


def region(region_id: str, region_type: str, sequence_type: str, name: str, low: int, high: int, sequence: str | None = None, regions: Sequence[dict] = ()) -> Tagged:
    found = Tagged("!Region", region_id=region_id, region_type=region_type, sequence_type=sequence_type, name=name, min_len=low, max_len=high, strand="pos")
    if sequence:
        found["sequence"] = sequence
    if regions:
        found["regions"] = list(regions)
    return found


def document(kind: str, regions: Sequence[dict], lengths: tuple[int, int], description: str, protocol: str = "", kit: str = "", date: str | None = None) -> Tagged:
    """A specification of one of ``ASSAYS``; the date is today's unless given."""
    assay_id, name, construct_id, construct_name, read_id, read_name, file = (x.format(protocol=protocol) for x in ASSAYS[kind])
    low, high = lengths
    source = Tagged("!File", file_id="R1.fastq.gz", filename=file, filetype="fastq", filesize=0, url=".", urltype="local")
    read = Tagged("!Read", read_id=read_id, name=read_name, modality="rna", primer_id=construct_id, strand="pos", min_len=low, max_len=high, files=[source])
    found = Tagged("!Assay", seqspec_version="0.3.0", assay_id=assay_id, name=name, publication_date=date or datetime.date.today().isoformat(), description=description, modalities=["rna"], library_protocol=PROTOCOLS.get(kind) or protocol)
    if kit:
        found["library_kit"] = kit
    found.update(library_spec=[region(construct_id, "joined", "joined", construct_name, low, high, regions=regions)], sequence_spec=[read])
    return found


def _as_regions(rows) -> list[Tagged]:
    return [region(r.region_id, r.region_type, r.sequence_type, r.name, r.min_len, r.max_len, r.sequence) for r in sorted(rows, key=lambda r: r.idx)]


def _lengths(reads: DataFrame, low: int = 20, high: int = 50) -> tuple[int, int, int]:
    found = read_lengths(reads).first()
    return (low, high, 30) if found.low is None else (found.low, found.high, found["mean"])


def layout_document(layouts: DataFrame, priority: int, reads: DataFrame, date: str | None = None) -> Tagged:
    """The specification of a known layout."""
    own = layouts.where(F.col("priority") == priority)
    held = own.first()
    text = f"Read structure detected as {held['name']} protocol from {held.source}"
    return document("known", _as_regions(layout_regions(own, reads).collect()), _lengths(reads)[:2], text, held["name"], held.source, date)


def document_from_segments(segments: Sequence[tuple[str, int, int]], reads: DataFrame, date: str | None = None) -> Tagged:
    """The specification of (type, s, e) segments; without any, one RPF of the reads' mean length give or take 5."""
    low, high, mean = _lengths(reads)
    rows = [region("full_rpf_sequence", "cdna", "joined", "Complete Ribosome Protected Fragment", mean - 5, mean + 5)]
    if segments:
        told = reads.sparkSession.createDataFrame([(0, k, *x) for k, x in enumerate(segments)], "bin int, k int, type string, s int, e int")
        rows = _as_regions(segment_regions(told, reads).collect())
    return document("segments", rows, (low, high), "Read structure detected using de novo multi-signal analysis", kit="auto-detected", date=date)


def document_from_headers(headers: DataFrame, reads: DataFrame, date: str | None = None) -> Tagged:
    rows = _as_regions(header_regions(headers, reads).collect())
    text = f"Complex read structure parsed from annotations. {len(rows)} distinct regions detected."
    return document("annotated", rows, _lengths(reads, 50, 100)[:2], text, date=date)


def mixed_document(clean: DataFrame, contaminated: DataFrame, adapters: Sequence[str] | None, date: str | None = None) -> Tagged:
    """The specification of reads of two kinds, (ordinal, seq) each: clean ones, and such as hold one of the adapters."""
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.min(F.length("seq")).alias("low"), F.max(F.length("seq")).alias("high")).first()
    a, b = count(clean), count(contaminated)
    rows = [region("clean_rpf_variant", "cdna", "joined", "Clean RPF sequences (pre-processed)", a.low if a.n else 25, a.high if a.n else 40)]
    if adapters is not None and b.n:
        parts = [region("contaminant_adapter", "illumina_p7", "fixed", "Adapter contamination (needs removal)", len(x), len(x), x) for x in adapters]
        parts.append(region("contaminated_rpf", "cdna", "joined", "RPF sequence (adapter-contaminated)", 25, 35))
        rows.append(region("contaminated_variant", "joined", "joined", "Contaminated reads requiring processing", 0, 0, regions=parts))
    first = head(clean, LENGTH_READS).select("ordinal", "seq")
    first = first.unionByName(head(contaminated, max(0, LENGTH_READS - a.n)).select("ordinal", "seq")) if a.n < LENGTH_READS else first
    return document("mixed", rows, _lengths(first)[:2], f"Mixed dataset: {a.n} clean RPFs + {b.n} contaminated reads", date=date)


def specification(reads: DataFrame, decision, headers: DataFrame | None = None, layouts: DataFrame | None = None, date: str | None = None) -> Tagged:
    """Of annotated headers, else of the known layout decided for, else of its segments."""
    if headers is not None and has_annotations(headers).first().annotated:
        return document_from_headers(headers, reads, date)
    if decision.layout is not None and layouts is not None:
        return layout_document(layouts, decision.layout["priority"], reads, date)
    return document_from_segments(decision.segments, reads, date)


def to_yaml(spec, indent: int = 0) -> str:
    """Block YAML of nested dicts, lists and scalars, in the order given, with the tags of ``Tagged``."""
    import json

    pad = "  " * indent
    scalar = lambda v: json.dumps(v, ensure_ascii=False)
    tag = lambda v: f" {v.tag}" if isinstance(v, Tagged) else ""
    if isinstance(spec, dict):
        out = [f"{spec.tag}\n"] if isinstance(spec, Tagged) and not indent else []
        for k, v in spec.items():
            out.append(f"{pad}{k}:{tag(v)}\n{to_yaml(v, indent + 1)}" if v and isinstance(v, dict | list) else f"{pad}{k}: {scalar(v)}\n")
        return "".join(out)
    return "".join(f"{pad}-{tag(v)}\n{to_yaml(v, indent + 1)}" if v and isinstance(v, dict | list) else f"{pad}- {scalar(v)}\n" for v in spec)


def adapter_fasta(adapters: DataFrame) -> DataFrame:
    """FASTA text of the adapters of (idx, name, seq) that say something: not empty, X or all N."""
    eligible = adapters.where("seq not in ('', 'N', 'X') and seq rlike '[^Nn]'")
    return eligible.select("idx", F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("record"))

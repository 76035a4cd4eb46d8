"""Protocol specifications in YAML files as layouts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators import architecture, seqspec

_PARSED = "file string, protocol string, source string, description string, regions array<struct<region_id:string,region_type:string,sequence:string,min_len:int,max_len:int>>, error string"


def cleaned_yaml(text: Column) -> Column:
    """Without the lines that hold Python object tags or begin with a tag."""
    keep = lambda line: ~F.contains(line, F.lit("!!python/object/apply:")) & ~F.startswith(F.trim(line), F.lit("!!"))
    return F.array_join(F.filter(F.split(text, "\n"), keep), "\n")


def _document(text: str):
    try:
        import yaml
    except ImportError as missing:
        raise ImportError("specifications need PyYAML") from missing

    class Loader(yaml.SafeLoader):
        """Takes what our own documents tag for what it is."""

    Loader.add_multi_constructor("!", lambda loader, _, node: loader.construct_mapping(node, deep=True))
    return yaml.load(text, Loader)  # noqa: S506


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("file", "protocol", "source", "description", "regions", "error")
    kind = pa.list_(pa.struct([("region_id", pa.string()), ("region_type", pa.string()), ("sequence", pa.string()), ("min_len", pa.int32()), ("max_len", pa.int32())]))
    for batch in batches:
        rows = []
        for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            stem = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            try:
                held = _document(text or "")
                if not held:
                    raise ValueError("empty")
                regions = [r for r in held.get("sequence_spec") or [] if isinstance(r, dict)]
                lengths = [(r.get("min_len") or 0, r.get("max_len", r.get("min_len")) or 0) for r in regions]
                told = [{"region_id": r.get("region_id") or "", "region_type": r.get("region_type") or "", "sequence": r.get("sequence") or "", "min_len": int(a), "max_len": int(b)} for r, (a, b) in zip(regions, lengths, strict=True)]
                rows.append((file, str(held.get("assay_id", stem)), str(held.get("library_kit", "Unknown")), str(held.get("description", "")), told, None))
            except ImportError:
                raise
            except Exception as wrong:  # a file that says nothing is left out, whatever is wrong with it
                rows.append((file, None, None, None, None, f"{type(wrong).__name__}: {wrong}"))
        columns = zip(*rows, strict=True) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, kind if n == "regions" else pa.string()) for c, n in zip(columns, names, strict=True)], names)


def parsed(texts: DataFrame) -> DataFrame:
    """(file, protocol, source, description, regions, error) of (file, text); error tells why a file gives no layout."""
    return texts.select("file", cleaned_yaml(F.col("text")).alias("text")).mapInArrow(_parse, _PARSED)


def region_rows(specs: DataFrame) -> DataFrame:
    """(file, idx, kind, sequence, min_len, max_len, length, start, end) of the regions of ``parsed``: a region with a
    sequence has the longest of its lengths, others the greater bound."""
    rows = specs.where("error is null").select("file", F.posexplode("regions").alias("idx", "r")).select("file", "idx", "r.*")
    length = F.when(F.col("sequence") != "", F.greatest("min_len", "max_len", F.length("sequence"))).otherwise(F.col("max_len"))
    rows = rows.withColumns({"kind": seqspec.classify_region(F.col("region_id"), F.col("region_type")), "length": length})
    return seqspec.region_offsets(rows, "file").drop("region_id", "region_type")


def layouts(specs: DataFrame) -> DataFrame:
    """The rows of ``architecture.SCHEMA`` for the files of ``parsed``, those that end in .yaml first, by name."""
    rows = region_rows(specs)
    held = lambda kind: F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("length") > 0), F.struct("idx", F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e"))))), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    cut = F.array_sort(F.collect_list(F.when((F.col("kind") == "adapter") & (F.col("sequence") != ""), F.struct("idx", "sequence"))))
    per = rows.groupBy("file").agg(held("umi").alias("umi"), held("barcode").alias("barcode"), F.transform(cut, lambda x: x["sequence"]).alias("adapters"))
    found = specs.where("error is null").join(per, "file", "left").join(seqspec.rpf_length_range(rows, "file"), "file", "left")
    ranges, words = F.array().cast("array<struct<s:int,e:int>>"), F.array().cast("array<string>")
    order = F.struct(~F.endswith("file", F.lit(".yaml")), F.col("file"))
    found = found.agg(F.array_sort(F.collect_list(F.struct(order.alias("at"), F.struct(
        F.col("protocol").alias("name"), "source", F.coalesce("umi", ranges).alias("umi"), F.coalesce("barcode", ranges).alias("barcode"), F.coalesce("adapters", words).alias("adapters"),
        F.lit(0).alias("rpf_start"), F.lit(-1).alias("rpf_end"), F.coalesce("low", F.lit(20)).alias("exp_min"), F.coalesce("high", F.lit(40)).alias("exp_max"),
    ).alias("x")))).alias("rows"))
    return found.select(F.posexplode("rows").alias("priority", "r")).select("priority", "r.x.*")  # a row for each file


def read_specifications(spark: SparkSession, folder: str) -> DataFrame:
    """``parsed`` of the .yaml and .yml files of a folder, in any store that Spark reads."""
    found = spark.read.option("pathGlobFilter", "*.{yaml,yml}").text(str(folder), wholetext=True)
    return parsed(found.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


#: Two specifications to begin with: fixed values.
SAMPLES = {
    "novel_protocol.yaml": {
        "seqspec_version": "0.3.0", "assay_id": "novel_protocol_2024", "name": "Novel Ribosome Profiling Protocol", "description": "Custom protocol with unique barcode structure",
        "library_kit": "Custom Lab Protocol", "modalities": ["rna"],
        "sequence_spec": [
            {"region_id": "custom_prefix", "region_type": "technical", "sequence": "TAG", "min_len": 3, "max_len": 3},
            {"region_id": "sample_barcode", "region_type": "barcode", "sequence": "NNNNNNNN", "min_len": 8, "max_len": 8},
            {"region_id": "ribosome_protected_fragment", "region_type": "cdna", "sequence_type": "joined", "min_len": 20, "max_len": 35},
            {"region_id": "custom_adapter", "region_type": "adapter", "sequence": "GGCCTTAAGCCCGGAA", "min_len": 16, "max_len": 16},
        ],
    },
    "modified_mcglincy.yaml": {
        "seqspec_version": "0.3.0", "assay_id": "modified_mcglincy_2024", "name": "Modified McGlincy Protocol", "description": "McGlincy protocol with extended UMI",
        "library_kit": "Modified McGlincy Lab", "modalities": ["rna"],
        "sequence_spec": [
            {"region_id": "extended_umi", "region_type": "umi", "sequence": "NNNNNNNN", "min_len": 8, "max_len": 8},
            {"region_id": "sample_barcode", "region_type": "barcode", "sequence": "NNNNN", "min_len": 5, "max_len": 5},
            {"region_id": "rpf_sequence", "region_type": "cdna", "min_len": 24, "max_len": 36},
            {"region_id": "illumina_adapter", "region_type": "adapter", "sequence": "AGATCGGAAGAGCAC", "min_len": 15, "max_len": 15},
        ],
    },
}


def write_samples(folder) -> list[str]:
    """Writes ``SAMPLES`` and returns their paths."""
    from pathlib import Path

    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, spec in SAMPLES.items():
        (Path(folder) / name).write_text(seqspec.to_yaml(spec))
    return [str(Path(folder) / name) for name in SAMPLES]


def with_specifications(built_in: DataFrame, folder: str) -> DataFrame:
    """``built_in`` layouts and, after them, those of a folder of specifications."""
    return architecture.with_more(built_in, layouts(read_specifications(built_in.sparkSession, folder)))

"""Text, JSON and HTML reports. Only small aggregates come to the driver: rows by position, by length, by check."""

from __future__ import annotations

import csv
import html
import io
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.sequence import BASES
from readloom.operators import adapters, qc

BARS = "▁▂▃▅▆▇"


def quality_report(reads: DataFrame) -> str:
    out = ["=== Read Length Distribution ==="]
    out += [f"{r.len}\t{r.n}" for r in qc.length_histogram(reads).orderBy("len").collect()]
    out += ["", "=== Nucleotide Frequencies ===", "Position\t" + "\t".join(BASES)]
    wide = qc.base_frequencies(reads).where("end = '5p'").groupBy("pos").pivot("base", list(BASES)).sum("freq").orderBy("pos")
    out += ["\t".join([str(r.pos), *(f"{r[b]:.3f}" for b in BASES)]) for r in wide.collect()]
    if "qual" in reads.columns:
        out += ["", "=== Quality Scores ===", "Position\tMean\tStd"]
        out += [f"{r.pos}\t{r['mean']:.2f}\t{r['std']:.2f}" for r in qc.quality_profile(reads).orderBy("pos").collect()]
    gc = qc.gc_summary(reads).first().gc_pct
    return "\n".join([*out, "", *([f"Overall GC%: {gc:.2f}"] if gc is not None else [])]) + "\n"


def check_report(rows: DataFrame, categories: DataFrame) -> str:
    head, held = categories.first(), rows.orderBy("idx").collect()
    out = [f"Status: {'CLEAN' if head.is_clean else 'FAILED'}", *([] if head.is_clean else [f"Primary failure: {head.primary}"]), "", "Summary"]
    out += [f"{r.check:30} [{r.status}]" for r in held] + ["", "Details"]
    return "\n".join(out + [f"{r.check}: {r.message}" for r in held]) + "\n"


def adapter_report(reads: DataFrame, adapter: str, min_overlap: int = 10, max_mismatches: int = 1) -> str:
    found = adapters.matches(reads, adapter, min_overlap, max_mismatches)
    rate = adapters.match_summary(reads, adapter, min_overlap, max_mismatches).first().rate
    out = [f"Adapter: {adapter}", f"Contamination rate: {rate:.2f}%", "", "Positions"]
    out += [f"{r.pos}\t{r.n}" for r in adapters.histogram(found, "pos").orderBy("pos").collect()]
    out += ["", "Match lengths"]
    out += [f"{r.len}\t{r.n}" for r in adapters.histogram(found.withColumn("len", F.length("variant")), "len").orderBy("len").collect()]
    out += ["", "Variants"]
    variants = adapters.histogram(found, "variant").orderBy("n", "variant", ascending=[False, True])
    return "\n".join(out + [f"{r.variant}\t{r.n}" for r in variants.collect()]) + "\n"


def _plain(held) -> dict:
    return held if isinstance(held, dict) else held.asDict(recursive=True)


def as_json(held) -> str:
    """Of a row or a dict."""
    return json.dumps(_plain(held), indent=2, ensure_ascii=False)


def as_csv(held) -> str:
    """A line for each value; nested ones under ``key_subkey``."""
    out = io.StringIO()
    lines = csv.writer(out, lineterminator="\n")
    for key, value in _plain(held).items():
        lines.writerows([[f"{key}_{k}", v] for k, v in value.items()] if isinstance(value, dict) else [[key, value]])
    return out.getvalue()


def write_report(held, path: str, kind: str = "json") -> None:
    if kind not in ("json", "csv"):
        raise ValueError(f"format must be json or csv, not {kind!r}")
    with open(path, "w") as out:
        out.write(as_json(held) if kind == "json" else as_csv(held))


def sparkline(values: Sequence[float]) -> str:
    if not values:
        return ""
    low, span = min(values), (max(values) - min(values)) or 1.0
    return "".join(BARS[int((v - low) / span * (len(BARS) - 1))] for v in values)


def segment_label(kind: str, start: int, end: int) -> str:
    return f"{kind} {start}-{'Variable / End' if end == -1 else 'Unknown' if end < 0 else end}"


def layout_report(name: str, segments: Sequence[tuple[str, int, int]], entropies: Sequence[float]) -> str:
    return "\n".join([f"Layout: {name}", *(f"  {segment_label(*s)}" for s in segments), f"Entropy: {sparkline(list(entropies)[:50])}"]) + "\n"


def html_report(name: str, segments: Sequence[tuple[str, int, int]], entropies: Sequence[float], trace: Sequence[str] = ()) -> str:
    top = max(entropies, default=0.0) or 1.0  # identical reads have no entropy anywhere
    blocks = "".join(f'<div class="segment {html.escape(k)}">{html.escape(segment_label(k, s, e))}</div>' for k, s, e in segments)
    bars = "".join(f'<div class="bar" style="height:{100 * h / top:.0f}%" title="{i}: {h:.2f}"></div>' for i, h in enumerate(list(entropies)[:50]))
    steps = "".join(f"<li>{html.escape(t)}</li>" for t in trace)
    return f"<!DOCTYPE html><html><head><title>{html.escape(name)}</title></head><body><h1>{html.escape(name)}</h1><section>{blocks}</section><section>{bars}</section><ol>{steps}</ol></body></html>"

"""How reads are laid out, and so where their fragments lie: a known layout, else the best path, else an adapter found in many.

Everything is decided from aggregates by position, length or layout; no more than their few rows come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators import adapters, architecture, segment, signals

CONFIDENCE = 0.95


@dataclass
class Decision:
    """``segments``: (type, start, end), -1 for the read's end. ``method``: strict_pattern_match, probabilistic_hmm or fallback_adapter_scan."""

    name: str
    source: str
    method: str
    segments: list[tuple[str, int, int]]
    adapters: list[str]
    trace: list[str] = field(default_factory=list)
    layout: dict | None = None

    @property
    def rpf(self) -> tuple[int, int] | None:
        """Start and end of the first RPF segment; None without one, in which case nothing is extracted."""
        return next(((s, e) for kind, s, e in self.segments if kind == "rpf"), None)

    @property
    def trims(self) -> dict:
        if self.rpf is None:
            return {"recommended_5prime_trim": 0, "recommended_3prime_trim": 0}
        return {"recommended_5prime_trim": self.rpf[0], "recommended_3prime_trim": 0, "note": "Use detected adapter sequences for 3' trimming"}


def _known(layouts: DataFrame, best) -> Decision:
    held = layouts.where(F.col("priority") == best.priority)
    layout, rows = held.first(), architecture.segments(held).orderBy("k").collect()
    trace = [f"UMI score {best.umi_score:.2f}", f"Adapter score {best.adapter_score:.2f}"]
    return Decision(best["name"], layout.source, "strict_pattern_match", [(r.type, r.s, r.e) for r in rows], list(layout.adapters), trace, layout.asDict(recursive=True))


def decide(reads: DataFrame, layouts: DataFrame, min_bin: int = segment.MIN_BIN) -> Decision:
    """Raises ValueError for reads that tell nothing, such as none of ``signals.MIN_LENGTH`` bases."""
    parts = signals.gathered(signals.composition(reads))
    best = architecture.best_match(architecture.evaluate(layouts, parts, signals.entropy(parts))).first()
    if best:
        return _known(layouts, best)
    bins = segment.length_bins(reads, min_bin)
    rows = sorted(segment.decided_segments(segment.scaled_segments(reads, min_bin), bins).collect(), key=lambda r: r.k)
    found = [(r.type, r.s, r.e) for r in rows]
    trace = []
    if rows and rows[0].bin:
        trace.append(f"The majority of length bins agrees; bin {rows[0].bin} speaks for them.")
    trace.append("Best path of the segment model." if found else "No segment.")
    suspicious = not any(kind == "rpf" for kind, _, _ in found) or found[0][0] == "umi" and found[0][2] > 40
    if suspicious and (hit := adapters.best_contained(reads).first()):
        name = adapters.KNOWN_ADAPTERS[hit.idx][0]
        trace.append(f"{name} is in {hit.n} of {hit.total} reads.")
        return Decision(f"fallback_detected_{name}", "Adapter scan", "fallback_adapter_scan", [("rpf", 0, -1), ("adapter", -1, -1)], [hit.seq], trace)
    if not found:
        raise ValueError("the layout of the reads can't be told")
    return Decision("de_novo_inferred", "Segment model", "probabilistic_hmm", found, [], trace)


def report(decision: Decision, extracted: int, specification: dict | None = None) -> dict:
    """The extraction report, as plain values."""
    return {
        "input_reads": extracted,
        "processed_reads": extracted,
        "extracted_rpfs": extracted,
        "failed_extractions": 0,
        "architecture_match": decision.name,
        "extraction_method": decision.method,
        "segments": {"detected": [{"segment_type": k, "start_pos": s, "end_pos": e, "confidence": 1.0 if decision.layout else CONFIDENCE, "consensus": None} for k, s, e in decision.segments]},
        "quality_metrics": {"confidence": CONFIDENCE},
        "seqspec_data": specification,
        "trim_recommendations": decision.trims,
    }

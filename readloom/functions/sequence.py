"""Column functions on sequences, qualities and headers; all stay inside the JVM."""

from __future__ import annotations

import itertools
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: So many alternatives at most are searched as patterns.
MAX_PATTERNS = 100

BASES = ("A", "C", "G", "T")


def symbols(seq: Column | str) -> Column:
    """The characters of a sequence; none for an empty one."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.when(F.length(seq) > 0, F.split(seq, "")).otherwise(F.array().cast("array<string>"))


def count_of(seq: str, letters: str) -> Column:
    """How many characters of ``seq`` are among ``letters``, without exploding it."""
    return (F.length(seq) - F.length(F.translate(F.col(seq), letters, ""))).cast("long")


def gc_count(seq: str = "seq") -> Column:
    return count_of(seq, "GC")


def phred(qual: Column, index: Column) -> Column:
    """Quality at a 0-based index (offset 33)."""
    return F.ascii(F.substring(qual, index + 1, F.lit(1))) - 33


def header_count(header: str, template: str = "read_{id}_{count}") -> Column:
    """The count that a template finds in a header, 1 if there is none.

    What stands before ``{count}`` back to ``{id}`` delimits it on the left, what stands after it on the right. Digits may
    be grouped by underscores, as in Python's integers.
    """
    before, _, after = template.partition("{count}")
    left = before.rpartition("}")[2]
    found = F.substring_index(header, left, -1) if left else F.col(header)
    found = F.when(F.contains(F.col(header), F.lit(left)), found) if left else found
    found = F.substring_index(found, after, 1) if after else found
    found = F.regexp_replace(F.trim(found), "^_+|_+$", "")
    grouped = F.when(found.rlike("^[0-9]+(_[0-9]+)*$"), F.replace(found, F.lit("_"), F.lit("")))
    return F.coalesce(grouped.try_cast("long"), F.lit(1).cast("long"))


def window_mismatches(seq: Column, adapter: str, width: int, start: Column) -> Column:
    """Mismatches of the adapter's first ``width`` bases with the window at 0-based ``start``, as a sum of comparisons."""
    terms = [F.when(F.substring(seq, start + k + 1, F.lit(1)) != adapter[k], 1).otherwise(0) for k in range(width)]
    return sum(terms[1:], terms[0])


def _leftmost(seq: Column, core: str, mismatches: int) -> Column:
    """Where the leftmost window starts (1-based) that differs from ``core`` in as many places at most; 0 if none does."""
    open_places = itertools.combinations(range(len(core)), mismatches)
    return F.regexp_instr(seq, F.lit("(?s)" + "|".join("".join("." if i in at else re.escape(c) for i, c in enumerate(core)) for at in open_places)))


def best_adapter_match(seq: str, adapter: str, min_overlap: int = 10, max_mismatches: int = 1) -> Column:
    """Struct (mm, pos) of the best window with at most ``max_mismatches``: fewest mismatches, then leftmost; else null.

    Mismatches never fall as a match grows, so the best match has the least length allowed; adapters shorter than that
    never match. The search is local to the row, and the sequence is bound once, however it was derived. Few mismatches are
    patterns, tried from none on; many are counted window by window.
    """
    if len(adapter) < min_overlap:
        return F.lit(None).cast("struct<mm:int,pos:int>")
    core, most = adapter[:min_overlap], min(max_mismatches, min_overlap)
    found_at = lambda mm, at: F.struct(F.lit(mm).cast("int").alias("mm"), (at - 1).cast("int").alias("pos"))

    def by_pattern(x: Column) -> Column:
        return F.coalesce(*[F.when(_leftmost(x, core, mm) > 0, found_at(mm, _leftmost(x, core, mm))) for mm in range(most + 1)])

    def by_window(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.length(x) - min_overlap)
        scored = F.transform(starts, lambda p: F.struct(window_mismatches(x, adapter, min_overlap, p).cast("int").alias("mm"), p.cast("int").alias("pos")))
        return F.when(F.length(x) >= min_overlap, F.array_min(F.filter(scored, lambda s: s["mm"] <= max_mismatches)))

    search = by_pattern if sum(math.comb(min_overlap, mm) for mm in range(most + 1)) <= MAX_PATTERNS else by_window
    return F.get(F.transform(F.array(F.col(seq)), search), F.lit(0))


def trim_at_adapters(seq: str, adapters: list[str]) -> Column:
    """Where the first adapter found, longest first and then by letters, begins (0-based); the length if there is none."""
    ordered = sorted(dict.fromkeys(adapters), key=lambda a: (-len(a), a))
    # the sequence is bound once: inlined in every branch, a derived one would outgrow a generated method
    found = lambda x: F.coalesce(*[F.when(F.contains(x, F.lit(a)), F.locate(a, x) - 1) for a in ordered], F.length(x))
    return F.get(F.transform(F.array(F.col(seq)), found), F.lit(0))


def header_elements(header: str) -> Column:
    """(element, length) pairs such as ``umi:8`` in a header, in order, lower-cased."""
    pattern = r"([a-zA-Z_][a-zA-Z0-9_]*):(\d+)"
    pairs = F.arrays_zip(F.regexp_extract_all(header, F.lit(pattern), F.lit(1)).alias("element"), F.regexp_extract_all(header, F.lit(pattern), F.lit(2)).alias("n"))
    return F.transform(pairs, lambda x: F.struct(F.lower(x["element"]).alias("element"), x["n"].cast("int").alias("n")))


def is_adapter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike("^[ACGTNacgtn]+$"), F.lit(False))

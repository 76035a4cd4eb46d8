"""Main text of web pages: structure where the page has it, and repeated runs of a host by suffix sorting.

A page is split into tags and text, in one pass whose time is in proportion to its length, however broken it is. Elements
that hold no article text (``DROPPED``, or a class, id or role that names one of ``NOISE``) go with all they contain. If the
page marks its article (``CONTAINERS``), the text in it is the main text, also within a form or a noisy class that wraps
the whole page. If there is no article and nothing is left, noisy classes are let stand.

Pages that mark none are loose: all their text is a candidate. The token streams of a host's pages, marked or loose, are
searched for repeated runs of ``min_tokens`` tokens by suffix sorting, on every table:

1. Each run has a minimizer; those that two different texts of a host hold are the keys, by a combining aggregate.
2. The stretches of tokens whose runs have such a key meet by key, so a host of any size spreads over all tasks, and are
   sorted by the bucket-pointer refinement of ``suffix_dedup``: equal runs end in one bucket, whose different texts count.
   What has a key in common by chance is told apart there. Keys with over ``HOT_STRETCHES`` stretches never meet in one
   task; their runs are counted by 128-bit digest, by aggregates.
3. Of loose pages, a run goes that two different texts hold; runs of one page, however often it repeats them, stay. A page
   with no unique run at all is a copy, not boilerplate, and is kept whole.
4. Marked articles are searched apart from loose pages. They share passages and have near copies, so there a run goes only
   if more than half of the host's different articles hold it, of ``MIN_ARTICLES`` or more, and an article that would lose
   over half of its tokens is a copy and stays whole.

Character references are decoded once; white space becomes single spaces; blocks join by one space. Defined results: null
or empty html gives an empty text, as do pages without any; a tag that the page's end cuts off is no text; repeated rows are
pages of their own, with equal texts; a null URL is a host of its own; null ids are kept; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import suffix_dedup
from readloom.llm.common import scratch_path, shuffles_end_with_queries, slices, table

MIN_TOKENS = 12
GRAM_TOKENS = 6
MIN_ARTICLES = 8
KEY_TOKENS = 3
HOT_STRETCHES = 50_000
FILTER_SPREAD = 128

#: Element names, and class, id or role words, of the HTML vocabulary and of common page templates: fixed values.
CONTAINERS = {"article", "main"}
DROPPED = set("head script style noscript template nav footer aside form button select option textarea input label iframe object canvas svg math audio video dialog menu".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
NOISE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored banner sidebar side menu nav navbar navigation footer masthead breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices alert comment comments disqus replies promo popup modal overlay newsletter subscribe signup login share sharing social related "
    "recommended widget pagination pager toolbar search contentinfo complementary dialog skip".split()
)
#: Words that stand with one of ``NOISE`` in a class of its kind, as in "ad-slot" or "site-footer": fixed values.
PARTS = set(
    "area bar block body bottom box btn button buttons card cell center col column container content desktop dropdown fixed form global group header heading holder icon icons inner item items "
    "left link links list main mobile module outer page panel placeholder post posts primary right row secondary section site slot sticky tertiary text title toggle top unit widgets wrap wrapper zone".split()
)
MIN_REST_WORDS = 3

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true)", re.I)
_MAIN = re.compile(r"role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody\b")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def names_noise(value: str) -> bool:
    """Whether a class, id or role names noise: one of its tokens is a word of ``NOISE``, or joins one to words of ``PARTS`` or ``NOISE`` alone."""
    for token in value.split():
        words = _WORD.findall(_HUMP.sub("-", token).lower())
        if words and not NOISE.isdisjoint(words) and all(w in NOISE or w in PARTS for w in words):
            return True
    return False


def _noisy(name: str, attributes: str) -> bool:
    """By what it is called."""
    return bool(attributes) and name not in ("html", "body", *CONTAINERS) and any(names_noise("".join(v)) for v in _NAMED.findall(attributes))


class _Tags:
    """Text and tags of a page, in order, each character looked at a bounded number of times."""

    def __init__(self, html: str):
        self.html, self.failures = html, 0

    def _end(self, at: int) -> int:
        """Where the tag ends that goes on at ``at``: at the first > outside quotes, or at the first at all if the quotes swallow the page."""
        html, first = self.html, at
        if self.failures < 8:
            while m := _STOP.search(html, at):
                if m[0] == ">":
                    return m.start()
                close = html.find(m[0], m.end())
                at = close + 1 if close >= 0 else m.end()
            self.failures += 1
        return html.find(">", first)

    def __iter__(self) -> Iterator[tuple[str, str, str, str]]:
        """(text before, "/" or "", name, attributes); an empty name for what is no element."""
        html, at, size = self.html, 0, len(self.html)
        begin = 0
        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                break
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                yield html[begin:lt], "", "", ""
                begin = at = size if end < 0 else end + 3
            elif html.startswith("<![CDATA[", lt) and (end := html.find("]]>", lt)) >= 0:
                yield html[begin:lt], "", "", ""
                yield html[lt + 9 : end].replace("&", "&amp;"), "", "", ""  # it has no references
                begin = at = end + 3
            elif html.startswith(("<!", "<?"), lt):
                end = html.find(">", lt)
                yield html[begin:lt], "", "", ""
                begin = at = size if end < 0 else end + 1
            elif m := _NAME.match(html, lt + 1):
                end = self._end(m.end())
                name = m[2].lower()
                yield html[begin:lt], m[1], name if end >= 0 else "", html[m.end() : end] if end >= 0 else ""
                begin = at = size if end < 0 else end + 1
                if name in RAW and not m[1] and end >= 0:  # its text is not markup
                    close = _RAW_END[name].search(html, at)
                    begin = at = close.end() if close else size
            else:
                at = lt + 1
        yield html[begin:], "", "", ""


def _parsed_as(html: str, classes: bool) -> tuple[str, bool, bool]:
    """(text, whether no article is marked, whether a class made something noise)."""
    inside: list[str] = []
    outside: list[str] = []
    open_tags: list[str] = []
    held: Counter[str] = Counter()
    noise_at, wraps = None, ()  # depth of the outermost noisy element; containers that stand all the same within it
    marks: list[int] = []  # depths of open containers
    seen = by_class = False
    for text, closing, name, attributes in _Tags(html):
        if text and noise_at is None:
            (inside if marks else outside).append(unescape(text))
        if not name:
            continue
        if name not in INLINE and noise_at is None:
            (inside if marks else outside).append(" ")
        if closing:
            while held[name]:
                last = open_tags.pop()
                held[last] -= 1
                if noise_at == len(open_tags):
                    noise_at = None
                if marks and marks[-1] == len(open_tags):
                    marks.pop()
                if last == name:
                    break
            continue
        if name in VOID or name in RAW or attributes.rstrip().endswith("/") and name in ("svg", "path", "use"):
            continue
        main = name == "main" or bool(_MAIN.search(attributes))
        if noise_at is not None and not marks and ("main" in wraps and main or name in wraps):
            noise_at = None
        if noise_at is None:
            if name in DROPPED or name == "header" and not marks:
                noise_at, wraps = len(open_tags), ("main", "article") if name == "form" else ()
            elif attributes and name not in ("html", "body") and _HIDDEN.search(attributes):
                noise_at, wraps = len(open_tags), ()
            elif classes and _noisy(name, attributes):
                noise_at, wraps, by_class = len(open_tags), ("main",), True
            elif name in CONTAINERS or main:
                marks.append(len(open_tags))
                seen = True
        open_tags.append(name)
        held[name] += 1
    return " ".join("".join(inside if seen else outside).split()), not seen, by_class


def parse(html: str | None) -> tuple[str, bool]:
    """(main text, False), or (all text that is not noise, True) if the page marks no article."""
    text, loose, by_class = _parsed_as(html or "", True)
    if not text and loose and by_class:
        rest, loose_rest, _ = _parsed_as(html, False)
        if rest.count(" ") + 1 >= MIN_REST_WORDS:
            return rest, loose_rest
    return text, loose


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").netloc.lower()
    except ValueError:
        return ""


_PARSED = "page_id long, url string, text string, text_key binary, host long, loose boolean"
_STRETCHES = "run_key long, text_key binary, host long, at int, tokens binary"
_HELD = "text_key binary, host long, first int, last int, n long"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def host_key(host: str) -> int:
    return xxhash.xxh64_intdigest(host) - (1 << 63)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.bool_()]
    for batch in slices(batches):
        rows = []
        for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            text, loose = parse(html)
            within = host_of(url) if loose else f"{host_of(url)} article"
            rows.append((page_id, url, text, hashlib.md5(f"{within} {text}".encode()).digest() if text else None, host_key(within), loose))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], _names(_PARSED))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def token_hashes(text: str, host: int) -> np.ndarray:
    seed = host & ((1 << 64) - 1)
    return np.array([xxhash.xxh3_64_intdigest(t, seed) for t in text.split(" ")], np.uint64)


def grams_of(tokens: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` tokens from each place on, as 64 bits; none for the last places."""
    n = max(0, len(tokens) - size + 1)
    found = tokens[:n].copy()
    for k in range(1, size):
        found = (found ^ (found >> np.uint64(31))) * _MIX + tokens[k : k + n]
    return (found ^ (found >> np.uint64(29))) * _MIX


def run_keys(tokens: np.ndarray, min_tokens: int) -> np.ndarray:
    """The minimizer of each run of ``min_tokens`` tokens: equal runs have equal ones."""
    if len(tokens) < min_tokens:
        return np.zeros(0, np.int64)
    size = min(KEY_TOKENS, min_tokens)
    least = np.lib.stride_tricks.sliding_window_view(grams_of(tokens, size), min_tokens - size + 1).min(axis=1)
    return (least * _MIX).view(np.int64)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, bytes, int]]]:
    """(text, text_key, host) by slices, equal texts once for each task."""
    told: set[bytes] = set()
    for batch in slices(batches):
        rows = []
        for text, key, host in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if key not in told:
                told.add(key)
                rows.append((text, key, host))
        yield rows


def _run_keys(min_tokens: int):
    """(run_key, tag) of the texts, each key once for a text; the tag is the text's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _once(batches):
            keys = [np.unique(run_keys(token_hashes(text, host), min_tokens)) for text, _, host in rows]
            tags = np.repeat(np.array([int.from_bytes(key[:4], "little", signed=True) for _, key, _ in rows], np.int32), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *keys])), pa.array(tags)], ["run_key", "tag"])

    return run


def _stretches(min_tokens: int, shared: suffix_dedup._Shared):
    """The tokens of successive runs of one shared key, and where they start."""
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _once(batches):
            rows = []
            for text, own, host in texts:
                tokens = token_hashes(text, host)
                keys = run_keys(tokens, min_tokens)
                edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
                for i in np.flatnonzero(suffix_dedup._passes(shared.value, keys[edges[:-1]])).tolist():
                    first, end = edges[i : i + 2].tolist()
                    rows.append((int(keys[first]), own, host, first, tokens[first : end + min_tokens - 1].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], _names(_STRETCHES))

    return run


def repeated_runs(held: list[tuple[bytes, int, int, bytes]], min_tokens: int, gram_tokens: int) -> list[tuple[bytes, int, int, int, int]]:
    """Of the stretches (text_key, host, at, tokens) with all stretches of their keys: (text_key, host, first start, last start, n) of
    the runs that n texts hold, two or more."""
    sizes = np.array([len(t) // 8 for *_, t in held])
    tokens = np.frombuffer(b"".join(t for *_, t in held), np.uint64)
    until = np.cumsum(sizes)
    depth = min(gram_tokens, min_tokens)
    grams = np.zeros(len(tokens), np.uint64)
    whole = grams_of(tokens, depth)
    grams[: len(whole)] = whole
    at, bucket = suffix_dedup.refined(grams, depth, np.repeat(until, sizes), min_tokens)
    if not len(at):
        return []
    stretch = np.searchsorted(until, at, side="right")
    names: dict[bytes, int] = {}
    text = np.array([names.setdefault(own, len(names)) for own, *_ in held])[stretch]
    bucket = np.unique(bucket, return_inverse=True)[1]
    n = np.bincount(np.unique(bucket * len(names) + text) // len(names))[bucket]
    edges = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (stretch[1:] != stretch[:-1]) | (n[1:] != n[:-1]), [True]]))
    begin = until - sizes
    found = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if n[a] > 1:
            own, host, offset, _ = held[stretch[a]]
            offset -= int(begin[stretch[a]])
            found.append((own, host, offset + int(at[a]), offset + int(at[b - 1]), int(n[a])))
    return found


def _sorted(min_tokens: int, gram_tokens: int):
    types = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]

    def solve(held: list[tuple[bytes, int, int, bytes]]) -> pa.RecordBatch:
        rows = repeated_runs(held, min_tokens, gram_tokens)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 5, types, strict=True)], _names(_HELD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, before, last = [], 0, None, None
        for batch in slices(batches):
            for key, own, host, at, tokens in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (own, at) == last:  # copies of one text, of other tasks
                    continue
                if key != before and size >= suffix_dedup.BLOCK_BYTES:
                    yield solve(held)
                    held, size = [], 0
                before, last = key, (own, at)
                held.append((own, host, at, tokens))
                size += len(tokens)
        if held:
            yield solve(held)

    return run


def _run_digests(min_tokens: int):
    """(run, text_key, host, at) of each run of the stretches."""
    types = [pa.binary(), pa.binary(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = []
            for own, host, at, tokens in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                for k in range(len(tokens) // 8 - min_tokens + 1):
                    rows.append((xxhash.xxh3_128_digest(tokens[8 * k : 8 * (k + min_tokens)]), own, host, at + k))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 4, types, strict=True)], ["run", "text_key", "host", "at"])

    return run


def unique_runs(text: str, spans: list, min_tokens: int) -> str:
    """The tokens outside the runs that start at the spans' first to last place; the whole text if there are none."""
    tokens = text.split(" ")
    for first, last in spans:
        tokens[first : last + min_tokens] = [""] * (last + min_tokens - first)
    return " ".join(filter(None, tokens)) or text


def _kept(min_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text, loose, spans in zip(*(batch.column(i).to_pylist() for i in range(2, 5)), strict=True):
                kept = unique_runs(text, [(x["first"], x["last"]) for x in spans], min_tokens)
                whole = not loose and 2 * (kept.count(" ") + 1) < text.count(" ") + 1
                texts.append(text if whole else kept)
            yield batch.set_column(2, batch.schema.field(2), pa.array(texts, pa.string())).drop_columns(["loose", "spans"])

    return run


def held_runs(texts: DataFrame, min_tokens: int = MIN_TOKENS, gram_tokens: int = GRAM_TOKENS, hot_stretches: int = HOT_STRETCHES) -> DataFrame:
    """(text_key, host, first, last, n): the runs of ``min_tokens`` tokens that start at first to last are held by n different
    texts of the host, two or more. ``texts``: (text, text_key, host); equal keys are one text."""
    spark = texts.sparkSession
    texts = texts.select("text", "text_key", "host")
    keys = texts.mapInArrow(_run_keys(min_tokens), "run_key long, tag int").groupBy("run_key").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi"), F.count(F.lit(1)).alias("n"))
    keys_at = scratch_path(spark, "pages-keys")
    keys.where("lo != hi").select("run_key", "n").write.parquet(keys_at)
    shared = spark.read.schema("run_key long, n long").parquet(keys_at)
    words, bits = suffix_dedup._bit_filter(shared, "run_key", FILTER_SPREAD)
    stretches = texts.mapInArrow(_stretches(min_tokens, suffix_dedup._Shared(spark.sparkContext.broadcast(words), bits)), _STRETCHES)
    hot_keys = shared.where(F.col("n") > hot_stretches).select("run_key")
    n_hot = hot_keys.count()
    hot_keys = F.broadcast(hot_keys) if n_hot <= suffix_dedup.MAX_BROADCAST_KEYS else hot_keys
    cool = stretches.join(hot_keys, "run_key", "left_anti") if n_hot else stretches
    cool = cool.repartition("run_key").sortWithinPartitions("run_key", "text_key", "at")
    found = cool.mapInArrow(_sorted(min_tokens, gram_tokens), _HELD)
    if n_hot:
        hot = stretches.join(hot_keys, "run_key", "left_semi").mapInArrow(_run_digests(min_tokens), "run binary, text_key binary, host long, at int").distinct()
        several = hot.select("run", "text_key").distinct().groupBy("run").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found = found.unionByName(hot.join(several, "run").select("text_key", "host", F.col("at").alias("first"), F.col("at").alias("last"), "n"))
    return found


def extract(pages: DataFrame, min_tokens: int = MIN_TOKENS, gram_tokens: int = GRAM_TOKENS, hot_stretches: int = HOT_STRETCHES) -> DataFrame:
    """(page_id, url, text) for each row of (page_id, url, html)."""
    spark = pages.sparkSession
    at, spans_at = scratch_path(spark, "pages-parsed"), scratch_path(spark, "pages-spans")
    pages.select("page_id", "url", "html").mapInArrow(_parsed, _PARSED).write.option("compression", "zstd").parquet(at)
    parsed = spark.read.schema(_PARSED).parquet(at)
    texts = parsed.where("text_key is not null")
    with shuffles_end_with_queries(spark):
        found = held_runs(texts, min_tokens, gram_tokens, hot_stretches)
        # of loose pages, two texts; of articles, most of the host's
        hosts = texts.select("host", "loose", "text_key").distinct().groupBy("host", "loose").agg(F.count(F.lit(1)).alias("texts"))
        least = F.when(F.col("loose"), F.lit(2)).when(F.col("texts") >= MIN_ARTICLES, F.floor(F.col("texts") / 2 + 1))
        boilerplate = found.join(hosts.select("host", least.alias("least")), "host").where("n >= least")
        boilerplate.groupBy("text_key").agg(F.collect_list(F.struct("first", "last")).alias("spans")).write.parquet(spans_at)
    spans = spark.read.schema("text_key binary, spans array<struct<first: int, last: int>>").parquet(spans_at)
    held = parsed.join(spans, "text_key").select("page_id", "url", "text", "loose", "spans")
    sure = parsed.join(spans, "text_key", "left_anti").select("page_id", "url", "text")
    return sure.unionByName(held.mapInArrow(_kept(min_tokens), "page_id long, url string, text string"))


def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))

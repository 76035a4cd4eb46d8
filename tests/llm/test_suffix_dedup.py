import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from readloom.llm import suffix_dedup as sd


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
        runs = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((len(d), sum(b - a for a, b in runs), len(runs), hashlib.sha256(bytes(x for x, g in zip(d, gone) if not g)).hexdigest()))
    return out


def corpus(seed):
    random.seed(seed)
    words = ["ab", "é", "the", "x", "of", "longer", "ñandú"]
    shared = [" ".join(random.choices(words, k=k)) for k in (10, 30, 60)]
    texts = [None, "", "short", "a" * 300, "ab" * 200, "ab" * 90]
    for _ in range(60):
        parts = [" ".join(random.choices(words, k=random.randint(1, 60))) for _ in range(random.randint(1, 3))]
        for s in random.sample(shared, random.randint(0, 2)):
            parts.insert(random.randint(0, len(parts)), s)
        texts.append(" ".join(parts))
    near = list(texts[-1] * 2)
    for _ in range(8):
        near[random.randrange(len(near))] = "#"
        texts.append("".join(near))
    return texts + [texts[10]] * 5 + texts[20:24]


@pytest.mark.parametrize(("seed", "length", "gram", "hot"), [(1, 50, 16, 1 << 20), (2, 40, 8, 1 << 20), (3, 50, 16, 1)])
def test_against_brute_force(spark, seed, length, gram, hot):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.digests(docs, length=length, gram=gram, hot_bytes=hot).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts, length)


@pytest.mark.parametrize(("gram", "most"), [(64, 40), (8, 120)])
def test_refinement_against_brute_force(monkeypatch, gram, most):
    monkeypatch.setattr(sd, "GRAM", gram)  # a short one leaves more to the refinement
    rng = np.random.default_rng(5)
    for _ in range(150):
        sizes = rng.integers(1, 3 * most, rng.integers(1, 6))
        text = rng.integers(97, 97 + rng.integers(1, 4), sizes.sum()).astype(np.uint8)
        for _ in range(rng.integers(0, 4)):  # near copies, parted at depths of all kinds
            a, b, n = rng.integers(0, len(text), 3)
            n = min(n, len(text) - max(a, b))
            text[b : b + n] = text[a : a + n].copy()
        ends = np.repeat(np.cumsum(sizes), sizes)
        length = int(rng.integers(1, most))
        strings = Counter(bytes(text[i : i + length]) for i in range(len(text)) if ends[i] - i >= length)
        want = [i for i in range(len(text)) if ends[i] - i >= length and strings[bytes(text[i : i + length])] > 1]
        assert sd.repeated_starts(text, ends, length).tolist() == want


def test_long_texts_are_chunked_alike(monkeypatch):
    data = np.random.default_rng(6).integers(97, 110, 30_000).astype(np.uint8).tobytes()
    whole = list(sd._Minimizers(400, 64).runs(data))
    monkeypatch.setattr(sd, "CHUNK", 5_000)
    parts = list(sd._Minimizers(400, 64).runs(data))
    cover = lambda runs: [(k, i) for k, a, b, _ in runs for i in range(a, b + 1)]
    assert sorted(set(cover(parts))) == sorted(cover(whole)) and len(cover(parts)) == len(set(cover(parts)))


def test_apply_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "é" * 300, 300, "s"), (2, "é" * 300, 300, "s"), (3, "unique", 6, "s"), (None, None, None, None)], "doc_id long, text string, n_chars long, spans string")
    out = sd.apply(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text, r.n_chars, r.spans) for r in out.collect()) == [(0, None, 0, None), (1, "", 0, "s"), (2, "", 0, "s"), (3, "unique", 6, "s")]
    assert sd.apply(docs.limit(0)).count() == 0


def test_grouping_stands_chance_agreement(monkeypatch):
    monkeypatch.setattr(sd, "_MIX", np.uint64(1 << 60))  # nearly all high bits agree
    values = np.random.default_rng(8).integers(0, 40, 500).astype(np.uint64)
    ranked = values[sd._grouped(values)]
    assert 1 + np.count_nonzero(ranked[1:] != ranked[:-1]) == len(set(values.tolist()))


def test_many_keys_are_sorted_in_small_blocks(monkeypatch):
    sizes, sort = [], sd.repeated_starts
    monkeypatch.setattr(sd, "repeated_starts", lambda text, *how: sizes.append(len(text)) or sort(text, *how))
    rng, pack = np.random.default_rng(4), sd.zstandard.ZstdCompressor(dict_data=sd._dictionary(b"")).compress
    own = [rng.bytes(465) for _ in range(400)]
    rows = [(key, bytes([side]) + key.to_bytes(8, "little"), 0, pack(c)) for key, c in enumerate(own) for side in (0, 1)]
    batch = sd.pa.RecordBatch.from_arrays([sd.pa.array(x) for x in zip(*rows)], ["key", "digest", "a", "context"])
    found = [r for b in sd._refined(400, b"")(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["digest"], r["a"], r["b"]) for r in found) == sorted((d, 0, 465) for _, d, _, _ in rows)
    assert sum(sizes) == 800 * 465 and max(sizes) <= 1 << 17

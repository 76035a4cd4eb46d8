import random
import sys
import unicodedata
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from readloom.llm import packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.default_tokenizer())


def _ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_library_for_every_plain_character(library):
    encode = packing.encoder(packing.default_tokenizer())
    plain = [c for c in map(chr, range(0x250)) if packing._PLAIN.fullmatch(c)]
    assert len(plain) > 300
    random.seed(1)
    texts = [f"a{c}b {c}{c} 1{c}2 '{c}s it'S {c.upper()}x" for c in map(chr, range(1, 0x3000)) if not 0xD800 <= ord(c) < 0xE000]
    texts += ["".join(random.choices(plain + list(" '123.,!-_stre"), k=random.randint(0, 60))) for _ in range(4000)]
    texts += ["<|endoftext|> x", "é x", "it's we'LL 'ſ", "", " ", "　 日本語 😀", "a" * 5000, "don't''s _a_ ª²³"]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == _ids(library, text), (text, unicodedata.normalize("NFC", text))


def test_sum_of_squares_rule_against_brute_force():
    random.seed(2)
    for _ in range(30):
        capacity = random.choice([7, 16, 40])
        lengths = np.array(sorted((random.randint(1, capacity - 1) for _ in range(60)), reverse=True))
        where, offset, n = packing.sum_of_squares(lengths, capacity)
        gaps = {}
        for s, own, at in zip(lengths.tolist(), where.tolist(), offset.tolist()):
            fits = [b for b, g in gaps.items() if g >= s]

            def cost(b):
                after = {**gaps, b: gaps.get(b, capacity) - s}
                return sum(x * x for x in np.unique([g for g in after.values() if g], return_counts=True)[1])

            if fits:
                assert own in fits and cost(own) == min(map(cost, fits))
            else:
                assert own not in gaps
            assert at == capacity - gaps.get(own, capacity)
            gaps[own] = gaps.get(own, capacity) - s
        assert n == len(gaps) and all(g >= 0 for g in gaps.values())


@pytest.mark.parametrize("shard_pieces", [10, 20_000])
def test_pack_covers_every_piece_once(spark, library, shard_pieces):
    random.seed(3)
    rows = [(i, " ".join(random.choices(["tion", "the", "of", "q"], k=random.choice([0, 1, 5, 30, 130])))) for i in range(120)]
    rows += [(7, "same"), (7, "same"), (None, "x"), (500, None), (501, "")] + [(600 + i, "copy of one") for i in range(40)]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, part int").repartition(3)
    cut = packing.checkpointed(packing.pieces(docs, capacity=64))
    found = packing.pack(cut, 64, shard_pieces).toPandas()
    assert len(found) == cut.count()
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.concatenate([[0], np.cumsum(own.length)[:-1]]).tolist() and own.length.sum() <= 64
    want = sorted((i, k, j // 1, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for i, t in rows if i is not None
                  for ids in [_ids(library, t or "") + [0]] for k, j in enumerate(range(0, len(ids), 64)) for p in [ids[j : j + 64]])
    got = found[found.doc_id.notna()].astype({"doc_id": int})
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == want
    least = -(-found.length.sum() // 64)
    assert found.sequence_id.nunique() <= least + max(2, -(-len(found) // shard_pieces))


def test_pack_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.checkpointed(packing.pieces(docs))).count() == 0


def test_a_large_vocabulary_is_encoded_once(monkeypatch):
    asked = []

    class Counted(packing.Remembered):
        def __init__(self, make, *how):
            super().__init__(lambda word: asked.append(word) or make(word), *how)

    monkeypatch.setattr(packing, "Remembered", Counted)
    encode = packing.encoder.__wrapped__(packing.default_tokenizer())
    digits = str.maketrans("0123456789", "abcdefghij")
    text = " ".join(f"w{i}".translate(digits) for i in range(190_000))
    first, n = encode(text), len(asked)
    assert encode(text) == first and len(asked) == n == 190_000


assert sys.byteorder == "little"

import hashlib
import random

import pytest

from readloom.llm import sentencepiece_codec as codec

TEXTS = [
    "", " ", "  a b\n\nc\t <s> 　x \x00y", "▁a ▁▁", "aaaa" * 2000, " " * 77 + "x" + " " * 40, "日本語のテキスト😀 é ﬁ", "\n\n \n",
    "a.b.c,d;e" * 300, "</s><unk><0x0A>", "Ünïcödé ñandú", "0123456789" * 50, "\r\n\x0b", "w" * 100, "éééé ñññ" * 9,
]


@pytest.fixture(scope="module")
def encoder():
    return codec.PrefixTableEncoder(codec.default_model())


def test_ids_equal_the_library(encoder):
    random.seed(4)
    alphabet = list("aeiourstnlTHE   ..,\n'-éñ0129▁中😀")
    texts = TEXTS + ["".join(random.choices(alphabet, k=random.randint(1, 90))) for _ in range(3000)]
    texts += ["".join(random.choices(list(encoder.ids), k=random.randint(1, 12))) for _ in range(3000)]
    for text in texts:
        assert encoder.encode(text) == encoder.library.encode(text), text
    for text in filter(None, texts[:2000]):
        pieces = encoder.tabulated(codec.SPACE + text.replace(" ", codec.SPACE))  # whole, not in chunks
        assert "".join(pieces) == codec.SPACE + text.replace(" ", codec.SPACE)
        assert [i for p in pieces for i in ([encoder.ids[p]] if p in encoder.ids else [encoder.bytes[b] for b in p.encode()])] == encoder.encode(text)


def test_query_columns(spark, encoder):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)] + [(None, None, "k"), (3, "x", "k")], "doc_id long, text string, ids string")
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in codec.digests(docs).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t in [*enumerate(TEXTS), (None, ""), (3, "x")]:
        ids = encoder.library.encode(t)
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(encoder.library.decode(ids) if ids else "")))
    assert found == want
    assert codec.digests(docs.limit(0)).count() == 0
    assert {r.doc_id: list(r.ids) for r in codec.encode_ids(docs).collect()}[3] == encoder.library.encode("x")

"""SentencePiece BPE encoding by a prefix table, and decoding.

The merges of a BPE model give every prefix of a text one encoding, hence one last token. So a text is encoded left to
right: an automaton of all pieces reports what ends at each character, and a piece is the last token of the prefix there
if it is compatible with the last token of the prefix before it, that is, if merging the text of both gives just these
two. A list of tokens whose neighbours are all compatible is the encoding, so the table is exact, and the ids are read
off it backwards. Work is linear in the text, whatever its length or repetition. A character outside the vocabulary
stands for itself in the table and becomes the ids of its UTF-8 bytes.

No piece joins a character to a following space, so texts are tabulated in chunks, and short chunks are remembered in a
cache of bounded size; a model with such pieces is tabulated whole.

Defined results: null counts as empty; an empty text has no ids and decodes to an empty text; repeated rows, null ids
and extra columns need no care, since every row stands alone.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from readloom.llm.common import Remembered, slices, table

SPACE = "▁"
CACHE_ENTRIES = 500_000
CACHE_PAIRS = 400_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PrefixTableEncoder:
    """Encodes as the library does for a BPE model with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if self.merged(piece) == [piece]:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.chunks = re.compile(self._chunk_pattern()).findall
        self.pairs: dict[tuple[str, str], bool] = {}
        self.decimals = Remembered(self._decimals, CACHE_ENTRIES)

    def _chunk_pattern(self) -> str:
        """Chunks end where no piece of the vocabulary goes on: before spaces and line ends, and between a letter and a mark that never follows one."""
        if any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p in self.ids):
            return "(?s).+"
        joined = {m for p in self.ids for m in re.findall(r"(?<=[^\W\d_])[^\w]", p)}
        marks = "".join(re.escape(c) for c in ".,;:!?)(" if c not in joined)
        return rf"{SPACE}*[^\W\d_]+(?=[{marks}{SPACE}\n]|\Z)|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by plain merging: the best score first, then the leftmost."""
        parts, get, none = list(text), self.scores.get, float("-inf")
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) > none:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], none)
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], none)
        return parts

    def compatible(self, left: str, right: str) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return found

    def tabulated(self, chunk: str) -> list[str]:
        """The pieces of a chunk: the last token of each prefix forwards, then the tokens backwards."""
        last: list[str] = [""] * (len(chunk) + 1)
        ends: list[list[str]] = [[] for _ in chunk]
        for end, piece in self.automaton.iter(chunk):
            ends[end].append(piece)
        for end, char in enumerate(chunk):
            for piece in ends[end] if char in self.scores else [*ends[end], char]:
                before = end + 1 - len(piece)
                if not before or self.compatible(last[before], piece):
                    last[end + 1] = piece
                    break
        found, at = [], len(chunk)
        while at:
            found.append(last[at])
            at -= len(last[at])
        return found[::-1]

    def _decimals(self, chunk: str) -> str:
        ids: list[int] = []
        for piece in self.tabulated(chunk):
            own = self.ids.get(piece)
            ids.extend([own] if own is not None else [self.bytes[b] for b in piece.encode()])
        return ",".join(map(str, ids))

    def encode_decimals(self, text: str) -> str:
        """The ids as decimals joined by commas."""
        return ",".join(map(self.decimals.__getitem__, self.chunks(SPACE + text.replace(" ", SPACE)))) if text else ""

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.encode_decimals(text).split(","))) if text else []

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@functools.cache
def encoder_for(path: str) -> PrefixTableEncoder:
    """One for each worker process, so that tables and caches serve all its tasks."""
    return PrefixTableEncoder(path)


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                decimals = encoder.encode_decimals(text or "")
                ids = list(map(int, decimals.split(","))) if decimals else []
                rows.append((doc_id, len(ids), sha(decimals), sha(encoder.decode(ids) if ids else "")))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_ids(documents: DataFrame, model_path: str | None = None) -> DataFrame:
    """``documents`` with the column ids, array<int>, added or replaced."""
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        for batch in slices(batches):
            ids = [encoder.encode(t or "") for t in batch.column("text").to_pylist()]
            yield batch.append_column("ids", pa.array(ids, pa.list_(pa.int32())))

    rest = documents.drop("ids")
    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def digests(documents: DataFrame, model_path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, the digest of its ids and that of what they decode to."""
    return documents.select("doc_id", "text").mapInArrow(_digests(model_path or default_model()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def sentencepiece_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))

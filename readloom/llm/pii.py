"""Surrogates for personal data and secrets.

Detected: e-mail addresses, telephone numbers, payment card numbers, IP addresses of both versions, US social security
numbers, IBANs, quoted or labelled secrets (keys and hex tokens) and names: after a title, of a listed given name with a
family name, and the parts of either wherever they stand alone in the same text. Each entity is replaced by one of its own
type and form: every digit by a digit, every letter by a letter of its case, script and kind (hex digits stay hex, vowels of
names vowels), separators untouched; card numbers keep their length and check digit, IBANs their country and check digits,
addresses stay valid. Given names keep their gender and family names their script.

A replacement is the next string of a form in a keyed order of them all (the order is a Feistel network on mixed-radix
numbers; the walk goes on until it meets the form's own rule), so equal entities get equal replacements in all documents and
executors, whatever else a document holds, and different ones different: distinctness and coreference hold by construction,
without a table that grows with the corpus. The order is one cycle, so that no entity stands for itself unless its form has
no other string. Strings of over ``SEGMENT`` letters and digits go segment by segment, each in an order keyed by what the
segments before it became, which keeps the whole one-to-one and the time linear. Cased forms of one entity keep their case.
The operator checks the corpus for ``collisions`` and takes another key if it finds any.

Names come from short lists, so each is mapped to the ``RESERVE`` of its gender and script, and those of the reserve to the
list; names outside the lists are permuted letter by letter.

The key is a secret of whoever runs this: the argument, else the session's ``KEY_SETTING``, else random bytes that last as
long as the session. Only with a key of one's own do runs of different sessions agree.

Defined results: null texts stay null, texts without an entity stay as they are; repeated rows get equal texts; tokens of any
length are replaced whole; columns other than text and n_chars pass unchanged, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import math
import re
import secrets
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import slices, table, unused

KEY_SETTING = "readloom.surrogates.key"
ROUNDS = 8
KEYS = 8
SEGMENT = 64
MIN_NAME = 3

#: Given names by gender and script, and titles by gender: fixed values.
GIVEN = {
    ("f", "latin"): "Alice Anna Clara Diana Elena Emma Eva Helen Ines Julia Laura Lucia Maria Marta Nina Olivia Rosa Sara Sofia Vera".split(),
    ("m", "latin"): "Adam Alan Bruno Carl David Erik Felix Georg Hugo Ivan Jakob John Karl Leo Marc Oscar Paul Peter Simon Tomas".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Юлия".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Иван Лев Олег Павел Юрий".split(),
}
#: Names that stand for those above, and the other way round: as many, none of them above.
RESERVE = {
    ("f", "latin"): "Agnes Beate Carmen Dora Edith Flora Greta Hilda Irene Judith Karin Lydia Miriam Nadia Odette Paula Renata Stella Tilda Ursula".split(),
    ("m", "latin"): "Albert Boris Conrad Dieter Edgar Frank Gregor Henrik Igor Jonas Kurt Louis Martin Nils Otto Philip Ralf Stefan Theo Viktor".split(),
    ("f", "cyrillic"): "Алла Галина Жанна Зоя Лидия Марина Надежда Раиса Тамара Яна".split(),
    ("m", "cyrillic"): "Артём Вадим Георгий Егор Захар Игорь Максим Никита Роман Семён".split(),
}
GIVEN = {k: v + RESERVE[k] for k, v in GIVEN.items()}
_LISTED = {name: k for k, v in GIVEN.items() for name in v}  # with gender and script
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Monsieur": "m", "Madame": "f", "Dr": "", "Prof": ""}

_CAPITAL = "(?=[A-ZÀ-ÞΑ-ΩА-ЯЁ])"
_NAME = r"[^\W\d_a-z][^\W\d_]+(?:-[^\W\d_]+)?"
_KINDS = (
    r"(?P<email>(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}(?![\w-]))",
    r"(?P<secret>(?<=[\"'=:])[0-9A-Za-z_-]{20,}(?=[\"'])|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{30,}|sk-[0-9A-Za-z_-]{20,}|xox[abp]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35})\b|(?<![0-9A-Za-z])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}(?![0-9A-Za-z]))",
    r"(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?\b)",
    r"(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{4,39}(?![\w:]))",
    r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![\w.]*\d))",
    r"(?P<card>(?<![\w+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))",
    r"(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))",
    r"(?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![\w-])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![\w-])|(?<![\w.+-])0[0-9]{2,4}[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w-]))",
    rf"(?P<name>\b(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\b\.? {_NAME}(?: {_NAME})?|\b{_CAPITAL}(?:{'|'.join(sorted(_LISTED, key=len, reverse=True))}) {_NAME}\b)",
)
PATTERNS = re.compile("|".join(_KINDS))
_ALONE = {re.match(r"\(\?P<(\w+)>", k)[1]: re.compile(k) for k in _KINDS}
#: A text without one of these has no entity but a name.
_MAYBE = re.compile(rf"[0-9@\"'=]|\b{_CAPITAL}(?:{'|'.join([*TITLES, *_LISTED])})")

_DIGITS = "0123456789"
_SETS = [_DIGITS, "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
_ALPHABETS = {c: s for s in _SETS for c in s}
#: The same for names, vowels apart, so that what comes out can be spoken.
_SPOKEN = {c: s for c, s in _ALPHABETS.items()} | {c: s for vowels, letters in zip(("aeiou", "аеиоуыэюя", "αεηιουω"), _SETS[1:], strict=True) for s in (vowels, "".join(x for x in letters if x not in vowels)) for c in s}


@functools.lru_cache(4096)
def _block(c: str) -> str:
    """The letters that one of another kind is permuted among: those of the same block of 64 that have case, or have none, as it does."""
    kind = lambda x: (x.isalpha() and x.lower() == x) and (1 if x.upper() == x else 2 if len(x.upper()) == 1 and x.upper().lower() == x else 0)
    return "".join(x for x in map(chr, range(ord(c) & ~63, (ord(c) | 63) + 1)) if x not in _ALPHABETS and kind(x) == kind(c)) if kind(c) else ""


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def ip6_ok(text: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(text)) and not text.strip(":").isalpha() and any(c in _DIGITS for c in text)
    except ValueError:
        return False


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Surrogates:
    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, i: int, value: int, size: int) -> int:
        found = hmac.digest(self.key, f"{tweak}|{i}|{value}".encode(), hashlib.sha256)
        more = -(-(size.bit_length() + 64) // 256)
        return int.from_bytes(b"".join([found, *(hmac.digest(self.key, found + bytes([k]), hashlib.sha256) for k in range(1, more))]), "big") % size

    def permute(self, value: int, size: int, tweak: str) -> int:
        """A keyed permutation of range(size)."""
        if size < 2:
            return value
        a = max(2, math.isqrt(size))
        b = -(-size // a)
        while True:  # the network permutes range(a b); the walk stays in range(size)
            left, right = divmod(value, b)
            for i in range(0, ROUNDS, 2):
                left = (left + self._round(tweak, i, right, a)) % a
                right = (right + self._round(tweak, i + 1, left, b)) % b
            value = left * b + right
            if value < size:
                return value

    def unpermute(self, value: int, size: int, tweak: str) -> int:
        """The inverse of ``permute``."""
        if size < 2:
            return value
        a = max(2, math.isqrt(size))
        b = -(-size // a)
        while True:
            left, right = divmod(value, b)
            for i in range(ROUNDS - 2, -1, -2):
                right = (right - self._round(tweak, i + 1, left, b)) % b
                left = (left - self._round(tweak, i, right, a)) % a
            value = left * b + right
            if value < size:
                return value

    def others(self, value: int, size: int, tweak: str) -> Iterator[int]:
        """All other numbers of range(size), in the order of one keyed cycle from ``value`` on."""
        at = self.permute(value, size, tweak)
        for k in range(1, size):
            yield self.unpermute((at + k) % size, size, tweak)

    def permute_string(self, text: str, tweak: str, ok: Callable[[str], bool] | None = None, hexed: bool = False, fixed: int = 0, sets: dict[str, str] = _ALPHABETS) -> str:
        """``text`` with its letters and digits permuted in their kinds, the first ``fixed`` as they are; walked on until it is as ``ok`` as before, so that either class keeps to itself."""
        lower = text.lower() if len(text.lower()) == len(text) else text
        kinds = ["0123456789abcdef" if hexed and c in "0123456789abcdef" else sets.get(c) or _block(c) for c in lower]
        kinds = ["" if i < fixed else s for i, s in enumerate(kinds)]
        if sum(map(bool, kinds)) <= SEGMENT:
            return self._permuted(text, lower, kinds, tweak, ok)
        out, before = [], hashlib.sha256()
        for at in range(0, len(text), SEGMENT):  # such a form has no rule of its own
            cut = slice(at, at + SEGMENT)
            out.append(self._permuted(text[cut], lower[cut], kinds[cut], f"{tweak}|{len(text)}|{before.hexdigest()}", None))
            before.update(out[-1].lower().encode("utf-8", "surrogatepass"))
        return "".join(out)

    def _permuted(self, text: str, lower: str, kinds: list[str], tweak: str, ok: Callable[[str], bool] | None) -> str:
        valid = ok and ok(text)
        size = math.prod(len(s) for s in kinds if s)
        shape = tweak + "|" + "".join(s[0] if s else c for s, c in zip(kinds, lower, strict=True))
        value = 0
        for c, s in zip(lower, kinds, strict=True):
            if s:
                value = value * len(s) + s.index(c)
        for rest in self.others(value, size, shape):  # a form with no other string of its class keeps its own
            out = []
            for c, s, t in zip(reversed(lower), reversed(kinds), reversed(text), strict=True):
                if s:
                    rest, at = divmod(rest, len(s))
                    c = s[at]
                out.append(c.upper() if t != t.lower() and len(c.upper()) == 1 else c if s else t)
            found = "".join(reversed(out))
            if not ok or ok(found) == valid:
                return found
        return text

    def _name(self, text: str) -> str:
        first, *names = re.split(r"(?<=\w)\.? ", text, maxsplit=1)
        names = names[0].split(" ") if first in TITLES and names else text.split(" ")
        lead = text[: len(text) - len(" ".join(names))]
        out = []
        for name in names:
            if name in _LISTED:  # wherever it stands and whatever the title, so that one name has one surrogate
                listed = GIVEN[_LISTED[name]]
                half, at = len(listed) // 2, listed.index(name)
                tweak = f"given|{_LISTED[name]}"
                name = listed[half + self.permute(at, half, tweak)] if at < half else listed[self.unpermute(at - half, half, tweak)]
            else:
                name = self.permute_string(name, "family", lambda s: s in _LISTED, sets=_SPOKEN)
            out.append(name)
        return lead + " ".join(out)

    def one(self, kind: str, text: str) -> str:
        if kind == "email":
            at = text.rindex("@")
            host, dot, top = text[at + 1 :].rpartition(".")
            return self.permute_string(text[:at], "mailbox") + "@" + self.permute_string(host, "host") + dot + top
        if kind == "card":
            return self.permute_string(text, "card", lambda s: luhn(re.sub(r"\D", "", s)), fixed=1)
        if kind == "iban":
            return self.permute_string(text, "iban", iban_ok, fixed=2)
        if kind == "ip":
            n = 0
            for part in text.split("."):
                n = n * 256 + int(part)
            n = next(self.others(n, 1 << 32, "ip"))
            return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
        if kind == "ip6":
            return self.permute_string(text, "ip6", ip6_ok, hexed=True)
        if kind == "phone":
            plus = re.match(r"\+\d+|", text).end()
            plus = plus if plus <= 4 else 2  # a number without separators is not all country code
            return self.permute_string(text, "phone", fixed=plus)
        if kind == "ssn":
            return self.permute_string(text, "ssn", lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000")
        if kind == "secret":
            prefix = re.match(r"AKIA|gh[pousr]_|sk-|xox[abp]-|AIza|", text).end()
            return self.permute_string(text, "secret", hexed=bool(re.fullmatch("[0-9a-f]+", text)), fixed=prefix)
        return self._name(text)


def _shorter(kind: str, found: str) -> int | None:
    """Where a shorter entity of ``kind`` ends that starts as ``found`` does; the longest one's end."""
    if kind == "iban":
        return next((n for n in range(len(found) - 1, 0, -1) if found[n] == " " and iban_ok(found[:n])), None)
    ends = [n for n in range(len(found) - 1, 0, -1) if found[n] in " -" and found[n - 1].isdigit() and 13 <= sum(map(str.isdigit, found[:n]))]
    return next((n for n in ends if luhn(re.sub(r"\D", "", found[:n]))), next((n for n in ends if n in (15, 16) and found[:n].isdigit()), None))


def _next(text: str, at: int) -> tuple[str, int, int] | None:
    """The first entity from ``at`` on. What fails its check is tried with shorter ends and as the kinds after it, then left by one character."""
    while m := PATTERNS.search(text, at):
        kind, a, b = m.lastgroup, m.start(), m.end()
        digits = re.sub(r"\D", "", m[0])
        if kind == "card":  # bare numbers of a card's length count as such
            good = luhn(digits) or len(digits) in (15, 16) and digits == m[0]
        else:
            good = {"iban": iban_ok, "ip6": ip6_ok}.get(kind, bool)(m[0])
        if good:
            return kind, a, b
        if kind in ("card", "iban") and (end := _shorter(kind, m[0])):
            return kind, a, a + end
        for other in ("ssn", "phone") if kind == "card" else ():
            if m := _ALONE[other].match(text, a):
                return other, a, m.end()
        at = a + 1
    return None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the entities of a text, in order."""
    if not text or not _MAYBE.search(text):
        return []
    out, at = [], 0
    while found := _next(text, at):
        out.append(found)
        at = found[2]
    names = {w for k, a, b in out if k == "name" for w in re.split(r"\.? ", text[a:b]) if w not in TITLES and len(w) >= MIN_NAME}
    if names:  # where they stand alone, outside of what is found already
        gaps = [(b, a) for (_, _, b), (_, a, _) in zip([("", 0, 0), *out], [*out, ("", len(text), len(text))], strict=True)]
        words = re.compile(_NAME)
        out += [("name", m.start(), m.end()) for a, b in gaps for m in words.finditer(text, a, b) if m[0] in names and not text[m.start() - 1 : m.start()].isalnum() and not text[m.end() : m.end() + 1].isalnum()]
        out.sort(key=lambda x: x[1])
    return out


def replace(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[str, int, int]]]:
    spans = find(text)
    if not spans:
        return text, []
    parts, at = [], 0
    for kind, a, b in spans:
        parts += [text[at:a], surrogates.one(kind, text[a:b])]
        at = b
    return "".join([*parts, text[at:]]), spans


def _replaced(key: bytes, kinds: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            done = [replace(t, surrogates) if t else (t, []) for t in batch.column(at).to_pylist()]
            field = batch.schema.field(at)
            out = batch.set_column(at, field, pa.array([t for t, _ in done], field.type))
            yield out.append_column(kinds, pa.array([[k for k, _, _ in s] for _, s in done], pa.list_(pa.string())))

    return run


def session_key(spark: SparkSession) -> bytes:
    """The session's key, made at random and kept in its settings where there is none."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING).encode()


def with_surrogates(documents: DataFrame, key: bytes | None = None, kinds: str = "kinds") -> DataFrame:
    """``documents`` with entities of text replaced, and the new column ``kinds``: their types in order."""
    from pyspark.sql import types as T

    if unused(documents, kinds) != kinds:
        raise ValueError(f"the documents have a column {kinds!r}")
    key = collision_free(documents, key or session_key(documents.sparkSession))
    schema = T.StructType([*documents.schema.fields, T.StructField(kinds, T.ArrayType(T.StringType()))])
    found = documents.mapInArrow(_replaced(key, kinds), schema)
    if "n_chars" in documents.columns:
        found = found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long")))
    return found


def apply(documents: DataFrame, key: bytes | None = None) -> DataFrame:
    return with_surrogates(documents, key, unused(documents, "kinds")).select(*documents.columns)


def entities(documents: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, kind, entity, surrogate) of each occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = find(text)
                rows += [(doc_id, k, text[a:b], surrogates.one(k, text[a:b])) for k, a, b in spans]
            types = (pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 4, types, strict=True)], ["doc_id", "kind", "entity", "surrogate"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, kind string, entity string, surrogate string")


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates of ``entities`` that stand for more than one entity of their kind."""
    pairs = found.select("kind", "entity", "surrogate").distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def collision_free(documents: DataFrame, key: bytes) -> bytes:
    """``key``, or the first of those made from it under which no two entities of the documents have one surrogate."""
    ids = documents.select(F.lit(None).cast("long").alias("doc_id"), "text")
    for k in range(KEYS):
        own = key if not k else key + b"|%d" % k
        if not collisions(entities(ids, own)).take(1):
            return own
    raise ValueError(f"{KEYS} keys all give two entities one surrogate")


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), kinds="kinds")
    return found.select("doc_id", "text", F.size("kinds").cast("long").alias("n_entities"), F.concat_ws(",", "kinds").alias("kinds"))
